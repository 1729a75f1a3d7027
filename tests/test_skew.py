import pytest
from pyspark.sql import functions as F

from corpusloom.operators import skew
from corpusloom.operators.skew import hot_rows, lookup_join, salted_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_plain_join(spark, how):
    # one key holds a third of the rows
    large = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k")
    )
    table = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    sizes = large.groupBy("k").agg(F.count("*").alias("cn"))
    hot = hot_rows(sizes.withColumn("cn", F.col("cn")), "cn", 3000 * 300)
    assert [r.k for r in hot.collect()] == [0]
    plain = large.join(table, "k", how).select("id", "k", "v")
    split = lookup_join(large, table, ["k"], hot, how, broadcast_rows=0).select("id", "k", "v")
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_salted_join_equals_plain_join(spark):
    large = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k")
    )
    table = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = spark.createDataFrame([(0,), (7,)], "k long")
    salted = salted_join(large, table, ["k"], hot, salts=5).select("id", "k", "v")
    plain = large.join(table, "k").select("id", "k", "v")
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_bounded(spark):
    counts = spark.range(5000).select("id", F.lit(1000).alias("cn"))
    assert hot_rows(counts, "cn", 5_000_000).count() == 0


def test_most_frequent_words_are_broadcast(spark, monkeypatch):
    """Of vectors too many to broadcast, those of as many frequent words as fit, hot or not."""
    from corpusloom.operators import lookup

    words = [(f"w{i}", 2 if i < 1200 else 1) for i in range(2200)]
    counts = spark.createDataFrame(words, "word string, cn long")
    assert skew.most_frequent(counts, "cn", 1199).count() == 0
    assert skew.most_frequent(counts, "cn", 2199).count() == 1200
    assert skew.most_frequent(counts, "cn", 2200).count() == 2200
    assert skew.most_frequent(counts.limit(0), "cn", 5).count() == 0
    hot = []
    join = lookup.lookup_join
    monkeypatch.setattr(
        lookup, "lookup_join", lambda large, table, on, keys, *a, **k: hot.append(keys.count()) or join(large, table, on, keys, *a, **k)
    )
    vectors = counts.selectExpr("word", "array(double(cn), 1d) AS vector")
    tokens = counts.selectExpr("pmod(hash(word), 7) AS doc_id", "explode(array_repeat(word, int(cn))) AS word")
    small = lookup.mean_vectors(tokens, counts, vectors, broadcast_values=3000)
    assert hot == [1200]
    assert sorted(small.collect()) == sorted(lookup.mean_vectors(tokens, counts, vectors).collect())
