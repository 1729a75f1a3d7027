import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.operators.ordering import prefix_sum, previous_value


def test_previous_value_crosses_slices(spark):
    random.seed(3)
    keys = random.sample(range(10_000), 300)
    rows = [(k, f"v{k}") for k in keys]
    df = spark.createDataFrame(rows, "k long, v string")
    found = dict(previous_value(df, "v", ["k"], "prev", slices=7).select("k", "prev").collect())
    ordered = sorted(keys)
    assert found == {k: (f"v{p}" if p is not None else None) for p, k in zip([None, *ordered], ordered)}


def test_previous_value_of_one_row(spark):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert previous_value(df, "v", ["k"], "prev").head().prev is None


def test_prefix_sum_by_group(spark):
    random.seed(4)
    rows = [(random.choice("aab"), i, random.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    out = prefix_sum(df, F.col("n"), [F.col("k").desc()], "before", ["g"], slices=9)
    found = {r.k: r.before for r in out.collect()}
    seen = defaultdict(int)
    expected = {}
    for g, k, n in sorted(rows, key=lambda r: -r[1]):
        expected[k] = seen[g]
        seen[g] += n
    assert found == expected


def test_prefix_sum_of_ones_is_the_position(spark):
    df = spark.range(100).withColumn("key", F.xxhash64("id"))
    out = prefix_sum(df, F.lit(1), [F.col("key")], "pos", slices=6)
    rows = out.orderBy("key").collect()
    assert [r.pos for r in rows] == list(range(100))
