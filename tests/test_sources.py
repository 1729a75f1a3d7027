import bz2
import gzip

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.counts import by_count, top_words, vocabulary_metrics, word_counts
from corpusloom.operators.subsample import FULL_KEEP, subsample, uniform
from corpusloom.operators.tokens import words
from corpusloom.plans.corpus_stats import corpus_stats
from corpusloom.sources import pairs, stopwords, text, wiki


def test_lines_are_numbered_over_many_splits(spark, tmp_path, monkeypatch):
    lines = {f"part-{n}.txt": [f"{n}:{i} " + "x" * (i % 50) for i in range(400 + n)] for n in range(3)}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = text.read_lines(spark, str(tmp_path)).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    flat = [(name, i, line) for name in sorted(lines) for i, line in enumerate(lines[name])]
    assert [r.doc_id for r in rows] == list(range(len(flat)))
    assert [(r.src.rsplit("/", 1)[1], r.line_no, r.text) for r in rows] == flat


def test_lines_do_not_depend_on_the_splits_of_a_later_read(spark, tmp_path):
    lines = {f"part-{n}.txt": [f"{n}:{i}" for i in range(20_000)] for n in range(2)}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    # stands for the number of cores that are alive
    cores, cost = "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"
    spark.conf.set(cost, "1000")
    try:
        spark.conf.set(cores, "8")
        numbered = text.read_lines(spark, str(tmp_path))
        spark.conf.set(cores, "6")
        rows = numbered.orderBy("doc_id").collect()
    finally:
        spark.conf.unset(cores)
        spark.conf.unset(cost)
    flat = [(name, i, line) for name in sorted(lines) for i, line in enumerate(lines[name])]
    assert [r.doc_id for r in rows] == list(range(len(flat)))
    assert [(r.src.rsplit("/", 1)[1], r.line_no, r.text) for r in rows] == flat


@pytest.mark.parametrize("suffix,opener", [(".gz", gzip.open), (".bz2", bz2.open), ("", open)])
def test_codec_follows_the_extension(spark, tmp_path, suffix, opener):
    with opener(tmp_path / f"a.txt{suffix}", "wt") as f:
        f.write("one\n\ntwo é\n")
    rows = text.read_lines(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["one", "", "two é"]


def test_written_corpus_keeps_its_order(spark, tmp_path, corpus_of):
    lines = text.document_lines(corpus_of(*(f"line {i}\nnext {i}" for i in range(50))))
    text.write_lines(lines, str(tmp_path / "out"), ["doc_id", "line_no"])
    back = text.read_lines(spark, str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [r.text for r in back] == [x for i in range(50) for x in (f"line {i}", f"next {i}")]
    # further sources come after it, whatever the names of their files
    own = [x for i in range(50) for x in (f"line {i}", f"next {i}")]
    for batch in (0, 1, 10):
        more = lines.withColumn("text", F.concat(F.lit(f"{batch} "), "text"))
        text.write_lines(more, str(tmp_path / "out"), ["doc_id", "line_no"], batch, files=3)
    back = text.read_lines(spark, str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [r.text for r in back] == own + [f"{b} {x}" for b in (0, 1, 10) for x in own]


def test_parts_are_ordered_by_number(spark, tmp_path):
    for name in ("part-99999-a", "part-100000-a", "part-10000-a"):
        (tmp_path / f"{name}.txt").write_text(name + "\n")
    back = text.read_lines(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.text for r in back] == ["part-10000-a", "part-99999-a", "part-100000-a"]


def test_token_and_phrase_sinks(spark, tmp_path):
    tokens = spark.createDataFrame([(0, ["a", "b"]), (1, [])], "doc_id long, tokens array<string>")
    text.write_tokens(tokens, "tokens", str(tmp_path / "t"), ["doc_id"])
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a b", ""]
    phrases = spark.createDataFrame([(0, 0, "new_york is"), (0, 1, "")], "doc_id long, line_no long, text string")
    text.write_phrase_lines(phrases, str(tmp_path / "p"), ["doc_id", "line_no"])
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == [" new_york is", ""]


def test_pair_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("China,Peking\ntürkei,ankara\nÖsterreich,Wien")
    rows = pairs.read_pairs(spark, str(tmp_path / "p.csv")).orderBy("pair_id").collect()
    assert [(r.word1, r.word2) for r in rows] == [("china", "peking"), ("türkei", "ankara"), ("österreich", "wien")]
    (tmp_path / "r.txt").write_text("word1\tword2\tscore\nLiebe\tSex\t8.46\nTiger\tTiger\t10.00\nTiger\tKatze\t7")
    rated = pairs.read_rated_pairs(spark, str(tmp_path / "r.txt"), "ws").orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in rated] == [("liebe", "sex", 8.46), ("tiger", "tiger", 10.0), ("tiger", "katze", 7.0)]
    assert {r.dataset for r in rated} == {"ws"}


def test_bad_rating_is_an_error(spark, tmp_path):
    (tmp_path / "r.txt").write_text("word1\tword2\tscore\na\tb\thigh\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        pairs.read_rated_pairs(spark, str(tmp_path / "r.txt"), "x").collect()


def test_stop_word_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("also\n\nthe")
    table = stopwords.stopword_table(
        spark, stopwords.language_stopwords("en"), stopwords.read_stopwords(spark, str(tmp_path / "s.txt"))
    )
    found = stopwords.stopword_list(table)
    assert len(found) == len(set(found)) and {"", "also", "the", "i"} <= set(found)
    assert stopwords.language_stopwords("de") == stopwords.language_stopwords("german")
    for code in stopwords.LANGUAGE_NAMES:
        assert stopwords.language_stopwords(code)
    assert len(stopwords.NEWS_STOPWORDS) == 36
    assert len(stopwords.ENCYCLOPEDIA_STOPWORDS_DE) == 10
    assert stopwords.stopword_list(table, limit=5) is None


def test_titles_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Wien\nVereinigtes Königreich")
    assert {"Wien", "Vereinigtes Königreich"} <= set(text.EXAMPLE_TITLES_DE)
    assert [r.title for r in text.read_titles(spark, str(tmp_path / "t.txt")).collect()] == ["Wien", "Vereinigtes Königreich"]


DUMP = """<mediawiki>
<page><title>1999</title><ns>0</ns><id>7</id><revision><id>70</id>
<text bytes="9" xml:space="preserve">Some [[link|shown]] &amp;lt;ref&amp;gt;
'''bold''' &lt;b&gt;tag&lt;/b&gt;</text></revision></page>
<page><title>Talk:x</title><ns>1</ns><id>8</id><revision><text>chat</text></revision></page>
<page><title>R</title><ns>0</ns><id>9</id><revision><text>#REDIRECT [[x]]</text></revision></page>
</mediawiki>"""


BODY = " some shown  ref \n'''bold''' tag"


@pytest.mark.parametrize("name,opener", [("d.xml", open), ("d.xml.bz2", bz2.open)])
def test_dump(spark, tmp_path, name, opener):
    with opener(tmp_path / name, "wt") as f:
        f.write(DUMP)
    pages = wiki.read_pages(spark, str(tmp_path / name))
    rows = pages.orderBy("doc_id").collect()
    assert [(r.doc_id, r.ns, r.title) for r in rows] == [(7, 0, "1999"), (8, 1, "Talk:x"), (9, 0, "R")]
    bodies = {r.doc_id: r.text for r in wiki.visible_bodies(pages).collect()}
    assert set(bodies) == {7, 8}
    assert bodies[7] == BODY
    tokens = wiki.article_token_rows(pages, min_tokens=1).orderBy("doc_id").collect()
    assert [r.doc_id for r in tokens] == [7, 9]


def test_counts(spark, corpus_of):
    docs = corpus_of("a a b\nb a ", "c  b")
    vocab = word_counts(words(docs), 2)
    assert sorted(map(tuple, vocab.collect())) == [("", 2), ("a", 3), ("b", 3)]
    assert tuple(vocabulary_metrics(vocab).head()) == (3, 8)
    assert tuple(vocabulary_metrics(vocab.where("cn > 99")).head()) == (0, 0)
    assert [r.word for r in top_words(vocab, 2).collect()] == ["a", "b"]
    assert [r.word for r in by_count(vocab).collect()] == ["a", "b", ""]


def test_corpus_stats(spark, corpus_of):
    docs = corpus_of("The the cat", "cat the  dog")
    metrics, top = corpus_stats(docs, ["THE", ""], min_count=1, top=1)
    assert dict(metrics.collect()) == {"vocab_size": 2.0, "words_in_corpus": 3.0}
    assert [tuple(r) for r in top.collect()] == [("cat", 2)]


@pytest.mark.parametrize("portable", [True, False])
def test_subsample_rate(spark, portable):
    tokens = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.lit(0).cast("long").alias("pos"),
        F.when(F.col("id") < 16_000, "often").otherwise(F.concat(F.lit("w"), "id")).alias("word"),
    )
    counts = tokens.groupBy("word").agg(F.count("*").alias("cn"))
    rate = 0.008
    kept = subsample(tokens, counts, 20_000, rate, portable=portable).groupBy().agg(
        F.count_if(F.col("word") == "often").alias("often"), F.count_if(F.col("word") != "often").alias("rare")
    ).head()
    ratio = rate / 0.8
    assert abs(kept.often / 16_000 - (ratio**0.5 + ratio)) < 0.01
    assert kept.rare == 4_000
    assert abs(FULL_KEEP**0.5 + FULL_KEEP - 1) < 1e-12


def test_uniform_is_in_range(spark):
    for portable in (True, False):
        row = spark.range(5000).select(uniform(1, "id", portable=portable).alias("u")).agg(
            F.min("u"), F.max("u"), F.avg("u")
        ).head()
        assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.02


def test_a_given_number_of_files_grows_with_the_text(spark, tmp_path, monkeypatch):
    """Files of a bounded size: a number that is asked for is the least one."""
    monkeypatch.setattr(text, "FILE_BYTES", 50)
    lines = spark.createDataFrame([(i, 0, f"line {i:03}") for i in range(60)], "doc_id long, line_no long, text string")
    text.write_lines(lines, str(tmp_path / "out"), ["doc_id", "line_no"], 0, files=2)
    assert len(list((tmp_path / "out").glob("*/part-*.txt"))) > 4
    back = text.read_lines(spark, str(tmp_path / "out")).orderBy("doc_id").collect()
    assert [r.text for r in back] == [f"line {i:03}" for i in range(60)]
