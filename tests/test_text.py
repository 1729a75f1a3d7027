import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.tokens import phrase_token_rows, space_token_rows, truncate_tokens
from corpusloom.operators.stopwords import remove_by_join, remove_ignoring_case, without_words
from corpusloom.plans.build_corpus import build_corpus
from corpusloom.sources.text import document_lines


@pytest.fixture
def apply(spark):
    def run(function, *values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def test_normalize_each_step(apply):
    cases = {
        "ABC É": "abc é",
        "it’s": "it ' s",
        "5′": "  ' ",
        "a''b": "a b",
        "a'b": "a ' b",
        "“x”": ' " x " ',
        'say "x"': 'say  " x " ',
        "end.": "end . ",
        "a<br />b": "a b",
        "a, b": "a , b",
        "a,b": "a,b",
        "(x)": " ( x ) ",
        "a!b?": "a ! b ? ",
        "a;b:c": "a b c",
        "a-b": "a - b",
        "a=b*c|d«e»": "a b c d e»",
        "x12y": "x  y",
        "": "",
        "’’": " ",  # turned straight first, then two in a row are a blank
    }
    assert apply(T.normalize_text, *cases) == list(cases.values())


def test_markup_each_step(apply):
    cases = {
        "Plain": " plain",
        "a &amp; b": " a & b",
        "&lt;i&gt;x&lt;/i&gt;": " x",
        "a<ref name=x>note</ref>b": " ab",
        "<b>x</b>": " x",
        "[http://a.b text]": "  text",
        "[https://a.b text]": " https://a.b text",
        "x|thumb|left|right|20px|y": " x|y",
        "[[image:a.png|cap]]": " cap",
        "[[category:dogs|d]]": " dogs",
        "[[category:dogs]]": " dogs",
        "[[de:hund]]": " ",
        "[[target|shown]]": " shown",
        "{{icon}}x{y}": " x",
        "{{a {{b}} c}}": "  c}}",
        "a&nbsp;b": " a b",
        "[[IMAGE:A.PNG|Cap]]": " cap",
    }
    assert apply(T.clean_markup, *cases) == list(cases.values())
    assert apply(lambda c: T.clean_markup(c, decode_entities=False), "&lt;b&gt;") == ["  b "]


def test_markup_equals_plain_patterns(apply):
    rng = random.Random(11)
    pieces = ["<", ">", "{", "}", "{{", "}}", "[[", "]]", "[", "]", "|", ":", ";", "&", "a", "b ", "x\n",
              "[[category:", "[[image:", "[[de:", "<ref", "</ref>", "[http:", "|thumb", "|12px"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(3000)]

    def plain(text):
        for pattern, replacement in T.MARKUP_REWRITES:
            text = re.sub(pattern, replacement.replace("$1", r"\1"), text)
        return " " + text

    found = apply(lambda c: T.clean_markup(c, decode_entities=False), *texts)
    assert found == [plain(t) for t in texts]


def test_unclosed_markup_is_read_once(apply):
    n = 100_000
    for opening in ("<", "{", "{{ ", "[[", "[[a:", "& "):
        assert apply(T.clean_markup, opening * n)[0].count("a") == (n if "a" in opening else 0)
    long = "[[category:" + "x" * n
    assert apply(T.clean_markup, long) == [" category:" + "x" * n]


def test_redirects_are_dropped(spark, corpus_of):
    pages = corpus_of("one two three", "x #REDIRECT [[y]]", "a", "line one\nsingle\n\nb c")
    rows = build_corpus({}, {"wiki": pages}).select("doc_id", "line_no", "text").collect()
    assert sorted(map(tuple, rows)) == [
        (0, 0, " one two three"),
        (3, 0, " line one"),
        (3, 3, "b c"),
    ]


def test_space_tokens(spark, corpus_of):
    texts = ["a  b", " a", "a ", "", " ", "x\ny  z\n"]
    rows = space_token_rows(corpus_of(*texts)).orderBy("doc_id", "line_no", "pos").collect()
    expected = [
        (d, n, p, w)
        for d, text in enumerate(texts)
        for n, line in enumerate(text.split("\n"))
        for p, w in enumerate(line.split(" "))
    ]
    assert list(map(tuple, rows)) == expected


def test_document_tokens_equal_line_tokens(spark, corpus_of):
    docs = corpus_of("a  b\nc\n\nd ", "", "\n")
    whole = docs.select(F.explode(T.document_space_tokens(F.col("text"))).alias("word"))
    lines = space_token_rows(docs).select("word")
    assert sorted(whole.collect()) == sorted(lines.collect())


def test_phrase_tokens(spark, corpus_of):
    rows = phrase_token_rows(
        corpus_of("a\tb  c\r\n\n d </s> e </s>f x</s>", "", "</s>", "\nz")
    ).collect()
    assert sorted(map(tuple, rows)) == [
        (0, 0, 0, "a"),
        (0, 0, 1, "b"),
        (0, 0, 2, "c"),
        (0, 2, 0, "d"),
        (0, 3, 0, "e"),
        (0, 3, 1, "</s>f"),
        (0, 3, 2, "x</s>"),
        (3, 1, 0, "z"),
    ]


def test_flat_tokens(apply):
    assert apply(T.flat_tokens, "a\tb\n\nc </s> d\r", "") == [["a", "b", "c", "d"], []]


def test_alphabetic_tokens_follow_unicode(apply):
    texts = ["Ab1c_d É-ß ½x ²", "日本 12 q", "", "__a"]
    expected = [re.findall(r"(?:(?!\d)\w)+", t.lower()) for t in texts]
    assert apply(T.alphabetic_tokens, *texts) == expected


def test_article_tokens(apply):
    text = "a ab _hidden abcdefghijklmno abcdefghijklmnop x1yz"
    assert apply(T.article_tokens, text) == [["ab", "abcdefghijklmno", "yz"]]


def test_several_fields(apply):
    lines = ["a b", "a", "  a  ", "", "a\tb", " a b "]
    assert apply(T.has_several_fields, *lines) == [len(x.split()) > 1 for x in lines]


def test_title_key(apply):
    assert apply(T.title_key, "Vereinigtes Königreich\n", "Wien") == ["Vereinigtes_Königreich", "Wien"]


def test_truncate_bytes(apply):
    values = ["abc", "abcdef", "aé", "abcé"]
    assert apply(lambda c: T.truncate_bytes(c, 4), *values) == ["abc", "abcd", "aé", "abc�"]


def test_truncated_tokens(corpus_of):
    long = "x" * 70
    rows = truncate_tokens(corpus_of(f"{long} short\n{long[:58]}y")).collect()
    tokens = [r.word for r in phrase_token_rows(truncate_tokens(corpus_of(rows[0].text))).collect()]
    assert tokens == ["x" * 58, "short", "x" * 58]


def test_pair_key_has_no_key_without_previous(spark):
    df = spark.createDataFrame([(None, "a"), ("b", "a")], "p string, w string")
    keys = df.select(T.pair_key(F.col("p"), F.col("w")).alias("k")).collect()
    assert [r.k for r in keys] == [None, "b_a"]


def test_stop_word_operators(spark):
    tokens = ["The", "the", "", "x", "x", "And"]
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    stop = ["the", "and", ""]
    assert remove_ignoring_case(df, "t", "o", stop).head().o == ["x", "x"]
    assert df.select(without_words(F.col("t"), stop).alias("o")).head().o == ["The", "x", "x", "And"]
    assert df.select(without_words(F.col("t"), []).alias("o")).head().o == tokens
    words = spark.createDataFrame([(t,) for t in tokens], "word string")
    table = spark.createDataFrame([(t,) for t in stop], "word string")
    kept = sorted(r.word for r in remove_by_join(words, table).collect())
    assert kept == ["And", "The", "x", "x"]


def test_lines_keep_their_numbers(corpus_of):
    rows = document_lines(corpus_of("a\n\nb", "")).orderBy("doc_id", "line_no").collect()
    assert list(map(tuple, rows)) == [(0, 0, "a"), (0, 1, ""), (0, 2, "b"), (1, 0, "")]
