"""Sub-corpora: documents that hold given words, or have given titles."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.skew import hot_rows, lookup_join, most_frequent, salted_join
from corpusloom.scratch import materialize

# Pair lists up to this length are tested inside the row; longer ones are joined.
LITERAL_PAIRS = 1_000
# Words of a longer list that are looked for in one scan of the texts, if they may lie across tokens or are long.
SCAN_WORDS = 100_000
# Words up to this length are looked for in the different tokens, by their first characters.
WORD_LENGTH = 64
HEAD_LENGTH = 6
# Characters of a token that one row is searched for starts of words.
STRIDE = 256
# Tokens that hold both words of a pair, as many are broadcast to find documents by them first.
SETTLING_TOKENS = 200_000
# Wanted words that are broadcast, at most this many bytes of them.
WANTED_BYTES = 8_000_000
# Pairs of one word that are kept together in a row.
TOGETHER = 10_000


def _part(pairs: DataFrame) -> Column:
    """A number that cuts the pairs into parts of about TOGETHER rows."""
    return F.pmod(F.xxhash64("word1", "word2"), F.lit(pairs.count() // TOGETHER + 1))


def pair_list(pairs: DataFrame) -> list[tuple[str, str]] | None:
    """Distinct pairs as a list, or None if there are more than LITERAL_PAIRS."""
    rows = pairs.select("word1", "word2").distinct().limit(LITERAL_PAIRS + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= LITERAL_PAIRS else None


def _any_pair(pairs: list[tuple[str, str]], holds) -> Column:
    if not pairs:
        return F.lit(False)
    literal = F.array(
        *(F.struct(F.lit(a).alias("word1"), F.lit(b).alias("word2")) for a, b in pairs)
    )
    return F.exists(literal, lambda p: holds(p["word1"]) & holds(p["word2"]))


def with_pair_tokens(
    docs: DataFrame, pairs: DataFrame, tokens: str = "tokens", key: str = "doc_id"
) -> DataFrame:
    """Documents whose token array holds both words of any pair."""
    short = pair_list(pairs)
    if short is None:
        return docs.join(_ids_of_pairs(_found_tokens(docs, pairs, tokens, key), pairs, key), key, "left_semi")
    wanted = sorted({word for pair in short for word in pair})
    literal = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    found = F.array(F.array_intersect(tokens, literal))
    # the inner lambda binds the words found, which are computed once per row
    return docs.where(
        F.exists(found, lambda f: _any_pair(short, lambda word: F.array_contains(f, word)))
    )


def _wanted(pairs: DataFrame) -> DataFrame:
    """Distinct words of either side of the pairs."""
    both = pairs.select(F.explode(F.array("word1", "word2")).alias("word"))
    return materialize(both.where(F.col("word").isNotNull()).distinct(), "wanted-words")


def _found_tokens(docs: DataFrame, pairs: DataFrame, tokens: str, key: str) -> DataFrame:
    """Wanted words ``(key, word)`` that are tokens of a document; no tokens travel with them."""
    wanted = _wanted(pairs)
    rows = docs.select(key, F.explode(F.array_distinct(tokens)).alias("word"))
    size = wanted.agg(F.sum(F.octet_length("word") + 16)).head()[0] or 0
    if size <= WANTED_BYTES:
        return rows.join(F.broadcast(wanted), "word")
    counts = materialize(rows.groupBy("word").agg(F.count("*").alias("cn")), "word-documents")
    total = counts.agg(F.sum("cn")).head()[0] or 0
    return lookup_join(rows, wanted, ["word"], hot_rows(counts, "cn", total), broadcast_rows=0)


def _text_tokens(docs: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """Different tokens ``(key, token)`` of every text that are not shorter than the shortest word."""
    tokens = F.array_distinct(T.document_space_tokens(F.col(text)))
    return docs.select(key, F.explode(F.filter(tokens, lambda t: F.length(t) >= least)).alias("token"))


def _words_in_tokens(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs ``(token_id, id)`` of a token ``(token_id, token)`` and a wanted word ``(id, word)`` inside it.

    Where a token goes on like the head of a word, the lengths of the words of this head are cut out,
    and an equi-join answers.  So rows follow the characters of the different tokens, however many words are wanted.
    """
    head = F.left("word", F.lit(HEAD_LENGTH))
    heads = materialize(
        wanted.groupBy(head.alias("head")).agg(F.collect_set(F.length("word")).alias("lengths")), "word-heads"
    )
    sizes = [r.n for r in heads.select(F.length("head").alias("n")).distinct().collect()]
    longest = wanted.agg(F.max(F.length("word"))).head()[0] or 0
    if not sizes:
        return tokens.select("token_id", F.col("token_id").alias("id")).limit(0)
    last = F.floor((F.length("token") - 1) / STRIDE).cast("int")
    cut = F.substring("token", F.col("nth") * STRIDE + 1, F.lit(STRIDE + longest - 1))
    pieces = tokens.select("token_id", "token", F.explode(F.sequence(F.lit(0), last)).alias("nth")).select(
        "token_id", cut.alias("piece")
    )
    # starts at which no head fits are left out
    starts = F.least(F.lit(STRIDE), F.length("piece") - (min(sizes) - 1))
    at = F.explode(F.sequence(F.lit(1), starts)).alias("at")
    rests = pieces.where(starts > 0).select("token_id", "piece", at).select(
        "token_id", F.substring("piece", F.col("at"), F.lit(longest)).alias("rest")
    )
    own = F.explode(F.array(*map(F.lit, sizes))).alias("n")
    begun = rests.select("token_id", "rest", own).where(F.length("rest") >= F.col("n"))
    begun = begun.select("token_id", "rest", F.left("rest", F.col("n")).alias("head")).join(heads, "head")
    fits = F.filter("lengths", lambda n: n <= F.length("rest"))
    words = begun.select("token_id", "rest", F.explode(fits).alias("n")).select(
        "token_id", F.left("rest", F.col("n")).alias("word")
    )
    return words.join(wanted, "word").select("token_id", "id").distinct()


def _found_by_scan(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """Wanted words ``(key, id)`` that a text contains.

    An automaton of a bounded number of words is met with every text in its
    own task, so no text is shuffled.
    """
    scans = max(-(-wanted.count() // SCAN_WORDS), 1)
    rows, kind = docs.select(key, text), docs.schema[key].dataType.simpleString()
    part = F.pmod(F.xxhash64("word"), F.lit(scans))
    found = None
    for nth in range(scans):
        words = [r.word for r in wanted.where(part == nth).select("word").collect()]
        hits = rows.mapInArrow(_word_scan(key, text, words), f"`{key}` {kind}, word string")
        found = hits if found is None else found.unionByName(hits)
    return materialize(found.join(wanted, "word").select(key, "id"), "found-words")


def _word_scan(key: str, text: str, words: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word in words:
            if word:
                automaton.add_word(word, word)
        automaton.make_automaton()
        always = {""} & set(words)
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column(text)):
                if not value.is_valid:
                    continue
                own = always | ({word for _, word in automaton.iter(value.as_py())} if len(automaton) else set())
                rows += [i] * len(own)
                found += sorted(own)
            keys = batch.column(key).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string())], names=[key, "word"])

    return scan


def _ids_of_pairs(found: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Ids of the documents that have both words of a pair, from the wanted words found in them.

    Pairs are indexed by the word that fewer documents hold.  Only where that word was found its
    partners are asked for, and an equi-join on document and word answers.  So rows are at most the documents of the rarer
    word of every pair, however many wanted words a document holds.
    """
    found = materialize(found, "found-words")
    counts = materialize(found.groupBy("word").agg(F.count("*").alias("cn")), "word-documents")
    total = counts.agg(F.sum("cn")).head()[0] or 0
    listed = pairs.select("word1", "word2").distinct()
    for word, cn in (("word1", "cn1"), ("word2", "cn2")):
        # pairs of a word that was not found are left out
        listed = listed.join(counts.withColumnsRenamed({"word": word, "cn": cn}), word)
    first = F.col("cn1") <= F.col("cn2")
    rarer = F.when(first, F.col("word1")).otherwise(F.col("word2"))
    partner = F.when(first, F.col("word2")).otherwise(F.col("word1"))
    index = listed.groupBy(rarer.alias("word"), _part(pairs).alias("part")).agg(
        F.collect_set(partner).alias("partners")
    )
    hot = hot_rows(counts, "cn", total)
    asked = salted_join(found, index, ["word"], hot).select(key, F.explode("partners").alias("word"))
    return asked.join(found, [key, "word"], "left_semi").select(key).distinct()


def _sides(pairs: DataFrame, wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """What a wanted word says of a document that holds it, as codes: its own ``2 * id`` if it is asked for, and
    ``2 * id + 1`` of each partner that it, the rarer word of their pair, asks for.
    """
    known = materialize(wanted.join(counts, "id"), "known-words")
    listed = pairs.select("word1", "word2").distinct()
    for nth in "12":
        # pairs of a word that was not found are left out
        names = {"word": f"word{nth}", "id": f"id{nth}", "cn": f"cn{nth}"}
        listed = listed.join(known.withColumnsRenamed(names), f"word{nth}")
    first = F.col("cn1") <= F.col("cn2")
    asking = materialize(
        listed.select(
            F.when(first, F.col("id1")).otherwise(F.col("id2")).alias("id"),
            F.when(first, F.col("id2")).otherwise(F.col("id1")).alias("partner"),
        ),
        "asking-words",
    )
    own = asking.select(F.col("partner").alias("id"), (F.col("partner") * 2).alias("code")).distinct()
    codes = own.unionByName(asking.select("id", (F.col("partner") * 2 + 1).alias("code")))
    part = F.pmod(F.xxhash64("code"), F.lit(asking.count() // TOGETHER + 1))
    # the partners of a word lie in one row, unless they are very many
    sizes = codes.groupBy("id", part.alias("part")).agg(F.collect_list("code").alias("codes"))
    few = F.size("codes") < 100
    return sizes.where(few).groupBy("id").agg(F.flatten(F.collect_list("codes")).alias("codes")).unionByName(
        sizes.where(~few).select("id", "codes")
    )


def _ids_of_substrings(docs: DataFrame, pairs: DataFrame, text: str, key: str) -> DataFrame:
    """Ids of the documents whose text contains both words of a pair.

    A word without blanks and line ends lies inside a token, so it is looked for once in each different
    token.  Only words that may lie across tokens, and very long ones, are looked for in the texts.
    A token that holds both words of a pair settles its documents; only the rest are joined by document and word.
    """
    numbered = _wanted(pairs).withColumn("id", F.monotonically_increasing_id())
    wanted = materialize(numbered, "numbered-words")
    whole = F.length("word").between(1, WORD_LENGTH) & ~F.contains("word", F.lit(" ")) & ~F.contains("word", F.lit("\n"))
    inside, other = wanted.where(whole), wanted.where(~whole)

    least = inside.agg(F.min(F.length("word"))).head()[0]
    rows = _text_tokens(docs, text, key, least or 1)
    counted = rows.groupBy("token").agg(F.count("*").alias("cn"))
    tokens = materialize(counted.withColumn("token_id", F.monotonically_increasing_id()), "text-tokens")
    holding = _words_in_tokens(tokens, inside).join(tokens, "token_id")
    holding = materialize(holding.select("token", "cn", "id"), "token-words")
    found = None if other.isEmpty() else _found_by_scan(docs, other, text, key)

    counts = holding.select("id", "cn")
    if found is not None:
        counts = counts.unionByName(found.select("id", F.lit(1).cast("long").alias("cn")))
    counts = materialize(counts.groupBy("id").agg(F.sum("cn").alias("cn")), "word-documents")
    sides = materialize(_sides(pairs, wanted, counts), "word-sides")

    said = materialize(holding.join(sides, "id").select("token", "cn", "codes"), "token-codes")
    settling = materialize(_both_said(said, ["token", "cn"]), "settling-tokens")
    short = settling.where(F.length("token") <= WORD_LENGTH)
    frequent = most_frequent(short, "cn", SETTLING_TOKENS).select("token")
    settled = rows.join(F.broadcast(frequent), "token", "left_semi").select(key).distinct()
    settled = materialize(settled, "settled-documents")
    others = materialize(docs.select(key).distinct().join(settled, key, "left_anti"), "other-documents")

    total = tokens.agg(F.sum("cn")).head()[0] or 0
    rest = _text_tokens(docs.join(others, key, "left_semi"), text, key, least or 1)
    codes = salted_join(rest, said.drop("cn"), ["token"], hot_rows(tokens, "cn", total).select("token")).select(key, "codes")
    if found is not None:
        by_scan = hot_rows(counts, "cn", found.count()).select("id")
        codes = codes.unionByName(salted_join(found, sides, ["id"], by_scan).select(key, "codes"))
    return settled.unionByName(_both_said(codes, [key])).distinct()


def _both_said(codes: DataFrame, by: list[str]) -> DataFrame:
    """Different rows of the columns ``by`` for which a word is held and asked for, by the arrays ``codes`` of `_sides`."""
    code = codes.select(*by, F.explode("codes").alias("code"))
    side = F.when(F.col("code") % 2 == 0, 1).otherwise(2)
    met = code.groupBy(*by, F.shiftright("code", 1).alias("id")).agg(F.bit_or(side).alias("sides"))
    return met.where("sides = 3").select(*by).distinct()


def with_pair_substrings(
    docs: DataFrame, pairs: DataFrame, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Documents whose text contains both words of any pair, also inside other words."""
    short = pair_list(pairs)
    if short is None:
        return docs.join(_ids_of_substrings(docs, pairs, text, key), key, "left_semi")
    return docs.where(_any_pair(short, lambda word: F.contains(F.col(text), word)))


def first_documents(
    docs: DataFrame, found: DataFrame, n: int = 1000, key: str = "doc_id"
) -> DataFrame:
    """The first ``n`` documents, in corpus order, of those in ``found``.

    Only the ids found are sorted; ``docs`` is then read by at most ``n`` ids,
    without the test that found them.
    """
    ids = found.select(key).orderBy(key).limit(n)
    return docs.join(ids, key, "left_semi")


def with_titles(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Pages ``(title, text, ...)`` whose title is listed, with the text lower-cased."""
    wanted = titles.select(T.title_key(F.col("title")).alias("title_key")).distinct()
    keyed = pages.withColumn("title_key", T.title_key(F.col("title")))
    return keyed.join(wanted, "title_key", "left_semi").withColumn("text", F.lower("text"))
