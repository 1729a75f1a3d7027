"""Registered queries: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import counts, phrases, ranks, select, stopwords
from corpusloom.operators.analogies import analogies, analogy_accuracy, synonyms
from corpusloom.operators.bigrams import key_counts
from corpusloom.operators.lookup import (
    dimension,
    fill_zero,
    known_pairs,
    known_vectors,
    mean_vectors,
    pair_vectors,
    pair_words,
)
from corpusloom.operators.ordering import previous_value
from corpusloom.operators.projection import pair_map
from corpusloom.operators.subsample import subsample
from corpusloom.operators.tokens import phrase_token_rows, space_token_rows, truncate_tokens, words
from corpusloom.operators.rows import small_table
from corpusloom.plans import training
from corpusloom.plans.build_corpus import (
    build_corpus,
    normalized_lines,
    numbered_corpus,
    pair_articles,
    pair_lines,
    phrase_corpus,
)
from corpusloom.plans.corpus_stats import corpus_stats, kept_words
from corpusloom.plans.evaluation import evaluate, metric_table, rounded
from corpusloom.plans.phrases import repeat_phrases
from corpusloom.registry import inputs as I
from corpusloom.scratch import drop_before_last, materialize, new_path, tables_written
from corpusloom.sources import stopwords as lists
from corpusloom.sources import text as files
from corpusloom.sources import wiki
from corpusloom.sources.pairs import pairs_from_list, read_pairs, read_rated_pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def six(column: str):
    return F.round(column, 6).alias(column)


def stop_list() -> list[str]:
    """Built-in English list and the extra news list, as one."""
    return lists.union_lists(lists.language_stopwords("en"), lists.NEWS_STOPWORDS)


# -- lines and tokens


@query
def text_lines(spark, sf):
    return files.document_lines(I.documents(spark, sf))


@query
def text_file_lines(spark, sf):
    """Write all lines as gzip text files, read them back and number them."""
    path = new_path(spark, "text-files")
    lines = files.document_lines(I.documents(spark, sf))
    files.write_lines(lines, path, ["doc_id", "line_no"], compression="gzip")
    return files.read_lines(spark, path).select("doc_id", "text")


@query
def text_files_appended(spark, sf):
    """Lines of one source and then of another one, written to the same text files."""
    path = new_path(spark, "appended")
    for batch, source in enumerate((I.documents, I.conversations)):
        lines = files.document_lines(source(spark, sf))
        files.write_lines(lines, path, ["doc_id", "line_no"], batch, files=3)
    return files.read_lines(spark, path).select("doc_id", "text")


@query
def token_corpus_file(spark, sf):
    """Articles written one per line, their tokens joined by a space, and read back."""
    path = new_path(spark, "articles")
    docs = I.documents(spark, sf)
    articles = docs.select("doc_id", T.article_tokens(F.col("text")).alias("tokens"))
    files.write_tokens(articles, "tokens", path, ["doc_id"])
    return files.read_lines(spark, path).select("doc_id", "text")


@query
def titles_file(spark, sf):
    """Titles of pages written as a list and read back."""
    path = new_path(spark, "titles")
    I.pages(spark, sf).select(F.col("title").alias("value")).write.text(path)
    return files.read_titles(spark, path)


@query
def stopword_file_removed(spark, sf):
    """Counts of the words that are not in a stop-word file, which has an empty line."""
    path = new_path(spark, "stop")
    small_table(spark, value=stop_list()).write.text(path)
    kept = stopwords.remove_by_join(words(I.documents(spark, sf)), lists.read_stopwords(spark, path))
    return kept.groupBy("word").agg(F.count("*").alias("cn"))


@query
def tokens_space(spark, sf):
    return space_token_rows(I.documents(spark, sf))


@query
def tokens_phrase(spark, sf):
    return phrase_token_rows(I.documents(spark, sf))


@query
def tokens_phrase_marks(spark, sf):
    """Phrase tokens of texts with tabs, carriage returns and line-break tokens among their words."""
    tabs = F.replace(F.col("text"), F.lit(" de "), F.lit("\t de\r\n"))
    marks = F.replace(tabs, F.lit(" the "), F.lit(" </s> the\r "))
    return phrase_token_rows(I.documents(spark, sf).withColumn("text", marks))


@query
def truncated_tokens(spark, sf):
    """Phrase tokens cut at eight bytes."""
    return phrase_token_rows(truncate_tokens(I.documents(spark, sf), 8))


@query
def alpha_tokens(spark, sf):
    docs = I.documents(spark, sf)
    rows = docs.select("doc_id", F.posexplode(T.alphabetic_tokens(F.col("text"))).alias("pos", "word"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query
def alpha_tokens_without_stopwords(spark, sf):
    stop = stop_list()
    docs = I.documents(spark, sf)
    kept = stopwords.without_words(T.alphabetic_tokens(F.col("text")), stop)
    return docs.select("doc_id", F.array_join(kept, " ").alias("text"))


# -- vocabulary


@query
def word_count_min(spark, sf):
    return counts.word_counts(words(I.documents(spark, sf)))


@query
def top_words(spark, sf):
    return counts.top_words(counts.word_counts(words(I.documents(spark, sf))))


@query
def vocab_by_count(spark, sf):
    return counts.by_count(counts.word_counts(words(I.documents(spark, sf)), 1))


@query
def vocab_size_and_total(spark, sf):
    return counts.vocabulary_metrics(counts.word_counts(words(I.documents(spark, sf))))


@query
def stopword_removed(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", T.document_space_tokens(F.col("text")).alias("raw"))
    kept = stopwords.remove_ignoring_case(docs, "raw", "kept", stop_list())
    return kept.select("doc_id", F.array_join("kept", " ").alias("text"))


@query
def stopword_removed_exact(spark, sf):
    kept = stopwords.without_words(T.document_space_tokens(F.col("text")), stop_list())
    return I.documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("text"))


@query
def stopword_antijoin_counts(spark, sf):
    """Counts first, then the join, so no frequent word crosses the shuffle twice."""
    stop = lists.stopword_table(spark, lists.language_stopwords("en"), lists.NEWS_STOPWORDS)
    return stopwords.remove_by_join(counts.word_counts(words(I.documents(spark, sf)), 1), stop)


@query
def corpus_stats_metrics(spark, sf):
    return corpus_stats(I.documents(spark, sf), stop_list())[0]


@query
def corpus_stats_top(spark, sf):
    return corpus_stats(I.documents(spark, sf), stop_list())[1]


@query
def subsample_tokens(spark, sf):
    docs = I.documents(spark, sf)
    vocab = materialize(counts.word_counts(words(docs), 1), "vocabulary")
    total = counts.vocabulary_metrics(vocab).head().words_in_corpus
    return subsample(space_token_rows(docs), vocab, total, portable=True)


@query
def subsample_tokens_small_rate(spark, sf):
    """At a rate at which the frequent words may be too many to broadcast."""
    docs = I.documents(spark, sf)
    vocab = materialize(counts.word_counts(words(docs), 1), "vocabulary")
    total = counts.vocabulary_metrics(vocab).head().words_in_corpus
    return subsample(space_token_rows(docs), vocab, total, rate=1e-8, portable=True)


# -- cleaning and corpus building


@query
def normalize_text(spark, sf):
    return normalized_lines(I.documents(spark, sf), "documents").drop("source")


@query
def clean_markup(spark, sf):
    return wiki.visible_bodies(I.pages(spark, sf), True).select("doc_id", "text")


@query
def clean_markup_redirects(spark, sf):
    """Cleaned bodies of pages of which every fifth is a redirect."""
    redirect = F.concat(F.lit("<text>#ReDirect [["), "title", F.lit("]]"), "text")
    text = F.when(F.col("doc_id") % 5 == 0, redirect).otherwise(F.col("text"))
    pages = I.pages(spark, sf).withColumn("text", text)
    return wiki.visible_bodies(pages, True).select("doc_id", "text")


@query
def visible_multiword_lines(spark, sf):
    bodies = wiki.visible_bodies(I.pages(spark, sf), True)
    lines = files.document_lines(bodies)
    return lines.where(T.has_several_fields(F.col("text")))


@query
def wiki_tokens_filtered(spark, sf):
    tokens = wiki.article_token_rows(I.pages(spark, sf), namespace=None, decode_entities=True)
    return tokens.select("doc_id", F.array_join("tokens", " ").alias("text"))


@query
def wiki_xml_dump(spark, sf):
    """Write the pages as an XML dump and read the articles back."""
    path = new_path(spark, "dump")
    dump = I.pages(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.lit(0).alias("ns"),
        "title",
        F.struct(F.col("text").alias("text")).alias("revision"),
    )
    dump.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").option(
        "compression", "bzip2"
    ).save(path)
    tokens = wiki.article_token_rows(wiki.read_pages(spark, path), decode_entities=True)
    return tokens.select("doc_id", F.array_join("tokens", " ").alias("text"))


def sources(spark, sf):
    """Three plain sources and the pages."""
    plain = {
        "documents": I.documents(spark, sf),
        "benchmark": I.benchmark(spark, sf),
        "conversations": I.conversations(spark, sf),
    }
    return plain, {"pages": I.pages(spark, sf)}


@query
def corpus_union(spark, sf):
    """Lines of three plain sources and the cleaned pages, normalised, as one corpus."""
    return build_corpus(*sources(spark, sf), decode_entities=True)


@query
def corpus_numbered(spark, sf):
    """The same lines as documents with one id through all sources."""
    return numbered_corpus(*sources(spark, sf), decode_entities=True)


@query
def corpus_phrases_end_to_end(spark, sf):
    """All sources, numbered, after two phrase passes, written as text and read back."""
    path = new_path(spark, "phrase-corpus")
    phrase_corpus(numbered_corpus(*sources(spark, sf), decode_entities=True), path)
    return files.read_lines(spark, path).select("doc_id", "text")


# -- sub-corpora


def selection_pairs(spark):
    return pairs_from_list(spark, I.PAIRS)


def alphabetic_documents(spark, sf):
    docs = I.documents(spark, sf)
    return docs.select("doc_id", T.alphabetic_tokens(F.col("text")).alias("tokens"))


@query
def docs_with_pair_tokens(spark, sf):
    docs = alphabetic_documents(spark, sf)
    return select.with_pair_tokens(docs, selection_pairs(spark)).select("doc_id")


@query
def docs_with_pair_substring(spark, sf):
    docs = I.documents(spark, sf)
    return select.with_pair_substrings(docs, selection_pairs(spark)).select("doc_id")


def many_pairs(spark, sf):
    """Neighbours in alphabetical order among the frequent long words: a list beyond the literal ones."""
    vocab = counts.word_counts(words(I.documents(spark, sf)), 8).where("length(word) > 5")
    near = previous_value(vocab.select("word"), "word", ["word"], "word1")
    return near.where("word1 IS NOT NULL").select("word1", F.col("word").alias("word2"))


@query
def docs_with_long_pair_list_tokens(spark, sf):
    docs = I.documents(spark, sf).select("doc_id", T.document_space_tokens(F.col("text")).alias("tokens"))
    return select.with_pair_tokens(docs, many_pairs(spark, sf)).select("doc_id")


@query
def docs_with_long_pair_list_substring(spark, sf):
    return select.with_pair_substrings(I.documents(spark, sf), many_pairs(spark, sf)).select("doc_id")


@query
def first_n_matching_docs(spark, sf):
    return pair_lines(I.documents(spark, sf), selection_pairs(spark), 20)


@query
def pair_article_corpus(spark, sf):
    return pair_articles(alphabetic_documents(spark, sf), selection_pairs(spark), 20)


@query
def pages_by_title(spark, sf):
    """Pages that share their title key with a page in English."""
    pages = I.pages(spark, sf)
    titles = pages.where(F.contains("text", F.lit('<html lang="en">'))).select("title")
    return select.with_titles(pages, titles).select("doc_id", "title_key", "text")


# -- phrases


def vocabulary(spark, sf, cross_line):
    counted = key_counts(I.documents(spark, sf), cross_line=cross_line)
    return counted.where(F.col("key").isNotNull())


@query
def bigram_vocab_crossline(spark, sf):
    return vocabulary(spark, sf, True)


@query
def bigram_vocab_line(spark, sf):
    return vocabulary(spark, sf, False)


@query
def corpus_words(spark, sf):
    """Number of words of the corpus, line ends not counted."""
    counted = key_counts(I.documents(spark, sf), cross_line=False)
    return counted.where(F.col("key").isNull()).select(F.col("cn").alias("words"))


@query
def phrase_scores(spark, sf):
    scored, _ = phrases.corpus_scores(I.documents(spark, sf))
    return scored.withColumn("score", F.round("score", 6))


@query
def phrase_scores_second_pass(spark, sf):
    """Scores over the joined words of a first pass, whose tokens hold underscores themselves."""
    first = tables_written()
    once = materialize(phrases.join_phrases(I.documents(spark, sf), threshold=200.0), "first-pass")
    drop_before_last(spark, first)
    scored, _ = phrases.corpus_scores(once)
    return scored.withColumn("score", F.round("score", 6))


@query
def phrase_scores_single(spark, sf):
    """Scores rounded to single precision after each step."""
    scored, _ = phrases.corpus_scores(I.documents(spark, sf), single=True)
    return scored.withColumn("score", F.col("score").cast("double"))


@query
def phrase_joined_lines(spark, sf):
    return files.document_lines(phrases.join_phrases(I.documents(spark, sf)))


@query
def phrase_joined_lines_line_counts(spark, sf):
    return files.document_lines(phrases.join_phrases(I.documents(spark, sf), cross_line=False))


@query
def phrase_two_pass(spark, sf):
    return files.document_lines(repeat_phrases(I.documents(spark, sf)))


@query
def phrase_text_file(spark, sf):
    """Phrase-joined lines written as text, every unit led by a space, and read back."""
    path = new_path(spark, "phrase-text")
    first = tables_written()
    lines = files.document_lines(phrases.join_phrases(I.documents(spark, sf)))
    files.write_phrase_lines(lines, path, ["doc_id", "line_no"], made_from=first)
    return files.read_lines(spark, path).select("doc_id", "text")


# -- vectors


@query
def rated_pairs_file(spark, sf):
    """Rated pairs written as tab-separated files with header and read back."""
    path = new_path(spark, "rated")
    rated = I.rated_pairs(spark, sf).select("word1", "word2", "score")
    rated.write.option("sep", "\t").csv(path, header=True)
    # the order of the lines is that of one file
    return read_rated_pairs(spark, path, "made up").drop("line_no")


@query
def analogy_pairs_file(spark, sf):
    """Analogy pairs written as comma-separated files and read back."""
    path = new_path(spark, "pairs")
    I.analogy_pairs(spark, sf).select(F.upper("word1"), F.upper("word2")).write.csv(path)
    return read_pairs(spark, path).drop("pair_id")


@query
def rated_pairs_file_order(spark, sf):
    """Rated pairs of one file with their line numbers."""
    path = new_path(spark, "rated")
    rated = I.rated_pairs(spark, sf).repartition(1).sortWithinPartitions("line_no")
    rated.select("word1", "word2", "score").write.option("sep", "\t").csv(path, header=True)
    return read_rated_pairs(spark, path, "made up")


@query
def analogy_pairs_file_order(spark, sf):
    """Analogy pairs of one file with their numbers."""
    path = new_path(spark, "pairs")
    pairs = I.analogy_pairs(spark, sf).repartition(1).sortWithinPartitions(F.desc("pair_id"))
    pairs.select(F.upper("word1"), F.upper("word2")).write.csv(path)
    return read_pairs(spark, path)


@query
def vector_lookup_zero_fill(spark, sf):
    vectors = I.word_vectors(spark, sf)
    filled = fill_zero(pair_vectors(I.rated_pairs(spark, sf), vectors), dimension(vectors))
    return filled.select(
        "dataset", "line_no", "word1", "word2",
        F.round(V.norm(F.col("vector1")), 6).alias("norm1"),
        F.round(V.norm(F.col("vector2")), 6).alias("norm2"),
    )


@query
def nonzero_vectors(spark, sf):
    """Words of the rated pairs that have a vector other than zero."""
    known = known_vectors(pair_words(I.rated_pairs(spark, sf)), I.word_vectors(spark, sf))
    return known.select("word", F.round(V.norm(F.col("vector")), 6).alias("norm"))


@query
def nonzero_vectors_zeroed(spark, sf):
    """The same where every third vector is zero."""
    zero = F.transform("vector", lambda x: F.lit(0.0))
    vector = F.when(F.col("word").cast("long") % 3 == 0, zero).otherwise(F.col("vector"))
    vectors = I.word_vectors(spark, sf).withColumn("vector", vector)
    known = known_vectors(pair_words(I.rated_pairs(spark, sf)), vectors)
    return known.select("word", F.round(V.norm(F.col("vector")), 6).alias("norm"))


@query
def cosine_pairs(spark, sf):
    pairs = known_pairs(I.rated_pairs(spark, sf), I.word_vectors(spark, sf))
    a, b = F.col("vector1"), F.col("vector2")
    return pairs.select(
        "line_no", "word1", "word2",
        F.round(V.cosine_similarity(a, b), 6).alias("similarity"),
        F.round(V.cosine_distance(a, b), 6).alias("distance"),
    )


def query_words(spark, sf):
    pairs = I.analogy_pairs(spark, sf)
    return pairs.select(F.col("pair_id").alias("query_id"), F.col("word1").alias("word"))


@query
def nearest_k(spark, sf):
    found = synonyms(query_words(spark, sf), I.word_vectors(spark, sf), exclude_self=False)
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def nearest_k_exclude_self(spark, sf):
    found = synonyms(query_words(spark, sf), I.word_vectors(spark, sf))
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def nearest_k_unknown(spark, sf):
    """Nearest words of second words, one of which has no vector and no answer."""
    asked = I.analogy_pairs(spark, sf).select(F.col("pair_id").alias("query_id"), F.col("word2").alias("word"))
    found = synonyms(asked, I.word_vectors(spark, sf))
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def synonym_report(spark, sf):
    return rounded(synonyms(query_words(spark, sf), I.word_vectors(spark, sf)))


@query
def analogy_offset(spark, sf):
    return rounded(analogies(I.analogy_pairs(spark, sf), I.word_vectors(spark, sf)))


@query
def analogy_unit_mean(spark, sf):
    pairs = I.analogy_pairs(spark, sf)
    return rounded(analogies(pairs, I.word_vectors(spark, sf), exclude_inputs=True))


@query
def analogy_accuracy_offset(spark, sf):
    pairs = I.analogy_pairs(spark, sf)
    return analogy_accuracy(pairs, analogies(pairs, I.word_vectors(spark, sf)))


@query
def analogy_accuracy_unit_mean(spark, sf):
    pairs = I.analogy_pairs(spark, sf)
    answers = analogies(pairs, I.word_vectors(spark, sf), exclude_inputs=True)
    return analogy_accuracy(pairs, answers)


@query
def doc_embedding_mean(spark, sf):
    docs = I.documents(spark, sf)
    tokens = docs.select("doc_id", F.explode(T.document_space_tokens(F.col("text"))).alias("word"))
    vocab = materialize(counts.word_counts(words(docs), 1), "vocabulary")
    vectors = materialize(I.hashed_word_vectors(vocab, spark, sf), "vectors")
    means = mean_vectors(tokens, vocab, vectors)
    rows = means.select("doc_id", "n_tokens", F.posexplode("vector").alias("dim", "value"))
    return rows.select("doc_id", "n_tokens", F.col("dim").cast("long"), six("value"))


@query
def spearman_positional(spark, sf):
    return ranks.similarity_scores(I.rated_pairs(spark, sf), I.word_vectors(spark, sf))


@query
def pair_coverage(spark, sf):
    rated = I.rated_pairs(spark, sf)
    known = known_pairs(rated, I.word_vectors(spark, sf))
    covered = known.groupBy("dataset").agg(F.count("*").alias("coverage"))
    every = rated.groupBy("dataset").agg(F.count("*").alias("n_pairs"))
    return every.join(covered, "dataset", "left").fillna(0, ["coverage"])


@query
def pca_points(spark, sf):
    points, _ = pair_map(I.analogy_pairs(spark, sf), I.word_vectors(spark, sf))
    return points.select("pair_id", "side", "word", six("x"), six("y"))


@query
def pca_segments(spark, sf):
    _, lines = pair_map(I.analogy_pairs(spark, sf), I.word_vectors(spark, sf))
    return lines.select("pair_id", "word1", six("x1"), six("y1"), "word2", six("x2"), six("y2"))


@query
def evaluation_metrics(spark, sf):
    reports = evaluate(
        I.word_vectors(spark, sf), I.analogy_pairs(spark, sf), I.rated_pairs(spark, sf)
    )
    return metric_table(reports)


# -- models


def fit_small(spark, sf):
    return training.fit_vectors(
        I.documents(spark, sf), stop_list(), vector_size=32, num_partitions=8, min_count=20
    )


@query
def w2v_fit_sampled(spark, sf):
    """Vectors fitted on sentences whose frequent words were thinned out."""
    rows = training.sampled_sentences(I.documents(spark, sf), stop_list(), rate=1e-3, portable=True)
    model = training.fit_sentences(rows, vector_size=16, num_partitions=8, min_count=20)
    return training.word_vectors(model).select("word", F.size("vector").cast("long").alias("dim"))


@query
def sampled_sentences(spark, sf):
    rows = training.sampled_sentences(I.documents(spark, sf), stop_list(), portable=True)
    return rows.select("doc_id", "line_no", F.array_join("raw", " ").alias("text"))


@query
def w2v_fit_vectors(spark, sf):
    rows = training.word_vectors(fit_small(spark, sf))
    return rows.select(
        "word",
        F.size("vector").cast("long").alias("dim"),
        V.is_nonzero(F.col("vector")).alias("nonzero"),
    )


@query
def w2v_transform(spark, sf):
    """Which documents get a vector other than zero."""
    model = fit_small(spark, sf)
    docs = I.documents(spark, sf).select("doc_id", T.document_space_tokens(F.col("text")).alias("raw"))
    means = training.sentence_vectors(model, docs)
    return means.select("doc_id", V.is_nonzero(F.col("vector")).alias("nonzero"))


@query
def w2v_word_lookup(spark, sf):
    """Which words of the corpus the model knows, asked as sentences of one word."""
    vocab = counts.word_counts(words(I.documents(spark, sf)), 5).select("word")
    found = training.vectors_by_model(fit_small(spark, sf), vocab)
    return found.select("word", V.is_nonzero(F.col("vector")).alias("nonzero"))


@query
def w2v_save_load(spark, sf):
    """Largest difference between the vectors of a model and of its saved copy."""
    path = new_path(spark, "model")
    model = fit_small(spark, sf)
    training.save_model(model, path)
    vectors = training.word_vectors(model)
    # the driver has room for one of the two
    del model
    copy = training.word_vectors(training.load_pipeline(path)).withColumnRenamed("vector", "copy")
    both = vectors.join(copy, "word", "full")
    gaps = F.transform(V.subtract(F.col("vector"), F.col("copy")), F.abs)
    return both.select("word", F.array_max(gaps).alias("gap"))


@query
def w2v_nearest(spark, sf):
    """Nearest words of the ten most frequent ones in a fitted model."""
    docs, stop = I.documents(spark, sf), stop_list()
    vectors = materialize(training.word_vectors(fit_small(spark, sf)), "vectors")
    top = counts.top_words(counts.word_counts(kept_words(docs, stop)), 10)
    asked = top.select(F.xxhash64("word").alias("query_id"), "word")
    return rounded(synonyms(asked, vectors))


@query
def w2v_nearest_shape(spark, sf):
    """What holds for every fit: five ranks a query, known words other than it, similarities that do not rise."""
    docs, stop = I.documents(spark, sf), stop_list()
    vectors = materialize(training.word_vectors(fit_small(spark, sf)), "vectors")
    top = counts.top_words(counts.word_counts(kept_words(docs, stop)), 10)
    found = synonyms(top.select(F.xxhash64("word").alias("query_id"), "word"), vectors)
    before = F.lag("similarity").over(Window.partitionBy("query_id").orderBy("rank"))
    known = vectors.select("word", F.lit(True).alias("known"))
    return found.withColumn("falls", before.isNull() | (F.col("similarity") <= before)).join(known, "word", "left").select(
        "query", "rank", F.coalesce("known", F.lit(False)).alias("known"),
        (F.col("word") == F.col("query")).alias("is_self"), "falls",
    )
