"""SQL texts that compute the registered queries in another engine.

They share the fixed values (rewrites, word lists, pairs) with the library and
nothing else.
"""

from __future__ import annotations

from corpusloom.functions.text import (
    ALPHABETIC_RUN,
    DIGITS,
    ENTITY_REWRITES,
    MARKUP_REWRITES,
    NORMALIZE_REWRITES,
)
from corpusloom.registry.inputs import PAIRS
from corpusloom.sources.stopwords import NEWS_STOPWORDS

# The built-in English stop-word list of Spark ML.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

DIM = 64


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = ", ".join(quoted(w) for w in ENGLISH_STOPWORDS + NEWS_STOPWORDS)
STOP_LIST = f"[{STOP}]"


def lines_of(table: str, key: str = "doc_id", text: str = "text") -> str:
    return f"""
SELECT {key}, unnest(range(len(parts))) AS line_no, unnest(parts) AS text
FROM (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {table})"""


def tokens_of(lines: str, blank: bool = False) -> str:
    """Token rows of a relation of lines, split on single spaces or on blanks."""
    split = "string_split(text, ' ')"
    if blank:
        plain = "replace(replace(text, chr(13), ''), chr(9), ' ')"
        split = f"list_filter(string_split({plain}, ' '), lambda t: t <> '')"
    return f"""
SELECT doc_id, line_no, unnest(range(len(parts))) AS pos, unnest(parts) AS word
FROM (SELECT doc_id, line_no, {split} AS parts FROM {lines})"""


LINES = f"lines AS ({lines_of('documents')})"
TOKENS = f"{LINES}, tokens AS ({tokens_of('lines')})"
BLANK_TOKENS = f"{LINES}, tokens AS ({tokens_of('lines', blank=True)})"
DOC_TOKENS = "string_split(replace(text, chr(10), ' '), ' ')"
VOCAB = f"{TOKENS}, vocab AS (SELECT word, count(*) AS cn FROM tokens GROUP BY word)"
KEPT = f"""{TOKENS},
vocab AS (SELECT word, count(*) AS cn FROM tokens WHERE lower(word) NOT IN ({STOP}) GROUP BY word)"""
MANY_PAIRS = """listed AS (SELECT word FROM vocab WHERE cn >= 8 AND length(word) > 5),
pairs AS (
SELECT * FROM (SELECT word AS word1, lead(word) OVER (ORDER BY word) AS word2 FROM listed)
WHERE word2 IS NOT NULL)"""
ALPHABETIC = f"regexp_extract_all(lower(text), '{ALPHABETIC_RUN}')"
PAGES = """pages_as_wiki AS (
SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS text
FROM pages)"""


def normalized(text: str) -> str:
    sql = f"lower({text})"
    for old, new in NORMALIZE_REWRITES:
        sql = f"replace({sql}, {quoted(old)}, {quoted(new)})"
    return f"translate({sql}, '{DIGITS}', '{' ' * len(DIGITS)}')"


def cleaned(text: str) -> str:
    sql = f"lower({text})"
    for old, new in ENTITY_REWRITES:
        sql = f"replace({sql}, {quoted(old)}, {quoted(new)})"
    for pattern, replacement in MARKUP_REWRITES:
        new = replacement.replace("$1", r"\1")
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"' ' || {sql}"


BODIES = f"""{PAGES}, bodies AS (
SELECT doc_id, {cleaned("text")} AS text FROM pages_as_wiki
WHERE lower(text) NOT LIKE '%#redirect%')"""
SEVERAL_FIELDS = (
    "len(list_filter(string_split(replace(text, chr(9), ' '), ' '), lambda t: t <> '')) > 1"
)
ARTICLE_TOKENS = f"""
SELECT doc_id, array_to_string(tokens, ' ') AS text FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower({cleaned("text")}), '{ALPHABETIC_RUN}'),
    lambda t: length(t) BETWEEN 2 AND 15 AND t NOT LIKE '\\_%' ESCAPE '\\') AS tokens
  FROM pages_as_wiki)
WHERE len(tokens) >= 50"""


def any_pair(function: str, value: str) -> str:
    return " OR ".join(
        f"({function}({value}, {quoted(a)}) AND {function}({value}, {quoted(b)}))"
        for a, b in PAIRS
    )


PAIR_TOKENS = any_pair("list_contains", ALPHABETIC)
PAIR_SUBSTRINGS = any_pair("contains", "text")


# -- phrases


def vocabulary_ctes(name: str, tokens: str, cross_line: bool) -> str:
    over = "ORDER BY doc_id, line_no, pos"
    if not cross_line:
        over = "PARTITION BY doc_id, line_no ORDER BY pos"
    return f"""{name}_pairs AS MATERIALIZED (
SELECT word, lag(word) OVER ({over}) AS prev FROM {tokens}),
{name}_vocab AS MATERIALIZED (
SELECT key, count(*) AS cn FROM (
  SELECT word AS key FROM {name}_pairs
  UNION ALL SELECT prev || '_' || word FROM {name}_pairs WHERE prev IS NOT NULL)
GROUP BY key HAVING count(*) >= 5)"""


def score_ctes(name: str, tokens: str, cross_line: bool) -> str:
    return f"""{vocabulary_ctes(name, tokens, cross_line)},
{name}_scores AS MATERIALIZED (
SELECT p.prev, p.word, a.cn AS pa, b.cn AS pb, ab.cn AS pab,
  (ab.cn - 5)::DOUBLE / a.cn::DOUBLE / b.cn::DOUBLE
    * (SELECT count(*) FROM {tokens})::DOUBLE AS score
FROM (SELECT DISTINCT prev, word FROM {name}_pairs WHERE prev IS NOT NULL) p
JOIN {name}_vocab ab ON ab.key = p.prev || '_' || p.word
JOIN {name}_vocab a ON a.key = p.prev
JOIN {name}_vocab b ON b.key = p.word)"""


def phrase_ctes(name: str, lines: str, threshold: int, cross_line: bool = True) -> str:
    """CTE ``<name>_lines``: the lines of relation ``lines`` with phrases joined."""
    return f"""{name}_tokens AS MATERIALIZED ({tokens_of(lines, blank=True)}),
{score_ctes(name, f"{name}_tokens", cross_line)},
{name}_near AS (
SELECT *, lag(word) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS near FROM {name}_tokens),
{name}_hits AS (
SELECT n.doc_id, n.line_no, n.pos,
  n.pos - row_number() OVER (PARTITION BY n.doc_id, n.line_no ORDER BY n.pos) AS run
FROM {name}_near n JOIN {name}_scores s ON s.prev = n.near AND s.word = n.word
WHERE s.score > {threshold}),
{name}_joined AS (
SELECT doc_id, line_no, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, run ORDER BY pos) AS nth
  FROM {name}_hits) WHERE nth % 2 = 1),
{name}_texts AS (
SELECT t.doc_id, t.line_no, string_agg(
  CASE WHEN t.pos = 0 THEN '' WHEN j.pos IS NULL THEN ' ' ELSE '_' END || t.word, ''
  ORDER BY t.pos) AS text
FROM {name}_tokens t LEFT JOIN {name}_joined j USING (doc_id, line_no, pos)
GROUP BY t.doc_id, t.line_no),
{name}_lines AS MATERIALIZED (
SELECT l.doc_id, l.line_no, coalesce(t.text, '') AS text
FROM {lines} l LEFT JOIN {name}_texts t USING (doc_id, line_no))"""


# -- vectors

VECTORS = "vectors AS (SELECT vec_id::VARCHAR AS word, embedding::DOUBLE[] AS vector FROM embeddings)"
ANALOGY_PAIRS = """pairs AS (
SELECT label::BIGINT AS pair_id, min(vec_id)::VARCHAR AS word1,
  CASE WHEN label = 9 THEN 'oov' ELSE max(vec_id)::VARCHAR END AS word2
FROM embeddings GROUP BY label)"""
RATED = """base AS (
SELECT CASE WHEN label < 3 THEN 'first' ELSE 'second' END AS dataset, vec_id AS line_no,
  vec_id::VARCHAR AS word1,
  ((vec_id * 5 + 1) % ((SELECT count(*) FROM embeddings) + 20))::VARCHAR AS word2,
  (vec_id * 13 % 37)::DOUBLE / 4 AS score
FROM embeddings),
rated AS (
SELECT * FROM base
UNION ALL
SELECT dataset, line_no + 4611686018427387904, word1, word2, score + 1 FROM base WHERE score > 4)"""
ZEROS = f"list_transform(range(1, {DIM + 1}), lambda i: 0.0::DOUBLE)"
NORM = "sqrt(list_dot_product({0}, {0}))"
FILLED = f"""filled AS (
SELECT p.*, coalesce(a.vector, {ZEROS}) AS vector1, coalesce(b.vector, {ZEROS}) AS vector2
FROM {{}} p LEFT JOIN vectors a ON a.word = p.word1 LEFT JOIN vectors b ON b.word = p.word2)"""
KNOWN = """known AS (
SELECT p.*, a.vector AS vector1, b.vector AS vector2
FROM rated p JOIN vectors a ON a.word = p.word1 JOIN vectors b ON b.word = p.word2)"""


def similarity(a: str, b: str) -> str:
    norms = f"({NORM.format(a)} * {NORM.format(b)})"
    return f"CASE WHEN {norms} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {norms} END"


def nearest(exclude: bool, digits: int, asked: str = "word1") -> str:
    condition = f"v.word <> p.{asked}" if exclude else "true"
    return f"""WITH {VECTORS}, {ANALOGY_PAIRS},
ranked AS (
SELECT p.pair_id AS query_id, p.{asked} AS query, v.word, {similarity("q.vector", "v.vector")} AS sim
FROM pairs p JOIN vectors q ON q.word = p.{asked} JOIN vectors v ON {condition})
SELECT query_id, query, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, word) AS rank,
  word, round(sim, {digits}) AS similarity
FROM ranked QUALIFY rank <= 5"""


def unit(vector: str) -> str:
    norm = NORM.format(vector)
    return f"CASE WHEN {norm} = 0 THEN {vector} ELSE list_transform({vector}, lambda x: x / {norm}) END"


def answers(unit_mean: bool) -> str:
    """CTE ``answers`` of analogy questions."""
    if unit_mean:
        vector = f"""list_transform(range(1, {DIM + 1}), lambda i: (b2[i] + u1[i] - b1[i]) / 3)"""
        where = f"{NORM.format('f.vector1')} > 0 AND {NORM.format('f.vector2')} > 0"
        allowed = "v.word NOT IN (q.base1, q.base2, q.word1)"
        parts = [unit("b.vector1"), unit("b.vector2"), unit("f.vector1")]
    else:
        vector = f"""list_transform(range(1, {DIM + 1}), lambda i: b2[i] - b1[i] + u1[i])"""
        where, allowed = "true", "true"
        parts = ["b.vector1", "b.vector2", "f.vector1"]
    return f"""{VECTORS}, {ANALOGY_PAIRS}, {FILLED.format("pairs")},
parts AS (
SELECT f.pair_id, f.word1, f.word2, b.word1 AS base1, b.word2 AS base2,
  {parts[0]} AS b1, {parts[1]} AS b2, {parts[2]} AS u1
FROM filled f JOIN filled b ON b.pair_id = 0 WHERE {where}),
questions AS (SELECT *, {vector} AS vector FROM parts),
ranked AS (
SELECT q.pair_id, q.word1, q.word2, v.word, {similarity("q.vector", "v.vector")} AS sim
FROM questions q JOIN vectors v ON {allowed}),
answers AS (
SELECT pair_id, word1, word2 AS expected,
  row_number() OVER (PARTITION BY pair_id ORDER BY sim DESC, word) AS rank,
  word AS predicted, sim AS similarity
FROM ranked QUALIFY rank <= 5)"""


REPORT = """
SELECT pair_id, word1, expected, rank, predicted, round(similarity, 4) AS similarity,
  rank = 1 AND predicted = expected AS correct FROM answers"""
ACCURACY = """
SELECT count(*) FILTER (predicted = expected) AS n_correct,
  (SELECT count(*) FROM pairs) AS n_pairs, count(*) AS n_answered FROM answers WHERE rank = 1"""

SCORES = f"""{RATED}, {KNOWN},
distances AS (
SELECT dataset, word1, word2, line_no, score,
  1 - list_dot_product(vector1, vector2) / ({NORM.format("vector1")} * {NORM.format("vector2")})
    AS distance
FROM known),
by_score AS (
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, line_no) - 1 AS pos1
FROM distances),
by_distance AS (
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY distance, pos1) - 1 AS own FROM by_score),
placed AS (
SELECT *, min(own) OVER (PARTITION BY dataset, word1, word2) AS pos2 FROM by_distance),
ranked_pairs AS (
SELECT dataset, pos1 + 1 AS rank1,
  rank() OVER (PARTITION BY dataset ORDER BY pos2)
    + (count(*) OVER (PARTITION BY dataset, pos2) - 1) / 2.0 AS rank2
FROM placed),
rho AS (
SELECT dataset, round(corr(rank1, rank2), 3) AS rho, count(*) AS coverage
FROM ranked_pairs GROUP BY dataset)"""

# The main components by power iteration on the matrix of inner products.
MAP = f"""{VECTORS}, {ANALOGY_PAIRS}, {FILLED.format("pairs")},
rows AS (
SELECT pair_id, 1::BIGINT AS side, word1 AS word, vector1 AS vector FROM filled
UNION ALL SELECT pair_id, 2::BIGINT, word2, vector2 FROM filled),
numbered AS MATERIALIZED (
SELECT *, row_number() OVER (ORDER BY side, pair_id) AS n FROM rows),
cells AS (SELECT n, unnest(range(1, {DIM + 1})) AS i, unnest(vector) AS value FROM numbered),
centred_cells AS (SELECT n, i, value - avg(value) OVER (PARTITION BY i) AS value FROM cells),
centred AS MATERIALIZED (
SELECT n, list(value ORDER BY i) AS vector FROM centred_cells GROUP BY n),
products AS MATERIALIZED (
SELECT a.n, list(list_dot_product(a.vector, b.vector) ORDER BY b.n) AS line
FROM centred a, centred b GROUP BY a.n),
gram AS MATERIALIZED (SELECT list(line ORDER BY n) AS g FROM products),
first_power(step, u) AS (
SELECT 0, list_transform(g, lambda r, i: 1.0::DOUBLE + i % 7) FROM gram
UNION ALL
SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
  SELECT step, list_transform(g, lambda r: list_dot_product(r, u)) AS w
  FROM first_power, gram WHERE step < 3000)),
main1 AS MATERIALIZED (
SELECT u, sqrt(list_dot_product(u, list_transform(g, lambda r: list_dot_product(r, u)))) AS s
FROM first_power, gram WHERE step = 3000),
second_power(step, u) AS (
SELECT 0, list_transform(g, lambda r, i: 1.0::DOUBLE + i % 5) FROM gram
UNION ALL
SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
  SELECT step, list_transform(v, lambda x, i: x - m.u[i] * list_dot_product(v, m.u)) AS w
  FROM (SELECT step, list_transform(g, lambda r: list_dot_product(r, u)) AS v
        FROM second_power, gram WHERE step < 3000), main1 m)),
main2 AS MATERIALIZED (
SELECT u, sqrt(list_dot_product(u, list_transform(g, lambda r: list_dot_product(r, u)))) AS s
FROM second_power, gram WHERE step = 3000),
loadings AS (
SELECT c.i, sum(c.value * a.u[c.n]) AS l1, sum(c.value * b.u[c.n]) AS l2
FROM centred_cells c, main1 a, main2 b GROUP BY c.i),
signs AS (
SELECT sign(arg_max(l1, abs(l1))) AS s1, sign(arg_max(l2, abs(l2))) AS s2 FROM loadings),
points AS (
SELECT r.pair_id, r.side, r.word, a.u[r.n] * a.s * s1 AS x, b.u[r.n] * b.s * s2 AS y
FROM numbered r, main1 a, main2 b, signs)"""

UNION_LINES = f"""{BODIES},
talk AS (SELECT conv_id * 4294967296 + turn AS doc_id, text FROM conversations),
every_line AS (
SELECT 0 AS rank, 'documents' AS source, * FROM ({lines_of("documents")})
UNION ALL SELECT 1, 'benchmark', * FROM ({lines_of("benchmark", "item_id")})
UNION ALL SELECT 2, 'conversations', * FROM ({lines_of("talk")})
UNION ALL SELECT 3, 'pages', * FROM ({lines_of("bodies")})),
normal AS (
SELECT rank, source, doc_id, line_no, {normalized("text")} AS text FROM every_line),
union_lines AS (SELECT * FROM normal WHERE source <> 'pages' OR {SEVERAL_FIELDS})"""

UNION_IDS = """ids AS (
SELECT rank, doc_id, row_number() OVER (ORDER BY rank, doc_id) - 1 AS id
FROM (SELECT DISTINCT rank, doc_id FROM union_lines))"""

ORACLES = {
    "text_lines": lines_of("documents"),
    "text_file_lines": f"""WITH {LINES}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS doc_id, text FROM lines""",
    "text_files_appended": f"""
SELECT row_number() OVER (ORDER BY batch, a, b, line_no) - 1 AS doc_id, text FROM (
SELECT 0 AS batch, doc_id AS a, 0 AS b, line_no, text FROM ({lines_of("documents")})
UNION ALL SELECT 1, conv_id, turn, line_no, text FROM ({lines_of("conversations", "conv_id, turn")}))""",
    "token_corpus_file": f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, array_to_string(list_filter({ALPHABETIC},
  lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_')), ' ') AS text FROM documents""",
    "titles_file": f"WITH {PAGES} SELECT title FROM pages_as_wiki",
    "stopword_file_removed": f"""WITH {VOCAB}
SELECT word, cn FROM vocab WHERE word NOT IN ({STOP})""",
    "tokens_space": f"WITH {TOKENS} SELECT * FROM tokens",
    "tokens_phrase": f"WITH {BLANK_TOKENS} SELECT * FROM tokens",
    "tokens_phrase_marks": f"""WITH marked AS (
SELECT doc_id, replace(replace(text, ' de ', chr(9) || ' de' || chr(10)), ' the ', chr(10) || 'the ') AS text FROM documents),
lines AS ({lines_of("marked")}), tokens AS ({tokens_of("lines", blank=True)}) SELECT * FROM tokens""",
    "truncated_tokens": f"""WITH {BLANK_TOKENS},
cut AS (
SELECT *, left(word, list_max(list_filter(range(0, 9), lambda n: strlen(left(word, n)) <= 8))) AS head FROM tokens)
SELECT doc_id, line_no, pos, CASE WHEN strlen(word) <= 8 THEN word
  WHEN strlen(head) < 8 THEN head || chr(65533) ELSE head END AS word FROM cut""",
    "alpha_tokens": f"""
SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS word
FROM (SELECT doc_id, {ALPHABETIC} AS parts FROM documents)""",
    "alpha_tokens_without_stopwords": f"""
SELECT doc_id, array_to_string(
  list_filter({ALPHABETIC}, lambda t: NOT list_contains({STOP_LIST}, t)), ' ') AS text
FROM documents""",
    "word_count_min": f"WITH {VOCAB} SELECT word, cn FROM vocab WHERE cn >= 5",
    "top_words": f"""WITH {VOCAB}
SELECT word, cn FROM vocab WHERE cn >= 5 ORDER BY cn DESC, word LIMIT 50""",
    "vocab_by_count": f"WITH {VOCAB} SELECT word, cn FROM vocab ORDER BY cn DESC, word",
    "vocab_size_and_total": f"""WITH {VOCAB}
SELECT count(*) AS vocab_size, coalesce(sum(cn), 0)::BIGINT AS words_in_corpus
FROM vocab WHERE cn >= 5""",
    "stopword_removed": f"""
SELECT doc_id, array_to_string(
  list_filter({DOC_TOKENS}, lambda t: NOT list_contains({STOP_LIST}, lower(t))), ' ') AS text
FROM documents""",
    "stopword_removed_exact": f"""
SELECT doc_id, array_to_string(
  list_filter({DOC_TOKENS}, lambda t: NOT list_contains({STOP_LIST}, t)), ' ') AS text
FROM documents""",
    "stopword_antijoin_counts": f"""WITH {VOCAB}
SELECT word, cn FROM vocab WHERE word NOT IN ({STOP})""",
    "corpus_stats_metrics": f"""WITH {KEPT}
SELECT 'vocab_size' AS metric, count(*)::DOUBLE AS value FROM vocab WHERE cn >= 5
UNION ALL SELECT 'words_in_corpus', coalesce(sum(cn), 0)::DOUBLE FROM vocab WHERE cn >= 5""",
    "corpus_stats_top": f"""WITH {KEPT}
SELECT word, cn FROM vocab WHERE cn >= 5 ORDER BY cn DESC, word LIMIT 50""",
    "subsample_tokens": f"""WITH {VOCAB},
share AS (
SELECT word, 1e-6 / (cn::DOUBLE / (SELECT count(*) FROM tokens)::DOUBLE) AS ratio FROM vocab)
SELECT doc_id, line_no, pos, word FROM tokens JOIN share USING (word)
WHERE ('0x' || substr(md5('1:' || doc_id || ':' || line_no || ':' || pos), 1, 13))::BIGINT::DOUBLE
  / pow(16, 13) < least(1.0, sqrt(ratio) + ratio)""",
    "subsample_tokens_small_rate": f"""WITH {VOCAB},
share AS (
SELECT word, 1e-8 / (cn::DOUBLE / (SELECT count(*) FROM tokens)::DOUBLE) AS ratio FROM vocab)
SELECT doc_id, line_no, pos, word FROM tokens JOIN share USING (word)
WHERE ('0x' || substr(md5('1:' || doc_id || ':' || line_no || ':' || pos), 1, 13))::BIGINT::DOUBLE
  / pow(16, 13) < least(1.0, sqrt(ratio) + ratio)""",
    "normalize_text": f"""WITH {LINES}
SELECT doc_id, line_no, {normalized("text")} AS text FROM lines""",
    "clean_markup": f"WITH {BODIES} SELECT doc_id, text FROM bodies",
    "clean_markup_redirects": f"WITH {BODIES} SELECT doc_id, text FROM bodies WHERE doc_id % 5 <> 0",
    "visible_multiword_lines": f"""WITH {BODIES}, lines AS ({lines_of("bodies")})
SELECT doc_id, line_no, text FROM lines WHERE {SEVERAL_FIELDS}""",
    "wiki_tokens_filtered": f"WITH {PAGES} {ARTICLE_TOKENS}",
    "wiki_xml_dump": f"WITH {PAGES} {ARTICLE_TOKENS}",
    "corpus_union": f"""WITH {UNION_LINES}
SELECT source, doc_id, line_no, text FROM union_lines""",
    "corpus_numbered": f"""WITH {UNION_LINES}, {UNION_IDS}
SELECT id AS doc_id, source, doc_id AS source_id, string_agg(text, chr(10) ORDER BY line_no) AS text
FROM union_lines JOIN ids USING (rank, doc_id) GROUP BY ALL""",
    "corpus_phrases_end_to_end": f"""WITH {UNION_LINES}, {UNION_IDS},
all_lines AS (SELECT id AS doc_id, line_no, text FROM union_lines JOIN ids USING (rank, doc_id)),
{phrase_ctes("one", "all_lines", 200)},
{phrase_ctes("two", "one_lines", 100)}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS doc_id,
  CASE WHEN text = '' THEN text ELSE ' ' || text END AS text FROM two_lines""",
    "docs_with_pair_tokens": f"SELECT doc_id FROM documents WHERE {PAIR_TOKENS}",
    "docs_with_pair_substring": f"SELECT doc_id FROM documents WHERE {PAIR_SUBSTRINGS}",
    "docs_with_long_pair_list_tokens": f"""WITH {VOCAB}, {MANY_PAIRS},
own AS (SELECT DISTINCT doc_id, word FROM tokens)
SELECT DISTINCT a.doc_id FROM pairs JOIN own a ON a.word = word1
JOIN own b ON b.word = word2 AND b.doc_id = a.doc_id""",
    "docs_with_long_pair_list_substring": f"""WITH {VOCAB}, {MANY_PAIRS}
SELECT DISTINCT doc_id FROM documents JOIN pairs ON contains(text, word1) AND contains(text, word2)""",
    "first_n_matching_docs": f"""
SELECT doc_id, text FROM documents WHERE {PAIR_SUBSTRINGS} ORDER BY doc_id LIMIT 20""",
    "pair_article_corpus": f"""
SELECT doc_id, array_to_string({ALPHABETIC}, ' ') AS text FROM documents
WHERE {PAIR_TOKENS} ORDER BY doc_id LIMIT 20""",
    "pages_by_title": f"""WITH {PAGES},
keyed AS (
SELECT doc_id, text, replace(replace(title, chr(10), ''), ' ', '_') AS title_key FROM pages_as_wiki)
SELECT doc_id, title_key, lower(text) AS text FROM keyed
WHERE title_key IN (SELECT title_key FROM keyed WHERE contains(text, '<html lang="en">'))""",
    "bigram_vocab_crossline": f"""WITH {BLANK_TOKENS}, {vocabulary_ctes("one", "tokens", True)}
SELECT key, cn FROM one_vocab""",
    "bigram_vocab_line": f"""WITH {BLANK_TOKENS}, {vocabulary_ctes("one", "tokens", False)}
SELECT key, cn FROM one_vocab""",
    "corpus_words": f"WITH {BLANK_TOKENS} SELECT count(*) AS words FROM tokens",
    "phrase_scores": f"""WITH {BLANK_TOKENS}, {score_ctes("one", "tokens", True)}
SELECT prev, word, pa, pb, pab, round(score, 6) AS score FROM one_scores""",
    "phrase_scores_second_pass": f"""WITH {LINES}, {phrase_ctes("one", "lines", 200)},
two_tokens AS MATERIALIZED ({tokens_of("one_lines", blank=True)}), {score_ctes("two", "two_tokens", True)}
SELECT prev, word, pa, pb, pab, round(score, 6) AS score FROM two_scores""",
    "phrase_scores_single": f"""WITH {BLANK_TOKENS}, {score_ctes("one", "tokens", True)}
SELECT prev, word, pa, pb, pab, CAST(CAST(CAST(CAST(pab - 5 AS FLOAT) / CAST(pa AS FLOAT) AS FLOAT)
  / CAST(pb AS FLOAT) AS FLOAT) * CAST((SELECT count(*) FROM tokens) AS FLOAT) AS DOUBLE) AS score
FROM one_scores""",
    "phrase_joined_lines": f"""WITH {LINES}, {phrase_ctes("one", "lines", 100)}
SELECT * FROM one_lines""",
    "phrase_joined_lines_line_counts": f"""WITH {LINES}, {phrase_ctes("one", "lines", 100, False)}
SELECT * FROM one_lines""",
    "phrase_two_pass": f"""WITH {LINES}, {phrase_ctes("one", "lines", 200)},
{phrase_ctes("two", "one_lines", 100)}
SELECT * FROM two_lines""",
    "phrase_text_file": f"""WITH {LINES}, {phrase_ctes("one", "lines", 100)}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS doc_id,
  CASE WHEN text = '' THEN text ELSE ' ' || text END AS text FROM one_lines""",
    "rated_pairs_file": f"WITH {RATED} SELECT 'made up' AS dataset, word1, word2, score FROM rated",
    "analogy_pairs_file": f"WITH {ANALOGY_PAIRS} SELECT word1, word2 FROM pairs",
    "rated_pairs_file_order": f"""WITH {RATED}
SELECT 'made up' AS dataset, row_number() OVER (ORDER BY line_no) - 1 AS line_no, word1, word2, score FROM rated""",
    "analogy_pairs_file_order": f"""WITH {ANALOGY_PAIRS}
SELECT row_number() OVER (ORDER BY pair_id DESC) - 1 AS pair_id, word1, word2 FROM pairs""",
    "vector_lookup_zero_fill": f"""WITH {VECTORS}, {RATED}, {FILLED.format("rated")}
SELECT dataset, line_no, word1, word2, round({NORM.format("vector1")}, 6) AS norm1,
  round({NORM.format("vector2")}, 6) AS norm2 FROM filled""",
    "nonzero_vectors": f"""WITH {VECTORS}, {RATED}
SELECT word, round({NORM.format("vector")}, 6) AS norm FROM vectors
WHERE word IN (SELECT word1 FROM rated UNION SELECT word2 FROM rated)
  AND len(list_filter(vector, lambda x: x <> 0)) > 0""",
    "nonzero_vectors_zeroed": f"""WITH {VECTORS}, {RATED}
SELECT word, round({NORM.format("vector")}, 6) AS norm FROM vectors
WHERE word IN (SELECT word1 FROM rated UNION SELECT word2 FROM rated) AND word::BIGINT % 3 <> 0
  AND len(list_filter(vector, lambda x: x <> 0)) > 0""",
    "cosine_pairs": f"""WITH {VECTORS}, {RATED}, {KNOWN}
SELECT line_no, word1, word2, round({similarity("vector1", "vector2")}, 6) AS similarity,
  round(1 - {similarity("vector1", "vector2")}, 6) AS distance FROM known""",
    "nearest_k": nearest(False, 6),
    "nearest_k_exclude_self": nearest(True, 6),
    "nearest_k_unknown": nearest(True, 6, "word2"),
    "synonym_report": nearest(True, 4),
    "analogy_offset": f"WITH {answers(False)} {REPORT}",
    "analogy_unit_mean": f"WITH {answers(True)} {REPORT}",
    "analogy_accuracy_offset": f"WITH {answers(False)} {ACCURACY}",
    "analogy_accuracy_unit_mean": f"WITH {answers(True)} {ACCURACY}",
    "doc_embedding_mean": f"""WITH {VOCAB},
coded AS (
SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT
  % ((SELECT count(*) FROM embeddings) * 2) AS vec_id FROM vocab),
sizes AS (SELECT doc_id, count(*) AS n_tokens FROM tokens GROUP BY doc_id),
used AS (
SELECT t.doc_id, c.vec_id, count(*) AS n FROM tokens t JOIN coded c USING (word)
JOIN embeddings USING (vec_id) GROUP BY t.doc_id, c.vec_id),
dims AS (
SELECT vec_id, unnest(range({DIM})) AS dim, unnest(embedding::DOUBLE[]) AS value FROM embeddings),
sums AS (
SELECT u.doc_id, d.dim, sum(u.n * d.value) AS total
FROM used u JOIN dims d USING (vec_id) GROUP BY u.doc_id, d.dim)
SELECT s.doc_id, s.n_tokens, d.dim,
  round(coalesce(sums.total, 0.0) / s.n_tokens, 6) AS value
FROM sizes s CROSS JOIN (SELECT unnest(range({DIM})) AS dim) d
LEFT JOIN sums ON sums.doc_id = s.doc_id AND sums.dim = d.dim""",
    "spearman_positional": f"WITH {VECTORS}, {SCORES} SELECT * FROM rho",
    "pair_coverage": f"""WITH {VECTORS}, {RATED}, {KNOWN}
SELECT r.dataset, count(*) AS n_pairs,
  (SELECT count(*) FROM known k WHERE k.dataset = r.dataset) AS coverage
FROM rated r GROUP BY r.dataset""",
    "pca_points": f"""WITH RECURSIVE {MAP}
SELECT pair_id, side, word, round(x, 6) AS x, round(y, 6) AS y FROM points""",
    "pca_segments": f"""WITH RECURSIVE {MAP}
SELECT a.pair_id, a.word AS word1, round(a.x, 6) AS x1, round(a.y, 6) AS y1,
  b.word AS word2, round(b.x, 6) AS x2, round(b.y, 6) AS y2
FROM points a JOIN points b USING (pair_id) WHERE a.side = 1 AND b.side = 2""",
    "evaluation_metrics": f"""WITH {answers(False)}, {SCORES},
accuracy AS ({ACCURACY})
SELECT 'n_correct' AS metric, n_correct::DOUBLE AS value FROM accuracy
UNION ALL SELECT 'n_pairs', n_pairs::DOUBLE FROM accuracy
UNION ALL SELECT 'n_answered', n_answered::DOUBLE FROM accuracy
UNION ALL SELECT dataset || ':rho', rho FROM rho
UNION ALL SELECT dataset || ':coverage', coverage::DOUBLE FROM rho""",
    "sampled_sentences": f"""WITH {LINES},
parts AS (
SELECT doc_id, line_no,
  list_filter({ALPHABETIC}, lambda t: NOT list_contains({STOP_LIST}, t)) AS tokens FROM lines),
tokens AS (
SELECT doc_id, line_no, unnest(range(len(tokens))) AS pos, unnest(tokens) AS word FROM parts),
share AS (
SELECT word, 1e-6 / (count(*)::DOUBLE / (SELECT count(*) FROM tokens)::DOUBLE) AS ratio
FROM tokens GROUP BY word)
SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY pos) AS text FROM tokens JOIN share USING (word)
WHERE ('0x' || substr(md5('1:' || doc_id || ':' || line_no || ':' || pos), 1, 13))::BIGINT::DOUBLE
  / pow(16, 13) < least(1.0, sqrt(ratio) + ratio)
GROUP BY doc_id, line_no""",
    "w2v_fit_sampled": f"""WITH {LINES},
parts AS (
SELECT doc_id, line_no,
  list_filter({ALPHABETIC}, lambda t: NOT list_contains({STOP_LIST}, t)) AS tokens FROM lines),
tokens AS (
SELECT doc_id, line_no, unnest(range(len(tokens))) AS pos, unnest(tokens) AS word FROM parts),
share AS (
SELECT word, 1e-3 / (count(*)::DOUBLE / (SELECT count(*) FROM tokens)::DOUBLE) AS ratio
FROM tokens GROUP BY word)
SELECT word, 16::BIGINT AS dim FROM tokens JOIN share USING (word)
WHERE ('0x' || substr(md5('1:' || doc_id || ':' || line_no || ':' || pos), 1, 13))::BIGINT::DOUBLE
  / pow(16, 13) < least(1.0, sqrt(ratio) + ratio)
GROUP BY word HAVING count(*) >= 20""",
    "w2v_fit_vectors": f"""WITH {KEPT}
SELECT word, 32::BIGINT AS dim, true AS nonzero FROM vocab WHERE cn >= 20""",
    "w2v_transform": f"""WITH {KEPT}
SELECT doc_id, bool_or(coalesce(v.cn, 0) >= 20) AS nonzero
FROM tokens LEFT JOIN vocab v USING (word) GROUP BY doc_id""",
    "w2v_word_lookup": f"""WITH {VOCAB}
SELECT word, cn >= 20 AND lower(word) NOT IN ({STOP}) AS nonzero FROM vocab WHERE cn >= 5""",
    "w2v_nearest_shape": f"""WITH {KEPT},
top AS (SELECT word, cn FROM vocab WHERE cn >= 5 ORDER BY cn DESC, word LIMIT 10)
SELECT word AS query, unnest(range(1, 6)) AS rank, true AS known, false AS is_self, true AS falls
FROM top WHERE cn >= 20""",
    "w2v_save_load": f"WITH {KEPT} SELECT word, 0.0::DOUBLE AS gap FROM vocab WHERE cn >= 20",
}
