"""SQL texts of the queries of this package that SQL can express."""

ORACLES: dict[str, str] = {}

# A-Z to a-z, then words; null has none.
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op10_decontamination"] = f"""
WITH item AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, least(i + 12, len(w))) AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
lens AS (SELECT DISTINCT len(p) AS n FROM win),
place AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM doc, lens)
),
hit AS (SELECT place.doc_id, place.i, place.n, win.item_id FROM place JOIN win USING (p)),
hit_word AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hit),
words AS (SELECT doc_id, count(*) AS n_hit FROM hit_word GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op9_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op2_url_filter"] = """
WITH rules(rule, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
    ('com/fr/', 'allow'), ('com/de/', 'block')
),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
u AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM cut
),
m AS (
  SELECT u.n, rule, verdict, row_number() OVER (PARTITION BY u.n ORDER BY length(rule) DESC, verdict DESC) AS r
  FROM u JOIN rules ON starts_with(path, substr(rule, strpos(rule, '/')))
    AND (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON m.n = u.n AND m.r = 1
"""

ORACLES["op8_jaccard"] = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r
)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, least_id AS component_id
FROM doc LEFT JOIN size USING (doc_id)
JOIN (SELECT doc_id, min(r) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same
  ) WHERE r <= 5
),
n AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

# An unsigned crc32 of a number's decimal digits, a list of codes of its characters at a time.
CRC32 = """xor(4294967295, list_reduce(
    list_transform(range(0, len(d) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(d[i]) END),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


ORACLES["op13_manifest"] = f"""
WITH RECURSIVE named AS (
  SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, CAST(doc_id AS VARCHAR) AS d FROM documents
),
summed AS (SELECT *, CAST({CRC32} AS BIGINT) AS crc FROM named),
leaf AS (
  SELECT doc_id, g, {_leaf('n_chars')} AS leaf,
    CASE WHEN crc % 7 = 0 THEN {_leaf('(CAST(n_chars AS HUGEINT) + 1)')} ELSE {_leaf('n_chars')} END AS claimed
  FROM summed
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
),
low(g, l, i, node) AS (
  SELECT g, 0, pos, leaf FROM placed
  UNION ALL
  SELECT g, l + 1, i // 2, sha256(string_agg(node, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM low) WHERE c > 1 GROUP BY g, l, i // 2
),
roots AS (
  SELECT g, arg_max(node, l) AS subroot, max(l) AS height, row_number() OVER (ORDER BY g) - 1 AS gpos FROM low GROUP BY g
),
high(l, i, node) AS (
  SELECT 0, gpos, subroot FROM roots
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(node, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM high) WHERE c > 1 GROUP BY l, i // 2
),
top AS (SELECT arg_max(node, l) AS root, max(l) AS height FROM high),
nodes AS (
  SELECT g, l, i, node FROM low JOIN roots USING (g) WHERE l < height
  UNION ALL
  SELECT g, roots.height + high.l, i, node FROM roots, high, top WHERE high.l < top.height
),
fold(g, pos, gpos, low_height, height, l, folded, proof) AS (
  SELECT g, pos, gpos, roots.height, roots.height + top.height, 0, claimed, ''
  FROM placed JOIN roots USING (g), top
  UNION ALL
  SELECT f.g, pos, gpos, low_height, f.height, f.l + 1,
    sha256(CASE WHEN own % 2 = 1 THEN coalesce(s.node, '') || folded ELSE folded || coalesce(s.node, '') END),
    proof || coalesce(s.node, '')
  FROM (
    SELECT *, CASE WHEN l < low_height THEN pos >> l ELSE gpos >> (l - low_height) END AS own FROM fold WHERE l < height
  ) f LEFT JOIN nodes s ON s.g = f.g AND s.l = f.l AND s.i = xor(own, 1)
)
SELECT p.doc_id, p.leaf, roots.subroot, top.root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root,
  f.folded = top.root AS verified
FROM placed p JOIN roots USING (g) JOIN fold f ON f.g = p.g AND f.pos = p.pos AND f.l = f.height, top
"""
