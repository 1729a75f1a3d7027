"""Secret scans with a random forest against false positives, as DataFrame operations.

Candidates are the values given to a credential's name, of any characters from
four on, and long runs of token characters.  A text is taken apart into
candidates and the gaps between them inside its row, so neighbours and offsets
need no join.  A random forest, fitted on labelled findings, votes on each
candidate by its length, character transitions, dictionary coverage, path and
neighbouring words; the fitted trees are column expressions, so scoring stays
in the row as well and no text is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize
from corpusloom.sources.stopwords import language_stopwords

# Names that a credential's value is given to, and what may stand between a name and its value: the rest of the
# name, a type, closing quotes and brackets, a sign of assignment, an opening quote.
SECRET_NAME = "pass ?word|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key"
NAME = SECRET_NAME + "|auth|credential|client[ _-]?id|signature"
REST = "s?(?:[_-][A-Za-z0-9]{1,12})?(?:[_-][A-Za-z0-9]{1,12})?(?:key|value|hash|string|[0-9]{1,4})?"
OPEN = "(?:[(frbuFRBU@]{0,2}\\\\{0,2}[\"'`])?"
SIGN = (
    "(?:[ \\t]{0,2}:[ \\t]{0,2}[A-Za-z]{1,10}(?=[ \\t]{0,2}=))?(?:\\\\{0,2}[\"'`])?[\\])]?[ \\t]{0,12}"
    "(?:[:=]{1,2}>?|>)[ \\t]{0,4}" + OPEN
)
HEADER = "(?:bearer|authorization[\"']?[ \\t]{0,2}[:=][ \\t]{0,2}[\"']?(?:basic|token|digest|apikey))[ \\t]{1,4}[\"']?"
# Long runs of token characters are candidates wherever they stand.
RUN = "[A-Za-z0-9_+/-]{16,}"
# A value: between escaped quotes; between quotes, with spaces only if no run is inside, which would be a candidate
# of its own; else up to a space, quote or angle bracket, or a comma, semicolon or ampersand before a next value.
_QUOTED = (
    "(?<=[^\\\\]{q})(?:(?:[^{q}\\\\\\s]|\\\\\\S){4,512}|(?![^{q}\\r\\n]{0,512}" + RUN + ")(?:[^{q}\\\\\\r\\n]|\\\\.){4,512})(?={q})"
)
_PLAIN = "[^\\s\"'`<>,;&]+"
VALUE = "|".join([
    "(?<=\\\\[\"'])[^\"'\\\\\\r\\n]{4,512}(?=\\\\[\"'])",
    *[_QUOTED.replace("{q}", q) for q in "\"'`"],
    "(?![=:~|])(?=[^\\s\"'`<>]{4})" + _PLAIN + "(?:[,;&]+(?![\\w.-]{1,32}=)" + _PLAIN + "){0,64}(?<![.:)\\]}\\\\])",
])
# A candidate: a value behind a name (the first tests are cheap and rule out most places), or a run with padding.
CANDIDATE = (
    "(?<=[=:>\"'`\\s])(?:(?<=[=:>][ \\t]{0,4}" + OPEN + ")(?<=(?i:" + NAME + ")" + "(?i:" + REST + ")" + SIGN + ")"
    "|(?<=(?i:" + HEADER + ")))(?:" + VALUE + ")"
    "|(?<![A-Za-z0-9_+/-])" + RUN + "={0,2}"
)
# Characters of the gaps beside a candidate that its features look at.
BESIDE = 48
# Labelled findings of each class that the forest is fitted on, its trees, their depth.
SAMPLE = 10_000
# A class with fewer distinct findings than this gets the fixed ones besides.
SPARSE = 100
TREES = 15
DEPTH = 5
MARK = "[SECRET]"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Frequent letter pairs of running text.
PAIRS = (
    "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro"
    "|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|ei|ie|un|ge|sc|au|qu|ue|ai|la|el|os|ad|do|ci|ca|pa"
)
CREDENTIAL = (
    "(?i)(pass ?word|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|auth|bearer|credential|private"
    "[ _-]?key|client[ _-]?id|signature)s?\\W*$"
)
EXAMPLE = "(?i)(example|sample|dummy|placeholder|test|fake|xxxx|changeme|your[_-])"
TEST_PATH = "(?i)(^|[/_.-])(test|tests|spec|example|examples|sample|docs?|mock|fixture|fixtures|vendor)([/_.-]|$)"
# Published forms of issued credentials.
ISSUED = "^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^[sr]k_(live|test)_[A-Za-z0-9]{16,}$|^xox[abprs]-"
# A name, what may close it, and a sign, or an authorization scheme, right before a value.
ASSIGNED = "(?i)(?:(?:" + SECRET_NAME + ")" + REST + SIGN + "|" + HEADER + ")$"
# What a name is given in code and prose in place of a secret: a word, a literal, a reference, a call, a mask.
NO_VALUE = (
    "^[A-Z]?[a-z]{1,15}$|(?i)^(true|false|null|none|nil|undefined|string|required|optional)$|^[$%{<]|^[*x.#-]+$"
    "|^(self|this|os|env|process|config|settings|request|req|args|options)[.\\[]|^[A-Za-z_][\\w.]*[(\\[]"
)

FINDING = "candidate string, left string, right string, path string, secret int"


def dictionary() -> list[str]:
    """Words of four letters and more of the stop lists, longest first."""
    words = {w.lower() for language in ("en", "de", "es", "fr") for w in language_stopwords(language)}
    words |= {"tion", "ment", "ing", "ción", "keit", "ungen"}
    return sorted((w for w in words if len(w) >= 3 and re.fullmatch("[a-z]+", w)), key=lambda w: (-len(w), w))


def _share(part: Column, of: Column) -> Column:
    return F.length(part) / F.greatest(F.length(of), F.lit(1))


def _without(c: Column, letters: str) -> Column:
    """The characters of ``letters`` in ``c``, by their number: what is left when they are removed."""
    return 1 - _share(F.translate(c, letters, ""), c)


def features(c: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """What the forest looks at, as numbers without nulls."""
    lower = F.lower(c)
    classes = F.translate(c, UPPER + LOWER + DIGITS, "A" * 26 + "a" * 26 + "0" * 10)
    runs = F.length(F.regexp_replace(classes, "(.)\\1+", "$1")) - 1
    yes = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    columns = [
        # length and make-up
        F.length(c),
        F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1)),
        _without(c, UPPER),
        _without(c, LOWER),
        _without(c, DIGITS),
        # character transitions: changes of class, pairs that running text has
        runs / F.greatest(F.length(c), F.lit(1)),
        1 - _share(F.regexp_replace(lower, PAIRS, ""), c),
        # dictionary coverage
        1 - _share(F.regexp_replace(lower, "|".join(dictionary()), ""), c),
        # path and neighbouring words
        yes(path.rlike(TEST_PATH)),
        yes(left.rlike(CREDENTIAL)),
        yes(left.rlike("[=:]\\s*[\"']?$")),
        yes(left.rlike("[\"']$") & right.rlike("^[\"']")),
        yes(left.rlike("\\p{L}$") | right.rlike("^\\p{L}")),
        yes(right.rlike("^[.]?[a-z0-9]*@|^[.]") | left.rlike("@$|[.]$")),
        yes(F.concat_ws(" ", left, c, right).rlike(EXAMPLE)),
        # published forms, and what stands in place of a secret
        yes(c.rlike(ISSUED)),
        yes(c.rlike(NO_VALUE)),
    ]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in columns]


def take_apart(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """Rows of ``docs`` with their ``candidates`` and the ``gaps`` before, between and after them.

    ``items`` joins each candidate with its neighbourhood: ``c, left, right``.
    The result has ``doc_id, path, text`` and these arrays.
    """
    known = path is not None and path.lower() in [c.lower() for c in docs.columns]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.col(path).cast("string") if known else F.lit(None).cast("string")).alias("path"),
    )
    return _arrays(rows)


def _arrays(rows: DataFrame) -> DataFrame:
    """Add ``candidates``, ``gaps`` and ``items`` to rows with ``text``; each is computed once, above a generator."""
    kept = rows.columns
    found = rows.select(*kept, F.explode(F.array(F.regexp_extract_all("text", F.lit(CANDIDATE), 0))).alias("candidates"))
    gaps = F.when(F.size("candidates") > 0, F.split("text", CANDIDATE, -1)).otherwise(F.array("text"))
    cut = found.select(*kept, "candidates", F.explode(F.array(gaps)).alias("gaps"))
    items = F.transform(
        "candidates",
        lambda c, i: F.struct(
            c.alias("c"),
            # a candidate may stand right behind another one, as a value behind a long name
            F.substring(
                F.concat(F.when(i > 0, F.get("candidates", i - 1)).otherwise(""), F.get("gaps", i)), -BESIDE, BESIDE
            ).alias("left"),
            F.substring(F.get("gaps", i + 1), 1, BESIDE).alias("right"),
        ),
    )
    return cut.select(*kept, "candidates", "gaps", items.alias("items"))


def findings_by_form(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """Findings labelled by their form, for tables without findings that people have labelled.

    Issued credentials, and mixed tokens assigned to a credential's name, are
    secrets.  Plain words, numbers, parts of addresses, and references and
    literals assigned to a name are not.  What is neither is not a labelled finding.
    """
    each = take_apart(docs, path).select("path", F.inline("items"))
    assigned = F.col("left").rlike(ASSIGNED)
    mixed = F.col("c").rlike("[0-9]") & F.col("c").rlike("[A-Za-z]")
    positive = F.col("c").rlike(ISSUED) | (assigned & mixed & ~F.col("c").rlike(NO_VALUE))
    negative = F.col("c").rlike("^[A-Z]?[a-z]+$|^[A-Z]+$|^[0-9]+$|^[A-Z]?[a-z]+([_/-][A-Za-z]?[a-z]+)+$")
    negative = (negative | F.col("right").startswith("@")) & ~assigned
    # a quoted word may be a password
    negative = negative | (assigned & F.col("c").rlike(NO_VALUE) & ~F.col("left").rlike("[\"'`]$"))
    return each.select(
        F.col("c").alias("candidate"),
        "left",
        "right",
        "path",
        F.when(positive, 1).when(negative, 0).alias("secret"),
    ).where("secret IS NOT NULL")


def fixed_findings(secret: int) -> list[dict]:
    """Labelled findings of one class that every table may lend: made-up values in usual places.

    Secrets are digests, passwords and passphrases given to a credential's name, in code, JSON, headers and
    settings, and issued forms in running text.  What is none are words, joined words, paths, numbers and parts of
    addresses in running text, and words, literals, references and calls given to a name.
    """
    words = [w for w in dictionary() if len(w) >= 4]
    out = []
    for i in range(240):
        digest = hashlib.sha256(f"{secret} {i}".encode()).hexdigest()
        some = [words[int(digest[k : k + 4], 16) % len(words)] for k in range(0, 24, 4)]
        mixed = "".join(chr(ord("A") + int(x, 16)) if k % 3 else x for k, x in enumerate(digest))
        prose, after = f"{some[4]} {some[5]} ", f" {some[3]} {some[2]}"
        places = [
            ("password=", " "), ('token = "', '"'), ('{"token": "', '", "'), ("pwd: ", "\n"), ("api_key='", "'"),
            ("Authorization: Bearer ", '"'), ("DB_PASSWORD=", "\n"), ('"secret" : "', '"}'),
        ]
        if secret:
            issued = [f"AKIA{mixed[:16].upper()}", f"ghp_{mixed[:36]}", f"sk_live_{digest[:24]}", f"xoxb-{digest[:12]}-{mixed[:20]}"]
            values = [
                digest[:12], digest[:18], digest[:40], digest[:32].upper(), mixed[:24].swapcase() + "==", f"{some[0]}{i}",
                f"{some[0].title()}{i % 90 + 10}&{digest[:3]}!", f"{some[0]}.{some[1]}.{some[2]}", f"{some[0]}-{some[1]}-{i}",
                f"{some[0]} {some[1]} {some[2]}",
            ]
            left, right = places[i % len(places)]
            if i % 6 == 5:
                candidate, left, right = issued[i // 6 % len(issued)], prose, after
            else:
                candidate = values[i // 2 % len(values)]
        else:
            values = [
                "".join(some[:4]), "_".join(some[:4]), "/".join(some[:4]), "-".join(some[:4]).title(), digest.translate(
                    {ord(c): str(k) for k, c in enumerate("abcdef")})[:20], "".join(some[:4]).upper(),
                some[0] + "".join(w.title() for w in some[1:4]), "".join(some[:2]) + digest[:12],
            ]
            given = [
                some[0], "true", "None", "string", f"get{some[0].title()}(", f"${{{some[1].upper()}}}", f"os.environ[{some[2]}",
                f"config.{some[0]}", "********", f"{some[0]}.{some[1]}(",
            ]
            candidate, left, right = values[i // 2 % len(values)], prose, after
            if candidate == values[-1]:
                right = "@example.com"
            if i % 2:
                candidate, left, right = given[i // 2 % len(given)], ("password: ", "token = ", "secret=", "auth: ")[i % 8 // 2], " "
        out.append({"candidate": candidate, "left": left, "right": right, "path": None})
    return out


@dataclass(frozen=True)
class Leaf:
    vote: float


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    low: Leaf | Split
    high: Leaf | Split


def read_tree(lines: list[str]) -> Leaf | Split:
    """A tree from the indented text that the fitted model gives of it; takes its lines off the list."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return Leaf(float(line.split(":")[1]))
    feature, threshold = re.search(r"feature (\d+) <= (\S+)\)", line).groups()
    low = read_tree(lines)
    lines.pop(0)  # the else line
    return Split(int(feature), float(threshold), low, read_tree(lines))


def fit_forest(
    findings: DataFrame,
    sample: int = SAMPLE,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = 7,
    always: bool = False,
) -> list[Leaf | Split]:
    """A random forest of ``findings`` (candidate, left, right, path, secret 0 or 1).

    It is fitted on at most ``sample`` distinct findings of each class, drawn by
    hash.  A class with fewer than `SPARSE` of them gets those of
    `fixed_findings` besides, so that no verdict is constant.  With no findings
    at all, every candidate is a secret, so nothing is missed; with ``always``
    the forest is then fitted on the fixed ones alone.
    """
    plain = findings.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FINDING.split(", ")])
    plain = materialize(plain.where("candidate IS NOT NULL AND secret IN (0, 1)"), "findings")
    text = ["candidate", "left", "right", "path"]
    counts = {r["secret"]: r["count"] for r in plain.distinct().groupBy("secret").count().collect()}
    if not counts and not always:
        return [Leaf(1.0)]
    drawn = None
    for secret in (0, 1):
        # equal findings count once; contradicting ones count on both sides
        own = plain.where(F.col("secret") == secret).select(*text).distinct()
        own = own.withColumn("h", F.xxhash64(*text)).orderBy("h", *text).limit(sample).drop("h")
        if counts.get(secret, 0) < SPARSE:
            fixed = F.from_json(F.lit(json.dumps(fixed_findings(secret))), f"array<struct<{FINDING.rpartition(',')[0]}>>".replace(" string", ":string"))
            own = own.unionByName(findings.sparkSession.range(1).select(F.inline(fixed)))
        own = own.withColumn("label", F.lit(float(secret)))
        drawn = own if drawn is None else drawn.unionByName(own)
    columns = features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path"))
    names = [f"f{i}" for i in range(len(columns))]
    # few rows, read many times: a few files
    rows = materialize(drawn.select("label", *[c.alias(n) for c, n in zip(columns, names)]).coalesce(4), "forest-sample")
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(ready)
    return [read_tree(tree.toDebugString.splitlines()[1:]) for tree in model.trees]


def forest_by_form(docs: DataFrame, path: str | None = "source") -> list[Leaf | Split]:
    """The forest for ``docs`` that no people have labelled findings of."""
    return fit_forest(findings_by_form(docs, path), always=True)


def votes(forest: list[Leaf | Split], values: list[Column]) -> Column:
    """Share of the trees that vote for a secret, as a column expression."""

    def vote(node: Leaf | Split) -> Column:
        if isinstance(node, Leaf):
            return F.lit(node.vote)
        return F.when(values[node.feature] <= node.threshold, vote(node.low)).otherwise(vote(node.high))

    return sum((vote(t) for t in forest), F.lit(0.0)) / len(forest)


def _scored(parts: DataFrame, forest: list[Leaf | Split], threshold: float) -> Column:
    """The items with ``score`` and ``secret``."""

    def measured(item: Column) -> Column:
        return F.struct(
            item["c"].alias("c"),
            F.array(*features(item["c"], item["left"], item["right"], F.col("path"))).alias("f"),
        )

    def judged(item: Column) -> Column:
        n = len(features(F.lit(""), F.lit(""), F.lit(""), F.lit("")))
        score = votes(forest, [F.get(item["f"], i) for i in range(n)])
        return F.struct(item["c"].alias("candidate"), score.alias("score"))

    scored = F.transform(F.transform("items", measured), judged)
    return F.transform(scored, lambda s: F.struct(s["candidate"], s["score"], (s["score"] >= threshold).alias("secret")))


def _starts(scored: DataFrame) -> DataFrame:
    """``doc_id, found, starts``: where each candidate starts, by the lengths of all before it.

    A running sum copies what it has gathered, so it is taken in blocks of as
    many candidates as the cube root of their number, and over the blocks.
    """
    lengths = F.zip_with(
        F.slice("gaps", 1, F.size("candidates")),
        "candidates",
        lambda g, c: F.struct(F.length(g).cast("long").alias("gap"), F.length(c).cast("long").alias("own")),
    )
    none = F.array().cast("array<long>")

    def running(items: Column, before: Callable[[Column], Column], size: Callable[[Column], Column]) -> Column:
        """``at``, the sum of ``size`` of all items, and ``starts``, that of the items before each and its ``before``."""
        return F.aggregate(
            items,
            F.struct(F.lit(0).cast("long").alias("at"), none.alias("starts")),
            lambda s, x: F.struct(
                (s["at"] + size(x)).alias("at"), F.concat(s["starts"], F.array(s["at"] + before(x))).alias("starts")
            ),
        )

    each = scored.select("doc_id", "found", F.explode(F.array(lengths)).alias("lengths"))
    block = F.greatest(F.ceil(F.cbrt(F.size("lengths"))).cast("int"), F.lit(1))
    each = each.select("doc_id", "found", "lengths", F.explode(F.array(block)).alias("block"))
    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("lengths"), F.lit(1)), F.col("block")),
        lambda first: running(
            F.slice("lengths", first, F.col("block")), lambda x: x["gap"], lambda x: x["gap"] + x["own"]
        ),
    )
    each = each.select("doc_id", "found", F.explode(F.array(blocks)).alias("blocks"))
    offsets = running(F.col("blocks"), lambda x: F.lit(0), lambda x: x["at"])["starts"]
    each = each.select("doc_id", "found", "blocks", F.explode(F.array(offsets)).alias("offsets"))
    starts = F.flatten(
        F.transform("blocks", lambda b, i: F.transform(b["starts"], lambda x: x + F.get("offsets", i)))
    )
    return each.select("doc_id", "found", F.explode(F.array(starts)).alias("starts"))


def scan_secrets(
    docs: DataFrame, forest: list[Leaf | Split], path: str | None = "source", threshold: float = 0.5
) -> DataFrame:
    """Findings of every document: ``doc_id, findings`` with an entry for each candidate in order.

    A finding has ``start`` and ``end`` (characters), ``candidate``, ``score``
    (share of the trees) and ``secret``.

    Null and empty texts have no findings.  Rows that repeat a doc_id, or have
    none, are scanned each on its own.  ``path`` names a column that may be
    missing or null.  Other columns are ignored; an empty table gives no rows.
    """
    parts = take_apart(docs, path)
    scored = parts.select("doc_id", "gaps", "candidates", F.explode(F.array(_scored(parts, forest, threshold))).alias("found"))
    placed = _starts(scored)
    findings = F.transform(
        "found",
        lambda s, i: F.struct(
            F.get("starts", i).alias("start"),
            (F.get("starts", i) + F.length(s["candidate"])).cast("long").alias("end"),
            s["candidate"].alias("candidate"),
            s["score"].alias("score"),
            s["secret"].alias("secret"),
        ),
    )
    return placed.select("doc_id", findings.alias("findings"))


def mask_secrets(
    docs: DataFrame,
    forest: list[Leaf | Split],
    path: str | None = "source",
    threshold: float = 0.5,
    mark: str = MARK,
) -> DataFrame:
    """``docs`` with ``mark`` in place of each secret; all columns, and null texts, stay.

    An ``n_chars`` column follows the text.
    """
    columns = docs.columns
    known = path is not None and path in columns
    # own names, that cannot clash with those of the table
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = docs.select(
        row,
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.col(path).cast("string") if known else F.lit(None).cast("string")).alias("path"),
    )
    parts = _arrays(rows)
    scored = parts.select("row", "text", "gaps", F.explode(F.array(_scored(parts, forest, threshold))).alias("found"))
    pieces = F.transform(
        "gaps",
        lambda g, i: F.concat(
            g,
            F.coalesce(
                F.when(F.get("found", i)["secret"], F.lit(mark)).otherwise(F.get("found", i)["candidate"]), F.lit("")
            ),
        ),
    )
    masked = F.when(F.exists("found", lambda s: s["secret"]), F.array_join(pieces, "")).otherwise(F.col("text"))
    done = scored.select("row", F.explode(F.array(F.when(F.col("row.text").isNotNull(), masked))).alias("masked"))
    out = []
    for c in columns:
        if c == "text":
            out.append(F.col("masked").cast(docs.schema[c].dataType).alias(c))
        elif c == "n_chars":
            changed = ~F.col("masked").eqNullSafe(F.col("row.text"))
            out.append(F.when(changed, F.length("masked")).otherwise(F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return done.select(*out)
