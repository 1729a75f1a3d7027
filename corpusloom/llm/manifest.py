"""Merkle tree over a dataset, with a proof for every row.

Rows are leaves.  The leaves of a group, in the order of their ids, are the
lowest level of its tree; every two consecutive nodes of a level (the last run
may be one) have a parent, until one node is left, the group's root.  The
groups' roots, in the order of the groups, are the leaves of one more such
tree, whose root stands for the dataset.

A level is kept as one string: the hex digests of its nodes, one after the
other.  An aligned block of BLOCK leaves is a row that holds all its levels;
a parent is the hash of a substring of fixed width, and the siblings on the
way up are the substrings beside it.  What a block cannot know lies above its
root: the roots of all blocks are the nodes of the next table of blocks, and
so on until every group is one node.  No task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_of, lookup, materialize
from corpusloom.operators.ordering import prefix_sum, slices_for

# Leaves of a block, a power of two, and its levels above them.
BLOCK = 1024
LEVELS = BLOCK.bit_length() - 1
# Hex digits of a digest.
DIGITS = 64

# Siblings of one level: the nodes of the run before and after a node, as text.
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' concatenation, as lowercase hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, ``:``, and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    """Digest of a row from the columns' values."""
    return digest(*map(field, columns))


def fold(leaf: Column, path: Column) -> Column:
    """Root above a leaf, from the siblings on the way up."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def _node(level: Column, at: Column, count: int = 1) -> Column:
    """``count`` consecutive nodes of a level (a binary) from number ``at`` on; what lies beyond its end is left out."""
    start = (at * DIGITS + 1).cast("int")
    return F.when(at < 0, F.lit("")).otherwise(F.substring(level, start, F.lit(DIGITS * count)).cast("string"))


def _level(nodes: Column) -> Column:
    return F.array_join(nodes, "").cast("binary")


def _above(level: Column) -> Column:
    """The level above a level."""
    size = F.octet_length(level)
    numbers = F.sequence(F.lit(0), ((size + 2 * DIGITS - 1) / (2 * DIGITS)).cast("int") - 1)
    parent = lambda i: F.sha2(F.substring(level, i * (2 * DIGITS) + 1, F.lit(2 * DIGITS)), 256)
    return _level(F.transform(numbers, parent))


def _blocks(nodes: DataFrame, label: str) -> DataFrame:
    """``grp, block, single, items, levels`` from ``grp, pos, node, ...`` with dense positions per group.

    ``items`` are the rows of the block, by position; ``levels`` its levels, from its nodes up
    to its root.  A group of one block ends at one node, else every block has LEVELS levels above its nodes.
    """
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    # at most BLOCK rows share a block
    item = F.struct("pos", *[c for c in nodes.columns if c not in ("grp", "pos")])
    filled = nodes.groupBy("grp", block).agg(F.array_sort(F.collect_list(item)).alias("items"))
    filled = materialize(filled, f"{label}-nodes")
    largest = materialize(filled.groupBy("grp").agg(F.max("block").alias("last")), f"{label}-groups")
    size = bytes_of(largest, "grp")[1]
    met = lookup(filled, largest, ["grp"], size)
    single = F.col("last") == 0
    own = F.ceil(F.log2(F.size("items").cast("double"))).cast("int")
    height = F.when(single, own).otherwise(F.lit(LEVELS))
    base = F.array(_level(F.transform("items", lambda x: x["node"])))
    # no level above for a height of 0
    steps = F.filter(F.sequence(F.lit(0), height), lambda i: i > 0)
    levels = F.aggregate(steps, base, lambda got, _: F.concat(got, F.array(_above(F.element_at(got, -1)))))
    return materialize(met.select("grp", "block", single.alias("single"), "items", levels.alias("levels")), label)


def _path(levels: Column, at: Column) -> Column:
    """Siblings of the node ``at`` (in its block) at every level but the block's root."""
    below = F.slice(levels, F.lit(1), F.size(levels) - 1)

    def of_level(level: Column, nth: Column) -> Column:
        number = F.floor(at / F.pow(F.lit(2.0), nth)).cast("int")
        right = number % 2 == 1
        return F.struct(
            F.when(right, _node(level, number - 1)).otherwise(F.lit("")).alias("before"),
            F.when(right, F.lit("")).otherwise(_node(level, number + 1)).alias("after"),
        )

    return F.transform(below, of_level)


def climb(nodes: DataFrame, label: str = "tree") -> DataFrame:
    """``grp, pos, node, ..., path, top`` from ``grp string, pos long, node string, ...``.

    Positions of a group are 0, 1, and so on.  ``path`` holds the siblings from the node up to
    ``top``, the root of its group.
    """
    blocks = _blocks(nodes, label)
    last = F.element_at("levels", -1).cast("string")
    several = blocks.where("NOT single")
    if several.isEmpty():
        placed = blocks.select("*", F.array().cast(PATH).alias("upper"), last.alias("top"))
    else:
        above = climb(several.select("grp", F.col("block").alias("pos"), last.alias("node")), f"{label}-up")
        above = materialize(above.select("grp", F.col("pos").alias("block"), F.col("path").alias("upper"), "top"), f"{label}-paths")
        # one row for each block; a group of one block has its root already
        met = blocks.join(above, ["grp", "block"], "left")
        placed = met.withColumns(
            {"upper": F.coalesce("upper", F.array().cast(PATH)), "top": F.coalesce("top", last)}
        )
    rows = placed.select("grp", "block", "levels", "upper", "top", F.explode("items").alias("item"))
    at = F.col("item.pos") - F.col("block") * BLOCK
    path = F.concat(_path(F.col("levels"), at), F.col("upper"))
    return rows.select("grp", "item.*", path.alias("path"), "top")


def group_key(group: Column) -> Column:
    """A group's name as a text that is never null and sorts null first, then bytewise."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def manifest(
    rows: DataFrame, fields: list[str], group: str, key: str = "doc_id", changed: dict[str, Column] | None = None
) -> DataFrame:
    """``key, leaf, subroot, root, path, claimed`` of every row.

    A leaf is the digest of the columns ``fields``.  Leaves of one ``group``
    ascend by ``key``; ``subroot`` is the root of their tree and ``root`` that
    of the dataset.  ``path`` holds the siblings (before, after) from the leaf
    to the root.  ``claimed`` is the leaf with the columns in ``changed`` replaced,
    to be held against the root by `fold`.

    Values may be null.  A null group is one of its own, before all others, and a
    null key precedes others.  Rows that share a key are in the order of their leaves;
    equal rows are leaves each.  Other columns are left out.  An empty table gives no rows.
    """
    named = {name: F.col(f"`{name}`") for name in fields}
    claimed = named | (changed or {})
    leaves = materialize(
        rows.select(
            group_key(F.col(f"`{group}`")).alias("grp"),
            F.col(f"`{key}`").cast("long").alias("key"),
            leaf_of(list(named.values())).alias("node"),
            leaf_of([claimed[name] for name in fields]).alias("claimed"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "leaves",
    )
    order = [F.col("key"), F.col("node"), F.col("tie")]
    count = leaves.count()
    placed = prefix_sum(leaves, F.lit(1).cast("long"), order, "pos", ["grp"], slices_for(count))
    low = materialize(climb(placed.select("grp", "pos", "node", "key", "claimed"), "leaf-tree"), "leaf-paths")
    roots = low.groupBy("grp").agg(F.first("top").alias("node"))
    roots = materialize(roots.select(F.lit("").alias("all"), "grp", "node"), "group-roots")
    rows_of, size = bytes_of(roots, "grp", "node")
    ordered = prefix_sum(roots, F.lit(1).cast("long"), [F.col("grp")], "pos", ["all"], slices_for(rows_of))
    named_roots = ordered.select(F.col("all").alias("grp"), "pos", "node", F.col("grp").alias("name"))
    high = materialize(
        climb(named_roots, "group-tree").select(
            F.col("name").alias("grp"), F.col("path").alias("upper"), F.col("top").alias("root")
        ),
        "group-paths",
    )
    met = lookup(low, high, ["grp"], size + rows_of * 2 * DIGITS * 40)
    return met.select(
        F.col("key").alias(key), F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.concat("path", "upper").alias("path"), "claimed",
    )
