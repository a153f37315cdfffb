"""Merkle tree over a dataset, with a proof of membership for every row.

A row is a leaf: the SHA-256 of its encoded values. The leaves of each group
(a language, say) are numbered in order; every ``fanout`` consecutive nodes
become one parent, level by level, until one node, the subroot, remains. The
subroots in order of their groups form the same tree above, whose last node is
the root. A row's proof is the list of its siblings, level by level.

How Spark builds it:

1. Leaves are numbered without one task for a group: a range sort by (group,
   order, leaf) deals rows evenly, ``row_number`` counts inside a part, and the
   parts' counts, summed in order, are the offsets. Rows equal in all of these
   are interchangeable; a written random number spreads them over parts.
2. Nodes go up in steps. A step divides the index by ``fanout**k`` (rounding
   down), groups the children of at most ``block`` places in an array sorted by
   index, and hashes ``k`` levels of the array: one shuffle for ten levels of a
   binary tree. A group with a hot key has many blocks, each of bounded size.
3. From the root down, one join a step appends the siblings of its levels to the
   proofs: the step that reaches the leaves joins every leaf with its block, so
   leaves are shuffled once for the proofs however high the tree is.
4. Each step is written to the shared folder before the next one reads it.

All work is in DataFrame functions. Digests travel as 32 bytes and are hashed as
lowercase hex.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkloom.llm.common import settle

PART_ROWS = 1 << 20  # rows of a part of the range sort
BLOCK = 1 << 10  # children that one array holds


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of the values' encodings, concatenated, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def hex_of(x: Column) -> Column:
    return F.lower(F.hex(x))


def numbered(rows: DataFrame, by: str, order: Sequence[str], tag: str) -> DataFrame:
    """``rows`` with ``idx`` (from 0) and ``n`` (rows) within ``by``, ordered by ``order`` (nulls first), written.

    Rows with equal ``by`` and ``order`` are numbered in any order.
    """
    salted = settle(rows.withColumn("salt", F.rand(7)), "salted")  # written, so that no second evaluation deals rows anew
    keys = [F.col(c).asc_nulls_first() for c in (by, *order, "salt")]
    parts = max(1, -(-salted.count() // PART_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settle(salted.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(by, "part").agg(F.count("*").alias("rows"))  # one row a part, and one more a group
    w = W.partitionBy(by)
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(by).alias("by_"), F.col("part").alias("part_"), before.alias("before"), F.sum("rows").over(w).alias("n"))
    place = F.row_number().over(W.partitionBy("part", by).orderBy(*keys[1:])) - 1
    x = dealt.withColumn("place", place).join(offsets, F.col(by).eqNullSafe(F.col("by_")) & (F.col("part") == F.col("part_")))
    return settle(x.withColumn("idx", F.col("before") + F.col("place")).drop("salt", "part", "place", "by_", "part_", "before"), tag)


def _up(level: Column, fanout: int) -> Column:
    """The parents of one level (an array of digests): every ``fanout`` of them, the last run fewer."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / fanout).cast("int") - 1)
    return F.transform(runs, lambda r: F.unhex(F.sha2(F.concat_ws("", F.transform(F.slice(level, r * fanout + 1, fanout), hex_of)), 256)))


def _levels(children: Column, height: Column, fanout: int) -> Column:
    """The levels above ``children``: ``height`` arrays after the children themselves."""
    step = lambda done, _: F.concat(done, F.array(_up(F.element_at(done, -1), fanout)))
    return F.when(height > 0, F.aggregate(F.sequence(F.lit(1), height), F.array(children), step)).otherwise(F.array(children))


def _siblings(levels: Column, place: Column, fanout: int) -> Column:
    """For the child at ``place``, level by level: (left, right), the digests beside its node in its run."""

    def beside(level: Column, i: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(float(fanout)), i)).cast("int")
        first = node - node % fanout
        run = F.slice(level, first + 1, fanout)
        some = lambda a, n: F.aggregate(F.slice(run, a, n), F.lit(b""), lambda x, y: F.concat(x, y))
        left, right = some(F.lit(1), node - first), some(node - first + 2, F.lit(fanout))
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), beside)


def _power(fanout: int, block: int) -> int:
    k = 1
    while fanout ** (k + 1) <= block:
        k += 1
    return k


def tree(nodes: DataFrame, by: str, *, fanout: int, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """The steps of the trees over written ``nodes`` (``by``, idx, n, digest), and their last nodes (``by``, digest).

    A step is a written table with a row for each block: ``by``, b, levels.
    """
    k = _power(fanout, block)
    size, steps = fanout**k, []
    top = nodes.agg(F.max("n")).first()[0] or 0
    now = nodes.select(by, "idx", "n", "digest")
    while top > 1:
        b = F.floor(F.col("idx") / size)
        child = F.array_sort(F.collect_list(F.struct((F.col("idx") % size).alias("at"), "digest")))
        grouped = now.groupBy(by, b.alias("b"), F.col("n")).agg(child.alias("children"))  # at most ``size`` rows a group
        # one block alone ends with its last node; blocks beside others are as high as a whole one
        alone = reduce(lambda h, j: F.when(F.col("n") > fanout ** (j - 1), j).otherwise(h), range(1, k + 1), F.lit(0))
        height = F.when(F.col("n") > size, k).otherwise(alone)
        levels = _levels(F.col("children.digest"), height, fanout)
        step = settle(grouped.select(by, "b", F.ceil(F.col("n") / size).alias("n"), levels.alias("levels")), "step")
        steps.append(step)
        now = step.select(by, F.col("b").alias("idx"), "n", F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        top = -(-top // size)
    return steps, now.select(by, "digest")


def proofs(nodes: DataFrame, steps: list[DataFrame], above: DataFrame, by: str, *, fanout: int, block: int = BLOCK) -> DataFrame:
    """``nodes`` with ``last`` and ``path``: an array of (left, right) from their level up.

    ``above`` (``by``, last, path) has the last node of each group and the path from there on.
    """
    size = fanout ** _power(fanout, block)
    up = above.select(F.col(by).alias("by_"), F.lit(0).cast("long").alias("b_"), "last", F.col("path").alias("rest"))
    for step, below in zip(reversed(steps), [*reversed(steps[:-1]), nodes]):
        held = step.select(F.col(by).alias("by__"), F.col("b").alias("b__"), "levels")
        held = held.join(up, F.col("by__").eqNullSafe(F.col("by_")) & (F.col("b__") == F.col("b_"))).drop("by_", "b_")
        idx = F.col("idx" if below is nodes else "b")
        x = below.drop("levels").join(held, F.col(by).eqNullSafe(F.col("by__")) & (F.floor(idx / size) == F.col("b__")))
        path = F.concat(_siblings(F.col("levels"), (idx % size).cast("int"), fanout), F.col("rest"))
        if below is nodes:
            return x.withColumn("path", path).drop("levels", "rest", "by__", "b__")
        up = settle(x.select(F.col(by).alias("by_"), idx.alias("b_"), "last", path.alias("rest")), "proofs")
    return nodes.join(up, F.col(by).eqNullSafe(F.col("by_"))).withColumnRenamed("rest", "path").drop("by_", "b_")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda x, p: F.unhex(F.sha2(F.concat(hex_of(p["left"]), hex_of(x), hex_of(p["right"])), 256)))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(hex_of(p["left"]), hex_of(p["right"])))), 256)


def manifest(
    docs: DataFrame,
    *,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    order_col: str = "doc_id",
    claimed: Sequence[Column] | None = None,
    fanout: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """A row for every row of ``docs``: ``order_col``, leaf, subroot, root (32 bytes each), path, claimed_root and verified.

    ``columns`` (all castable to string) make the leaf; ``claimed`` are the
    values that somebody presents instead (the columns themselves by default):
    claimed_root is where these lead with the row's siblings, and verified says
    whether that is the root.

    Groups are ordered with null first, else by UTF-8 bytes of their text; rows
    of a group by ``order_col`` (null first), equal ones by leaf; repeated rows
    are leaves of their own. Nulls in any column are encoded as such, empty
    texts as texts without bytes; texts of any length are hashed whole. A group
    of one row is its own subroot, a table of one row its own root with an empty
    path; an empty table gives an empty manifest. Other columns are ignored.
    """
    if fanout < 2:
        raise ValueError("a parent needs two children")
    values = [docs[c] for c in columns]
    mine = digest(*values)
    leaves = docs.select(docs[order_col].alias("ord"), docs[group_col].cast("string").alias("grp"), mine.alias("digest"))
    if claimed is not None:
        changed = reduce(lambda p, q: p | q, (~v.eqNullSafe(c) for v, c in zip(values, claimed, strict=True)))
        leaves = docs.select(docs[order_col].alias("ord"), docs[group_col].cast("string").alias("grp"), mine.alias("digest"), F.when(changed, digest(*claimed)).alias("claim"))
    leaves = numbered(leaves, "grp", ["ord", "digest"], "leaves")
    steps, subroots = tree(leaves, "grp", fanout=fanout, block=block)
    groups = numbered(subroots.withColumn("all", F.lit(0)), "all", ["grp"], "subroots")
    high, root = tree(groups, "all", fanout=fanout, block=block)
    root = root.select("digest").first()
    root = F.lit(root[0] if root else None).cast("binary")
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    start = docs.sparkSession.range(1).select(F.lit(0).alias("all"), root.alias("last"), nothing.alias("path"))
    above = proofs(groups, high, start, "all", fanout=fanout, block=block).select("grp", F.col("digest").alias("last"), "path")
    x = proofs(leaves, steps, settle(above, "above"), "grp", fanout=fanout, block=block)
    shown = F.coalesce("claim", "digest") if claimed is not None else F.col("digest")
    out = x.select(F.col("ord").alias(order_col), F.col("digest").alias("leaf"), F.col("last").alias("subroot"), root.alias("root"), "path", folded(shown, F.col("path")).alias("claimed_root"))
    return out.withColumn("verified", F.col("claimed_root") == F.col("root"))
