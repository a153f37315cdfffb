"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Native: only DataFrame functions. Sizes are words. The steps:

1. Totals by source give each source's target: weights share 100 % of all
   sizes; a target stops at ``cap`` times its source's size and the excess is
   shared again by weight (water filling, in closed form over the sources
   sorted by size for each unit of weight).
2. Every source's documents fall by keyed hash into about sqrt(n) blocks, so
   neither the list of blocks nor one block outgrows a task, whatever share of
   the corpus a source has. A source's exact quota is whole passes over its
   blocks, then blocks in permuted order, then a part of one last block.
3. The quotas of block draws are split over the shards: at every node of a
   binary tree the left half draws its number of blocks from the node's urn,
   source after source (a hypergeometric draw each, by Gumbel maximum over its
   exact log-probabilities).
4. Shards take disjoint runs of each source's permuted draws, and each shard is
   shuffled locally by keyed hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.llm.common import WORD, settle


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Add rank, weight, target to one row for each source (source, source_size).

    The windows run over one row for each source, not over documents. Sources
    rank by code point, null last; weights repeat in that order.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*(F.lit(float(x)) for x in weights))
    x = sizes.withColumn("sid", rank).withColumn("weight", F.get(w, F.col("sid") % len(weights)))
    most = cap * F.col("source_size")
    order = W.orderBy(most / F.col("weight"), "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = F.sum("source_size").over(W.partitionBy())
    left = everything - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    share = left / F.sum("weight").over(after)
    x = x.withColumn("share", share).withColumn("full", most <= F.col("share") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("share"))).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    # that of the first source that isn't full: shares fall from there on
    return x.withColumn("target", F.when(F.col("full"), most).otherwise(F.col("weight") * level)).drop("share", "full")


def _lgamma(z: str) -> str:
    """SQL for log gamma of z >= 1: Stirling's series at z + 7."""
    y = f"({z} + 7d)"
    steps = " * ".join(f"({z} + {i}d)" for i in range(7))
    return f"(({y} - 0.5d) * ln({y}) - {y} + 1d / (12d * {y}) - 1d / (360d * {y} * {y} * {y}) - ln({steps}))"


def _draw(seed: int) -> str:
    """SQL lambda for one source of a node: (urn N, still to draw n, result) and quota q."""
    k, n, total = "cast(q.k as double)", "cast(a.n as double)", "cast(a.total as double)"
    x = "cast(x as double)"
    log_p = f"-({_lgamma(f'({x} + 1d)')} + {_lgamma(f'({k} - {x} + 1d)')} + {_lgamma(f'({n} - {x} + 1d)')} + {_lgamma(f'({total} - {k} - {n} + {x} + 1d)')})"
    u = f"((pmod(xxhash64({seed}, node, q.sid, x), 9007199254740991L) + 0.5d) / 9007199254740992d)"
    pick = f"array_max(transform(sequence(greatest(0L, a.n - (a.total - q.k)), least(q.k, a.n)), x -> struct({log_p} - ln(-ln({u})) as s, x as x))).x"
    return f"""transform(array({pick}), v -> struct(a.total - q.k as total, a.n - v as n,
        array_append(a.got, struct(q.sid as sid, v as k)) as got))[0]"""


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """sid, k (draws of a source) -> shard, sid, k: exact, multivariate hypergeometric.

    A node is one row with its quotas by source, so a row is as long as the
    list of sources; the tree has ``n_shards`` leaves.
    """
    quota = "array<struct<sid:int,k:bigint>>"
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("sid").cast("int"), F.col("k").cast("long")))).cast(quota).alias("q"))
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), F.lit(0).alias("lo"), F.lit(n_shards).alias("width"), "q")
    for _ in range((n_shards - 1).bit_length()):
        total = "aggregate(q, 0L, (s, e) -> s + e.k)"
        x = nodes.withColumn("half", F.expr("width div 2")).withColumn("total", F.expr(total))
        x = x.withColumn("n", F.expr("total * half div greatest(width, 1)"))
        x = x.withColumn("left", F.expr(f"aggregate(q, struct(total as total, n as n, cast(array() as {quota}) as got), (a, q) -> {_draw(seed)}).got"))
        right = "zip_with(q, left, (e, l) -> struct(e.sid as sid, e.k - l.k as k))"
        x = x.withColumn("kid", F.explode(F.expr(f"""filter(array(
            struct(node * 2 as node, lo as lo, cast(half as int) as width, left as q),
            struct(node * 2 + 1 as node, cast(lo + half as int) as lo, cast(width - half as int) as width, {right} as q)), c -> c.width > 0)""")))
        nodes = x.select("kid.*")
    return settle(nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("e")).select("shard", "e.*").where("k > 0"), "quotas")


@dataclass
class Plan:
    """What a mix decides: sources (target), and the draws of every block."""

    sources: DataFrame
    draws: DataFrame  # skey, block, n_blocks, pass, shard, part (last block: only up to h_star), h_star
    seed: int


def row_key(docs: DataFrame, id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col("size"))


def plan_mix(slim: DataFrame, weights: Sequence[float], cap: float, n_shards: int, seed: int) -> Plan:
    """``slim``: skey, source, size, h, one row for each document, read several times."""
    src = slim.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    src = targets(src, weights, cap).withColumn("n_blocks", F.ceil(F.sqrt("n_docs")).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    src = settle(src.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "sources")
    placed = slim.join(src.select("skey", "n_blocks"), "skey").withColumn("block", F.pmod("h", "n_blocks"))
    blocks = placed.groupBy("skey", "block").agg(F.sum("size").alias("block_size"))
    order = W.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 1), "skey", "block"), "block")
    blocks = blocks.withColumn("at", F.row_number().over(order).cast("long") - 1).withColumn("cum", F.sum("block_size").over(order))
    blocks = blocks.join(src.select("skey", "sid", "n_blocks", "passes", "rest"), "skey")
    blocks = settle(blocks.withColumn("whole", F.col("cum") <= F.col("rest")).withColumn(
        "part", (~F.col("whole")) & (F.col("cum") - F.col("block_size") < F.col("rest"))), "blocks")
    edge = blocks.where("part").select("skey", "block", (F.col("rest") - F.col("cum") + F.col("block_size")).alias("room"))
    run = W.partitionBy("skey", "block").orderBy("h")  # equal keys (repeated rows) share one frame and one fate
    inside = placed.join(edge, ["skey", "block"]).withColumn("run", F.sum("size").over(run))
    star = inside.where(F.col("run") - F.col("size") / 2 <= F.col("room")).groupBy("skey", "block").agg(F.max("h").alias("h_star"))
    times = F.expr("sequence(0L, passes + if(whole or part, 0L, -1L))")
    draws = (
        blocks.join(star, ["skey", "block"], "left")
        .where("passes > 0 or whole or part")
        .withColumn("pass", F.explode(times))
        .withColumn("part", F.col("part") & (F.col("pass") == F.col("passes")))
        .where("not (part and h_star is null)")
    )
    # passes one after the other, each in an order of its own; the last one in the order of ``cum``
    turn = F.when(F.col("pass") == F.col("passes"), F.col("at")).otherwise(F.xxhash64(F.lit(seed + 2), "skey", "pass", "block"))
    draws = draws.withColumn("pos", F.row_number().over(W.partitionBy("skey").orderBy("pass", turn, "block")).cast("long") - 1)
    draws = settle(draws.select("skey", "sid", "block", "n_blocks", "pass", "pos", "part", "h_star"), "draws")
    split = split_quotas(draws.groupBy("sid").agg(F.count("*").alias("k")), n_shards, seed + 3)
    end = F.sum("k").over(W.partitionBy("sid").orderBy("shard"))
    runs = split.withColumn("end", end).select("sid", "shard", F.explode(F.expr("sequence(end - k, end - 1)")).alias("pos"))
    return Plan(src, draws.join(runs, ["sid", "pos"]), seed)


def _placed(docs: DataFrame, plan: Plan) -> DataFrame:
    """Documents with ``shards``: the shard of every time they are taken.

    One row of draws for each source and block meets the documents: about
    sqrt(n) rows of a source, each for about sqrt(n) of its documents.
    """
    by_block = plan.draws.groupBy("skey", "block").agg(
        F.collect_list(F.when(~F.col("part"), F.struct("pass", "shard"))).alias("whole"),  # at most cap + 1 passes
        F.max(F.when(F.col("part"), F.struct("h_star", "pass", "shard"))).alias("last"),
    )
    x = docs.join(plan.sources.select("skey", "n_blocks"), "skey").withColumn("block", F.pmod("h", "n_blocks"))
    x = x.join(by_block, ["skey", "block"], "left")
    last = F.when(F.col("last").isNotNull() & (F.col("h") <= F.col("last.h_star")), F.array(F.struct(F.col("last.pass").alias("pass"), F.col("last.shard").alias("shard"))))
    none = F.array().cast("array<struct<pass:bigint,shard:int>>")
    return x.withColumn("takes", F.concat(F.coalesce("whole", none), F.coalesce(last, none)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    x = docs.withColumn("size", words(F.col(text_col))).withColumn("skey", source_key(F.col(source_col)))
    return x.withColumn("h", row_key(x, id_col, seed))


def shards_for(slim: DataFrame, n_shards: int | None, shard_words: int) -> int:
    """As many shards as hold ``shard_words`` each, unless stated."""
    return n_shards or max(1, -(-int(slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // shard_words))


def taken(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, n_shards: int | None = None, shard_words: int = 1_000_000, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For every row: its id, size, source_size, target, taken (words, repeats counted) and shards.

    ``shards`` is the sorted list of the shards that take the row, once for each
    time it is taken: what the splitting tree drew. Null text has size 0, null sources are one source, null ids are ids like
    others. Repeated rows share their fate. Other columns aren't read.
    """
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    slim = settle(_keyed(x, "id", "text", "source", seed).select("id", "source", "skey", "size", "h"), "sizes")
    plan = plan_mix(slim, weights, cap, shards_for(slim, n_shards, shard_words), seed)
    y = _placed(slim, plan).join(plan.sources.select("skey", "source_size", "target"), "skey").withColumn("shards", F.array_sort(F.transform("takes", lambda t: t["shard"])))
    return y.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, n_shards: int | None = None, shard_words: int = 1_000_000, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row for every time a document is taken, dealt to its shard and shuffled there.

    Columns are those of ``docs``; shard i is partition i. The number of shards
    grows with the words of the corpus unless it is stated; what is taken
    doesn't depend on it. Edge cases are those of ``taken``.
    """
    own = docs.columns
    row = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    keyed = _keyed(row, "id", "text", "source", seed)
    slim = settle(keyed.select("source", "skey", "size", "h"), "sizes")
    n_shards = shards_for(slim, n_shards, shard_words)
    plan = plan_mix(slim, weights, cap, n_shards, seed)
    dealt = _placed(keyed.select("row", "skey", "h"), plan).withColumn("take", F.explode("takes"))
    slot = F.xxhash64(F.lit(seed + 4), "h", "take.pass", "take.shard")
    return dealt.select("row", F.col("take.shard").alias("shard"), slot.alias("slot")).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot").select("row.*")
