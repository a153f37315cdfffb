"""URL filter: rules first, then a path-template tree judged by labelled purity.

Native: only DataFrame functions. ``html`` is never read.

Every URL is split into host and path. Rules (host suffix and path prefix,
longest wins) decide the URLs they fit and label them (block 1, allow 0). The
paths of each host form a tree; the tree is generalised level by level:

* digit and hexadecimal runs of a segment become ``<n>`` and ``<h>``;
* where a node has many children, children with a small share of its URLs are
  one wildcard ``*``;
* then, from the deepest level up, sibling branches with the same templates
  below and a bad rate that a z-test can't tell from their pooled rate are merged.

A template is rejected when ``(bad + alpha * base) / (labelled + alpha)``, its
purity smoothed towards the base rate over all URLs, reaches ``purity``. URLs
without a rule take their template's verdict; templates without labels keep
the base rate and are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; ties to the first listed."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(-i).alias("at"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for i, (v, h, p) in enumerate(rules)
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,at:int,rule:string,verdict:string>")


def shape_of(path: Column) -> Column:
    """The segments of a path with hexadecimal and digit runs masked."""
    masked = F.regexp_replace(F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,}(?![0-9A-Za-z])", "<h>"), r"[0-9]+", "<n>")
    return F.filter(F.split(masked, "/"), lambda s: s != "")


def templates(shapes: DataFrame, *, fan_out: int = 12, rare_share: float = 0.02) -> DataFrame:
    """Add ``template`` (array of segments) to host, segs, n, lab, bad rows.

    One branching level of the tree a round: counts of each node and child are
    grouped sums, joined back. Segments that all paths of a node share are one
    element, and so is all that is left where a node has a single path below;
    so long paths without branches cost no rounds.
    """
    none = F.array().cast("array<string>")
    left = shapes.withColumn("template", none).withColumn("rest", F.col("segs"))
    done = left.where(F.size("rest") == 0).drop("rest")
    left = left.where(F.size("rest") > 0)
    while not left.isEmpty():
        left = left.withColumn("seg", F.get("rest", F.lit(0)))
        child = left.groupBy("host", "template", "seg").agg(F.sum("n").alias("n_child"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        node = child.groupBy("host", "template").agg(F.sum("n_child").alias("n_node"), F.count("*").alias("fan"), F.min("low").alias("low"), F.max("high").alias("high"))
        # what the least and the greatest path share, all paths of the node share
        apart = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        node = node.withColumn("single", F.col("low") == F.col("high")).withColumn("shared", F.when(apart == 0, F.least(F.size("low"), F.size("high"))).otherwise(apart - 1).cast("int")).drop("low", "high")
        named = (F.col("fan") < fan_out) | (F.col("n_child") >= rare_share * F.col("n_node"))
        kinds = child.join(node, ["host", "template"]).select("host", "template", "seg", "single", "shared", named.alias("named"))
        step = left.join(kinds, ["host", "template", "seg"])
        own = F.when(F.col("single"), F.array_join("rest", "/")).when(F.col("named"), F.array_join(F.slice("rest", 1, F.greatest("shared", F.lit(1))), "/")).otherwise("*")
        rest = F.when(F.col("single"), none).otherwise(F.slice("rest", F.greatest(F.when(F.col("named"), F.col("shared")), F.lit(1)) + 1, F.size("rest")))
        step = settle(step.withColumn("template", F.array_append("template", own)).withColumn("rest", rest).drop("seg", "single", "shared", "named"), "templates")
        done = done.unionByName(step.where(F.size("rest") == 0).drop("rest"))
        left = step.where(F.size("rest") > 0)
    return done


def merged(leaves: DataFrame, *, z: float = 1.96) -> DataFrame:
    """Merge similar sibling branches, at every node, from the deepest level up.

    Siblings are similar if the same templates lie below them and their bad
    rates don't differ from the pooled one by a z-test; branches without a label
    have no rate, so they merge among themselves only (as ``*?``).
    ``leaves``: host, template, lab, bad. Returns host, template, merged.
    """
    state = leaves.withColumn("merged", F.col("template"))
    deepest = leaves.agg(F.coalesce(F.max(F.size("template")), F.lit(0))).first()[0]
    for level in range(deepest - 1, -1, -1):
        at = state.withColumn("parent", F.slice("merged", 1, level)).withColumn("branch", F.get("merged", F.lit(level))).withColumn("below", F.slice("merged", level + 2, deepest))
        own = ["host", "parent", "branch"]
        cell = at.where("branch is not null").groupBy(*own, "below").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        # two hashes stand for the set of templates below
        branch = cell.groupBy(*own).agg(*(F.bit_xor(F.xxhash64(F.lit(i), "below")).alias(f"b{i}") for i in (1, 2)), F.count("*").alias("size"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).withColumn("seen", F.col("lab") > 0)
        same = ["host", "parent", "b1", "b2", "size", "seen"]
        pool = branch.groupBy(*same).agg(F.sum("lab").alias("lab_p"), F.sum("bad").alias("bad_p"), F.count("*").alias("kin")).where("kin > 1")
        p = (F.col("bad_p") + 0.5) / (F.col("lab_p") + 1.0)
        alike = (~F.col("seen")) | (F.abs(F.col("bad") / F.col("lab") - p) <= z * F.sqrt(p * (1 - p) / F.col("lab")))
        join = branch.join(pool, same).where(alike).select(*own, "seen")
        kind = F.when(F.col("seen"), F.lit("*")).otherwise(F.lit("*?"))
        new = F.when(F.col("seen").isNull(), F.col("merged")).otherwise(F.concat("parent", F.array(kind), "below"))
        state = settle(at.join(join, own, "left").select("host", "template", "lab", "bad", new.alias("merged")), "merged")
    return state.select("host", "template", "merged")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", alpha: float = 8.0, purity: float = 0.5, **tree) -> DataFrame:
    """Add host, path, rule, verdict and template to every row of ``pages``.

    Null URLs and URLs without ``://`` have an empty host and path and are
    allowed unless a rule fits; repeated rows are judged alike; an empty table
    gives an empty result. Columns of ``pages`` with one of the five names are
    replaced; others stay.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "template")]
    x = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    x = x.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("_segs", shape_of(F.col("path")))
    lab = F.col("_r").isNotNull().cast("long")
    bad = (F.coalesce(F.col("_r.verdict"), F.lit("")) == "block").cast("long")
    shapes = settle(
        x.groupBy("host", F.col("_segs").alias("segs")).agg(F.count("*").alias("n"), F.sum(lab).alias("lab"), F.sum(bad).alias("bad")), "shapes"
    )
    tree_rows = settle(templates(shapes, **tree), "tree")
    leaves = tree_rows.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "lab", "bad")))
    named = tree_rows.join(merged(leaves), ["host", "template"], "left").withColumn("merged", F.coalesce("merged", "template"))
    stats = named.groupBy("host", "merged").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    base = shapes.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(1)), F.lit(1))).alias("base"))
    scored = stats.join(F.broadcast(base)).withColumn("rejected", (F.col("bad") + alpha * F.col("base")) / (F.col("lab") + alpha) >= purity)
    verdicts = named.join(scored.select("host", "merged", "rejected"), ["host", "merged"]).select(
        "host", F.col("segs").alias("_segs"), F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "rejected"
    )
    return x.join(verdicts, ["host", "_segs"], "left").select(
        *own,
        "host",
        "path",
        F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
    )
