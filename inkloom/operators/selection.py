"""Ranking and sampling: balanced packs, stratified limits, pages and volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def round_robin(rows: DataFrame, group: str, order: list[Column], limit: int | None) -> DataFrame:
    """Turns over groups (larger ones first, then by name); within a group by ``order``. With a limit the plan is a top-k."""
    x = rows.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    if limit is not None:
        x = x.where(F.col("_rn") <= max(0, limit))  # a group's later rows have no turn: it is cut before the shuffle
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_size"))
    x = x.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).orderBy("_rn", F.desc("_size"), F.lower(group), group)
    return (x if limit is None else x.limit(limit)).drop("_rn", "_size", "_group")


def review_pack(rows: DataFrame, *, limit: int | None = 200, include_ok: bool = False, only_high: bool = False, balanced: bool = True) -> DataFrame:
    """Rows to review, by descending risk: a turn for each series, or plainly the riskiest."""
    least = 55 if only_high else 0 if include_ok else 25
    x = rows.where((F.col("risk_score") >= least) & ~F.col("suggested_action").isin("ignored", "validated"))
    order = [F.desc("risk_score"), F.col("page_index"), F.col("block_id")]
    if balanced:
        return round_robin(x, "series_label", order, limit)
    return x.orderBy(*order) if limit is None else x.orderBy(*order).limit(limit)


def stratified_limit(rows: DataFrame, group: str, index: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, a turn for each group in order of first index; the result is in order of index."""
    by = W.partitionBy(group).orderBy(index)
    x = rows.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= max(0, limit)).withColumn("_first", F.first(index).over(by))
    return x.orderBy("_rn", "_first").limit(max(0, limit)).drop("_rn", "_first").orderBy(index)


def hash_order(seed: int, index: str) -> Column:
    """A repeatable shuffle by integer arithmetic, the same in any engine."""
    return F.expr(f"pmod((cast({index} as bigint) + {seed}) * 1103515245L + 12345L, 2147483647L)")


def text_hash(seed: int, *columns: str) -> Column:
    """A repeatable number of a row's values, the same in any engine: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary")), 1, 8), 16, 10).cast("long")


def select_rows(rows: DataFrame, index: str, mode: str, limit: int, *, seed: int = 47, group: str | None = None, start: int = 0) -> DataFrame:
    """Modes first, random and stratified over the rows from ``start`` on."""
    if start < 0 or mode not in ("first", "random", "stratified"):
        raise ValueError("start must not be negative, mode one of first, random, stratified")
    x = rows.where(F.col(index) >= start) if start else rows
    if mode == "stratified":
        return stratified_limit(x, group or index, index, limit)
    order = [F.col(index)] if mode == "first" else [hash_order(seed, index), F.col(index)]
    return x.orderBy(*order).limit(max(0, limit)).orderBy(index)


def choose_pages(pages: DataFrame, count: int, *, mode: str = "mixed", seed: int = 47, skip_first: int = 2, skip_last: int = 1, volume: str = "volume_label", page: str = "page_index", score: str | None = None) -> DataFrame:
    """``count`` pages of each volume: random, stratified, mixed (three quarters stratified, the rest random) or busy (the highest ``score``; without one, stratified).

    First and last pages are skipped unless nothing is left. Strata are equal
    parts with rounded ends; each gives the page in its middle or, by a keyed
    step, one to either side.
    """
    w = W.partitionBy(volume)
    x = pages.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(page)) - 1)
    inside = (F.col("_at") >= skip_first) & (F.col("_at") < F.col("_n") - skip_last)
    x = x.withColumn("_in", inside).withColumn("_kept", F.count_if("_in").over(w)).where("_in or _kept = 0")
    x = x.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(page)) - 1).withColumn("_h", text_hash(seed, volume, page))
    strata = {"random": 0, "busy": 0 if score else count, "stratified": count, "mixed": max(1, round(0.75 * count))}[mode]
    if strata:
        k = F.least(F.lit(strata), F.col("_n"))
        # strata end at multiples of n / k, rounded half to even: exact in whole numbers
        twice, at = (2 * F.col("_at") + 1) * k, F.col("_at")
        x = x.withColumn("_b", (twice - twice % (2 * F.col("_n"))) / (2 * F.col("_n")) - ((twice % (2 * F.col("_n")) == 0) & (at % 2 == 1)).cast("int"))
        b = W.partitionBy(volume, "_b")
        jitter = F.pmod(F.min("_h").over(b), F.lit(3)) - 1
        size = F.count("*").over(b)
        mid = F.greatest(F.lit(0), F.least(size - 1, F.floor(size / 2) + jitter))
        x = x.withColumn("_pick", F.row_number().over(b.orderBy("_at")) - 1 == mid).drop("_b")
    else:
        x = x.withColumn("_pick", F.lit(False))
    first = [F.desc(score)] if mode == "busy" and score else [F.desc("_pick")]
    x = x.withColumn("_rn", F.row_number().over(w.orderBy(*first, "_h", page)))
    return x.where(F.col("_rn") <= count).drop("_n", "_at", "_in", "_kept", "_h", "_pick", "_rn").orderBy(volume, page)


def choose_volumes(volumes: DataFrame, count: int, *, mode: str = "mixed", seed: int = 47, series: str = "series_label", key: str = "natural") -> DataFrame:
    """``count`` volumes of each series: first, last, random or mixed (first, last, then random; one volume: random)."""
    w = W.partitionBy(series)
    h = F.xxhash64(F.lit(seed), series, key)
    x = volumes.withColumn("_at", F.row_number().over(w.orderBy(key))).withColumn("_n", F.count("*").over(w))
    edge = (F.col("_at") == 1) | (F.col("_at") == F.col("_n"))
    by = {"first": [F.col("_at")], "last": [F.desc("_at")], "random": [h], "mixed": [h] if count == 1 else [F.desc(edge), h]}[mode]
    return x.withColumn("_rn", F.row_number().over(w.orderBy(*by, key))).where(F.col("_rn") <= count).drop("_at", "_n", "_rn")


def volume_ordinals(volumes: DataFrame, *, series: str = "series_label", key: str = "natural") -> DataFrame:
    """Number of the volume in its series, number of volumes there, and the series' own number (all from 1)."""
    w = W.partitionBy(series)
    from inkloom.sources.tables import ranked

    names = ranked(volumes.select(F.lower(series).alias("_low")).distinct(), ["_low"], "series_index").withColumn("series_index", (F.col("series_index") + 1).cast("int"))
    x = volumes.withColumn("series_volume_number", F.row_number().over(w.orderBy(key))).withColumn("series_volume_count", F.count("*").over(w)).withColumn("_low", F.lower(series))
    return x.join(names, "_low").drop("_low")


def best_candidate(candidates: DataFrame, key: list[str], score: str, ordinal: str) -> DataFrame:
    """The highest score of each key; the first one wins ties."""
    return candidates.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(score), ordinal))).where("_rn = 1").drop("_rn")


def top_by_count(rows: DataFrame, key: list[str], k: int, *, seq: str = "seq", at_least: int = 1) -> DataFrame:
    """The k most frequent keys with their counts, ties by first appearance."""
    x = rows.groupBy(*key).agg(F.count("*").alias("count"), F.min(seq).alias("first_seq")).where(F.col("count") >= at_least)
    return x.orderBy(F.desc("count"), "first_seq", *key).limit(k)


def duplicate_parents(volumes: DataFrame, path: str = "volume_path") -> DataFrame:
    """parent (lower case), volumes, paths of folders with two volumes or more."""
    parent = F.lower(F.regexp_replace(path, "/[^/]*$", ""))
    x = volumes.groupBy(parent.alias("parent")).agg(F.count("*").alias("volumes"), F.sort_array(F.collect_list(path)).alias("paths"))
    return x.where("volumes > 1")


def pages_of_volumes(volumes: DataFrame, pages: DataFrame, key: str = "volume_path") -> DataFrame:
    """``volumes`` with the number of their sampled pages, 0 for those without any."""
    n = pages.groupBy(key).agg(F.count("*").alias("sampled_pages"))
    return volumes.join(n, key, "left").na.fill(0, ["sampled_pages"])


def sample_corpus(entries: DataFrame, *, volumes_per_series: int = 2, pages_per_volume: int = 25, series_mode: str = "mixed", mode: str = "mixed", seed: int = 47, skip_first: int = 2, skip_last: int = 1) -> DataFrame:
    """Manifest rows of the chosen pages of the chosen volumes.

    ``entries``: archive, entry, ordinal, error, as ``read_archive_entries``
    gives them; rows with an error are left out (report them from there). The
    folder of an archive is its series.
    """
    from inkloom.functions.text import natural_key, slug
    from inkloom.sources.tables import ranked

    x = entries.where("error is null").select(F.col("archive").alias("source_path"), F.col("entry").alias("source_image_name"), F.col("ordinal").cast("int").alias("source_page_index"))
    counts = x.groupBy("source_path").agg(F.count("*").alias("page_count"))
    v = counts.withColumn("source_parent", F.regexp_replace("source_path", "/[^/]*$", ""))
    v = v.withColumn("series_label", F.regexp_extract("source_parent", "[^/]*$", 0)).withColumn("volume_label", F.regexp_replace(F.regexp_extract("source_path", "[^/]*$", 0), r"\.[^.]*$", ""))
    v = v.withColumn("series_path", F.col("source_parent")).withColumn("natural", natural_key(F.col("volume_label")))
    v = choose_volumes(volume_ordinals(v, series="series_path"), volumes_per_series, mode=series_mode, seed=seed, series="series_path")
    v = ranked(v.drop("natural"), ["series_index", "series_volume_number"], "volume_index").withColumn("volume_index", (F.col("volume_index") + 1).cast("int"))
    chosen = choose_pages(x.join(v.select("source_path"), "source_path"), pages_per_volume, mode=mode, seed=seed, skip_first=skip_first, skip_last=skip_last, volume="source_path", page="source_page_index")
    name = F.format_string("%s__page_%04d%s", slug(F.col("volume_label")), F.col("source_page_index") + 1, F.regexp_extract("source_image_name", r"\.[^.]*$", 0))
    return chosen.join(v, "source_path").select(
        "series_index", "series_label", "series_path", "series_volume_number", "series_volume_count", "volume_index", "volume_label", "source_path", "source_parent", "page_count",
        (F.col("source_page_index") + 1).alias("source_page_number"), "source_page_index", "source_image_name", F.concat_ws("/", F.lit("pages"), slug(F.col("series_label")), slug(F.col("volume_label")), name).alias("output_relpath"),
        F.lit(mode).alias("sampling_mode"), F.lit(seed).alias("seed"),
    )
