"""Helpers that several operators share: shared-folder tables and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a local master without one, a folder in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/inkloom-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    Lost executors cost nothing behind this point, and a value drawn from a
    plan that is evaluated twice can't change between the two.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder; to be called when results that read them are written."""
    store, path = fs.FileSystem.from_uri(shared_dir(spark))
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names differ by more than their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 1 << 23, most_rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts exceed ``most_bytes`` or their rows ``most_rows``; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64")
        part = size.cumsum() // most_bytes
        cut = [i + 1 for i in range(len(part) - 1) if part[i + 1] != part[i] or (i + 1) % most_rows == 0]
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            yield batch.slice(a, b - a)


def tidy(results: Iterator, *caches) -> Iterator:
    """The results as they come; then the worker, which Spark uses again, gives back what its caches (with ``clear``) held."""
    try:
        yield from results
    finally:
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: ``node``, ``component`` (its smallest node).

    Alternating large-star and small-star rounds over written tables. Every
    step is a grouped minimum (combined before the shuffle) and an equi-join,
    so a hub with very many edges is split by the adaptive skew join. Nodes
    without an edge don't appear; edges with a null end are ignored.
    """
    e = settle(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where((F.col("a") < F.col("b")) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct(),
        "edges",
    )
    def sign(x: DataFrame):
        return x.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()

    before = sign(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = settle(small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
