"""Block views of the driver's tables. The mapping is this engine's own; the tables hold no page blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.schema import as_blocks

SMALL, BIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # other letters keep their case, which engines fold differently


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder (a local master without one: in /tmp)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/inkloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back, so that plans which use them twice don't make them twice."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` over all cores where their files are fewer than these.

    A file with one row group is one task, whatever the cores; tables of many
    files are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if len(rows.inputFiles()) < cores else rows


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks: ten a page, sources as series, labels as review status, parts of the text as translation."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, t = F.col("doc_id"), F.col("text")
    status = F.when(F.col("toxic") == 1, "ignored").when(F.col("quality") == 1, "validated").when(F.col("quality") == 0, "review").otherwise("unchecked")
    first = lambda stop: F.regexp_extract(t, f"^[^{stop}]*", 0)  # noqa: E731  the first sentence or word
    fr = F.when(n % 4 == 0, t).when(n % 4 == 1, first(".!?")).when(n % 4 == 2, F.translate(first(" ."), SMALL, BIG)).otherwise("")
    notes = F.when(n % 11 == 0, "[sfx] bruit").when(n % 11 == 1, "[fusion] bulle").when(n % 11 == 2, "[zone] coupé").otherwise("")
    x1, y1 = ((n % 2) * 100).cast("int"), (F.floor((n % 10) / 2) * 60 + F.floor(n / 10) % 3 * 5).cast("int")
    return as_blocks(
        d.select(
            F.concat(F.lit("p"), F.floor(n / 100).cast("string")).alias("project_id"), F.col("source").alias("series_label"), F.floor(n / 10).cast("int").alias("page_index"), F.concat(F.lit("pages/"), "source", F.lit("/v"), (n % 3).cast("string"), F.lit("/p"), F.floor(n / 10).cast("string"), F.lit(".png")).alias("image_name"),
            n.alias("seq"), F.concat(F.lit("d"), n.cast("string")).alias("block_id"), F.array(x1, y1, x1 + 80, y1 + 40).alias("bbox"), F.col("lang").alias("source_lang"), t.alias("ocr_text"),
            F.when(n % 5 == 0, F.replace(t, F.lit("the"), F.lit("The"))).alias("ocr_corrected_text"), fr.alias("translation_fr"), F.when(n % 6 == 0, F.lower(fr)).alias("raw_translation_fr"), notes.alias("review_notes"),
            F.when(F.col("quality").isNotNull(), (n % 101) / 100).alias("confidence"), (n % 10).cast("int").alias("reading_order"), status.alias("manual_status"),
            F.when(n % 7 == 0, F.array(F.lit("w1"))).when(n % 7 == 1, F.array(F.lit("w1"), F.lit("w2"))).alias("quality_warnings"),
        )
    )


def sentence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents as blocks, a document a page; some are made technical, signage or sounds by their number."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    x = d.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))).alias("i", "part"))
    n, i, t = F.col("doc_id"), F.col("i"), F.btrim("part")
    made = F.when(n % 3 == 0, F.concat(F.lit("phase 4 "), t)).when(i % 9 == 0, F.lit("SLAM!")).when(i % 13 == 0, F.concat(F.lit("card fee "), t)).when(i % 7 == 0, F.concat(F.lit("only "), t)).otherwise(t)
    status = F.when(F.col("quality") == 1, "validated").when(F.col("quality") == 0, "review").otherwise("unchecked")
    return as_blocks(
        x.select(
            F.concat(F.lit("p"), F.floor(n / 100).cast("string")).alias("project_id"), F.col("source").alias("series_label"), n.cast("int").alias("page_index"), (n * 100_000 + i).alias("seq"),
            F.concat_ws("_", F.lit("s"), n.cast("string"), i.cast("string")).alias("block_id"), made.alias("ocr_text"), F.col("lang").alias("source_lang"), i.cast("int").alias("reading_order"), status.alias("manual_status"),
        )
    )


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as blocks: a user's turn is a source, the assistant's next one its translation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("reply", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    n, k, t = F.col("conv_id").cast("long"), F.col("turn").cast("int"), F.col("text")
    fixed = F.when(n % 5 == 0, F.replace(t, F.lit("."), F.lit("!"))).when(n % 5 == 1, F.reverse(t)).when(n % 5 == 2, F.translate(t, SMALL, BIG)).otherwise("")
    return as_blocks(
        c.where("role = 'user'").select(
            F.lit("conversations").alias("project_id"), F.concat(F.lit("c"), (n % 5).cast("string")).alias("series_label"), n.cast("int").alias("page_index"), (n * 1000 + F.col("turn")).alias("seq"),
            F.concat_ws("_", F.lit("t"), n.cast("string"), F.col("turn").cast("string")).alias("block_id"), t.alias("ocr_text"), fixed.alias("ocr_corrected_text"), F.col("reply").alias("translation_fr"), F.when(n % 3 == 0, F.lower("reply")).when(n % 3 == 1, F.reverse("reply")).alias("raw_translation_fr"), k.alias("reading_order"),
            F.array(k * 0, k * 50, k * 0 + 80, k * 50 + 40).alias("bbox"), F.when(n % 4 == 0, "validated").when(n % 4 == 1, "edited").when(n % 4 == 2, "ignored").otherwise("review").alias("manual_status"), F.when(n % 4 == 3, "[zone] coupé").otherwise("").alias("review_notes"),
        )
    )
