"""Passes over a corpus that keep count and can be stopped: what was done, what was skipped and why.

A pass works on the pages that have no blocks yet. It writes its blocks, then
one row of state for each page it looked at, under the pass's own version; the
state is what counts, so a pass that dies leaves nothing that is read, and the
next one takes its version. Pages that were skipped, and pages whose work gave no
block, are looked at again by every later pass.

The counters of a pass are observed on its rows while they are written
(``DataFrame.observe``); of a stream, a listener writes those of each batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from inkloom.operators.blocks import blank

STATE = "project_id string, page_index int, status string, reason string, n_blocks long, version int"
PAGE = ["project_id", "page_index"]


def counters() -> list[Column]:
    """Of rows of blocks: how many, with warnings, and without a translation though not ignored."""
    return [
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.size("quality_warnings") > 0).alias("blocks_with_warnings"), F.count_if(blank("translation_fr") & (F.col("manual_status") != "ignored")).alias("untranslated"),
    ]


def all_states(spark: SparkSession, folder: str) -> DataFrame:
    """project_id, page_index, status, reason, n_blocks and version of every page of every pass."""
    try:
        return spark.read.schema(STATE).parquet(f"{folder}/state")
    except AnalysisException:  # no pass yet
        return spark.createDataFrame([], STATE)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each page."""
    x = all_states(spark, folder).groupBy(*PAGE).agg(F.max_by(F.struct("status", "reason", "n_blocks", "version"), "version").alias("s"))
    return x.select(*PAGE, "s.*")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of processed pages, each from the pass that processed it last."""
    done = states(spark, folder).where("status = 'processed'").select(*PAGE, "version")
    return spark.read.parquet(f"{folder}/blocks").join(done, [*PAGE, "version"], "left_semi").drop("version")


def to_do(spark: SparkSession, pages: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Pages without blocks so far; all pages, if forced."""
    if force:
        return pages
    done = states(spark, folder).where("status = 'processed'").select(*PAGE)
    return pages.join(done, PAGE, "left_anti")


def run_pass(pages: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, *, skip: Column | None = None, force: bool = False) -> dict:
    """One pass of ``work`` (pages to blocks) over the pages that are to do; returns its counters, which are written too.

    ``skip``: why a page isn't worked on, or an empty or null text. Repeated
    pages are one; rows without a project or page number are left out. Counters:
    version, pages_total, pages_processed, pages_skipped, pages_empty, blocks,
    blocks_with_warnings, untranslated, last_skip_reason, elapsed_seconds.
    """
    spark, began = pages.sparkSession, time.monotonic()
    version = (all_states(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    own = pages.dropDuplicates(PAGE).dropna(subset=PAGE)
    todo = to_do(spark, own.withColumn("_why", F.coalesce(skip, F.lit("")) if skip is not None else F.lit("")), folder, force)
    seen = Observation(f"pass-{version}")
    made = work(todo.where("_why = ''").drop("_why")).withColumn("version", F.lit(version))
    made.observe(seen, *counters()).write.mode("overwrite").parquet(f"{folder}/blocks/version={version}/")
    blocks = spark.read.parquet(f"{folder}/blocks/version={version}/").groupBy(*PAGE).agg(F.count("*").alias("n_blocks"))
    x = todo.select(*PAGE, "_why").join(blocks, PAGE, "left").na.fill(0, ["n_blocks"])
    status = F.when(F.col("_why") != "", "skipped").when(F.col("n_blocks") == 0, "empty").otherwise("processed")
    count = lambda s: F.count_if(status == s).alias(f"pages_{s}")
    pass_pages = Observation(f"pages-{version}")
    last = F.max_by(F.nullif(F.col("_why"), F.lit("")), F.when(F.col("_why") != "", F.struct(*PAGE))).alias("last_skip_reason")
    x = x.observe(pass_pages, count("processed"), count("skipped"), count("empty"), last)
    x.select(*PAGE, status.alias("status"), F.col("_why").alias("reason"), "n_blocks", F.lit(version).alias("version")).write.mode("append").parquet(f"{folder}/state")
    got = {"version": version, "pages_total": own.count(), **pass_pages.get, **seen.get, "elapsed_seconds": round(time.monotonic() - began, 3)}
    put(f"{folder}/progress/pass-{version:06d}.json", got)
    return got


def put(path: str, values: dict) -> None:
    """A small JSON file, written from the driver under another name first."""
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{name}.part") as f:
        f.write(json.dumps(values, ensure_ascii=False, sort_keys=True).encode())
    store.move(f"{name}.part", name)


def observed(blocks: DataFrame, name: str = "progress") -> DataFrame:
    """A stream of blocks whose counters ``ProgressWriter`` writes."""
    return blocks.observe(name, *counters())


class ProgressWriter(StreamingQueryListener):
    """Writes the observed counters of every batch of every stream to ``folder``/progress; add it with ``spark.streams.addListener``."""

    def __init__(self, folder: str, name: str = "progress"):
        self.folder, self.name = folder, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is not None:
            put(f"{self.folder}/progress/batch-{p.runId}-{p.batchId:06d}.json", {"batch": p.batchId, "rows_read": p.numInputRows, **row.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
