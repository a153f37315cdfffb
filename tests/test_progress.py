"""Passes over pages: what a pass does, skips and looks at again; passes that die; counters."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from inkloom.plans import queries
from inkloom.schema import as_blocks
from inkloom.streaming import progress as P
from inkloom.streaming import resume


def worker(texts=("a", "", "b"), dies=None):
    """Three blocks a page, but none on pages that 4 divides; the second has no translation and a warning."""

    def work(pages):
        x = pages.where("page_index % 4 <> 0").select("project_id", "page_index", F.posexplode(F.array(*map(F.lit, texts))).alias("i", "t"))
        if dies is not None:
            x = x.withColumn("t", F.when(F.col("page_index") == dies, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
        warned = F.when(F.col("t") == "", F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
        return as_blocks(x.select("project_id", "page_index", F.concat_ws("_", "page_index", "i").alias("block_id"), F.lit("x").alias("ocr_text"), F.col("t").alias("translation_fr"), warned.alias("quality_warnings")))

    return work


def test_passes(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    pages = spark.createDataFrame([("p", i, 10 * i) for i in range(1, 11)] + [("p", 1, 10), (None, 3, 1), ("p", None, 1)], "project_id string, page_index int, size int")
    large = F.when(F.col("size") > 80, F.concat(F.lit("too large: "), "size"))
    first = P.run_pass(pages, worker(), folder, skip=large)
    want = {"version": 1, "pages_total": 10, "pages_processed": 6, "pages_skipped": 2, "pages_empty": 2, "blocks": 18, "blocks_with_warnings": 6, "untranslated": 6, "last_skip_reason": "too large: 100"}
    assert {k: first[k] for k in want} == want and json.load(open(f"{tmp_path}/run/progress/pass-000001.json")) == first
    # nothing is done twice; skipped and empty pages are looked at again
    second = P.run_pass(pages, worker(("c",)), folder, skip=large)
    assert (second["pages_processed"], second["pages_skipped"], second["pages_empty"], second["blocks"]) == (0, 2, 2, 0)
    third = P.run_pass(pages, worker(("d",)), folder)
    assert (third["pages_processed"], third["pages_skipped"], third["pages_empty"], third["last_skip_reason"]) == (2, 0, 2, None)
    got = {(r.page_index, r.translation_fr) for r in P.results(spark, folder).collect()}
    assert got == {(i, t) for i in (1, 2, 3, 5, 6, 7) for t in ("a", "", "b")} | {(9, "d"), (10, "d")}
    assert {r.page_index: r.status for r in P.states(spark, folder).collect()} == {i: "empty" if i % 4 == 0 else "processed" for i in range(1, 11)}
    # forced: every page again, and its new blocks replace the old ones
    assert P.run_pass(pages, worker(("e",)), folder, force=True)["pages_processed"] == 8
    assert {r.translation_fr for r in P.results(spark, folder).collect()} == {"e"} and P.results(spark, folder).count() == 8
    assert P.all_states(spark, folder).count() == 10 + 4 + 4 + 10
    assert P.run_pass(pages.limit(0), worker(), f"file://{tmp_path}/none")["pages_total"] == 0


def test_a_pass_that_dies_counts_for_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    pages = spark.createDataFrame([("p", i) for i in range(1, 8)], "project_id string, page_index int").repartition(4)
    with pytest.raises(Exception, match="lost"):
        P.run_pass(pages, worker(dies=5), folder)
    assert P.states(spark, folder).count() == 0 and not os.path.exists(f"{tmp_path}/run/progress")
    again = P.run_pass(pages, worker(), folder)
    assert again["version"] == 1 and again["pages_processed"] == 6 and P.results(spark, folder).count() == 18


def test_the_listener_writes_the_counters_of_each_batch(spark, tmp_path):
    src, folder = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    listener = P.ProgressWriter(folder)
    spark.streams.addListener(listener)
    try:
        for n in (3, 2):
            (src / f"{n}.json").write_text("\n".join(json.dumps({"page_index": i}) for i in range(n)))
            work = lambda x: P.observed(as_blocks(x.select(F.lit("p").alias("project_id"), "page_index", F.lit("b").alias("block_id"))))
            resume.process_available(spark, str(src), "page_index int", work, str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination()
        until = time.time() + 60
        while time.time() < until and (not os.path.exists(tmp_path / "out/progress") or len([f for f in os.listdir(tmp_path / "out/progress") if f.endswith(".json")]) < 2):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = [json.load(open(tmp_path / "out/progress" / f)) for f in os.listdir(tmp_path / "out/progress") if f.endswith(".json")]
    assert sorted((g["blocks"], g["untranslated"]) for g in got if g["blocks"]) == [(2, 2), (3, 3)]


def test_a_pass_over_the_tables(spark, sf, tmp_path):
    """Blocks of all documents in two passes are those of one."""
    x = queries.doc_blocks(spark, sf)
    pages = x.select("project_id", "page_index").distinct()
    folder = f"file://{tmp_path}/run"
    work = lambda p: x.join(p.select("project_id", "page_index"), ["project_id", "page_index"], "left_semi")
    P.run_pass(pages.where("page_index % 3 = 0"), work, folder)
    P.run_pass(pages, work, folder)
    got = P.results(spark, folder)
    assert got.count() == x.count() and got.select("block_id").distinct().count() == x.select("block_id").distinct().count()
