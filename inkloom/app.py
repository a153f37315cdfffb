"""Applications for spark-submit: ``spark-submit inkloom/app.py COMMAND OPTIONS`` (or ``python -m inkloom.app``).

Every command reads and writes tables of the shared store and prints one JSON
line of what it did. Projects are read from JSON documents (or, with ``--lines``,
from files with a document a line, as the commands write them). Outputs must not
exist, unless ``--overwrite`` is given; a command never writes over its input.
Models are named ``module:function``; the function is a plug-in of
``inkloom.plans.plugins``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import re
import sys
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.score import with_quality
from inkloom.operators import blocks as B
from inkloom.operators import evaluate, memory, selection
from inkloom.plans import pipeline, plugins
from inkloom.sources import archives, sinks, tables
from inkloom.streaming import progress


def named(text: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, name = text.partition(":")
    if not module or not name:
        raise argparse.ArgumentTypeError(f"{text!r} isn't module:function")
    return getattr(importlib.import_module(module), name)


def share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"{text} isn't between 0 and 1")
    return value


def natural(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError(f"{text} is negative")
    return value


def words(text: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in text.split(",") if w.strip())


def read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return (tables.read_project_lines if a.lines else tables.read_projects)(spark, a.project)


def sample(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Chosen pages of archives, extracted below OUT with a manifest of their digests."""
    entries = archives.list_entries(spark, a.input)
    chosen = selection.sample_corpus(entries, volumes_per_series=a.volumes_per_series, pages_per_volume=a.pages_per_volume, series_mode=a.series_mode, mode=a.mode, seed=a.seed, skip_first=a.skip_first, skip_last=a.skip_last)
    at = entries.where("error is null").select(F.col("archive").alias("source_path"), F.col("entry").alias("source_image_name"), "bytes", "packed", "offset", "method", "crc", "error")
    rows = chosen.join(at, ["source_path", "source_image_name"]).withColumn("archive", F.col("source_path")).withColumn("entry", F.col("source_image_name"))
    done = archives.extract(rows, f"{a.out}/files")
    sinks.write_manifest(done.where("error is null"), f"{a.out}/manifest")
    unread = entries.where("error is not null").select("archive", "error").unionByName(done.where("error is not null").select("archive", "error"))
    unread.write.json(f"{a.out}/unread")
    return {"pages": done.where("error is null").count(), "unread": unread.count()}


def inspect(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Images of archives by archive."""
    x = archives.list_entries(spark, a.input).groupBy("archive").agg(F.count("entry").alias("images"), F.sum("bytes").alias("bytes"), F.first("error", ignorenulls=True).alias("error"))
    x.write.json(a.out)
    return {"archives": x.count()}


def process(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One pass over page images: recognise, prepare, translate and check what has no blocks yet."""
    registry = plugins.Registry()
    registry.register("recognizer", "app", a.recognizer)
    registry.register("translator", "app", a.translator)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.input)
    if a.glob:
        files = files.where(F.col("path").rlike(a.glob))
    names = tables.ranked(files.select("path", "length"), ["path"], "page_index")  # contents aren't read here
    pages = names.select(F.lit(a.name).alias("project_id"), F.col("page_index").cast("int").alias("page_index"), F.lit(a.lang).alias("source_lang"), "path", "length")
    large = F.when(F.col("length") > a.max_bytes, F.concat(F.lit("page of "), "length", F.lit(" bytes"))) if a.max_bytes else None

    def translator(batches):
        import pandas as pd
        import pyarrow as pa

        kind = plugins.KINDS["translator"]
        run = plugins.checked(a.translator, kind)
        for p in batches:
            asked = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(len(p))], "text": p["text"].tolist(), "lang": [a.lang] * len(p)}, plugins._arrow(kind.gets))
            made = {k: t for b in run(iter((asked,))) for k, t in zip(b.column("key").to_pylist(), b.column("translation").to_pylist())}
            yield pd.DataFrame({"text": p["text"], "translation": [made[str(i)] for i in range(len(p))]})

    def work(todo: DataFrame) -> DataFrame:
        found = plugins.recognise(registry, "app", todo.join(files.select("path", F.col("content").alias("image")), "path"))
        return pipeline.process(found, translator)

    return progress.run_pass(pages, work, a.out, skip=large, force=a.force)


def analysis(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The review dataset of projects: rows, learned counts, glossary and quality report."""
    x = with_quality(read(spark, a))
    sinks.write_dataset(x, a.out)
    return {"blocks": x.count()}


def learn(spark: SparkSession, a: argparse.Namespace) -> dict:
    """What a corpus teaches: tokens, names, repeated sources and weights."""
    x = with_quality(read(spark, a))
    sinks.write_profile(x, a.out, a.max_items)
    return {"blocks": x.count()}


def review_pack(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The blocks that are worth a review, as a tab-separated table with empty columns for the decisions, the same as JSON lines, and a guide."""
    x = selection.review_pack(with_quality(read(spark, a)), limit=a.max_blocks, include_ok=a.include_ok, only_high=a.only_high, balanced=not a.not_balanced)
    sinks.write_review_pack(sinks.review_rows(x), a.out)
    return {"rows": spark.read.json(f"{a.out}/jsonl").count()}


def apply_review(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Projects with the decisions of a review table (or of the one table below a folder)."""
    review = tables.read_review_table(spark, tables.find_review(spark, a.review)).withColumn("seq", F.monotonically_increasing_id())
    applied = B.apply_review(read(spark, a), review)
    sinks.write_projects(applied, a.out)
    return B.review_counts(applied, review).first().asDict()


def refresh(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Blocks that nobody has decided yet prepared and checked again."""
    own = read(spark, a)
    x = pipeline.refresh(own, a.lang, include_review=a.include_review)
    sinks.write_projects(x, a.out)
    return {"blocks": own.count(), "refreshed": own.where(B.refreshable(a.lang, a.include_review)).count()}


def diagnose(spark: SparkSession, a: argparse.Namespace) -> dict:
    """What reviewers changed, by category, with examples."""
    items = evaluate.diagnose(read(spark, a))
    sinks.write_diagnosis(items, a.out)
    return {"items": items.count()}


def replay(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Reviewed blocks against those of a second run, for some pages or all."""
    own = read(spark, a)
    targets = own.where(F.col("manual_status").isin(*a.statuses))
    if a.pages:
        targets = targets.join(tables.page_list(spark, a.pages), "page_index", "left_semi")
    if a.failures_from:
        targets = targets.join(tables.failing_pages(spark, a.failures_from, a.failure_statuses), "page_index", "left_semi")
    found = (tables.read_project_lines if a.lines else tables.read_projects)(spark, a.found)
    results = evaluate.replay(targets, found, least_iou=a.min_iou, source_at=a.source_threshold, translation_at=a.translation_threshold)
    sinks.write_replay(results, a.out)
    return {"targets": results.count()}


def build_memory(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A memory by majority of the votes of reviewed blocks."""
    x = read(spark, a)
    votes = {"translation": lambda: memory.votes_for_translations(x, a.statuses), "ocr": lambda: memory.votes_for_corrections(x, a.statuses), "ignore": lambda: memory.votes_for_ignoring(x)}[a.kind]()
    m = memory.majority(votes)
    sinks.write_memory(m, a.out)
    return {"entries": m.count()}


def export_html(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Pages as HTML, a row a page."""
    x = sinks.html_pages(read(spark, a))
    x.write.json(a.out)
    return {"pages": x.count()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, project: bool = True, resumes: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=run.__doc__, description=run.__doc__)
        c.set_defaults(run=run, resumes=resumes)
        c.add_argument("--out", required=True)
        c.add_argument("--overwrite", action="store_true", help="delete OUT first")
        c.add_argument("--project" if project else "--input", required=True)
        if project:
            c.add_argument("--lines", action="store_true", help="a document on every line")
        return c

    c = command("sample", sample, False)
    c.add_argument("--pages-per-volume", type=natural, default=25)
    c.add_argument("--volumes-per-series", type=natural, default=2)
    c.add_argument("--seed", type=int, default=47)
    c.add_argument("--mode", choices=["mixed", "stratified", "random"], default="mixed")
    c.add_argument("--series-mode", choices=["mixed", "first", "last", "random"], default="mixed")
    c.add_argument("--skip-first", type=natural, default=2)
    c.add_argument("--skip-last", type=natural, default=1)
    command("inspect", inspect, False)
    c = command("process", process, False, resumes=True)
    c.add_argument("--recognizer", type=named, required=True)
    c.add_argument("--translator", type=named, required=True)
    c.add_argument("--name", default="corpus")
    c.add_argument("--lang", choices=["en", "ja"], default="en")
    c.add_argument("--glob", default="")
    c.add_argument("--max-bytes", type=natural, default=0)
    c.add_argument("--force", action="store_true")
    command("analysis", analysis)
    command("learn", learn).add_argument("--max-items", type=natural, default=120)
    c = command("review-pack", review_pack)
    c.add_argument("--max-blocks", type=natural, default=200)
    for flag in ("--include-ok", "--only-high", "--not-balanced"):
        c.add_argument(flag, action="store_true")
    command("apply-review", apply_review).add_argument("--review", required=True)
    c = command("refresh", refresh)
    c.add_argument("--lang", choices=["en", "ja"], default="en")
    c.add_argument("--include-review", action="store_true")
    command("diagnose", diagnose)
    c = command("replay", replay)
    c.add_argument("--found", required=True)
    c.add_argument("--statuses", type=words, default=("edited", "validated"))
    c.add_argument("--pages", default="")
    c.add_argument("--failures-from", default="")
    c.add_argument("--failure-statuses", type=words, default=("missing", "mismatch"))
    c.add_argument("--min-iou", type=share, default=0.35)
    c.add_argument("--source-threshold", type=share, default=0.92)
    c.add_argument("--translation-threshold", type=share, default=0.85)
    c = command("memory", build_memory)
    c.add_argument("--kind", choices=["translation", "ocr", "ignore"], required=True)
    c.add_argument("--statuses", type=words, default=("edited", "validated"))
    command("export-html", export_html)
    return p


def prepare_output(a: argparse.Namespace) -> None:
    """OUT is new, or a folder of a run that goes on; inputs are left alone."""
    plain = lambda x: os.path.normpath(re.sub("^file:/*", "/", x) if x.startswith(("file:", "/")) else x) + "/"
    inside = lambda x, y: plain(x).startswith(plain(y))
    for name in ("project", "input", "review", "found"):
        if (x := getattr(a, name, None)) and (inside(x, a.out) or inside(a.out, x)):
            raise SystemExit(f"--out would write over --{name}")
    store, path = fs.FileSystem.from_uri(a.out)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        if a.overwrite:
            store.delete_dir(path)
        elif not a.resumes:
            raise SystemExit(f"{a.out} exists; give --overwrite to replace it")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    if a.out.startswith("/"):
        a.out = f"file://{a.out}"
    prepare_output(a)
    spark = spark or SparkSession.builder.appName(f"inkloom {a.command}").getOrCreate()
    done = {"command": a.command, **a.run(spark, a)}
    print(json.dumps(done, ensure_ascii=False, default=str))
    return done


if __name__ == "__main__":
    main(sys.argv[1:])
