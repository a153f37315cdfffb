"""The applications, end to end over files."""

import hashlib
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom import app
from inkloom.plans import queries
from inkloom.sources import sinks, tables


def lines(folder):
    return [json.loads(x) for n in sorted(os.listdir(folder)) if n.startswith("part-") for x in open(f"{folder}/{n}", encoding="utf-8")]


@pytest.fixture(scope="module")
def project(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("p") / "projects")
    sinks.write_projects(queries.doc_blocks(spark, sf), f"file://{path}")
    return path


def test_from_review_pack_to_memory(spark, project, tmp_path):
    """Packed, reviewed, applied, learned from, replayed and diagnosed."""
    own = ["--project", project, "--lines"]
    assert app.main(["review-pack", *own, "--out", f"{tmp_path}/pack", "--max-blocks", "30"], spark)["rows"] == 30
    rows = lines(f"{tmp_path}/pack/jsonl")
    assert len(rows) == 30 and list(rows[0])[:5] == list(sinks.EDITABLE) and "| sfx |" in open([f"{tmp_path}/pack/guide/{n}" for n in os.listdir(f"{tmp_path}/pack/guide") if n.startswith("part-")][0]).read()
    table = tables.find_review(spark, f"{tmp_path}/pack/table")
    assert table == f"file://{tmp_path}/pack/table"
    reviewed = tables.read_review_table(spark, table)
    reviewed = reviewed.withColumn("review_decision", F.lit("correct")).withColumn("corrected_fr", F.concat(F.lit("corrigé "), "block_id"))
    reviewed.write.csv(f"{tmp_path}/done/review.csv", header=True, escape='"', emptyValue="")
    got = app.main(["apply-review", *own, "--review", f"{tmp_path}/done", "--out", f"{tmp_path}/applied"], spark)
    assert (got["corrected"], got["changed"], got["skipped"]) == (30, 30, 0)
    applied = tables.read_project_lines(spark, f"{tmp_path}/applied")
    assert applied.where("manual_status = 'edited' and translation_fr = concat('corrigé ', block_id)").count() == 30 and applied.count() == queries.table(spark, "/root/testdata/sf0.001", "documents").count()
    made = ["--project", f"{tmp_path}/applied", "--lines"]
    m = app.main(["memory", *made, "--kind", "translation", "--out", f"{tmp_path}/memory"], spark)
    assert m["entries"] == len(lines(f"{tmp_path}/memory")) > 10
    assert app.main(["diagnose", *made, "--out", f"{tmp_path}/diagnosis"], spark)["items"] == len(lines(f"{tmp_path}/diagnosis/items")) >= 30
    r = app.main(["replay", *made, "--found", project, "--statuses", "edited", "--out", f"{tmp_path}/replay"], spark)
    assert r["targets"] == 30 == sum(x["status"] != "match" for x in lines(f"{tmp_path}/replay/mismatches")) + sum(x["status"] == "match" for x in lines(f"{tmp_path}/replay/results"))
    text = "".join(open(f"{tmp_path}/replay/report/{n}").read() for n in sorted(os.listdir(f"{tmp_path}/replay/report")) if n.startswith("part-"))
    assert text.startswith("# Replay") and "- targets: 30" in text and text.index("1 totals") < text.index("2 statuses")


def test_reports_and_refresh(spark, project, tmp_path):
    own = ["--project", project, "--lines"]
    n = queries.doc_blocks(spark, "/root/testdata/sf0.001").count()
    assert app.main(["analysis", *own, "--out", f"{tmp_path}/a"], spark)["blocks"] == n
    head = open([f"{tmp_path}/a/rows/csv/{f}" for f in sorted(os.listdir(f"{tmp_path}/a/rows/csv")) if f.startswith("part-")][0], "rb").read(3)
    assert head == b"\xef\xbb\xbf" and tables.read_review_table(spark, f"{tmp_path}/a/rows/csv").columns[0] == sinks.REVIEW_COLUMNS[0] and len(lines(f"{tmp_path}/a/learning/summary")) == 1
    assert app.main(["learn", *own, "--out", f"{tmp_path}/l", "--max-items", "5"], spark)["blocks"] == n
    assert sum(1 for f in os.listdir(f"{tmp_path}/l/glossary") if f.startswith("part-") for _ in open(f"{tmp_path}/l/glossary/{f}")) <= 5
    got = app.main(["refresh", *own, "--out", f"{tmp_path}/r", "--include-review"], spark)
    assert got["blocks"] == n == tables.read_project_lines(spark, f"{tmp_path}/r").count() and got["refreshed"] > 0
    assert app.main(["export-html", *own, "--out", f"{tmp_path}/h"], spark)["pages"] == len(lines(f"{tmp_path}/h"))


def test_outputs_and_options(spark, project, tmp_path, capsys):
    own = ["--project", project, "--lines"]
    app.main(["memory", *own, "--kind", "ignore", "--out", f"{tmp_path}/m"], spark)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["command"] == "memory"
    with pytest.raises(SystemExit, match="exists"):
        app.main(["memory", *own, "--kind", "ignore", "--out", f"{tmp_path}/m"], spark)
    app.main(["memory", *own, "--kind", "ignore", "--out", f"{tmp_path}/m", "--overwrite"], spark)
    with pytest.raises(SystemExit, match="write over"):
        app.main(["apply-review", *own, "--review", f"{tmp_path}/x", "--out", project, "--overwrite"], spark)
    for bad in (["replay", *own, "--found", "x", "--out", "y", "--min-iou", "2"], ["review-pack", *own, "--out", "y", "--max-blocks", "-1"], ["process", "--input", "x", "--out", "y", "--recognizer", "none", "--translator", "a:b"], ["dance"]):
        with pytest.raises(SystemExit):
            app.main(bad, spark)
    for n in ("a.csv", "b.tsv"):
        (tmp_path / "two").mkdir(exist_ok=True)
        (tmp_path / "two" / n).write_text("x")
    with pytest.raises(ValueError, match="2 review tables"):
        tables.find_review(spark, f"{tmp_path}/two")
    assert tables.find_review(spark, f"{tmp_path}/two/a.csv").endswith("two/a.csv")


def models():
    """Stand-ins: an image is its text, a translation its capitals."""
    from inkloom.plans.plugins import by_row

    box = [[0.0, 0.0], [90.0, 0.0], [90.0, 30.0], [0.0, 30.0]]
    return (
        by_row("recognizer", lambda r: [{"page": r["page"], "ord": 0, "polygon": box, "text": r["image"].decode(), "confidence": 0.95}] if r["image"].isascii() and r["image"].strip() and r["image"] != b"\x89PNG" else []),
        by_row("translator", lambda r: [{"key": r["key"], "translation": r["text"].upper()}]),
    )


def test_sampled_and_processed(spark, tmp_path, monkeypatch):
    """Archives to extracted pages, and these to blocks in two passes."""
    rng = random.Random(2)
    for v in range(3):
        os.makedirs(f"{tmp_path}/lib/s{v % 2}", exist_ok=True)
        with zipfile.ZipFile(f"{tmp_path}/lib/s{v % 2}/v{v}.cbz", "w") as z:
            for i in range(8):
                z.writestr(f"{i:02d}.png", f"Good morning number {rng.randint(0, 10**6)} of volume {v}.")
    (tmp_path / "lib/s0/bad.zip").write_bytes(b"nothing")
    assert app.main(["inspect", "--input", f"{tmp_path}/lib", "--out", f"{tmp_path}/seen"], spark)["archives"] == 4
    got = app.main(["sample", "--input", f"{tmp_path}/lib", "--out", f"{tmp_path}/s", "--pages-per-volume", "3", "--volumes-per-series", "1"], spark)
    assert got == {"command": "sample", "pages": 6, "unread": 1}
    manifest = lines(f"{tmp_path}/s/manifest/jsonl")
    assert len(manifest) == 6 and all(hashlib.sha256(open(f"{tmp_path}/s/files/{r['output_relpath']}", "rb").read()).hexdigest() == r["output_sha256"] for r in manifest)
    import sys
    import types

    plug = types.ModuleType("plug_ins_of_this_test")
    plug.read, plug.speak = models()
    monkeypatch.setitem(sys.modules, plug.__name__, plug)
    run = ["process", "--input", f"{tmp_path}/s/files/pages", "--out", f"{tmp_path}/run", "--recognizer", "plug_ins_of_this_test:read", "--translator", "plug_ins_of_this_test:speak", "--glob", r"\.png$"]
    first = app.main([*run, "--max-bytes", "5"], spark)
    assert (first["pages_total"], first["pages_skipped"], first["blocks"]) == (6, 6, 0)
    second = app.main(run, spark)
    assert (second["version"], second["pages_processed"], second["blocks"]) == (2, 6, 6)
    from inkloom.streaming import progress

    texts = {(r.ocr_text, r.translation_fr) for r in progress.results(spark, f"file://{tmp_path}/run").collect()}
    assert len(texts) == 6 and all(t.upper() == f for t, f in texts) and app.main(run, spark)["pages_processed"] == 0
