"""Plug-ins: what registering refuses, and deterministic stand-ins over binary images."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkloom.plans import plugins as P
from inkloom.plans.pipeline import blocks_of_fragments


def upper(row):
    return [{"key": row["key"], "translation": f"{row['lang']}:{row['text'].upper()}"}]


def registry():
    def read_image(row):
        """An image of this test is its text, a line for each fragment."""
        lines = [line for line in row["image"].decode("latin-1").split("\n") if line]
        return [{"page": row["page"], "ord": i, "polygon": [[0.0, 40.0 * i], [80.0, 40.0 * i], [80.0, 40.0 * i + 30], [0.0, 40.0 * i + 30]], "text": t, "confidence": 0.9 if row["lang"] == "en" else None} for i, t in enumerate(lines)]

    def upper(row):
        return [{"key": row["key"], "translation": f"{row['lang']}:{row['text'].upper()}"}]

    r = P.Registry()
    r.register("recognizer", "lines", P.by_row("recognizer", read_image))
    r.register("translator", "upper", P.by_row("translator", upper))
    r.register("scorer", "size", P.by_row("scorer", lambda row: [{"key": row["key"], "score": float(len(row["image"]))}]))
    return r


def test_registering_refuses_what_does_not_answer_as_declared():
    r = registry()
    gives = P._arrow(P.KINDS["translator"].gives)
    as_given = lambda f: lambda batches: (f(b) for b in batches)
    bad = {
        "columns": as_given(lambda b: pa.RecordBatch.from_pydict({"key": b.column("key"), "out": b.column("text")})),
        "instead of string": as_given(lambda b: pa.RecordBatch.from_pydict({"key": b.column("key"), "translation": pa.array([1] * b.num_rows)})),
        "no answer": as_given(lambda b: pa.RecordBatch.from_pydict({"key": [], "translation": []}, gives)),
        "wasn't asked": as_given(lambda b: pa.RecordBatch.from_pydict({"key": ["zz"] * b.num_rows, "translation": ["x"] * b.num_rows}, gives)),
        "answered before": as_given(lambda b: pa.RecordBatch.from_pydict({"key": [k for k in b.column("key").to_pylist() for _ in "ab"], "translation": ["x"] * 2 * b.num_rows}, gives)),
        "null in key": as_given(lambda b: pa.RecordBatch.from_pydict({"key": [None] * b.num_rows, "translation": ["x"] * b.num_rows}, gives)),
        "ZeroDivisionError": as_given(lambda b: 1 // 0),
    }
    for said, model in bad.items():
        with pytest.raises(P.PluginError, match=said):
            r.register("translator", f"bad {said}", model)
    assert r.names("translator") == ["upper"]
    with pytest.raises(P.PluginError, match="no kind"):
        r.register("singer", "x", bad["columns"])
    with pytest.raises(P.PluginError, match="is known"):
        r.register("translator", "upper", P.by_row("translator", upper))
    r.register("translator", "upper", P.by_row("translator", upper), replace=True)
    with pytest.raises(P.PluginError, match="no recognizer named 'x': lines"):
        r.get("recognizer", "x")


def test_recognised_pages_become_blocks(spark):
    images = [("p", i, "en" if i % 2 else "ja", f"HELLO {i}\nTHERE".encode() if i % 5 else b"") for i in range(40)]
    df = spark.createDataFrame(images + [images[3]] * 2 + [("p", 90, "en", None), (None, 1, "en", b"x"), ("a|\"b", 1, None, b"one")], "project_id string, page_index int, source_lang string, image binary").withColumn("page", F.lit("clash"))
    got = P.recognise(registry(), "lines", df.repartition(7))
    by = {}
    for r in got.collect():
        by.setdefault((r.project_id, r.page_index), []).append((r.raw_order, r.text, r.confidence, r.source_lang))
    want = {("p", i): [(0, f"HELLO {i}", 0.9 if i % 2 else None, lang), (1, "THERE", 0.9 if i % 2 else None, lang)] for _, i, lang, _ in images if i % 5} | {("a|\"b", 1): [(0, "one", None, None)]}
    assert {k: sorted(v) for k, v in by.items()} == want
    blocks = blocks_of_fragments(got.where("source_lang = 'en'"), drop_noise=False, merge_lines=False)
    assert blocks.count() == 2 * sum(i % 5 > 0 and i % 2 for i in range(40))
    assert P.recognise(registry(), "lines", df.limit(0)).count() == 0


def test_translations_and_answers_that_go_wrong_later(spark):
    texts = spark.createDataFrame([("hi", "en"), ("hi", "ja"), ("hi", None), ("hi", "en"), (" ", "en"), (None, "en")], "text string, lang string")
    assert sorted(map(tuple, P.translations(registry(), "upper", texts).collect()), key=repr) == sorted([("hi", "en", "en:HI"), ("hi", "ja", "ja:HI"), ("hi", None, "None:HI")], key=repr)
    r = registry()
    r.register("translator", "shy", P.by_row("translator", lambda row: [] if row["text"] == "secret" else [{"key": row["key"], "translation": ""}]))
    with pytest.raises(Exception, match="no answer"):
        P.translations(r, "shy", spark.createDataFrame([("secret", "en")], "text string, lang string")).collect()
    images = spark.createDataFrame([("a", b"xyz"), ("b", b"")], "key string, image binary")
    assert sorted(map(tuple, r.run("scorer", "size", images).collect())) == [("a", 3.0), ("b", 0.0)]
