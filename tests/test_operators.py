"""Cases that the tables don't reach: fixtures with known answers, and brute force."""

import io
import json
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from inkloom.functions import detect, text
from inkloom.functions.score import band, row_risk, with_quality
from inkloom.operators import blocks as B
from inkloom.operators import evaluate, geometry, learning, memory, selection
from inkloom.operators.terms import protect_terms
from inkloom.schema import as_blocks
from inkloom.sources import sinks, tables
from inkloom.streaming import resume


def blocks(spark, *rows):
    base = {"project_id": "p", "page_index": 0}
    rows = [{**base, "seq": i, "block_id": f"b{i}", "reading_order": i, **r} for i, r in enumerate(rows)]
    names = sorted({k for r in rows for k in r})
    kinds = {"bbox": "array<int>", "confidence": "double", "quality_warnings": "array<string>", "seq": "long", "page_index": "int", "reading_order": "int", "ocr_alternatives": "array<struct<engine:string,text:string,confidence:double,score:double,note:string>>"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return as_blocks(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, key", [(" Hello  ... ", "hello"), ("Right??", "right?"), ("“Wait !!”", "wait!"), ("", ""), ("L’AMI :", "l'ami")])
def test_memory_key(spark, raw, key):
    assert one(spark, text.memory_key, raw) == key


def test_replay_key(spark):
    assert one(spark, text.replay_key, "Hello  !") == one(spark, text.replay_key, "hello!") == "hello!"


def test_natural_order(spark):
    df = spark.createDataFrame([("p10.jpg",), ("P2.jpg",), ("p1.jpg",), ("cover.jpg",)], "n string")
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n"))).collect()] == ["cover.jpg", "p1.jpg", "P2.jpg", "p10.jpg"]


def test_path_labels(spark):
    s, v = text.path_labels(F.col("p"))
    df = spark.createDataFrame([("x/pages/A/B/c.png",), ("a/b.png",)], "p string")
    assert values(df, s, v) == [("A", "B"), ("", "")]


@pytest.mark.parametrize("t, want", [("SLAM!", True), ("OK", False), ("", True), ("?!", True), ("SAAAAA (fwsssh)", True), ("Where are you going?", False), ("HAHAHA", True)])
def test_sound_or_noise(spark, t, want):
    assert one(spark, detect.sound_or_noise, t) is want


@pytest.mark.parametrize("t, want", [("hosted at mangafox", "credit scantrad"), ("ATM card fee", "signalétique/interface"), ("maximum depth 30", "infographie/signaletique"), ("SLAM", "sfx/bruit"), ("IS THAT IT?", "")])
def test_skip_reason(spark, t, want):
    assert one(spark, detect.skip_reason, t) == want


def test_dialogue_vetoes_a_learned_reason(spark):
    df = spark.createDataFrame([("you are a long sentence of dialogue", "ignore appris"), ("BRRRM", "ignore appris")], "t string, m string")
    assert [r[0] for r in df.select(detect.skip_reason(F.col("t"), F.col("m"))).collect()] == ["", "ignore appris"]


def test_zones(spark):
    assert one(spark, detect.zone_categories, "and this is what,") == ["zone_too_small", "split_bubble"]
    assert one(spark, detect.zone_categories, "BAM we go to the house now.") == ["sfx_mixed", "fused_bubble"]
    assert one(spark, detect.note_categories, "[zone] ?") == ["zone_too_small"]


def test_quality_rules(spark):
    x = with_quality(blocks(spark, {"ocr_text": "Inhook this", "normalized_source_text": "unhook this", "translation_fr": "Décroche ça.", "confidence": 0.55, "manual_status": "validated"}, {"ocr_text": "the on plane", "translation_fr": "sur le plan", "confidence": 0.45, "quality_warnings": ["w"]}, {"ocr_text": "", "translation_fr": ""}))
    rows = x.orderBy("seq").collect()
    assert rows[0].suggested_action == "validated" and rows[0].source == "unhook this"
    assert rows[1].risk_score >= 25 and rows[1].suggested_action.startswith("review_")
    assert rows[2].risk_score == 65 and rows[2].risk_reasons == ["empty source", "empty translation"]


def test_bands(spark):
    df = spark.createDataFrame([("80.9",), ("x",), (None,), ("30",)], "v string")
    assert [r[0] for r in df.select(band(row_risk(F.col("v")))).collect()] == ["HIGH", "OK", "OK", "MED"]


def test_review_decisions(spark):
    b = blocks(spark, {"block_id": "a1", "ocr_text": "x"}, {"block_id": "b1", "ocr_text": "y"}, {"block_id": "c1"})
    r = spark.createDataFrame([("0", "a1", "correct", "X", "Y", "Z", "", 0), ("0", "b1", "sfx", "", "", "", "boum", 1), ("0", "zz", "ok", "", "", "", "", 2), ("x", "c1", "ok", "", "", "", "", 3)], "page_index string, block_id string, review_decision string, corrected_ocr string, corrected_source string, corrected_fr string, review_notes string, seq long")
    r = r.withColumn("page_index", F.col("page_index").try_cast("int"))
    got = {x.block_id: x for x in B.apply_review(b, r).collect()}
    assert (got["a1"].manual_status, got["a1"].ocr_corrected_text, got["a1"].raw_translation_fr) == ("edited", "X", "Z")
    assert (got["b1"].manual_status, got["b1"].review_notes) == ("ignored", "[sfx] boum")
    assert B.review_counts(B.apply_review(b, r), r).first().asDict() == {"changed": 2, "validated": 0, "corrected": 1, "ignored": 1, "review": 0, "skipped": 2}


def test_edits(spark):
    b = blocks(spark, {"ocr_text": "a\nb\n\nc", "bbox": [10, 0, 20, 30], "translation_fr": "t", "ocr_alternatives": [("e", "alt", 0.5, 1.0, "")]}, {"ocr_text": "d", "bbox": [0, 40, 60, 60], "manual_status": "ignored"})
    assert values(B.split_lines(b), "block_id", "ocr_text", "bbox", "reading_order") == [("b0_s1", "a", [10, 0, 20, 10], 0), ("b0_s2", "b", [10, 10, 20, 20], 1), ("b0_s3", "c", [10, 20, 20, 30], 2)]
    assert values(B.merge_blocks(b, F.lit(1)), "block_id", "ocr_text", "bbox") == [("b0", "a\nb\n\nc\nd", [0, 0, 60, 60])]
    assert values(B.use_alternative(b, F.lit(0), F.col("seq") == 0).orderBy("seq"), "ocr_text", "translation_fr", "manual_status") == [("alt", "", "edited"), ("d", "", "ignored")]
    assert values(B.set_field(b, "translation_fr", F.lit(" u "), F.lit(True)).orderBy("seq"), "translation_fr", "manual_status") == [("u", "edited"), ("u", "ignored")]


def test_empty_tables(spark):
    b = blocks(spark, {}).limit(0)
    for f in (B.page_stats, B.project_stats, B.renumber, B.split_lines, B.auto_ignore, learning.suspicious_tokens, evaluate.diagnose, geometry.group_lines):
        x = with_quality(b) if f is learning.suspicious_tokens else b
        assert f(x).count() == 0


def test_learned_tokens(spark):
    rows = with_quality(blocks(spark, {"ocr_text": "I know 1 have TO ROB OR STEAL", "translation_fr": "Je sais que je dois steal"}, {"ocr_text": "Kanade is here", "translation_fr": "Kanade est ici"}))
    assert "steal" in [r.token for r in learning.residue_tokens(rows).collect()]
    assert [r.token for r in learning.name_candidates(rows).collect()] == ["Kanade"]


def test_memories(spark):
    b = blocks(
        spark,
        {"ocr_text": "Hello  ...", "translation_fr": "Salut", "manual_status": "edited"}, {"ocr_text": "hello", "translation_fr": "Bonjour", "manual_status": "validated"},
        {"ocr_text": "hello", "translation_fr": "Bonjour", "manual_status": "validated"}, {"ocr_text": "nope", "translation_fr": "non", "manual_status": "unchecked"},
        {"ocr_text": "BLOPR ME N0W", "ocr_corrected_text": "help me now!", "translation_fr": "aide-moi", "manual_status": "edited"}, {"ocr_text": "SAAAAA (fwsssh)", "manual_status": "ignored", "review_notes": "[sfx]"},
    )
    tm = {r.key: r for r in memory.majority(memory.votes_for_translations(b)).collect()}
    assert tm["hello"].value == "Bonjour" and tm["hello"].n_values == 2 and "nope" not in tm
    assert values(memory.majority(memory.votes_for_corrections(b)), "key", "value") == [("blopr me n0w", "help me now!")]
    assert values(memory.majority(memory.votes_for_ignoring(b)), "key", "value") == [("saaaaa (fwsssh)", "ignore appris: sfx/bruit")]


def test_fuzzy_lookup_against_brute_force(spark):
    keys = ["who do you think i am? i am sonic sodom, you know!", "this is a line that nobody says at all", "this is a line that nobody said at all", "short", "completely other words are in here today"]
    asked = ["who do you think i am? i am sonic sodom you know!", "this is a line that nobody sayz at all", "completely different words are not here now ok", "tiny"]
    m = spark.createDataFrame([(k, f"v{i}", i) for i, k in enumerate(keys)], "key string, value string, seq long")
    got = {r.key: r.memory_key for r in memory.fuzzy(spark.createDataFrame([(a,) for a in asked], "key string"), m).collect()}
    import re

    want = {}
    for a in asked:
        ta = set(re.findall("[a-z0-9']+", a))
        if len(a) < 16 or len(ta) < 3:
            continue
        best = max(((SequenceMatcher(None, a, k).ratio(), -i) for i, k in enumerate(keys) if abs(len(a) - len(k)) <= max(12, len(a) // 4) and len(ta & set(re.findall("[a-z0-9']+", k))) / max(len(ta), len(set(re.findall("[a-z0-9']+", k)))) >= 0.72), default=(0, 0))
        if best[0] >= 0.94:
            want[a] = keys[-best[1]]
    assert got == want and len(want) == 2


def test_glossary(spark):
    terms = memory.parse_glossary(spark.createDataFrame([("Sea=>Mer; ki = qi, Tom\n",)], "terms string"))
    assert values(terms, "source", "target") == [("Sea", "Mer"), ("ki", "qi"), ("Tom", "Tom")]
    x = protect_terms(spark.createDataFrame([("SEA of kings, ki.",), (None,)], "text string"), terms)
    assert sorted(values(x, "restored")) == [("",), ("Mer of kings, qi.",)]


def test_boxes(spark):
    a, b = F.array(*map(F.lit, (0, 0, 10, 10))), F.array(*map(F.lit, (5, 5, 15, 15)))
    assert spark.range(1).select(geometry.iou(a, b)).first()[0] == pytest.approx(25 / 175)
    kept = blocks(spark, {"bbox": [0, 0, 10, 10]})
    rescued = blocks(spark, {"bbox": [1, 1, 10, 10]}, {"bbox": [50, 50, 60, 60]}, {"bbox": [51, 50, 60, 60]}, {"bbox": [80, 80, 90, 90]})
    assert values(geometry.supplement(kept, rescued).orderBy("seq"), "block_id", "seq") == [("p0000_s0000", 1), ("p0000_s0001", 3)]


def test_lines_join(spark):
    rows = [{"ocr_text": t, "bbox": [100, 100 + 32 * i, 250, 127 + 32 * i], "confidence": 0.9} for i, t in enumerate(["WHY AM I", "ALWAYS", "IN", "SO MUCH", "TROUBLE?"])]
    got = geometry.group_lines(blocks(spark, *rows, {"ocr_text": "FAR AWAY", "bbox": [900, 900, 990, 930]})).orderBy("reading_order")
    assert values(got, "ocr_text", "n_lines") == [("WHY AM I ALWAYS IN SO MUCH TROUBLE?", 5), ("FAR AWAY", 1)]


def test_replay(spark):
    t = blocks(spark, {"ocr_text": "hello there", "translation_fr": "salut", "bbox": [0, 0, 10, 10]}, {"ocr_text": "gone", "translation_fr": "parti", "bbox": [50, 50, 60, 60]}, {"ocr_text": "other", "translation_fr": "autre", "bbox": [0, 20, 10, 30]})
    f = blocks(spark, {"block_id": "n0", "ocr_text": "Hello there", "translation_fr": "Salut", "bbox": [0, 0, 10, 11]}, {"block_id": "n1", "ocr_text": "xxxxx", "translation_fr": "autre", "bbox": [0, 20, 10, 30]})
    r = {x.target_id: x.status for x in evaluate.replay(t, f).collect()}
    assert r == {"b0": "match", "b1": "missing", "b2": "source_mismatch"}


def test_diagnosis(spark):
    b = blocks(spark, {"ocr_text": "Hello there", "ocr_corrected_text": "Hello there!"}, {"ocr_text": "abc", "ocr_corrected_text": "xyz"}, {"translation_fr": "a", "raw_translation_fr": "b", "ocr_text": "Fine."}, {"ocr_text": "So.", "review_notes": "bulle fusionnée"}, {"ocr_text": "Nothing."})
    got = {(r.block_id, r.category) for r in evaluate.diagnose(b).collect()}
    assert got == {("b0", "punctuation"), ("b1", "ocr_text"), ("b2", "translation"), ("b3", "fused_bubble")}


def test_sampling(spark):
    pages = spark.createDataFrame([("v1", i) for i in range(100)] + [("v2", i) for i in range(3)], "volume_label string, page_index int")
    got = selection.choose_pages(pages, 10)
    v1 = [r.page_index for r in got.where("volume_label = 'v1'").collect()]
    assert len(v1) == 10 and min(v1) >= 2 and max(v1) <= 98
    assert [r.page_index for r in got.where("volume_label = 'v2'").collect()] == [0, 1, 2]
    rows = spark.createDataFrame([(s, i) for i, s in enumerate("AAABBC")], "g string, i long")
    assert values(selection.stratified_limit(rows, "g", "i", 3), "g") == [("A",), ("B",), ("C",)]
    assert selection.select_rows(rows, "i", "first", 0).count() == 0 and selection.select_rows(rows, "i", "random", 99).count() == 6
    with pytest.raises(ValueError):
        selection.select_rows(rows, "i", "none", 3)


def test_projects_and_memories_on_disk(spark, tmp_path):
    doc = {"cbz_path": "a.cbz", "extra": 1, "pages": [{"page_index": 0, "image_name": "pages/S/V/1.png", "blocks": [{"id": "b", "ocr_text": None, "confidence": 0.5, "quality_warnings": ["w"]}]}, {"page_index": 1, "image_name": "x", "blocks": []}]}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    b = tables.read_projects(spark, str(tmp_path / "p.json"))
    assert values(b, "project_id", "series_label", "volume_label", "ocr_text", "manual_status", "bbox", "quality_warnings") == [("p", "S", "V", "", "unchecked", [0, 0, 0, 0], ["w"])]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "entries": {"Hello ...": "a", "hello": "b", " ": "c"}}))
    assert values(tables.read_memory(spark, str(tmp_path / "m.json"), translation=True), "key", "value") == [("hello", "b")]
    (tmp_path / "l.json").write_text(json.dumps({"entries": [{"source": "Hi :", "translation_fr": "Salut"}, {"source_key": "Yo", "translation_fr": "Yo"}, {"source": "x"}]}))
    assert sorted(values(tables.read_memory(spark, str(tmp_path / "l.json"), translation=True), "key", "value")) == [("hi", "Salut"), ("yo", "Yo")]
    m = spark.createDataFrame([("k", "v"), ("a b", "w é"), (None, "x")], "key string, value string")
    sinks.write_memory(m, str(tmp_path / "lines"))
    sinks.write_memory_document(m, str(tmp_path / "doc"), {"origin": "test"})
    for kept in (tables.read_memory(spark, str(tmp_path / "lines"), lines=True), tables.read_memory(spark, str(tmp_path / "doc"))):
        assert sorted(values(kept, "key", "value")) == [("a b", "w é"), ("k", "v")]
    sinks.write_memory_document(m.limit(0), str(tmp_path / "none"))
    assert tables.read_memory(spark, str(tmp_path / "none")).count() == 0


def test_manifests_and_lists(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"output_relpath": "pages/S/V/x.png", "series_label": "S1"}\n\n{"image_path": "y.png", "page_number": "7"}\n')
    got = tables.read_manifest_jsonl(spark, str(tmp_path / "m.jsonl"), "output_relpath string, image_path string, series_label string, page_number string")
    assert sorted(values(got, "image_path", "series_label", "volume_label")) == [("pages/S/V/x.png", "S1", "V"), ("y.png", "unknown", "")]
    (tmp_path / "l.txt").write_text('﻿# list\n\n"a b.cbz"\nc.cbz\n')
    assert [r[0].removeprefix("file://") for r in values(tables.read_volume_list(spark, str(tmp_path / "l.txt")), "volume_path")] == [f"{tmp_path}/a b.cbz", f"{tmp_path}/c.cbz"]
    (tmp_path / "r.tsv").write_text("Page index\tBlock ID\tDécision\tNotes reviewer\n3\tb1\tok\ta, b\n\t\t\t\n")
    assert values(tables.read_review_table(spark, str(tmp_path / "r.tsv")), "page_index", "block_id", "review_decision", "review_notes") == [("3", "b1", "ok", "a, b")]
    assert sorted(r[0] for r in tables.page_list(spark, "p3,7-5,10").collect()) == [3, 5, 6, 7, 10]


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in ("p10.jpg", "p2.JPG", "readme.txt", "d/"):
            z.writestr(n, b"x")
    (tmp_path / "a.cbz").write_bytes(data.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = tables.read_archive_entries(spark, str(tmp_path), contents=True)
    assert values(got.where("error is null").orderBy("ordinal"), "entry", "bytes") == [("p2.JPG", 1), ("p10.jpg", 1)]
    assert got.where("error is not null").count() == 1


def test_html_is_escaped(spark):
    html = sinks.html_pages(blocks(spark, {"ocr_text": "<b>", "translation_fr": ""})).first().html
    assert "&lt;b&gt;" in html and "[non traduit]" in html


def test_streaming_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"page_index": n, "project_id": "p"}))
        resume.process_available(spark, src, "project_id string, page_index int", lambda d: d.withColumn("twice", F.col("page_index") * 2), out, ck).awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [2, 4]
    resume.append_batches(spark, src, "project_id string, page_index int", lambda d: d.groupBy("project_id").count(), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "o2")).collect()] == [2]


def test_checks(spark):
    from inkloom.functions.checks import apply_checks, japanese_skip

    b = blocks(
        spark, {"ocr_text": "What are you doin", "translation_fr": "Que fais-tu"}, {"ocr_text": "", "confidence": 0.3}, {"ocr_text": "x", "manual_status": "validated", "quality_warnings": ["old"]},
        {"ocr_text": "I know the tiger.", "translation_fr": "Je sais, le tiger."}, {"ocr_text": "Hello my friend.", "translation_fr": "Bonjour mon ami, je suis ici."}, {"ocr_text": "The book", "source_lang": "ja"},
    )
    got = [r[0] for r in apply_checks(b).orderBy("seq").select("quality_warnings").collect()]
    assert "point d'interrogation probablement manquant: relire la ponctuation de la bulle" in got[0] and got[0][-1] == "anglais familier impliqué: doin"
    assert got[1] == ["OCR confiance basse (0.30)", "OCR vide"] and got[2] == []
    assert "mots anglais restants: tiger" in got[3] and "termes source recopiés dans la traduction: tiger" in got[3]
    assert got[4] == [] and got[5] == ["fragment japonais non traduit: OCR trop court/faible", "traduction vide"]
    df = spark.createDataFrame([("", 0.9), ("！？", 0.9), ("これは日本語です", 0.9), ("これは日本語です", 0.3), ("100円", 0.9)], "t string, c double")
    assert [r[0] for r in df.select(japanese_skip(F.col("t"), F.col("c"))).collect()] == [True, True, False, True, False]


def test_normalise(spark):
    from inkloom.operators.normalise import normalise

    rows = blocks(spark, {"ocr_text": "Hello ,  world !"}, {"ocr_text": "CIRCUM- STANCES"}, {"ocr_text": "wHaT aRe you doing there BOOM!"}, {"ocr_text": "I am gonna rvn"}, {"ocr_text": "bad key"}, {"ocr_text": "no , , ,"}, {"ocr_text": "wait =:="}, {"ocr_text": "but-"}, {"ocr_text": "Mr: Fox"}, {"ocr_text": "I would go but"}, {"ocr_text": "with"}, {"ocr_text": "COMEI.."})
    m = spark.createDataFrame([("bad key", "Good text")], "key string, value string")
    got = [r[0] for r in normalise(rows, word_rules=[(r"\brvn\b", "run")], colloquial=True, memory=m).orderBy("seq").select("normalised").collect()]
    assert got == ["Hello, world!", "CIRCUMSTANCES", "what are you doing there", "I am going to run", "Good text", "no...", "wait =...", "but...", "Mr. Fox", "I would go but...", "with", "COME!"]


def test_replacement_guard(spark):
    """A new reading has the words of the old one in order, nothing before or between them, and little after."""
    from inkloom.operators.normalise import is_safe, penalty, suspect

    pairs = [
        ("Good morning dear", "Good morning dear friend", True), ("Good morning dear", "x Good morning dear", False), ("Good morning dear", "Good x morning dear", False), ("Good morning dear", "Good morning", True), ("Good morning dear", "Good", False),
        ("one two three four five", "one two three four", True), ("hello", "hello", False), ("", "hello", False), ("hello there", "hello there b", False), ("hello there", "hello there i", True), ("hello there", "hello there 42", False),
        ("hello there", "hello there a b c d e f", False), ("Good morning dear", "other words entirely", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r for r in df.select("a", "b", is_safe(F.col("a"), F.col("b")).alias("got"), "want").collect() if r.got != r.want] == []
    assert one(spark, lambda v: is_safe(F.lit("toid you"), v, F.lit(True)), "told you") is True  # a local correction
    costs = [("go home", "go home", 0.0), ("go home", "go home now my dear old friend of mine", 0.85 * 4 + 2.2), ("we go to the house", "BAM we go to the house", 2.8 + 1.8)]
    assert [round(r[0], 6) for r in spark.createDataFrame(costs, "a string, b string, c double").select(penalty(F.col("a"), F.col("b"))).collect()] == [round(c, 6) for *_, c in costs]
    b = blocks(spark, {"ocr_text": "Fine words here."}, {"ocr_text": ""}, {"ocr_text": "I toid you."}, {"ocr_text": "a; b"}, {"ocr_text": "Sure.", "confidence": 0.7}, {"ocr_text": "Sure.", "quality_warnings": ["w"]}, {"ocr_text": "toid", "manual_status": "validated"}, {"ocr_text": "I was going to"})
    assert [r[0] for r in b.orderBy("seq").select(suspect()).collect()] == [False, True, True, True, True, True, False, True]


def test_improve(spark):
    from inkloom.operators.normalise import improve

    rows = blocks(spark, {"ocr_text": "I toid you", "confidence": 0.3, "translation_fr": "x"}, {"ocr_text": "Hello there my", "confidence": 0.3}, {"ocr_text": "Fine.", "manual_status": "ignored"}, {"ocr_text": "Clean enough words.", "confidence": 0.95})
    c = [("b0", "ocr-corrections", "I told you", 0.3, 0), ("b0", "crop", "zz I told you", 0.99, 1), ("b1", "crop", "Hello there my friend", 0.9, 0), ("b1", "crop", "HELLO there my friend", 0.5, 1), ("b1", "crop", "   ", 0.9, 2), ("b2", "crop", "Fine day.", 0.9, 0), ("b3", "crop", "Clean enough words. Indeed.", 0.99, 0)]
    got = {r.block_id: r for r in improve(rows, spark.createDataFrame(c, "block_id string, engine string, text string, confidence double, ord int")).collect()}
    assert got["b0"].ocr_text == "I told you" and got["b0"].manual_status == "edited" and got["b0"].translation_fr == "" and got["b0"].quality_warnings == ["OCR fallback: ocr-corrections a remplacé 'I toid you' par 'I told you'"]
    assert got["b1"].ocr_text == "Hello there my friend" and [a.text for a in got["b1"].ocr_alternatives] == ["Hello there my friend", "Hello there my"]
    assert not got["b2"].improved and not got["b3"].improved and got["b3"].ocr_alternatives == []
    assert improve(rows.limit(0), spark.createDataFrame(c, "block_id string, engine string, text string, confidence double, ord int")).count() == 0


def test_improve_makes_blocks_and_readings_once(spark):
    """Blocks are made once to find the suspect ones and once for the result; candidates of suspect blocks are read once."""
    from inkloom.operators.normalise import improve

    made, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(df, n):
        def run(batches):
            for p in batches:
                n.add(len(p))
                yield p

        return df.mapInPandas(run, df.schema)

    rows = blocks(spark, *({"ocr_text": "I toid you" if i % 3 else "Clean enough words.", "confidence": 0.95} for i in range(30))).select("block_id", "ocr_text", "confidence", "manual_status", "quality_warnings", "ocr_alternatives", "translation_fr")
    c = spark.createDataFrame([(f"b{i}", "ocr-corrections", "I told you", 0.95, 0) for i in range(30)], "block_id string, engine string, text string, confidence double, ord int")
    got = improve(counted(rows, made), counted(c, read)).collect()
    assert sum(r.improved for r in got) == 20 and made.value == 60 and read.value == 30


def test_tokens_are_judged_after_they_are_counted(spark):
    rows = spark.createDataFrame([("wolld the wolld", 60, "x"), ("Wolld aBc", 10, "x"), (None, 10, "x")], "source string, risk_score int, suggested_action string")
    x = learning.suspicious_tokens(rows)
    assert sorted(values(x, "token", "count", "high_risk_count")) == [("Wolld", 1, 0), ("aBc", 1, 0), ("wolld", 2, 2)]
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("nestern") < plan.index("Aggregate [token")


def test_short_searches_find_what_counts_find(spark):
    """Flags by short searches are those by whole counts."""
    from inkloom.functions import patterns as P

    texts = ["", "a", "ab c", "é1ñ", "é\nñ ü", "x'y", "a b c d e ff", "aa bb cc dd ee", "aa bb cc dd", "a'b 'cc d'd e'' f'f", "aa-bb_cc1dd\nee", "Abc Def Ghi Jklm no pq rs tu", "Abc Def GHi Jkl no pq rs tu vw", "Abcd AbcdAbcd Xyz Uvw aa bb cc dd ee",
             "ATM fee", "atmfee", "card card", "Transfer CARD", "we take no  credit", "raw", "raws", "straw", "UPLOADED", "phase  4", "oom", "12 km", "hiver", "notable hives", "In Control Of", "profile", "faction", "AAABBB", "ABCDEF", "İ raw", "raw\u212a"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    v = F.col("v")
    n = lambda p: F.regexp_count(v, F.lit(p))
    word = P.DIALOGUE_WORD
    titled = F.filter(text.tokens(v, word), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))
    pairs = [
        (v.rlike(detect.FIVE_WORDS), n(word) >= 5), (~v.rlike(detect.THREE_LETTERS), n(r"\p{L}") <= 2), (detect.credit(v), v.rlike(P.bounded(P.CREDIT))),
        (detect.signage(v), F.size(F.array_intersect(text.words_of(F.lower(v)), F.array(*map(F.lit, P.SIGNAGE)))) >= 2),
        (detect.infographic(v), v.rlike(P.MEASURE) | v.rlike(P.bounded(P.TECHNICAL)) | F.lower(v).isin(P.SHORT_PHASES)),
        (detect.profile(v), v.rlike(P.bounded(P.PROFILE)) | (~v.rlike("[!?]") & (n(word) >= 8) & (F.size(titled) >= 4))),
    ]
    x = df.select("v", *(F.struct(a.alias("got"), b.alias("want")).alias(f"t{i}") for i, (a, b) in enumerate(pairs)))
    assert [(r.v, i) for r in x.collect() for i in range(len(pairs)) if r[i + 1].got != r[i + 1].want] == []



def test_sounds_noise_and_lines(spark):
    """Labels are listed sounds alone; marks and single signs are noise; labels never join dialogue."""
    assert [one(spark, geometry.sfx_label, t) for t in ("RUSTLE", "bang!", "Bang bang", "sfx: boom", "hey,", "banging")] == [True, True, False, False, True, False]
    noisy = spark.createDataFrame([("8 <", 0.9), ("<", 0.9), ("ab", 0.5), ("ab", 0.6), ("abc", 0.5), ("abc", 0.1), ("日本", None), ("..!", 0.9)], "t string, c double")
    assert [r[0] for r in noisy.select(geometry.noise(F.col("t"), F.col("c"))).collect()] == [True, True, True, False, False, True, False, True]
    box = lambda y, x=100.0, w=150.0: [[x, y], [x + w, y], [x + w, y + 27.0], [x, y + 27.0]]
    lines = [(0, "BANG!", box(80.0)), (1, "I AM IN TROU-", box(110.0)), (2, "BLE, YOU KNOW.", box(140.0)), (3, "<>", box(170.0)), (4, "FAR AWAY", box(900.0))]
    raw = spark.createDataFrame([("p", 2, i, b, "en", t, 0.9) for i, t, b in lines], "project_id string, page_index int, seq long, polygon array<array<double>>, source_lang string, ocr_text string, confidence double")
    got = sorted(values(geometry.post_process(raw), "block_id", "ocr_text", "n_lines"))
    assert got == [("p0002_b0000", "BANG!", 1), ("p0002_b0001", "I AM IN TROU- BLE, YOU KNOW.", 2), ("p0002_b0004", "FAR AWAY", 1)]
    assert sorted(values(geometry.post_process(raw, merge_lines=False, filter_noise=False), "block_id", "ocr_text", "reading_order"))[1] == ("p0002_b0001", "I AM IN TROU...", 1)


def test_line_groups_by_brute_force(spark):
    """Each line, in reading order, joins the group that fits it best: the same scores worked out one by one."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(60):
        x, y = rng.randint(0, 300), rng.randint(0, 500)
        rows.append({"page_index": i % 3, "block_id": f"b{i}", "bbox": [x, y, x + rng.randint(20, 160), y + rng.randint(12, 30)], "ocr_text": rng.choice(["BANG!", "some words", "other"]), "source_lang": "ja" if i % 3 == 2 else "en", "confidence": 0.5})
    got = {(r.page_index, r.block_id): (r.n_lines, r.reading_order, r.bbox) for r in geometry.group_lines(blocks(spark, *rows)).collect()}
    want = {}
    for p in range(3):
        sign = -1 if p == 2 else 1
        place = lambda r: (r["bbox"][1] + r["bbox"][3], sign * (r["bbox"][0] + r["bbox"][2]))  # noqa: E731,B023
        groups = []
        for r in sorted((r for r in rows if r["page_index"] == p), key=place):
            b, best = r["bbox"], None
            for g in groups:
                u = [f(m["bbox"][i] for m in g) for i, f in enumerate((min, min, max, max))]
                if any(m["ocr_text"] == "BANG!" for m in g) != (r["ocr_text"] == "BANG!"):
                    continue
                gap = max(0, b[1] - u[3], u[1] - b[3])
                if gap > max(34, 1.45 * sum(m["bbox"][3] - m["bbox"][1] for m in [*g, r]) / (len(g) + 1)):
                    continue
                wide = (u[2] - u[0], b[2] - b[0])
                share, off, allow = max(0, min(u[2], b[2]) - max(u[0], b[0])) / min(wide), abs((u[0] + u[2]) / 2 - (b[0] + b[2]) / 2), 0.85 * max(wide)
                score = 100 * share - 18 * off / max(1, allow) - 0.2 * gap if share >= 0.18 else 24 - 20 * off / max(1, allow) - 0.2 * gap if off <= max(45, allow) else None
                if score is not None and (best is None or score > best[0]):
                    best = (score, g)
            best[1].append(r) if best else groups.append([r])
        for order, g in enumerate(sorted(groups, key=lambda g: place(g[0]))):
            want[p, g[0]["block_id"]] = (len(g), order, [f(m["bbox"][i] for m in g) for i, f in enumerate((min, min, max, max))])
    assert got == want


def test_dialogue(spark):
    from inkloom.operators.dialogue import prepare, prepare_blocks, soften_capitals, with_override

    assert [one(spark, soften_capitals, t) for t in ("I AM HERE , NOW", "NASA", "Hi There", "OK", "「ABCDあ」", " 'WAIT' ")] == ["I am here, now", "nasa", "Hi There", "OK", "「ABCDあ」", "wait"]
    kept = spark.createDataFrame([("baka", "Baka"), ("ohh!", "kept")], "key string, value string")
    over = spark.createDataFrame([("no way", "Pas question"), ("baka", "never")], "key string, value string")
    mem = spark.createDataFrame([("no way", "never"), ("well then", "Eh bien")], "key string, value string")
    df = spark.createDataFrame([("Baka:",), ("ohh!",), ("Oooh!",), ("awww! ",), ("Hi-yaaa!",), ("Whoaal!",), ("No way...",), ("Well  then .",), ("nothing",), (None,)], "t string")
    got = [r.override for r in with_override(df, F.col("t"), kept=kept, overrides=over, memory=mem).collect()]
    want = ["Baka", "kept", "Oh...", "Aww...", "Hi-yaaa!", "Whoa !", "Pas question", "Eh bien", "", ""]
    assert sorted(got) == sorted(want)
    x = prepare(blocks(spark, {"ocr_text": "I'M GONNA GO HOME"}, {"ocr_text": "lerned"}), corrections=spark.createDataFrame([("lerned", "Learned text")], "key string, value string"))
    assert sorted(values(x, "block_id", "corrected", "normalized")) == [("b0", "I'm gonna go home", "I am going to go home"), ("b1", "Learned text", "Learned text")]
    b = prepare_blocks(blocks(spark, {"ocr_text": "No way"}, {"ocr_text": "No way", "source_lang": "ja"}), overrides=over)
    assert sorted(values(b, "block_id", "translation_fr", "normalized_source_text")) == [("b0", "Pas question", "No way"), ("b1", "", "")]


def test_single_reviews(spark):
    """Reviews of single blocks: against what is shown, with the marks of other decisions taken off the note."""
    b = blocks(spark, {"ocr_text": "x", "translation_fr": "t"}, {"ocr_text": "y", "review_notes": "[zone] old"}, {"ocr_text": "z"}, {"ocr_text": "w"}, {"ocr_text": "v"})
    r = [("b0", "", "x", "", "T", ""), ("b1", "ok", "", "", "", "[zone] seen"), ("b2", "Bulles fusionnees", "", "", "", "two"), ("b3", "SFX", "", "", "", "[SFX] pan"), ("zz", "ok", "", "", "", "")]
    reviews = spark.createDataFrame([("p", 0, *row) for row in r], "project_id string, page_index int, block_id string, decision string, corrected_ocr string, corrected_source string, corrected_fr string, notes string")
    got = {x.block_id: x for x in B.review_each(b, reviews).collect()}
    assert (got["b0"].manual_status, got["b0"].ocr_corrected_text, got["b0"].translation_fr, got["b0"].raw_translation_fr) == ("edited", "", "T", "T")
    assert (got["b1"].manual_status, got["b1"].review_notes) == ("validated", "seen")
    assert (got["b2"].manual_status, got["b2"].review_notes) == ("review", "[fusion] two")
    assert (got["b3"].manual_status, got["b3"].review_notes) == ("ignored", "[SFX] pan")
    assert got["b4"].manual_status == "unchecked"


def test_reports_on_disk(spark, tmp_path):
    """Datasets, manifests, profiles, diagnoses and replays: what is written is what the operators give."""
    b = blocks(spark, {"ocr_text": "Kanade is fopm here", "translation_fr": "Kanade est là", "manual_status": "validated"}, {"ocr_text": "wolld you steal it", "translation_fr": "steal", "quality_warnings": ["w"]}, {"ocr_text": "SLAM", "manual_status": "ignored", "review_notes": "[sfx]"})
    scored = with_quality(b)
    text_of = lambda p: "\n".join(r.value for r in spark.read.text(str(tmp_path / p)).collect())
    sinks.write_dataset(scored, str(tmp_path / "set"))
    assert spark.read.json(str(tmp_path / "set/rows/jsonl")).count() == spark.read.csv(str(tmp_path / "set/rows/csv"), header=True).count() == 3 and "Kanade" in text_of("set/glossary") and "# Quality" in text_of("set/quality")
    sinks.write_profile(scored, str(tmp_path / "profile"))
    assert spark.read.json(str(tmp_path / "profile/summary")).first().rows == 3 and "steal" in text_of("profile/residue_words") and "Kanade" in text_of("profile/glossary")
    items = evaluate.diagnose(b)
    sinks.write_diagnosis(items, str(tmp_path / "diagnosis"))
    assert spark.read.json(str(tmp_path / "diagnosis/items")).count() == items.count() and "- sfx_or_non_dialogue: 1" in text_of("diagnosis/report")
    results = evaluate.replay(b, b.withColumn("ocr_text", F.when(F.col("seq") == 0, F.lit("other")).otherwise(F.col("ocr_text"))).withColumn("bbox", F.col("bbox")))
    sinks.write_replay(results, str(tmp_path / "replay"))
    assert spark.read.json(str(tmp_path / "replay/mismatches")).count() == results.where("status <> 'match'").count() > 0
    pages = spark.createDataFrame([("S", "V", 3, "pages/S/V/x__page_4.png"), ("S", "V", 7, "pages/S/V/x__page_8.png")], "series_label string, volume_label string, source_page_index int, output_relpath string")
    (tmp_path / "corpus").mkdir()
    sinks.write_manifest(pages, str(tmp_path / "m"))
    assert len(spark.read.csv(str(tmp_path / "m/csv"), header=True).columns) == 17 and "- V: 2" in text_of("m/report")
    (tmp_path / "corpus/manifest.jsonl").write_text("\n".join(sorted(r.value for r in spark.read.text(str(tmp_path / "m/jsonl")).collect())))
    (tmp_path / "corpus/analysis").mkdir()
    (tmp_path / "corpus/analysis/manifest.csv").write_text("image_path\nno.png\n")
    back = tables.read_manifest(spark, str(tmp_path / "corpus"), "output_relpath string, series_label string, volume_label string, source_page_number string")
    assert sorted(values(back, "image_path", "index", "page_number")) == [("pages/S/V/x__page_4.png", 0, 1), ("pages/S/V/x__page_8.png", 1, 2)]
    (tmp_path / "two/a").mkdir(parents=True)
    (tmp_path / "two/b").mkdir()
    for n in ("a", "b"):
        (tmp_path / f"two/{n}/manifest.csv").write_text("image_path\nx.png\n")
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "two"))
    (tmp_path / "bare/pages/S/V").mkdir(parents=True)
    (tmp_path / "bare/pages/S/V/x__page_2.png").write_bytes(b"x")
    assert values(tables.read_manifest(spark, str(tmp_path / "bare")), "index", "page_number", "series_label") == [(0, 2, "S")]


def test_series_of_roots(spark):
    files = spark.createDataFrame([(p,) for p in ("/a/1.cbz", "/a/2.cbz", "/a/deep/3.cbz", "/b/x/4.zip", "/b/y/5.zip", "/c/note.txt", "/d/6.cbz")], "path string")
    roots = spark.createDataFrame([("/a/",), ("/b",), ("/c",), ("/c/note.txt",), ("/d/6.cbz",), ("/gone",)], "root string")
    of = lambda **k: sorted(r.volume_path for r in tables.discover_series(files, roots=roots, **k).collect())
    assert of() == ["/a/1.cbz", "/a/2.cbz", "/d/6.cbz"] and of(recursive=True) == ["/a/1.cbz", "/a/2.cbz", "/b/x/4.zip", "/b/y/5.zip", "/d/6.cbz"]
    assert sorted(values(tables.rejected_roots(files, roots), "root", "reason")) == [("/b", "no archive in folder"), ("/c", "no archive in folder"), ("/c/note.txt", "unsupported file"), ("/gone", "not found")]
    assert "/b" not in {r.root for r in tables.rejected_roots(files, roots, recursive=True).collect()}


def test_sampled_corpus(spark):
    entries = [(f"/lib/{s}/v{v}.cbz", f"p{p}.png", 1, None, None, p) for s in ("A", "B") for v in (1, 2, 3) for p in range(12)] + [("/lib/A/bad.cbz", None, None, None, "broken", 0)]
    df = spark.createDataFrame(entries, "archive string, entry string, bytes long, content binary, error string, ordinal int")
    got = selection.sample_corpus(df, volumes_per_series=2, pages_per_volume=4).collect()
    assert len(got) == 2 * 2 * 4 and all(2 <= r.source_page_index < 11 and r.page_count == 12 for r in got) and sorted({r.volume_index for r in got}) == [1, 2, 3, 4]
    assert {r.output_relpath for r in got} >= {f"pages/A/v1/v1__page_{r.source_page_number:04d}.png" for r in got if r.source_path == "/lib/A/v1.cbz"}
    busy = spark.createDataFrame([("v", p, float(p == 5 or p == 7)) for p in range(10)], "volume_label string, page_index int, ink double")
    assert [r.page_index for r in selection.choose_pages(busy, 2, mode="busy", score="ink").collect()] == [5, 7]


def test_process_and_refresh(spark):
    from inkloom.plans.pipeline import corpus_totals, process, refresh

    def fake(batches):
        for p in batches:
            yield p.assign(translation="fr:" + p["text"])

    box = lambda i: [[100.0, 100.0 + 32 * i], [250.0, 100.0 + 32 * i], [250.0, 127.0 + 32 * i], [100.0, 127.0 + 32 * i]]
    lines = [("p", 3, i, box(i), t, c, "en") for i, (t, c) in enumerate([("WHY AM I", 0.9), ("IN SO MUCH", 0.9), ("TROUBLE?", 0.9), ("8", 0.9), ("<", 0.9), ("RUSTLE", 0.1)])]
    raw = spark.createDataFrame(lines, "project_id string, page_index int, raw_order int, polygon array<array<double>>, text string, confidence double, source_lang string")
    got = process(raw, fake).collect()
    assert [(r.block_id, r.ocr_text, r.translation_fr, r.bbox) for r in got] == [("p0003_b0000", "WHY AM I IN SO MUCH TROUBLE?", "fr:why am I in so much trouble?", [100, 100, 250, 191])]
    b = blocks(spark, {"ocr_text": "Hello , you."}, {"ocr_text": "Kept.", "manual_status": "validated", "translation_fr": "Gardé."}, {"ocr_text": "Hello there.", "manual_status": "review"})
    out = {r.block_id: r for r in refresh(b, "en", fake, include_review=True).collect()}
    assert out["b0"].translation_fr == "fr:Hello, you." and out["b1"].translation_fr == "Gardé." and out["b2"].manual_status == "edited"
    assert corpus_totals(b).first().asDict() == {"pages": 1, "processed": 1, "skipped": 0, "blocks": 3, "blocks_with_warnings": 0, "untranslated": 2}
    assert process(raw.limit(0), fake).count() == 0
    from inkloom.plans.pipeline import WEAK, translate

    over = spark.createDataFrame([("no way", "Pas question")], "key string, value string")
    j = blocks(spark, {"ocr_text": "あ", "source_lang": "ja", "translation_fr": "old"}, {"ocr_text": "これは日本語です", "source_lang": "ja", "confidence": 0.9}, {"ocr_text": "NO WAY...", "manual_status": "review"}, {"ocr_text": "Gone.", "manual_status": "ignored"})
    out = {r.block_id: r for r in translate(j, fake, overrides=over).collect()}
    assert (out["b0"].translation_fr, out["b0"].quality_warnings) == ("", [WEAK]) and out["b1"].translation_fr == "fr:これは日本語です"
    assert (out["b2"].translation_fr, out["b2"].manual_status, out["b2"].normalized_source_text) == ("Pas question", "edited", "no way...") and out["b3"].translation_fr == ""


def test_strata_have_rounded_ends(spark):
    """Each stratum between rounded multiples gives one page, in its middle or beside it; every size and count."""
    sizes = [(f"v{n}", n) for n in range(1, 41)]
    pages = spark.createDataFrame([(v, i) for v, n in sizes for i in range(n)], "volume_label string, page_index int")
    for count in (1, 2, 4, 6, 7):
        got = {}
        for r in selection.choose_pages(pages, count, mode="stratified", skip_first=0, skip_last=0).collect():
            got.setdefault(r.volume_label, []).append(r.page_index)
        for v, n in sizes:
            if n <= count:
                assert got[v] == list(range(n))
                continue
            ends = [round(b * n / count) for b in range(count + 1)]
            assert len(got[v]) == count
            for p, a, z in zip(sorted(got[v]), ends, ends[1:]):
                assert a <= p < z and abs(p - (a + (z - a) // 2)) <= 1


def test_zone_alternatives(spark):
    """Blocks under review with a doubtful zone get readings and a warning, or the best safe one; others stay."""
    from inkloom.operators.normalise import zone_alternatives
    from inkloom.plans.pipeline import refresh

    b = blocks(
        spark,
        {"ocr_text": "I toid you to go home", "manual_status": "review", "review_notes": "[zone] cut", "source_lang": "en"},
        {"ocr_text": "Fine words stay here.", "manual_status": "review", "source_lang": "en"},
        {"ocr_text": "I toid you to go home", "manual_status": "validated", "review_notes": "[zone] cut", "source_lang": "en"},
        {"ocr_text": "I toid you to go home", "manual_status": "review", "review_notes": "bbox", "source_lang": "ja"},
        {"ocr_text": "No reading is here", "manual_status": "review", "review_notes": "crop", "source_lang": "en"},
    )
    found = [(f"b{i}", "ocr-corrections", t, 0.95, n) for i in range(4) for n, t in enumerate(["I told you to go home", "i TOLD you  to go home", "x y z"])]
    c = spark.createDataFrame(found, "block_id string, engine string, text string, confidence double, ord int")
    got = {r.block_id: r for r in zone_alternatives(b, c, "en").collect()}
    assert [got[f"b{i}"].updated for i in range(5)] == [True, False, False, False, True] and len(got) == 5
    assert got["b0"].ocr_text == "I toid you to go home" and got["b0"].quality_warnings == ["OCR zone fallback: alternatives crop elargi disponibles"]
    assert got["b0"].ocr_alternatives[0].text == "I told you to go home" and len(got["b0"].ocr_alternatives) == 3 and [a.text for a in got["b4"].ocr_alternatives] == ["No reading is here"]
    assert got["b1"].quality_warnings == [] == got["b3"].ocr_alternatives
    best = {r.block_id: r for r in zone_alternatives(b, c, "en", apply_best=True).collect()}
    assert best["b0"].ocr_text == "I told you to go home" and best["b0"].manual_status == "review" and best["b2"].ocr_text == "I toid you to go home"
    again = {r.block_id: r for r in refresh(b, "en", zone_readings=c).collect()}
    assert len(again["b0"].ocr_alternatives) == 3 and len(again["b2"].ocr_alternatives) == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rewriting_reads_its_rows_once(spark):
    from inkloom.operators.normalise import normalise

    df = spark.createDataFrame([(1, "w0rd  here"), (2, None)], "block_id long, ocr_text string")
    x = normalise(df)
    assert "Join" not in plan_of(x) and {r.block_id for r in x.collect()} == {1, 2}


def test_frequent_texts_are_dealt_to_the_translation(spark):
    from inkloom.plans.pipeline import with_translations

    df = spark.range(400).selectExpr("'p' as project_id", "1 as page_index", "cast(id as string) as block_id", "if(id < 300, 'often', concat('t', id)) as _text")
    up = lambda batches: (p.assign(translation=p["text"].str.upper()) for p in batches)
    x = with_translations(df, up, 50)
    assert "_part" in plan_of(x)
    got = x.collect()
    assert len(got) == 400 and all(r.translation == r._text.upper() for r in got)


def test_reports_score_each_row_once(spark, sf):
    from inkloom.plans import queries

    rules = lambda name: plan_of(queries.queries()[name](spark, sf)).count("empty translation")
    assert rules("quality_report") == 1 and rules("review_pack_balanced") == 0  # scored and written before


def test_fragments_become_blocks_in_one_pass(spark):
    """Fragments are made once, their blocks keep number and language of the first line, and pages without a key have none."""
    from inkloom.plans.pipeline import blocks_of_fragments

    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for p in batches:
            made.add(len(p))
            yield p

    box = lambda y: [[10.0, y], [210.0, y], [210.0, y + 24], [10.0, y + 24]]
    lines = [("p", k, i, box(30.0 * i), "SLAM!" if i == 3 else "1" if i == 5 else f"some  words {i}", 0.9 if i else None, "ja" if k == 2 else "en") for k in (1, 2, None) for i in range(8)]
    raw = spark.createDataFrame(lines, "project_id string, page_index int, raw_order int, polygon array<array<double>>, text string, confidence double, source_lang string")
    got = blocks_of_fragments(raw.mapInPandas(run, raw.schema)).orderBy("page_index", "reading_order").collect()
    assert made.value == 24
    texts = ["some words 0 some words 1 some words 2", "SLAM!", "some words 4", "some words 6 some words 7"]
    assert [(r.page_index, r.source_lang, r.seq, r.block_id, r.ocr_text, r.confidence) for r in got if r.page_index == 1] == [(1, "en", s, f"p0001_b{s:04d}", t, pytest.approx(0.9)) for s, t in zip((0, 3, 4, 5), texts)]
    assert {(r.page_index, r.source_lang) for r in got} == {(1, "en"), (2, "ja")}


def test_groups_out_of_reach_are_left():
    """A long page of labels apart is grouped in time linear in its lines; heights that differ much change nothing."""
    import random

    reads = 0

    class Box(list):
        def __getitem__(self, i):
            nonlocal reads
            reads += 1
            return list.__getitem__(self, i)

    row = lambda b, t, i: {"box": b, "text": t, "conf": None, "id": i, "keep": []}
    assert sum(1 for _ in geometry.page_groups([row(Box([0, 90 * i, 100, 90 * i + 24]), "SLAM!", i) for i in range(2_000)], False)) == 2_000
    assert reads < 200 * 2_000

    rng = random.Random(11)
    for _ in range(20):
        rows = []
        for i in range(120):
            x, y, h = rng.randint(0, 300), rng.randint(0, 4_000), rng.choice((rng.randint(1, 40), rng.randint(1, 40), rng.randint(100, 1_500)))
            rows.append(row([x, y, x + rng.randint(1, 300), y + h], rng.choice(["BANG!", "words"]), i))
        tall = lambda b: max(1, b[3] - b[1])
        groups = []
        for r in sorted(rows, key=lambda r: (r["box"][1] + r["box"][3], r["box"][0] + r["box"][2])):
            b, fits = r["box"], []
            for k, g in enumerate(groups):
                a = [f(m["box"][i] for m in g) for i, f in enumerate((min, min, max, max))]
                gap = max(0, b[1] - a[3], a[1] - b[3])
                if g[0]["text"] == r["text"] and gap <= max(34, 1.45 * sum(tall(m["box"]) for m in [*g, r]) / (len(g) + 1)):
                    widths = a[2] - a[0], b[2] - b[0]
                    share, off, allow = max(0, min(a[2], b[2]) - max(a[0], b[0])) / min(widths), abs(a[0] + a[2] - b[0] - b[2]) / 2, 0.85 * max(widths)
                    score = 100 * share - 18 * off / max(1.0, allow) - 0.2 * gap if share >= 0.18 else 24 - 20 * off / max(1.0, allow) - 0.2 * gap if off <= max(45, allow) else None
                    fits += [(score, -k)] if score is not None else []
            groups[-max(fits)[1]].append(r) if fits else groups.append([r])
        assert [(g[0], g[5]) for g in geometry.page_groups([dict(r) for r in rows], False)] == [(g[0]["id"], len(g)) for g in groups]


def test_searches_that_stop_early_find_the_same(spark):
    """Guarded searches, blanks and counts against what they stand for."""
    from inkloom.functions import checks
    from inkloom.functions import patterns as P
    from inkloom.operators.dialogue import soften_capitals

    lists = [*(p for p, _ in checks.CONFUSIONS), checks.SHORT_ZONE, checks.SOUNDS, checks.IDIOMS, checks.BAD_FRENCH, "gramma|grandma", P.either(P.RESIDUE), P.either(P.SFX_MIX), P.SHORT_ZONE, P.CLAUSE_WORDS]
    words = "TOLD to!d tolda c!imbin' narli enolgh im I'm ive didnta ou'd t0 4nder could ve would  ve menx...tioned men... tioned exx...istence al...read what 9i kin0a unnecesaqy bmusthvb gallenl asleeep inifront computer and this is what god whooosh sfx handy No Way slam skills skill after If told ya looky".split(" ")
    odd = ["", " ", "a", " b ", " é\n", "7", "ab", "a 1 b", "a\tb　c", "日", "日本", "x\r\n", "\x1f", "...", "É È Ê ça", "AB C÷×D", "ÀÉ×îßÿ", "  THE  END\n", "WHO  IS THIS", "日本ABCDE", "we're off", "a\x00B", "Kim", "ſfx", "a-b", "12 ab"]
    texts = [*words, *(f"x{w}" for w in words), *(f"({w})!" for w in words), *(f"é{w}" for w in words), *(" ".join(words[i : i + 4]) for i in range(len(words))), *odd, None]
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate((t, c) for t in texts for c in ((0.1, 0.5, 0.9, None) if t in odd or t is None else (0.9,)))], "i int, v string, c double")
    v, c, old = F.col("v"), F.col("c"), F.btrim(F.regexp_replace("v", r"(?U)\s+", " "))
    letters = F.regexp_count(old, F.lit(geometry.LETTER))
    marks = r"^[0-9\s<>{}\[\]().,;:!?/\\|_+*=~`'\"-]+$"
    noise = (old == "") | F.coalesce(c < 0.2, F.lit(False)) | (F.length(old) <= 1) | old.rlike(marks) | (letters == 0) | F.coalesce((c < 0.55) & (letters <= 2), F.lit(False))
    number = lambda p: F.regexp_count(v, F.lit(p))
    pairs = [
        *((detect.held(v, F.lower(v), p), v.rlike(P.bounded(p))) for p in lists), (text.squeeze(v), old), (geometry.noise(v, c), noise), (B.blank("v"), text.squeezed_ends(v) == ""),
        (text.identity_key(v), F.regexp_replace(F.lower(v), "[^a-z0-9]", "")), (F.coalesce(v.rlike(checks.THREE_WORDS), F.lit(False)), F.size(text.tokens(v, P.ZONE_WORD)) >= 3), (v.rlike(P.ANY_DIGIT_MIX), v.rlike(P.DIGIT_MIX)),
        *((F.length(v) - F.length(F.regexp_replace(v, f"[{some}]+", "")), number(p)) for some, p in ((text.CAPITALS, "[A-ZÀ-ÖØ-Þ]"), (text.CAPITALS + text.OTHERS, "[A-Za-zÀ-ÖØ-öø-ÿ]"))),
        *((text.tokens(v, p), F.coalesce(F.regexp_extract_all(v, F.lit(p), F.lit(0)), F.array().cast("array<string>"))) for p in (P.TOKEN, P.ZONE_WORD, P.DIALOGUE_WORD, P.PROFILE_TOKEN)),
        *((text.words_up_to(v, n), F.least(F.lit(n), F.size(text.tokens(v, P.ZONE_WORD)))) for n in (1, 3, 14)), (text.squeezed_ends(v), F.regexp_replace(v, r"(?U)^\s+|\s+$", "")),
    ]
    x = df.select("v", "c", *(F.struct(a.alias("got"), b.alias("want")).alias(f"t{i}") for i, (a, b) in enumerate(pairs)))
    assert [(r.v, r.c, i) for r in x.collect() for i in range(len(pairs)) if r[i + 2].got != r[i + 2].want] == []
    assert [one(spark, soften_capitals, t) for t in ("WHO IS I", "Who IS", "AÉÀ÷", "AÉÀÔ", "日ABCDE")] == ["who is I", "Who IS", "AÉÀ÷", "aéàô", "日ABCDE"]


def test_ready_shapes_are_found_in_any_form(spark):
    from inkloom.operators.dialogue import with_override

    texts = {"“Hi   YAA!”": "Hi YAA!", "hi-yaa": "hi-yaa", "whooaal": "whooaal", " 'Whoaa !'": "Whoaa!", "AWWW !!": "Aww...", "　“OOH...": "Oh...", "oh": "Oh...", "of": "", "hi there": "", "aw": "", "": "", None: "", "say ooh": ""}
    got = with_override(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")).collect()
    want = {k: "Whoa !" if v.lower().startswith("who") else v if not k or "hi" not in k.lower() else v for k, v in texts.items()}
    assert {r.t: r.override for r in got} == want


def test_flags_are_kept_for_texts_that_stay(spark):
    """A second run searches changed texts only, and comes to what it comes to without kept flags."""
    rows = [{"ocr_text": t, "page_index": i // 8, "reading_order": i, "manual_status": "review"} for i, t in enumerate(["BANG!", "phase 4", "Hello there, you are late.", "raws", "ATM card fee", "hall", "depth", "I know what we can do here", "", "km"] * 4)]
    memory = spark.createDataFrame([("hello there, you are late.", "learned"), ("km", "learned")], "key string, value string")
    base = blocks(spark, *rows)
    for m in (None, memory):
        first = B.auto_ignore(base, m, keep_flags=True)
        later = lambda x: x.withColumn("ocr_text", F.when(F.col("seq") % 3 == 0, F.lit("monument")).otherwise(F.col("ocr_text")))
        plain = B.auto_ignore(later(B.auto_ignore(base, m).select(*base.columns)), m)
        kept = B.auto_ignore(later(first.select(*base.columns, *detect.FLAGS)), m)
        assert kept.columns == plain.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect()))
    # rows whose text is what was judged take their flags from there
    told = first.select(*base.columns, *detect.FLAGS).withColumn("_own", F.lit("kept"))
    assert {r.reason for r in B.with_reasons(told, memory).collect() if not r.page_reason} <= {"kept"}
