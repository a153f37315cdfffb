"""Filters, decisions, statistics and edits of block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import detect
from inkloom.functions.score import band, queue_risk
from inkloom.functions.text import decision_key, final_translation, full, source_corrected_first, source_normalized_first, squeeze, squeezed_ends

PAGE = ("project_id", "page_index")
LABELS = {"validate": "validé", "correct": "corrigé", "review": "à revoir", "fused": "fusion", "zone": "zone", "ignore": "ignoré", "sfx": "SFX", "unchecked": "brut"}


def blank(name: str) -> Column:
    return ~F.col(name).rlike(r"(?U)\S")


def block_filter(name: str) -> Column:
    """One of all, warnings, review, untranslated, unvalidated, validated, ignored; an unknown name is all."""
    status = F.col("manual_status")
    return {
        "warnings": F.size("quality_warnings") > 0,
        "review": status == "review",
        "untranslated": (status != "ignored") & blank("translation_fr"),
        "unvalidated": ~status.isin("validated", "ignored"),
        "validated": status == "validated",
        "ignored": status == "ignored",
    }.get(name, F.lit(True))


def matches(query: str) -> Column:
    """Every word of the query occurs, in any case, in the id, a text or a warning."""
    texts = ["block_id", "ocr_text", "ocr_corrected_text", "normalized_source_text", "raw_translation_fr", "translation_fr"]
    hay = F.lower(F.concat_ws("\n", *texts, F.array_join("quality_warnings", "\n")))
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.contains(hay, F.lit(term))
    return out


def visible(blocks: DataFrame, name: str = "all", query: str = "") -> DataFrame:
    return blocks.where(block_filter(name) & matches(query)).orderBy(*PAGE, "reading_order", "seq")


def decision() -> Column:
    """The review decision that a block's status and note stand for."""
    status, note = F.col("manual_status"), F.lower(squeezed_ends(F.col("review_notes")))
    return (
        F.when((status == "ignored") & note.startswith("[sfx]"), "sfx")
        .when((status == "review") & note.startswith("[fusion]"), "fused")
        .when((status == "review") & note.startswith("[zone]"), "zone")
        .when(status == "validated", "validate")
        .when(status == "ignored", "ignore")
        .when(status == "review", "review")
        .when(status == "edited", "correct")
        .otherwise("unchecked")
    )


def decision_label(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[name]


def queue_filter(name: str) -> Column:
    """One of the twelve views of the review queue (by band, decision and warnings); an unknown name is all."""
    d, b = F.col("decision"), F.col("band")
    open_ = ~d.isin("validate", "ignore", "sfx")
    single = {"Corrections faites": "correct", "À revoir": "review", "Fusion": "fused", "Zones": "zone", "Validés": "validate", "Ignorés": "ignore", "SFX": "sfx"}
    if name in single:
        return d == single[name]
    return {
        "À traiter": d.isin("unchecked", "review", "fused", "zone"),
        "Risques HIGH/MED": b.isin("HIGH", "MED") & open_,
        "High": (b == "HIGH") & open_,
        "Alternatives OCR": F.lower("diagnostics").contains("alternative"),
    }.get(name, F.lit(True))


QUEUE_VIEWS = ("À traiter", "Risques HIGH/MED", "High", "Tous", "Corrections faites", "À revoir", "Fusion", "Zones", "Alternatives OCR", "Validés", "Ignorés", "SFX")


# Fixed value: what a note about a zone says.
ZONE_NOTES = "zone|bbox|crop|bulle|fusion"
# End of the fixed value.


def zone_fallback_candidate() -> Column:
    """A zone worth reading again: its note names a zone, or its text has a zone problem."""
    notes = F.lower(squeezed_ends(F.col("review_notes")))
    return notes.rlike(ZONE_NOTES) | (F.size(detect.zone_categories(source_normalized_first())) > 0)


def review_queue(blocks: DataFrame) -> DataFrame:
    """One display row for each block: risk, band, decision, previews of 70 characters."""
    preview = lambda c: F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, 70)
    x = blocks.withColumn("risk", queue_risk()).withColumn("decision", decision())
    return x.select(
        *PAGE, "block_id", "reading_order", "risk", band(F.col("risk")).alias("band"), "decision", decision_label(F.col("decision")).alias("label"),
        preview(source_normalized_first()).alias("source"), preview(final_translation()).alias("translation"),
        squeezed_ends(F.replace(F.array_join("quality_warnings", " "), F.lit("\n"), F.lit(" "))).alias("diagnostics"),
    )


def queue_summary(blocks: DataFrame) -> DataFrame:
    q = review_queue(blocks)
    n = lambda test, name: F.count_if(F.expr(test)).alias(name)
    names = ("unchecked", "validate", "correct", "review", "fused", "zone", "ignore", "sfx")
    return q.agg(F.count("*").alias("total"), n("band = 'HIGH'", "high"), n("band = 'MED'", "medium"), *(n(f"decision = '{d}'", d) for d in names), n("decision in ('unchecked', 'review')", "todo"))


def protected() -> Column:
    return F.col("manual_status").isin("validated", "ignored")


def learnable() -> Column:
    return F.col("manual_status").isin("edited", "validated") & ~blank("translation_fr")


def refreshable(lang: str, include_review: bool = False) -> Column:
    return (F.col("source_lang") == lang) & F.col("manual_status").isin("unchecked", *(["review"] if include_review else []))


def changed() -> Column:
    c = lambda name: F.lower(squeeze(F.col(name)))
    differs = lambda a, b: (c(a) != "") & (c(a) != c(b))
    return (
        (F.col("manual_status") != "unchecked") | ~blank("review_notes") | differs("ocr_corrected_text", "ocr_text")
        | ((c("normalized_source_text") != "") & (c("normalized_source_text") != F.coalesce(full(c("ocr_corrected_text")), c("ocr_text"))))
        | ((c("raw_translation_fr") != "") & differs("translation_fr", "raw_translation_fr"))
    )


def _counts() -> list[Column]:
    status, active = F.col("manual_status"), F.col("manual_status") != "ignored"
    return [
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(F.size("quality_warnings") > 0).alias("warnings"),
        F.count_if(status == "review").alias("review"),
        F.count_if(active & blank("translation_fr")).alias("untranslated"),
        F.count_if(status == "validated").alias("validated"),
        F.count_if(~active).alias("ignored"),
    ]


def page_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(*_counts())


def project_stats(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Counters of each project. Pages without blocks count if ``pages`` (project_id, page_index) is given."""
    x = page_stats(blocks)
    if pages is not None:
        x = pages.select(*PAGE).distinct().join(x, [*PAGE], "left").na.fill(0)
    some = F.col("active") > 0
    return x.groupBy("project_id").agg(
        F.count("*").alias("pages"), F.sum("total").alias("blocks"), F.sum("validated").alias("validated_blocks"), F.sum("warnings").alias("warning_blocks"), F.sum("review").alias("review_blocks"),
        F.count_if(some & (F.col("untranslated") == 0)).alias("translated_pages"), F.count_if(some & (F.col("validated") == F.col("active"))).alias("validated_pages"),
    )


def renumber(blocks: DataFrame) -> DataFrame:
    """Reading order 0, 1, ... by (order, y, x, id) within a page."""
    order = W.partitionBy(*PAGE).orderBy("reading_order", F.col("bbox")[1], F.col("bbox")[0], "block_id")
    return blocks.withColumn("reading_order", F.row_number().over(order) - 1)


def spatial_order(blocks: DataFrame) -> DataFrame:
    """Reading order by the boxes' centres: down, then right (Japanese: left)."""
    cx, cy = F.col("bbox")[0] + F.col("bbox")[2], F.col("bbox")[1] + F.col("bbox")[3]
    order = W.partitionBy(*PAGE).orderBy(cy, F.when(F.col("source_lang") == "ja", -cx).otherwise(cx), "seq")
    return blocks.withColumn("reading_order", F.row_number().over(order) - 1)


def move(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """Swap blocks named in ``moves`` (project_id, page_index, block_id, direction) with a neighbour; at an edge nothing moves.

    One move for each page; the orders of a page are 0, 1, ... afterwards.
    """
    page = W.partitionBy(*PAGE)
    x = blocks.join(moves.select(*PAGE, "block_id", F.when(F.col("direction") < 0, -1).otherwise(1).alias("_d")), [*PAGE, "block_id"], "left")
    x = x.withColumn("_at", F.row_number().over(page.orderBy("reading_order", "seq")) - 1).withColumn("_n", F.count("*").over(page))
    x = x.withColumn("_from", F.max(F.when(F.col("_d").isNotNull(), F.col("_at"))).over(page)).withColumn("_to", F.col("_from") + F.max("_d").over(page))
    ok = F.col("_to").between(0, F.col("_n") - 1)
    place = F.when(ok & (F.col("_at") == F.col("_from")), F.col("_to")).when(ok & (F.col("_at") == F.col("_to")), F.col("_from")).otherwise(F.col("_at"))
    return x.withColumn("reading_order", place).drop("_d", "_at", "_n", "_from", "_to")


CASCADE = {
    "ocr_text": ("ocr_corrected_text", "normalized_source_text", "raw_translation_fr", "translation_fr"),
    "ocr_corrected_text": ("normalized_source_text", "raw_translation_fr", "translation_fr"),
    "normalized_source_text": ("raw_translation_fr", "translation_fr"),
    "translation_fr": (),
}


def set_field(blocks: DataFrame, name: str, value: Column, where: Column) -> DataFrame:
    """Edit a text of the chosen blocks; what was made from it is cleared, the status becomes edited unless ignored."""
    put = lambda c, new: F.when(where, new).otherwise(F.col(c)).alias(c)
    new: dict[str, Column] = {name: squeezed_ends(value), **{c: F.lit("") for c in CASCADE[name]}, "quality_warnings": F.array().cast("array<string>")}
    new["manual_status"] = F.when(F.col("manual_status") == "ignored", "ignored").otherwise("edited")
    if name == "ocr_text":
        new["ocr_alternatives"] = F.array().cast(blocks.schema["ocr_alternatives"].dataType)
    return blocks.select(*(put(c, new[c]) if c in new else F.col(c) for c in blocks.columns))


def with_warning(text: Column) -> Column:
    return F.when(F.array_contains("quality_warnings", text), F.col("quality_warnings")).otherwise(F.array_append("quality_warnings", text))


def set_status(blocks: DataFrame, status: str, where: Column) -> DataFrame:
    """Validated and ignored blocks lose their warnings; review adds one."""
    warned = F.array().cast("array<string>") if status in ("validated", "ignored") else with_warning(F.lit("marqué à revoir manuellement")) if status == "review" else F.col("quality_warnings")
    return blocks.withColumn("quality_warnings", F.when(where, warned).otherwise(F.col("quality_warnings"))).withColumn("manual_status", F.when(where, status).otherwise(F.col("manual_status")))


def use_alternative(blocks: DataFrame, at: Column, where: Column) -> DataFrame:
    """Put an alternative's text in place of the raw text; a missing or blank one raises an error when it is read."""
    text = squeezed_ends(F.get("ocr_alternatives", at)["text"])
    checked = F.when(where & (F.coalesce(text, F.lit("")) == ""), F.raise_error(F.lit("no such alternative"))).otherwise(text)
    return set_field(blocks, "ocr_text", checked, where)


def split_lines(blocks: DataFrame) -> DataFrame:
    """Blocks of two or more lines become a block for each line, with a band of the box; others don't appear.

    The orders of a page's new blocks follow the old order and the line.
    """
    text = F.coalesce(full(F.col("ocr_corrected_text")), F.col("ocr_text"))
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), squeezed_ends), lambda s: s != "")
    x = blocks.withColumn("_lines", lines).where(F.size("_lines") >= 2).withColumn("_n", F.size("_lines"))
    x = x.select("*", F.posexplode("_lines").alias("_i", "_line"))
    y1, h = F.col("bbox")[1], F.greatest(F.lit(1), F.col("bbox")[3] - F.col("bbox")[1])
    edge = lambda i: y1 + F.floor(h * i / F.col("_n")).cast("int")
    new = {
        "block_id": F.concat_ws("_s", "block_id", (F.col("_i") + 1).cast("string")),
        "bbox": F.array(F.col("bbox")[0], edge(F.col("_i")), F.col("bbox")[2], F.greatest(edge(F.col("_i")) + 1, edge(F.col("_i") + 1))),
        "ocr_text": F.col("_line"), "manual_status": F.lit("edited"), "quality_warnings": F.array(F.lit("bloc OCR séparé manuellement")),
        "ocr_alternatives": F.array().cast(blocks.schema["ocr_alternatives"].dataType),
        **{c: F.lit("") for c in CASCADE["ocr_text"]},
    }
    order = W.partitionBy(*PAGE).orderBy("reading_order", "seq", "_i")
    x = x.withColumn("_at", F.row_number().over(order) - 1)
    return x.select(*(new[c].alias(c) if c in new else (F.col("_at") if c == "reading_order" else F.col(c)).alias(c) for c in blocks.columns))


def merge_blocks(blocks: DataFrame, key: Column) -> DataFrame:
    """Blocks of a page with equal, not null ``key`` become one: its first block, the union of boxes, joined texts.

    Groups of one block are left out, as there is nothing to merge.
    """
    x = blocks.withColumn("_key", key).where("_key is not null")
    text = squeezed_ends(F.coalesce(full(F.col("ocr_corrected_text")), F.col("ocr_text")))
    box = lambda i, f: f(F.col("bbox")[i])
    parts = F.sort_array(F.collect_list(F.struct("reading_order", "seq", "block_id", text.alias("text"), F.slice("ocr_alternatives", 1, 3).alias("alternatives"))))
    g = x.groupBy(*PAGE, "_key").agg(
        parts.alias("parts"), F.count("*").alias("n_merged"), F.avg("confidence").alias("confidence"),
        F.array(box(0, F.min), box(1, F.min), box(2, F.max), box(3, F.max)).alias("bbox"),
    ).where("n_merged >= 2")
    return g.select(
        *PAGE, F.col("parts")[0]["block_id"].alias("block_id"), "bbox", "confidence", "n_merged", F.col("parts")[0]["reading_order"].alias("reading_order"),
        F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda s: s != ""), "\n").alias("ocr_text"),
        F.slice(F.flatten(F.transform("parts", lambda p: p["alternatives"])), 1, 10).alias("ocr_alternatives"),
        F.lit("edited").alias("manual_status"), F.array(F.lit("blocs OCR fusionnés manuellement")).alias("quality_warnings"),
    )


# What a reviewer may write as a decision.
IGNORE, SFX = ("ignore", "ignored", "sfx", "noise"), ("sfx", "noise")
FUSED, ZONE = ("fused", "fusion", "merged", "merge"), ("zone", "bad_zone", "crop", "bbox", "segmentation")
REVIEW = ("review", "revoir", "a revoir", "todo", *FUSED, *ZONE)
VALIDATE, CORRECT = ("validate", "valid", "validated", "ok", "keep"), ("correct", "corrected", "edit", "edited")


def apply_review(blocks: DataFrame, review: DataFrame) -> DataFrame:
    """Apply review rows (page_index, block_id, review_decision, corrected_*, review_notes) to blocks.

    All blocks come back, with ``outcome``: validated, corrected, ignored,
    review, skipped, or null without a review row; ``row_changed`` is whether
    the row changed anything. One review row for each block: the last one
    (by ``seq``) counts.
    """
    cell = lambda c: squeezed_ends(F.coalesce(F.col(c), F.lit("")))
    r = review.select(
        F.col("page_index").cast("int").alias("page_index"), "block_id", F.col("seq").alias("_seq"), decision_key(F.col("review_decision")).alias("_d"),
        cell("corrected_ocr").alias("_ocr"), cell("corrected_source").alias("_source"), cell("corrected_fr").alias("_fr"), cell("review_notes").alias("_notes"),
    )
    last = F.row_number().over(W.partitionBy("page_index", "block_id").orderBy(F.desc("_seq")))
    x = blocks.join(r.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_seq"), ["page_index", "block_id"], "left")
    d, notes = F.col("_d"), F.col("_notes")
    for words, mark in ((SFX, "[sfx]"), (FUSED, "[fusion]"), (ZONE, "[zone]")):
        notes = F.when(d.isin(*words) & ~F.lower(notes).startswith(mark), F.btrim(F.concat(F.lit(mark + " "), notes))).otherwise(notes)
    x = x.withColumn("_notes", notes)
    new = lambda c, v: (F.col(v) != "") & (F.col(c) != F.col(v))
    pairs = {"ocr_corrected_text": "_ocr", "normalized_source_text": "_source", "translation_fr": "_fr", "review_notes": "_notes"}
    x = x.withColumn("_edits", sum((F.coalesce(new(c, v), F.lit(False)).cast("int") for c, v in pairs.items()), F.lit(0)))
    corrected = (F.col("_ocr") != "") | (F.col("_source") != "") | (F.col("_fr") != "")
    outcome = (
        F.when(d.isNull(), None).when(d.isin(*IGNORE), "ignored").when(d.isin(*REVIEW), "review").when(d.isin(*VALIDATE), "validated")
        .when(d.isin(*CORRECT) | corrected, "corrected").when(d == "", "skipped").otherwise("review")
    )
    x = x.withColumn("outcome", outcome).withColumn("row_changed", F.coalesce(F.col("outcome") != "skipped", F.lit(False)))
    back = F.when(new("translation_fr", "_fr") & (F.col("raw_translation_fr") == ""), F.col("_fr")).otherwise(F.col("raw_translation_fr"))
    x = x.withColumn("raw_translation_fr", back)
    for c, v in pairs.items():
        x = x.withColumn(c, F.when(new(c, v), F.col(v)).otherwise(F.col(c)))
    status = F.when(F.col("outcome") == "corrected", "edited").when(F.col("outcome").isin("ignored", "review", "validated"), F.col("outcome")).otherwise(F.col("manual_status"))
    return x.withColumn("manual_status", status).select(*blocks.columns, "outcome", "row_changed")


# Further decisions that a single block's review knows.
FUSED_ONE, ZONE_ONE = (*FUSED, "bulle fusionnee", "bulles fusionnees"), (*ZONE, "zone incorrecte")
# End of the fixed values.


def review_each(blocks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Decisions taken on single blocks: texts count as changes against what the block shows now, and a mark of another decision leaves the note.

    ``reviews``: project_id, page_index, block_id, decision, corrected_ocr,
    corrected_source, corrected_fr, notes; one row for each block. Blocks
    without one are unchanged; a decision that nothing fits asks for a review,
    or is an edit if a text changed.
    """
    cell = lambda c: squeezed_ends(F.coalesce(F.col(c), F.lit("")))
    r = reviews.select(*PAGE, "block_id", decision_key(F.col("decision")).alias("_d"), cell("corrected_ocr").alias("_ocr"), cell("corrected_source").alias("_source"), cell("corrected_fr").alias("_fr"), cell("notes").alias("_notes"))
    x = blocks.join(r, [*PAGE, "block_id"], "left")
    d, notes = F.col("_d"), F.col("_notes")
    bare = F.regexp_replace(notes, r"(?i)^\[(?:sfx|fusion|zone)\]\s*", "")
    marked = bare
    for words, mark in ((ZONE_ONE, "[zone]"), (FUSED_ONE, "[fusion]"), (SFX, "[sfx]")):
        own = F.when(F.lower(notes).startswith(mark), notes).otherwise(F.btrim(F.concat(F.lit(mark + " "), notes)))
        marked = F.when(d.isin(*words), own).otherwise(marked)
    x = x.withColumn("_notes", marked)
    now = {"_ocr": squeezed_ends(F.col("ocr_text")), "_source": squeezed_ends(source_normalized_first()), "_fr": squeezed_ends(final_translation())}
    differs = {k: (F.col(k) != "") & (F.col(k) != v) for k, v in now.items()}
    x = x.withColumn("_any", differs["_ocr"] | differs["_source"] | differs["_fr"])
    new = {
        "ocr_corrected_text": F.when(differs["_ocr"], F.col("_ocr")),
        "normalized_source_text": F.when((F.col("_source") != "") & (F.col("_source") != now["_source"]), F.col("_source")),
        "translation_fr": F.when(differs["_fr"], F.col("_fr")),
        "raw_translation_fr": F.when(differs["_fr"] & (F.col("raw_translation_fr") == ""), F.col("_fr")),
        "review_notes": F.when(F.col("_notes") != "", F.col("_notes")),
        "manual_status": F.when(d.isNull(), None).when(d.isin("validate", "valid", "validated", "ok"), "validated").when(d.isin(*IGNORE), "ignored")
        .when(d.isin("review", "revoir", "a revoir", "todo", *FUSED_ONE, *ZONE_ONE), "review").when(d.isin("correct", "corrected", "edit", "edited") | F.col("_any"), "edited").otherwise("review"),
    }
    return x.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in blocks.columns))


def review_counts(applied: DataFrame, review: DataFrame) -> DataFrame:
    """Counters of ``apply_review``; review rows without a block are skipped rows."""
    lost = review.select(F.col("page_index").cast("int").alias("page_index"), "block_id").join(applied.select("page_index", "block_id"), ["page_index", "block_id"], "left_anti")
    n = lambda o, name: F.count_if(F.col("outcome") == o).alias(name)
    x = applied.agg(F.count_if("row_changed").alias("changed"), n("validated", "validated"), n("corrected", "corrected"), n("ignored", "ignored"), n("review", "review"), n("skipped", "_skipped"))
    return x.crossJoin(F.broadcast(lost.agg(F.count("*").alias("_lost")))).select("changed", "validated", "corrected", "ignored", "review", (F.col("_skipped") + F.col("_lost")).alias("skipped"))


def with_reasons(blocks: DataFrame, memory: DataFrame | None = None, *, keep_flags: bool = False) -> DataFrame:
    """Add ``page_reason`` (by counts over the page's blocks) and ``reason`` (the page's, else the block's); the flags of earlier runs go, unless they are kept."""
    from inkloom.functions.text import ignore_key

    x = blocks.withColumn("_text", source_corrected_first())
    learned = None
    if memory is not None:
        x = x.withColumn("_k", ignore_key(F.col("_text"))).join(memory.select(F.col("key").alias("_k"), F.col("value").alias("_learned")), "_k", "left")
        learned = F.col("_learned")
    x = detect.with_flags(x, F.col("_text"), learned)
    kept = [c for c in detect.FLAGS if keep_flags]
    page = W.partitionBy(*PAGE)  # one shuffle; a page has the blocks of one image
    flags = {"technical": "_technical", "dialogue": "_dialogue", "profile": "_profile", "marks": "_marks"}
    counts = {"n": F.count("*").over(page).cast("int"), "reasons": F.count_if(F.col("_own") != "").over(page), **{k: F.count_if(f).over(page) for k, f in flags.items()}}
    x = x.select("*", *(v.alias(k) for k, v in counts.items()))
    c, fifth, sixth = F.col, F.expr("n div 5"), F.expr("n div 6")
    verdict = (
        F.when(c("n") < 6, "")
        .when((c("technical") >= 5) & (c("reasons") / c("n") >= 0.55) & (c("dialogue") <= F.greatest(F.lit(2), fifth)), "page non exploitable: infographie/signaletique")
        .when((c("profile") >= F.greatest(F.lit(4), F.expr("n div 2"))) & (c("marks") <= F.greatest(F.lit(1), fifth)), "page non exploitable: fiche personnages/extra dense")
        .when((c("reasons") / c("n") >= 0.75) & (c("dialogue") <= F.greatest(F.lit(1), sixth)), "page non exploitable: non-dialogue")
        .otherwise("")
    )
    x = x.withColumn("page_reason", verdict).withColumn("reason", F.coalesce(full(F.col("page_reason")), F.col("_own")))
    return x.select(*(c for c in blocks.columns if c not in detect.FLAGS), "page_reason", "reason", *kept)


def auto_ignore(blocks: DataFrame, memory: DataFrame | None = None, *, keep_flags: bool = False) -> DataFrame:
    """Ignore what needs no review (English blocks); ``auto_changed`` tells which statuses changed.

    With ``keep_flags`` what was found in the texts stays beside them, and a
    further run with the same memory searches changed texts only.
    """
    x = with_reasons(blocks, memory, keep_flags=keep_flags)
    hit = (F.col("source_lang") == "en") & (F.col("reason") != "")
    x = x.withColumn("quality_warnings", F.when(hit, with_warning(F.concat(F.lit("auto-ignore: non-dialogue probable: "), F.col("reason")))).otherwise(F.col("quality_warnings")))
    x = x.withColumn("review_notes", F.when(hit & blank("review_notes"), F.concat(F.lit("[auto-ignore] "), F.col("reason"))).otherwise(F.col("review_notes")))
    x = x.withColumn("auto_changed", hit & F.col("manual_status").isin("unchecked", "review"))
    return x.withColumn("manual_status", F.when(F.col("auto_changed"), "ignored").otherwise(F.col("manual_status")))
