"""Writers: projects, review rows, manifests, packs, memories, HTML pages. All are distributed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import final_translation, source_normalized_first
from inkloom.schema import TEXTS

REVIEW_COLUMNS = (
    "page_index", "page_number", "series_label", "volume_label", "image_name", "block_id", "reading_order", "bbox", "source_lang", "confidence", "manual_status",
    "risk_score", "suggested_action", "risk_reasons", "quality_warnings", "ocr_text", "ocr_corrected_text", "normalized_source_text", "source_for_review",
    "raw_translation_fr", "translation_fr", "ocr_alternatives_count", "ocr_alternatives",
)
EDITABLE = ("review_decision", "corrected_ocr", "corrected_source", "corrected_fr", "review_notes")


def nested_projects(blocks: DataFrame) -> DataFrame:
    """One row for each project: pages of blocks, in order. A project is a document, so it is gathered as one."""
    b = F.struct(F.col("seq").alias("_seq"), F.struct(F.col("block_id").alias("id"), "bbox", "source_lang", *TEXTS, "confidence", "reading_order", "manual_status", "quality_warnings", "ocr_alternatives").alias("b"))
    pages = blocks.groupBy("project_id", "page_index").agg(F.min_by("image_name", "seq").alias("image_name"), F.min_by("page_status", "seq").alias("status"), F.transform(F.sort_array(F.collect_list(b)), lambda s: s["b"]).alias("blocks"))
    page = F.sort_array(F.collect_list(F.struct("page_index", "image_name", "status", "blocks")))
    return pages.groupBy("project_id").agg(page.alias("pages")).select("project_id", F.lit("").alias("cbz_path"), F.lit(1).alias("version"), F.lit("").alias("glossary_terms"), "pages")


def write_projects(blocks: DataFrame, path: str) -> None:
    """Project documents, one on each line; nulls are written out."""
    nested_projects(blocks).write.option("ignoreNullFields", False).json(path)


def review_rows(blocks: DataFrame) -> DataFrame:
    """The 23 review columns, all of them text, of blocks with quality columns."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    made: dict[str, Column] = {
        "page_number": F.col("page_index") + 1,
        "bbox": F.array_join(F.transform("bbox", lambda x: x.cast("string")), ","),
        "confidence": F.format_string("%.4f", "confidence"),
        "risk_reasons": F.array_join("risk_reasons", " | "),
        "quality_warnings": F.array_join("quality_warnings", " | "),
        "source_for_review": F.col("source"),
        "ocr_alternatives_count": F.size("ocr_alternatives"),
        "ocr_alternatives": F.to_json("ocr_alternatives", {"ignoreNullFields": "false"}),
    }
    made["confidence"] = F.when(F.col("confidence").isNull(), "").otherwise(made["confidence"])
    return blocks.select(*(s(made.get(c, F.col(c))).alias(c) for c in REVIEW_COLUMNS))


BOM = "\ufeff"


def write_review_rows(blocks: DataFrame, path: str) -> None:
    """Review rows as CSV, which begins with a byte order mark for spreadsheets, and as JSON lines."""
    rows = review_rows(blocks)
    rows.toDF(BOM + rows.columns[0], *rows.columns[1:]).write.csv(f"{path}/csv", header=True, escape='"', emptyValue="")
    rows.write.json(f"{path}/jsonl")


def pack_rows(rows: DataFrame) -> DataFrame:
    """Review rows with empty editable columns in front."""
    return rows.select(*(F.lit("").alias(c) for c in EDITABLE), *(c for c in rows.columns if c not in EDITABLE))


def write_pack(rows: DataFrame, path: str) -> None:
    pack_rows(rows).write.csv(path, header=True, sep="\t", quoteAll=True, escape='"', emptyValue="")


GUIDE = """# How to review

Fill the first five columns; rows without a decision stay as they are.

| review_decision | what happens |
|---|---|
| validate | the translation is right as it stands |
| correct | corrected_ocr, corrected_source and corrected_fr replace the block's texts where they are filled |
| review | the block is looked at again later |
| fused | two bubbles, or a bubble and a sound, were read as one: the block goes back to review |
| zone | the box is wrong or cuts the bubble: the block goes back to review |
| ignore | the block is left out |
| sfx | the block is a sound or a sign and is left out |

review_notes are kept with the block. Don't change page_index and block_id: they say which block a row is about.
"""


def write_review_pack(rows: DataFrame, path: str) -> None:
    """A pack as a tab-separated table and as JSON lines, and the guide to its decisions; rows keep their order."""
    write_pack(rows, f"{path}/table")
    pack_rows(rows).write.json(f"{path}/jsonl")
    rows.sparkSession.createDataFrame([(GUIDE,)], "value string").coalesce(1).write.text(f"{path}/guide")


def write_memory(memory: DataFrame, path: str) -> None:
    """key and value on every line, sorted by key across files, as ``read_memory`` with ``lines`` takes them."""
    memory.select("key", "value").orderBy("key").write.json(path)


def write_memory_document(memory: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """The exchange format {version, metadata, entries}: one JSON object, so one task gathers the entries. For a large memory take ``write_memory``."""
    about = F.map_from_arrays(F.array(*map(F.lit, metadata)), F.array(*map(F.lit, metadata.values()))) if metadata else F.expr("cast(map() as map<string,string>)")
    x = memory.where("key is not null and value is not null").groupBy("key").agg(F.max("value").alias("value"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    x.agg(entries.alias("entries")).select(F.lit(1).alias("version"), about.alias("metadata"), "entries").coalesce(1).write.json(path)


def write_dataset(blocks: DataFrame, path: str) -> None:
    """The review dataset of scored blocks: rows as CSV and JSON lines, learned counts, glossary terms and the quality report."""
    from inkloom.operators import learning

    write_review_rows(blocks, f"{path}/rows")
    learning.translation_counts(blocks).write.json(f"{path}/learning/translations")
    learning.correction_counts(blocks).write.json(f"{path}/learning/corrections")
    learning.learning_summary(blocks).write.json(f"{path}/learning/summary")
    learning.glossary_candidates(blocks).select("term").coalesce(1).write.text(f"{path}/glossary")
    report(learning.quality_report(blocks), f"{path}/quality", "Quality")


MANIFEST = (
    "series_index", "series_label", "series_path", "series_volume_number", "series_volume_count", "volume_index", "volume_label", "source_path", "source_parent", "page_count",
    "source_page_number", "source_page_index", "source_image_name", "output_relpath", "output_sha256", "sampling_mode", "seed",
)


def write_manifest(pages: DataFrame, path: str) -> None:
    """Sampled pages as a manifest of 17 columns, in CSV and in JSON lines; columns that are missing are null. A report counts pages by volume."""
    x = pages.select(*(F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in MANIFEST))
    x.write.csv(f"{path}/csv", header=True, escape='"')
    x.write.option("ignoreNullFields", False).json(f"{path}/jsonl")
    volumes = x.groupBy(F.col("series_label").alias("section"), F.col("volume_label").alias("name")).agg(F.count("*").alias("value"))
    report(volumes, f"{path}/report", "Sample")


def report(rows: DataFrame, path: str, title: str) -> None:
    """section, name, value as Markdown: a heading for each section, its lines by falling value. One row a section line; a report is one file."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value").cast("double")).alias("_v"), "name", F.col("value").cast("string").alias("value")))), lambda r: F.concat(F.lit("- "), r["name"], F.lit(": "), r["value"]))
    body = rows.where("name is not null").groupBy(F.coalesce("section", F.lit("")).alias("section")).agg(lines.alias("lines"))
    text = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n"))
    x = body.select("section", text.alias("value")).unionByName(rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("section"), F.lit(f"# {title}\n").alias("value")))
    x.orderBy(F.col("section").asc_nulls_first()).select("value").write.text(path)  # files in order; a small report is one


def write_profile(rows: DataFrame, path: str, most: int = 120) -> None:
    """What a corpus taught: summary, tokens, names, repeated sources and weights as JSON lines, the ``most`` frequent names and residue words as text, and a report."""
    from inkloom.operators import learning

    parts = {"suspicious": learning.suspicious_tokens(rows), "residue": learning.residue_tokens(rows), "names": learning.name_candidates(rows), "repeated": learning.repeated_sources(rows), "weights": learning.token_risk(rows), "series": learning.top_series(rows)}
    learning.profile_summary(rows).write.json(f"{path}/summary")
    for name, x in parts.items():
        x.write.json(f"{path}/{name}")
    parts["names"].orderBy(F.desc("count"), "token").limit(most).select("token").coalesce(1).write.text(f"{path}/glossary")
    parts["residue"].orderBy(F.desc("count"), "token").limit(most).select("token").coalesce(1).write.text(f"{path}/residue_words")
    top = lambda name, key, value: parts[name].orderBy(F.desc(value), key).limit(40).select(F.lit(name).alias("section"), F.col(key).alias("name"), F.col(value).cast("double").alias("value"))
    report(top("series", "series_label", "blocks").unionByName(top("suspicious", "token", "count")).unionByName(top("residue", "token", "count")).unionByName(top("weights", "token", "risk_weight")), f"{path}/report", "Profile")


def write_diagnosis(items: DataFrame, path: str, k: int = 8) -> None:
    """All items as JSON lines; counts by category, larger ones first, and at most ``k`` examples of each."""
    from inkloom.operators.evaluate import diagnose_counts, examples

    items.write.json(f"{path}/items")
    counts = diagnose_counts(items)
    counts.orderBy(F.desc("count"), "category").coalesce(1).write.json(f"{path}/counts")
    examples(items, k).repartition(1).sortWithinPartitions("category", "rn").write.json(f"{path}/examples")
    report(counts.select(F.lit("categories").alias("section"), F.col("category").alias("name"), F.col("count").alias("value")), f"{path}/report", "Diagnosis")


def write_replay(results: DataFrame, path: str) -> None:
    """All results and totals as JSON lines, a report of totals and statuses, and in detail the results that aren't a match."""
    from inkloom.operators.evaluate import replay_totals

    results.write.json(f"{path}/results")
    totals = replay_totals(results)
    totals.coalesce(1).write.json(f"{path}/totals")
    flat = totals.select(F.explode(F.array(*(F.struct(F.lit("1 totals").alias("section"), F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in totals.columns))).alias("r")).select("r.*")
    kinds = results.groupBy(F.lit("2 statuses").alias("section"), F.col("status").alias("name")).agg(F.count("*").alias("value"))
    report(flat.unionByName(kinds), f"{path}/report", "Replay")
    results.where("status <> 'match'").orderBy("project_id", "page_index", "target_id").write.json(f"{path}/mismatches")


def escaped(c: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_pages(blocks: DataFrame) -> DataFrame:
    """project_id, page_index, html: the page's image and status, and its blocks in reading order with every text, warnings and notes."""
    fr = F.coalesce(F.nullif(F.btrim(final_translation()), F.lit("")), F.lit("[non traduit]"))

    def shown(label: str, c: Column) -> Column:
        """A line where there is a text that differs from what is shown as the source."""
        return F.when((c != "") & (c != source_normalized_first()), F.concat(F.lit(f"<p class='{label}'>"), escaped(c), F.lit("</p>"))).otherwise("")

    meta = F.concat_ws(" · ", F.col("block_id"), F.col("manual_status"), F.format_string("%.2f", F.col("confidence")))
    meta = F.when(F.col("confidence").isNull(), F.concat_ws(" · ", F.col("block_id"), F.col("manual_status"))).otherwise(meta)
    warned = F.array_join(F.transform("quality_warnings", lambda w: F.concat(F.lit("<li class='warning'>"), escaped(w), F.lit("</li>"))), "")
    item = F.concat(
        F.lit("<li><p class='meta'>"), escaped(meta), F.lit("</p><p>"), escaped(source_normalized_first()), F.lit("</p><p>"), escaped(fr), F.lit("</p>"),
        shown("raw", F.col("ocr_text")), shown("corrected", F.col("ocr_corrected_text")), shown("notes", F.col("review_notes")),
        F.when(warned != "", F.concat(F.lit("<ul>"), warned, F.lit("</ul>"))).otherwise(""), F.lit("</li>"),
    )
    rows = F.sort_array(F.collect_list(F.struct("reading_order", "seq", item.alias("item"))))
    body = F.array_join(F.transform(rows, lambda r: r["item"]), "")
    g = blocks.groupBy("project_id", "page_index").agg(F.min_by("image_name", "seq").alias("image"), F.coalesce(F.min_by("page_status", "seq"), F.lit("")).alias("status"), body.alias("body"))
    head = F.concat(F.lit('<section data-status="'), escaped(F.col("status")), F.lit('"><img src="'), escaped(F.col("image")), F.lit('"><ol>'))
    return g.select("project_id", "page_index", F.concat(head, F.col("body"), F.lit("</ol></section>")).alias("html"))
