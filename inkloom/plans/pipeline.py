"""End-to-end runs: recognised fragments to checked blocks, and a refresh of reviewed projects.

Models are plug-ins: a translator is a function from an iterator of pandas
frames (text) to frames (text, translation), run in Arrow batches over the
distinct texts. Tests use simple stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions.checks import apply_checks, japanese_skip
from inkloom.functions.detect import FLAGS
from inkloom.functions.text import full, once, source_clean_normalized_first, squeeze
from inkloom.operators.blocks import PAGE, auto_ignore, blank, protected, refreshable, with_warning
from inkloom.operators.dialogue import prepare, prepare_blocks, with_override
from inkloom.operators.geometry import group_lines, noise, polygon_box
from inkloom.operators.normalise import zone_alternatives
from inkloom.schema import as_blocks
from inkloom.sources.views import settled

Translator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def blocks_of_fragments(raw: DataFrame, *, least: float = 0.20, merge_lines: bool = True, drop_noise: bool = True) -> DataFrame:
    """Blocks of recognised fragments: project_id, page_index, raw_order, polygon, text, confidence, source_lang.

    Noise goes, boxes are made from polygons, ids are ``p<page>_b<order>``;
    lines are joined (on pages that have a project and a number), or keep their
    order. Empty pages have no blocks.
    """
    x = raw.where(~noise(F.col("text"), F.col("confidence"), least)) if drop_noise else raw
    # dealt by page once, for the numbers and for the lines
    x = x.select(*PAGE, "raw_order", polygon_box(F.col("polygon")).alias("bbox"), "source_lang", squeeze(F.col("text")).alias("ocr_text"), "confidence").repartition(*PAGE)
    at = F.row_number().over(W.partitionBy(*PAGE).orderBy("raw_order")) - 1
    x = x.withColumn("reading_order", at).withColumn("block_id", F.format_string("p%04d_b%04d", "page_index", "reading_order")).withColumn("seq", F.col("reading_order").cast("long"))
    if not merge_lines:
        return as_blocks(x)
    return as_blocks(group_lines(x.where("project_id is not null and page_index is not null"), keep=("source_lang", "seq"), dealt=True))


# Fixed value: what a Japanese fragment too weak to translate is told.
WEAK = "fragment japonais non traduit automatiquement: OCR faible/court"
# End of the fixed value.


def with_translations(rows: DataFrame, translator: Translator, often: int = 50_000) -> DataFrame:
    """Add ``translation``: what the translator makes of ``_text``, each distinct text once.

    Rows of a text that occurs more than ``often`` times are dealt over several
    parts, each of which gets the translation.
    """
    counts = rows.groupBy("_text").agg(F.count("*").alias("_n"))
    parts = F.broadcast(counts.where(F.col("_n") > often).select("_text", F.ceil(F.col("_n") / often).cast("int").alias("_parts")))
    made = counts.select(F.col("_text").alias("text")).mapInPandas(translator, "text string, translation string").withColumnRenamed("text", "_text")
    own = F.coalesce(F.col("_parts"), F.lit(1))
    made = made.join(parts, "_text", "left").select("_text", "translation", F.explode(F.sequence(F.lit(0), own - 1)).alias("_part"))
    dealt = rows.join(parts, "_text", "left").withColumn("_part", F.pmod(F.xxhash64(*PAGE, "block_id"), own).cast("int")).drop("_parts")
    return dealt.join(made, ["_text", "_part"], "left").drop("_part")


def translate(blocks: DataFrame, translator: Translator, *, force: bool = False, often: int = 50_000, **tables) -> DataFrame:
    """Fill translations of blocks that aren't protected, blank or too weak; ready translations go before the model.

    English blocks without a normalised source are prepared first (``tables``
    are those of ``dialogue.prepare``). Japanese fragments too weak to translate
    lose their translation and are warned of; blocks under review become edited.
    """
    some = source_clean_normalized_first() != ""
    if not force:
        some = some & ~protected()
    weak = some & (F.col("source_lang") == "ja") & japanese_skip(F.col("ocr_text"), F.col("confidence")) if not force else F.lit(False)
    english = F.col("source_lang") == "en"
    x = once(blocks, _go=some & ~weak, _weak=weak)
    x = x.withColumn("_raw_text", F.when(F.col("_go") & english & blank("normalized_source_text"), source_clean_normalized_first()))
    x = prepare(x, text_col="_raw_text", **tables)
    text = F.when(F.col("_raw_text").isNotNull(), F.col("normalized")).otherwise(source_clean_normalized_first())
    x = x.withColumn("_text", F.when(F.col("_go"), text)).drop("override")
    ready = {k: v for k, v in tables.items() if k in ("kept", "overrides", "memory")}
    x = with_override(x, F.when(english, F.col("_text")), **ready)
    x = settled(x.withColumn("_ask", F.coalesce(F.col("_go") & (F.col("override") == ""), F.lit(False))), "translate")
    x = with_translations(x.where("_ask"), translator, often).unionByName(x.where("not _ask").withColumn("translation", F.lit(None).cast("string")))
    new = F.coalesce(full(F.col("override")), "translation", F.lit(""))
    status = F.when(F.col("manual_status") == "review", "edited").otherwise(F.col("manual_status"))
    values = {"normalized_source_text": F.col("_text"), "raw_translation_fr": new, "translation_fr": new, "manual_status": status, "ocr_corrected_text": F.when(F.col("_raw_text").isNotNull(), F.col("corrected")).otherwise(F.col("ocr_corrected_text"))}
    put = lambda c: F.when(F.col("_go"), values[c])
    gone = lambda c: put(c).when(F.col("_weak"), "") if c.endswith("translation_fr") or c == "translation_fr" else put(c)
    y = x.withColumn("quality_warnings", F.when(F.col("_weak"), with_warning(F.lit(WEAK))).otherwise(F.col("quality_warnings")))
    return y.select(*(gone(c).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in blocks.columns))


def process(raw: DataFrame, translator: Translator, *, ignored: DataFrame | None = None, **tables) -> DataFrame:
    """Fragments to checked blocks: join, prepare, filter, translate, check, and filter again (checks reset warnings)."""
    x = blocks_of_fragments(raw)
    own = x.columns
    ready = {k: v for k, v in tables.items() if k in ("kept", "overrides", "memory")}
    x = auto_ignore(prepare_blocks(x, **tables), ignored, keep_flags=True).select(*own, *FLAGS)  # the second pass finds the same texts
    x = apply_checks(translate(x, translator, **ready))
    return auto_ignore(x, ignored).select(*own)


def refresh(blocks: DataFrame, lang: str, translator: Translator | None = None, *, include_review: bool = False, zone_readings: DataFrame | None = None, apply_readings: bool = False, **tables) -> DataFrame:
    """Prepare, translate and check again what nobody has decided yet; other blocks stay as they are.

    ``zone_readings`` (candidates as ``normalise.improve`` takes them) are then
    offered to blocks under review whose zone is in doubt, or applied.
    """
    own = blocks.columns
    chosen = refreshable(lang, include_review)
    ready = {k: v for k, v in tables.items() if k in ("kept", "overrides", "memory")}
    x = prepare_blocks(blocks.where(chosen), **tables)
    x = apply_checks(translate(x, translator, **ready) if translator else x)
    x = x.select(*own).unionByName(blocks.where(~chosen))
    return x if zone_readings is None else zone_alternatives(x, zone_readings, lang, apply_best=apply_readings).select(*own)


def corpus_totals(blocks: DataFrame) -> DataFrame:
    """pages, processed and skipped pages, blocks, blocks with warnings, untranslated blocks."""
    pages = blocks.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(F.size("quality_warnings") > 0).alias("w"), F.count_if(blank("translation_fr") & (F.col("manual_status") != "ignored")).alias("u"), F.max((F.col("page_status") == "ignored").cast("int")).alias("s"))
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("s") == 0).alias("processed"), F.count_if(F.col("s") == 1).alias("skipped"), F.sum("n").alias("blocks"), F.sum("w").alias("blocks_with_warnings"), F.sum("u").alias("untranslated")
    )
