"""Evaluation against reviewed data: diagnosis of changes, and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import detect
from inkloom.functions.text import final_translation, full, identity_key, punctuation, replay_key, source_clean_normalized_first, source_corrected_first, source_normalized_first, squeeze, squeezed_ends
from inkloom.operators.blocks import PAGE, changed
from inkloom.operators.geometry import best_match
from inkloom.operators.memory import similarity

# Words that show a French or an English source in replays.
FRENCH = """je j tu il elle nous vous ils elles le la les un une des de du ce cette ca ça est suis sont etre être avoir pas que qui quoi
    ou où pourquoi comment avec sans dans sur plus moins tres très faire faut voila voilà mais donc alors comme pour pere père mere mère""".split()
ENGLISH = """i you we they he she it what why how where when who the a an to of and or is are was were be been have has had do does did
    not don can will would should could wanna gonna gotta""".split()
# End of the fixed values.


def diagnose(blocks: DataFrame) -> DataFrame:
    """project_id, page_index, block_id, category, reason: every category of change that applies to a block."""
    t = lambda c: squeezed_ends(F.col(c))
    compact = lambda c: F.lower(squeeze(c))
    raw, fixed, norm, raw_fr, fr = (t(c) for c in ("ocr_text", "ocr_corrected_text", "normalized_source_text", "raw_translation_fr", "translation_fr"))
    x = blocks.withColumn("_ratio", similarity(identity_key(raw), identity_key(fixed)))
    notes = detect.note_categories(F.lower(t("review_notes")))
    own = detect.skip_reason(source_corrected_first())
    item = lambda c, r: F.struct((F.lit(c) if isinstance(c, str) else c).alias("category"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    one = lambda test, c, r: F.when(test, F.array(item(c, r))).otherwise(F.array())
    apart = (fixed != "") & (compact(fixed) != compact(raw))
    kind = F.when((F.col("_ratio") >= 0.90) & (punctuation(raw) != punctuation(fixed)), "punctuation").when(F.col("_ratio") < 0.90, "ocr_text").otherwise("casing_or_spacing")
    found = F.concat(
        one(F.col("manual_status") == "ignored", "sfx_or_non_dialogue", F.coalesce(full(own), F.lit("ignore humain non couvert automatiquement"))),
        F.transform(notes, lambda c: item(c, "note humaine zone/bbox")),
        F.transform(F.array_except(detect.zone_categories(source_clean_normalized_first()), notes), lambda c: item(c, "heuristique texte/zone")),
        one(apart, kind, "texte corrigé"),
        one((norm != "") & (compact(norm) != compact(F.coalesce(full(fixed), raw))), "source_normalization", "source reformulée avant traduction"),
        one((raw_fr != "") & (fr != "") & (compact(raw_fr) != compact(fr)), "translation", "traduction corrigée"),
    )
    found = F.when((F.size(found) == 0) & changed(), F.array(item("other", "modification non classée"))).otherwise(found)
    return x.select(*PAGE, "block_id", "seq", F.posexplode(found).alias("pos", "item")).select(*PAGE, "block_id", "seq", "pos", "item.category", "item.reason")


def diagnose_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count("*").alias("count"))


def examples(items: DataFrame, k: int = 8) -> DataFrame:
    """The first k items of each category."""
    return items.withColumn("rn", F.row_number().over(W.partitionBy("category").orderBy("seq", "pos"))).where(F.col("rn") <= k)


def similarity_scores(blocks: DataFrame) -> DataFrame:
    """Mean similarity of reviewed sources and translations, and the share of ignored blocks that rules cover."""
    key = lambda c: F.lower(squeeze(c))
    src, fr = similarity(key(F.col("ocr_text")), key(source_normalized_first())), similarity(key(F.col("raw_translation_fr")), key(F.col("translation_fr")))
    x = blocks.select("*", src.alias("_s"), fr.alias("_t"), (detect.skip_reason(source_corrected_first()) != "").cast("double").alias("_i"))
    reviewed = F.col("manual_status").isin("edited", "validated", "review") & (key(F.col("ocr_text")) != "")
    both = (key(F.col("raw_translation_fr")) != "") & (key(F.col("translation_fr")) != "")
    mean = lambda test, c, name: F.round(F.avg(F.when(test, F.col(c))), 4).alias(name)
    return x.agg(mean(reviewed, "_s", "source_similarity"), mean(both, "_t", "translation_similarity"), mean(F.col("manual_status") == "ignored", "_i", "ignored_auto_covered"))


def replay(targets: DataFrame, found: DataFrame, *, least_iou: float = 0.35, source_at: float = 0.92, translation_at: float = 0.85) -> DataFrame:
    """Reviewed blocks against a new run: match, translation_mismatch, source_mismatch, mismatch or missing."""
    pairs = best_match(targets, found, least_iou)
    texts = lambda d, p, i: d.select(*PAGE, F.col("block_id").alias(i), source_normalized_first().alias(f"{p}_source"), final_translation().alias(f"{p}_translation"))
    x = pairs.join(texts(targets, "expected", "target_id"), [*PAGE, "target_id"]).join(texts(found, "actual", "matched_id"), [*PAGE, "matched_id"], "left")
    es, et, as_, at = (replay_key(F.coalesce(c, F.lit(""))) for c in ("expected_source", "expected_translation", "actual_source", "actual_translation"))
    x = x.withColumn("_s", similarity(es, as_)).withColumn("_t", similarity(et, at)).withColumn("_x", similarity(es, et))
    words = F.split(es, r"[^\p{L}\p{N}_]+")
    n = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    french = (n(FRENCH) + es.rlike("[àâçéèêëîïôùûüÿœ]").cast("int") >= 2) & (n(ENGLISH) == 0)
    skipped = (es != "") & (et != "") & ((F.col("_x") >= 0.82) | french)
    missing = F.col("matched_id").isNull()
    translation = F.when(missing, 0.0).otherwise(F.col("_t"))
    source = F.when(missing, 0.0).when(skipped & (F.col("_t") >= translation_at), 1.0).otherwise(F.col("_s"))
    x = x.withColumn("source_similarity", source).withColumn("translation_similarity", translation)
    s, t = F.col("source_similarity") >= source_at, F.col("translation_similarity") >= translation_at
    status = F.when(missing, "missing").when(s & t, "match").when(s, "translation_mismatch").when(t, "source_mismatch").otherwise("mismatch")
    evaluation = F.when(~missing & skipped, "skipped_translation_in_source").otherwise("checked")
    return x.withColumn("status", status).withColumn("source_evaluation", evaluation).drop("_s", "_t", "_x")


def replay_totals(results: DataFrame, source_at: float = 0.92, translation_at: float = 0.85) -> DataFrame:
    s, t = F.col("source_similarity") >= source_at, F.col("translation_similarity") >= translation_at
    return results.agg(F.count("*").alias("targets"), F.count_if(F.col("status") != "missing").alias("matched"), F.count_if(s).alias("source_matches"), F.count_if(t).alias("translation_matches"), F.count_if(s & t).alias("full_matches"))
