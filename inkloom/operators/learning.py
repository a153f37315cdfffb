"""What a corpus teaches: translation and correction counts, names, residues, risky tokens, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import patterns as P
from inkloom.functions.score import with_quality, with_texts
from inkloom.functions.text import once, squeezed_ends, tokens
from inkloom.operators.blocks import learnable


def translation_counts(blocks: DataFrame, k: int = 100) -> DataFrame:
    x = with_texts(blocks).where(learnable() & (F.col("source") != "")).groupBy("source_lang", "source", F.col("translation").alias("translation_fr"))
    return x.agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")).orderBy(F.desc("count"), F.lower("source"), "first_seq").limit(k)


def correction_counts(blocks: DataFrame, k: int = 100) -> DataFrame:
    raw, fixed = squeezed_ends(F.col("ocr_text")), squeezed_ends(F.col("ocr_corrected_text"))
    x = blocks.where(learnable()).select(raw.alias("ocr_raw"), fixed.alias("ocr_corrected"), "seq").where("ocr_raw <> '' and ocr_corrected <> '' and ocr_raw <> ocr_corrected")
    return x.groupBy("ocr_raw", "ocr_corrected").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")).orderBy(F.desc("count"), F.lower("ocr_raw"), "first_seq").limit(k)


def glossary_candidates(blocks: DataFrame, k: int = 100) -> DataFrame:
    """Capitalised words of learnable sources that aren't all capitals."""
    x = with_texts(blocks).where(learnable()).select("seq", F.explode(tokens(F.col("source"), r"[A-Z][A-Za-z'’-]+")).alias("term"))
    x = x.where((F.length("term") >= 3) & (F.upper("term") != F.col("term")))
    return x.groupBy("term").agg(F.count("*").alias("count"), F.min("seq").alias("first_seq")).orderBy(F.desc("count"), "first_seq", "term").limit(k)


def riskiest(blocks: DataFrame, k: int = 100) -> DataFrame:
    x = with_quality(blocks).where("risk_score >= 55 and suggested_action not in ('ignored', 'validated')")
    return x.orderBy(F.desc("risk_score"), "seq").limit(k)


def learning_summary(blocks: DataFrame) -> DataFrame:
    x = with_quality(blocks)
    high = (F.col("risk_score") >= 55) & ~F.col("suggested_action").isin("ignored", "validated")
    return x.agg(
        F.count_distinct("project_id", "page_index").alias("pages"), F.count("*").alias("blocks"), F.count_if(learnable() & (F.col("source") != "")).alias("learnable_blocks"),
        F.count_if(F.col("manual_status") == "validated").alias("validated_blocks"), F.count_if(high).alias("high_risk_blocks"),
    )


def _high():
    return (F.col("risk_score") >= 55) | (F.col("suggested_action") == "review_high")


def suspicious_tokens(rows: DataFrame) -> DataFrame:
    """token, count, high_risk_count of tokens that look misread."""
    from inkloom.functions.detect import weird_token

    x = rows.select(F.explode(tokens(F.col("source"), P.PROFILE_TOKEN)).alias("token"), _high().alias("high"))
    x = x.groupBy("token").agg(F.count("*").alias("count"), F.count_if("high").alias("high_risk_count"))
    # a token is judged once, after it was counted; what is evaluated once isn't pushed below the counts
    return once(x, _weird=weird_token(F.col("token"))).where("_weird").drop("_weird")


def residue_tokens(rows: DataFrame) -> DataFrame:
    """token, count of words of four letters or more that translations copy, once a row."""
    low = lambda c: F.array_distinct(F.transform(F.filter(tokens(F.col(c), P.PROFILE_TOKEN), lambda t: F.length(t) >= 4), F.lower))
    x = rows.select(F.explode(F.array_except(F.array_intersect(low("source"), low("translation")), F.array(*map(F.lit, P.FRENCH_STOP)))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("count"))


def name_candidates(rows: DataFrame) -> DataFrame:
    x = rows.select(F.explode(F.regexp_extract_all("source", F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_'’-])({P.CAPITALISED})"), F.lit(1))).alias("token"))
    return x.where(~F.col("token").isin(P.NAME_STOP) & ~F.lower("token").isin(P.ENGLISH_COMMON)).groupBy("token").agg(F.count("*").alias("count"))


def repeated_sources(rows: DataFrame, k: int = 5) -> DataFrame:
    """source, count and its k most frequent translations, of sources that occur twice or more."""
    n = rows.where("source <> ''").groupBy("source", "translation").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    w = W.partitionBy("source")
    n = n.withColumn("count", F.sum("n").over(w)).where("count >= 2").withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "first_seq", "translation")))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= k, F.struct("rn", "translation")))), lambda s: s["translation"])
    return n.groupBy("source").agg(F.first("count").alias("count"), top.alias("translations"))


def token_risk(rows: DataFrame) -> DataFrame:
    """Smoothed share of high-risk rows of each token that occurs twice or more: (high + 1) / (count + 2) >= 0.55."""
    x = rows.select(F.explode(F.transform(tokens(F.col("source"), P.PROFILE_TOKEN), F.lower)).alias("token"), _high().alias("high"))
    x = x.groupBy("token").agg(F.count("*").alias("count"), F.count_if("high").alias("high_risk_count")).where("count >= 2")
    weight = (F.col("high_risk_count") + 1) / (F.col("count") + 2)
    return x.withColumn("risk_weight", F.round(weight, 4)).where(weight >= 0.55)


def profile_summary(rows: DataFrame) -> DataFrame:
    s = F.col("risk_score")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(_high()).alias("high"), F.count_if((s >= 25) & (s < 55)).alias("medium"), F.count_if(s < 25).alias("ok"), F.count_distinct("series_label").alias("series")
    )


def top_series(rows: DataFrame, k: int = 20) -> DataFrame:
    """series_label, blocks of the k series with most blocks."""
    return rows.groupBy("series_label").agg(F.count("*").alias("blocks")).orderBy(F.desc("blocks"), "series_label").limit(k)


def quality_report(blocks: DataFrame) -> DataFrame:
    """Long-form report: section, name, value (bands and reasons of actionable blocks, blocks of series)."""
    x = with_quality(blocks)
    entry = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    act = F.coalesce(~F.col("suggested_action").isin("ignored", "validated"), F.lit(False))
    series = F.array(entry("series", F.col("series_label")))
    acted = F.concat(series, F.array(entry("band", F.col("suggested_action"))), F.transform("risk_reasons", lambda r: entry("reason", r)))
    # every row is scored once: what it counts for goes into one grouping
    n = x.select(F.inline(F.when(act, acted).otherwise(series))).groupBy("section", "name").agg(F.count("*").alias("value"))
    n = n.withColumn("_rn", F.row_number().over(W.partitionBy("section").orderBy(F.desc("value"), "name"))).where("_rn <= 30")
    return n.where("_rn <= 20 or section <> 'reason'").select("section", "name", "value")
