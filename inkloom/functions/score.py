"""Risk scores: the light quality risk with its reasons, the queue's risk, and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import patterns as P
from inkloom.functions.text import any_of, final_translation, once, source_normalized_first, squeeze, squeezed_ends, tokens, words_of


def lowered_tokens(found: Column, least: int = 1) -> Column:
    """Distinct tokens in lower case without quotes at their ends, of those of ``least`` characters or more."""
    long = F.filter(F.array_distinct(found), lambda t: F.length(t) >= least) if least > 1 else F.array_distinct(found)
    return F.array_distinct(F.transform(long, lambda t: F.btrim(F.lower(t), F.lit("'"))))


def copied_residue(source: Column, translation: Column) -> Column:
    """Words of four letters or more that the translation copies, without safe ones; both are lists of tokens."""
    both = F.array_intersect(lowered_tokens(source, 4), lowered_tokens(translation, 4))
    return F.array_except(both, F.array(*map(F.lit, P.SAFE_COPIES)))


def safe_untranslated(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]+", "").isin(P.SAFE_UNTRANSLATED)


def with_texts(blocks: DataFrame) -> DataFrame:
    """Add source and translation alone, for reports that need no score: what is evaluated once a row can't be pruned by column."""
    return once(blocks, source=source_normalized_first(), translation=squeezed_ends(F.col("translation_fr")))


def with_quality(blocks: DataFrame) -> DataFrame:
    """Add source, translation, risk_score, suggested_action, risk_reasons, source_tokens, translation_tokens.

    Texts are cut into tokens once and the rules are evaluated once; a filter
    on the score is applied to what they gave.
    """
    x = with_texts(blocks)
    s, t, conf = F.col("source"), F.col("translation"), F.col("confidence")
    x = once(x, _st=tokens(s, P.TOKEN), _tt=tokens(t, P.TOKEN), _sw=words_of(F.lower(s)), _tw=words_of(t), _safe_s=safe_untranslated(s), _safe_t=safe_untranslated(t), _warned=F.size("quality_warnings"))
    x = once(x, source_tokens=F.size("_st"), translation_tokens=F.size("_tt"), _copied=F.size(copied_residue(F.col("_st"), F.col("_tt"))))
    n, m, copied = F.col("source_tokens"), F.col("translation_tokens"), F.col("_copied")
    english = F.size(F.array_intersect(lowered_tokens(F.col("_tt")), F.array(*map(F.lit, P.ENGLISH))))
    shout = F.exists("_tw", lambda w: w.rlike("^[A-Z]{3,}$") & ~w.isin(P.SAFE_UPPERCASE))
    rules = [
        (F.col("_warned") > 0, F.least(F.lit(35), 9 * F.col("_warned")), F.concat(F.lit("QC warnings: "), F.col("_warned").cast("string"))),
        (conf < 0.35, 30, "OCR confidence very low"),
        ((conf >= 0.35) & (conf < 0.60), 16, "OCR confidence low"),
        (s == "", 30, "empty source"),
        (t == "", 35, "empty translation"),
        ((s != "") & (n == m) & (F.lower(squeeze(s)) == F.lower(squeeze(t))) & ~F.col("_safe_s"), 32, "translation identical to source"),
        (s.rlike(P.SYMBOLS) | t.rlike(P.SYMBOLS), 22, "suspicious symbols"),
        (any_of(F.col("_sw"), P.TYPOS.split()), 22, "known OCR typo pattern"),
        (s.contains("-") & s.rlike(P.LINE_BREAK), 16, "probable OCR line-break hyphen"),
        ((n >= 3) & (m <= 1), 24, "translation too short"),
        ((n <= 2) & (conf < 0.75), 12, "short uncertain OCR fragment"),
        ((english >= 2) & ~F.col("_safe_t"), 24, "obvious English residue in French translation"),
        (any_of(F.transform("_tw", F.lower), P.RESIDUE_FORMS) & ~F.col("_safe_t"), 28, "probable English residue in French translation"),
        ((copied > 0) & ~F.col("_safe_s"), F.when(copied == 1, 22).otherwise(30), "source residue copied into translation"),
        (s.rlike(P.ANY_DIGIT_MIX), 18, "OCR digit/symbol confusion"),
        (shout, 18, "uppercase residue in translation"),
        (s.rlike(P.ANY_RANDOM_CASE), 10, "random OCR casing"),
        (s.contains(":") & ~s.rlike(P.COLON_OK), 16, "suspect colon punctuation"),
        ((n >= 3) & s.rlike(P.WEAK_END), 16, "probable missing ellipsis or strong punctuation"),
        (~s.contains("?") & s.rlike(P.QUESTION_START), 18, "probable missing question mark"),
    ]
    hits = F.array(*(F.when(test, F.struct((F.lit(p) if isinstance(p, int) else p).alias("points"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))) for test, p, r in rules))
    x = once(x, _hits=F.filter(hits, lambda h: h.isNotNull())).drop("_st", "_tt", "_sw", "_tw", "_safe_s", "_safe_t", "_copied", "_warned")
    total = F.least(F.lit(100), F.aggregate("_hits", F.lit(0), lambda a, h: a + h["points"]))
    x = once(x, risk_score=total, risk_reasons=F.transform("_hits", lambda h: h["reason"])).drop("_hits")
    band = F.when(F.col("risk_score") >= 55, "review_high").when(F.col("risk_score") >= 25, "review_medium").otherwise("probably_ok")
    status = F.col("manual_status")
    return x.withColumn("suggested_action", F.when(status.isin("validated", "ignored"), status).otherwise(band))


def queue_risk() -> Column:
    """Risk of the review queue; not the light quality risk."""
    warned = F.size("quality_warnings")
    s, t = F.lower(squeezed_ends(source_normalized_first())), F.lower(squeezed_ends(final_translation()))
    status = F.col("manual_status")
    total = (
        F.least(F.lit(70), 15 * warned)
        + F.when(F.col("confidence") < 0.35, 25).otherwise(0)
        + F.when(t == "", 35).otherwise(0)
        + F.when((s != "") & (s == t), 35).otherwise(0)
        + F.when(status.isin("review", "unchecked"), 5).otherwise(0)
        - F.when(status.isin("validated", "ignored"), 20).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def band(score: Column, names: tuple[str, str, str] = ("HIGH", "MED", "OK")) -> Column:
    return F.when(score >= 55, names[0]).when(score >= 25, names[1]).otherwise(names[2])


def row_risk(cell: Column) -> Column:
    """A risk score read from a table cell: truncated, and 0 where it is no number."""
    return F.coalesce(cell.try_cast("double").try_cast("int"), F.lit(0))
