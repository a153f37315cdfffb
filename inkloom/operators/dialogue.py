"""From recognised dialogue to text ready for translation: softened capitals, corrected and plain wording, ready translations.

Rules of misreadings and wording are in ``inkloom.rules``; a corpus's own rules,
(pattern, replacement) in order, run behind them. Override tables (key, value)
are data of a corpus, read with ``sources.tables``. Which table decides first is
fixed: words that stay as they are, drawn-out interjections,
overrides, and the translation memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import reading
from inkloom.functions.cascade import Rules
from inkloom.functions.checks import JAPANESE
from inkloom.functions.text import CAPITALS, OTHERS, QUOTES, let, memory_key, squeeze, squeezed_ends
from inkloom.operators.normalise import own, rewrite

# Interjections that are translated by their shape, tried in this order, on the text or on its key.
SHAPES = [
    ("text", r"(?i)^hi[-\s]?ya+a+-?!?$", None),
    ("text", r"(?i)^who+a+l?[!?]?$", "Whoa !"),
    ("key", r"^aw{2,}! ?$", "Aww..."),
    ("key", r"^o+h!?$", "Oh..."),
]
# End of the fixed values.
#: How every text of these shapes begins, blanks and quotes left out.
SHAPED = rf"(?iU)^[\s{QUOTES}]*+(?:hi[-\s]*+y|who|aww|o++h)"


def compact(c: Column) -> Column:
    """Blanks collapsed, quotes at the ends and blanks before marks removed."""
    return F.regexp_replace(squeeze(F.btrim(squeezed_ends(c), F.lit(QUOTES))), r"\s+([,.;:!?])", "$1")


def soften_capitals(c: Column) -> Column:
    """Lower case, but for the word I, where three quarters of four Latin letters or more are capitals and none is Japanese."""

    def soft(t: Column) -> Column:
        count = lambda some: F.length(t) - F.length(F.regexp_replace(t, f"[{some}]+", ""))  # noqa: E731  no list of matches
        letters, loud = count(CAPITALS + OTHERS), count(CAPITALS)
        low = F.regexp_replace(F.lower(t), r"(?<![\p{L}\p{N}_])i(?![\p{L}\p{N}_])", "I")
        return F.when((loud >= 3) & (letters >= 4) & (loud / letters >= 0.75) & ~t.rlike(JAPANESE), low).otherwise(t)

    return let(compact(c), soft)


def with_override(rows: DataFrame, text: Column, *, kept: DataFrame | None = None, overrides: DataFrame | None = None, memory: DataFrame | None = None, out: str = "override") -> DataFrame:
    """Add ``out``: the ready translation of a text, or empty.

    ``kept``, ``overrides`` and ``memory`` (key, value) are joined on the
    memory key; one row a key (the greatest value, if a key repeats).
    """
    x, values = rows, []
    if any(t is not None for t in (kept, overrides, memory)):
        x = x.withColumn("__key", memory_key(text))
    for i, t in enumerate((kept, overrides, memory)):
        if t is not None:
            t = t.where("key <> ''").groupBy(F.col("key").alias("__key")).agg(F.max("value").alias(f"__v{i}"))
            x = x.join(t, "__key", "left")
        values.append(F.nullif(F.col(f"__v{i}"), F.lit("")) if t is not None else F.lit(None).cast("string"))

    def shaped(at: Column) -> Column:
        out = F.lit(None).cast("string")
        for on, pattern, value in reversed(SHAPES):
            out = F.when(at[on].rlike(pattern), at[on] if value is None else F.lit(value)).otherwise(out)
        return out

    # texts that begin otherwise are neither compacted nor made keys
    shapes = F.when(text.rlike(SHAPED), let(F.struct(compact(text).alias("text"), memory_key(text).alias("key")), shaped))
    return x.withColumn(out, F.coalesce(values[0], shapes, values[1], values[2], F.lit(""))).select(*(c for c in rows.columns if c != out), out)


def prepare(
    rows: DataFrame, *, text_col: str = "ocr_text", word_rules: Rules = (), context_rules: Rules = (), colloquial_rules: Rules = (), plain: bool = True,
    corrections: DataFrame | None = None, kept: DataFrame | None = None, overrides: DataFrame | None = None, memory: DataFrame | None = None,
) -> DataFrame:
    """Add corrected, normalized and override.

    Learned ``corrections`` replace whole texts first; then capitals are
    softened, misreadings corrected, and, if ``plain``, colloquial forms made
    plain. The override is looked up by the normalised text.
    """
    from inkloom.functions.text import ignore_key

    x = rows.withColumn("_raw", F.coalesce(F.col(text_col), F.lit("")))
    if corrections is not None:
        learned = corrections.where("key <> ''").groupBy(F.col("key").alias("_k")).agg(F.max("value").alias("_learned"))
        x = x.withColumn("_k", ignore_key(F.col("_raw"))).join(learned, "_k", "left").withColumn("_raw", F.coalesce(F.nullif(F.col("_learned"), F.lit("")), F.col("_raw"))).drop("_k", "_learned")
    x = x.withColumn("_raw", soften_capitals(F.col("_raw")))

    def correct():
        words, contexts = own(word_rules), own(context_rules)
        return lambda t: reading.corrected(t, words, contexts)

    def make_plain():
        more = own(colloquial_rules)
        return lambda t: reading.plain(t, more)

    x = rewrite(x, "_raw", "corrected", correct)
    x = rewrite(x, "corrected", "normalized", make_plain) if plain else x.withColumn("normalized", F.col("corrected"))
    return with_override(x, F.col("normalized"), kept=kept, overrides=overrides, memory=memory).drop("_raw")


def prepare_blocks(blocks: DataFrame, **tables) -> DataFrame:
    """English blocks with a text get corrected and normalised sources, and a translation where one is ready."""
    x = prepare(blocks, **tables)
    on = (F.col("source_lang") == "en") & F.col("ocr_text").rlike(r"(?U)\S")
    ready = on & (F.col("override") != "")
    new = {
        "ocr_corrected_text": F.when(on, F.col("corrected")), "normalized_source_text": F.when(on, F.col("normalized")),
        "raw_translation_fr": F.when(ready, F.col("override")), "translation_fr": F.when(ready, F.col("override")),
    }
    return x.select(*(F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in blocks.columns))
