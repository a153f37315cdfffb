"""Ordered rewriting of recognised text, and the choice among several readings of a block.

What a text becomes is said in ``functions.reading``; here texts run through
it in Arrow batches, as hundreds of nested column expressions
can't be planned. Rules of a corpus's own are (pattern, replacement) pairs,
which run behind those of the package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions import reading
from inkloom.functions.cascade import Rules, cascade
from inkloom.functions.detect import zone_categories, zones
from inkloom.functions.patterns import either
from inkloom.functions.text import any_of, let, once, squeeze
from inkloom.sources.views import settled

# Misread tokens, and words that a good reading has.
BAD_TOKENS = """inhook lnhook lhook toid to1d lookv loooky l00k l0ok repect respecl enolgh folr fopm colld hlnger individlals napehouse nestern tslrlmi
    houps ramn rarn setupi morningb howdid tholsand entipe etire sevenn""".split()
RAW_BAD = "houps b0dy tholsand entipe etire sevenn"
COMMON = """a all am an and are as at be but by can come coming country did director do doing due encounter expected eye for from get go going good
    grandma have he her here him his i i'd i'll i'm i've ignore in is it just like look looking looky me miwa more my nar naru nee never no not now
    of okay on one or please picturesque respect risky someone stuff that the there this to told unhook up was what where who with ya you orphanage
    food shelter steal brave enough tiger four days agency individuals abilities skills earn keep master animal form staff backup sake bomb
    explosion button press company dorm posthaste lad ideals mafia battle fault cry body hours hour few first place seven star academy student
    challenge dared thousand hundred hunting recognized player town guess happen revealed late""".split()
ZONE_READINGS = "OCR zone fallback: alternatives crop elargi disponibles"
READING_WORD = "[A-Za-zÀ-ÖØ-öø-ÿぁ-んァ-ン一-龯々ー']+"
# End of the fixed values.


def rewrite(rows: DataFrame, text_col: str, out: str, make: Callable[[], Callable[[str], str]], learned: DataFrame | None = None) -> DataFrame:
    """Add ``out``: what the function that ``make`` gives (once a task) makes of the text; a task makes a recent text once.

    ``learned`` (key, value) replaces whole texts first; of a key's values the
    greatest counts. Null texts read as empty. Only the texts go to Python, in
    the rows' own tasks: the rows are neither found a second time nor shuffled.
    """
    from inkloom.functions.text import ignore_key

    x = rows.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    if learned is not None:
        m = learned.where("key <> ''").groupBy(F.col("key").alias("_k")).agg(F.max("value").alias("_m"))
        x = x.withColumn("_k", ignore_key(F.col("_t"))).join(m, "_k", "left").withColumn("_t", F.coalesce(F.nullif(F.col("_m"), F.lit("")), F.col("_t"))).drop("_k", "_m")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = lru_cache(maxsize=4_096)(make())
        for texts in batches:
            yield texts.map(one)

    # told to be without fixed results, so that no plan makes a text twice
    return x.withColumn(out, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER).asNondeterministic()(F.col("_t"))).drop("_t")


def own(rules: Rules):
    """A cascade of a corpus's own rules, or none."""
    return cascade(tuple(map(tuple, rules))) if rules else None


def apply_rules(rows: DataFrame, rules: DataFrame, *, text_col: str = "ocr_text", out: str = "rewritten", part: int = 20_000) -> DataFrame:
    """Add ``out``: the text after all ``rules`` (ord, pattern, replacement) in order, however many.

    ``part`` rules at a time come to the driver and run over the texts; the next
    part runs over what they gave. Equal ``ord`` are taken by pattern. Null and
    empty texts are empty before the first rule.
    """
    from inkloom.sources.tables import ranked

    listed = ranked(rules.select("ord", "pattern", "replacement"), ["ord", "pattern", "replacement"], "_at")
    x, at = rows.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))), 0
    while some := listed.where((F.col("_at") >= at) & (F.col("_at") < at + part)).orderBy("_at").collect():
        now = tuple((r.pattern, r.replacement) for r in some)
        x = rewrite(x, "_text", "_text", lambda now=now: cascade(now))
        at += part
    return x.withColumn(out, F.col("_text")).drop("_text")


def normalise(rows: DataFrame, *, text_col: str = "ocr_text", out: str = "normalised", word_rules: Rules = (), context_rules: Rules = (), colloquial: bool = False, memory: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the text after learned corrections, spacing, casing, edge sounds, misread words and phrases; with ``colloquial``, in plain wording.

    ``memory`` (key, value) replaces whole texts first. Null and empty texts give an empty one.
    """

    def make() -> Callable[[str], str]:
        words, contexts = own(word_rules), own(context_rules)
        one = lambda t: reading.readable(t, words, contexts)
        return (lambda t: reading.plain(one(t))) if colloquial else one

    return rewrite(rows, text_col, out, make, memory)


def reading_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(READING_WORD), F.lit(0))


def lowered(words: Column) -> Column:
    return F.transform(words, lambda w: F.btrim(F.lower(w), F.lit("'")))


def suspect(bad: Sequence[str] = tuple(BAD_TOKENS), least: float = 0.72) -> Column:
    """A reading worth a second look, unless its block is validated or ignored: an empty text, warnings, a zone problem, low confidence, misread tokens, or a short text with a semicolon."""
    t = squeeze(F.col("ocr_text"))

    def tests(t: Column) -> Column:
        z = zones(t)
        words = reading_words(t)
        listed = any_of(F.array_distinct(lowered(words)), list(bad)) if bad else F.lit(False)
        unsure = F.coalesce(F.col("confidence") < max(0.72, least), F.lit(False))
        return (t == "") | (F.size("quality_warnings") > 0) | unsure | listed | (t.contains(";") & (F.size(words) <= 4)) | let(z, lambda z: z["incomplete"] | z["fused"])

    return ~F.col("manual_status").isin("validated", "ignored") & let(t, tests)


def odd_case(text: Column) -> Column:
    """Words of three letters or more in mixed case make up a good part of the text, or meet two words in capitals."""

    def share(words: Column) -> Column:
        letters = lambda w: F.regexp_replace(w, r"[^\p{L}]", "")
        odd = F.filter(words, lambda w: (F.length(letters(w)) >= 3) & (F.upper(letters(w)) != letters(w)) & (F.lower(letters(w)) != letters(w)) & (letters(w) != F.concat(F.substring(F.upper(letters(w)), 1, 1), F.substring(F.lower(letters(w)), 2, 1 << 20))))
        loud = F.filter(words, lambda w: (F.length(w) >= 3) & (F.upper(w) == w))
        return (F.size(odd) >= 1) & ((F.size(odd) / F.greatest(F.lit(1), F.size(words)) >= 0.15) | (F.size(loud) >= 2))

    return let(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'’.-]*"), F.lit(0)), share)


def reading_score(text: Column, confidence: Column, clean: Column | None = None, *, known: Sequence[str] = tuple(COMMON), bad: Sequence[str] = tuple(BAD_TOKENS), bonus: Column | float = 0.0) -> Column:
    """Quality of a reading: letters, words, confidence and known words, less bad words, odd marks and odd case.

    ``clean`` is the normalised text, which the counts are made on; marks and
    case are judged on the text as it was read.
    """
    clean = squeeze(text) if clean is None else clean

    def score(c: Column, words: Column, low: Column) -> Column:
        n = lambda listed: F.size(F.array_intersect(low, F.array(*map(F.lit, listed)))) if listed else F.lit(0)
        size = F.size(words)
        letters = F.regexp_count(c, F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿぁ-んァ-ン一-龯々]"))
        weird = F.regexp_count(c, F.lit(r"[|_{}\[\]<>]"))
        total = (
            F.least(letters, F.lit(120)) * 0.065 + size * 0.58 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))) * 2
            + F.when((F.upper(c) == c) & (size >= 2), 0.18).otherwise(0.0) + F.when(size >= 3, 0.55).otherwise(0.0) + F.least(F.lit(2.2), n(known) * 0.22) + bonus
            - n(bad) * 3.0 - F.regexp_count(text, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{either(RAW_BAD)})(?![\p{{L}}\p{{N}}_])")) * 1.4 - F.regexp_count(text, F.lit(";")) * 0.7 - odd_case(text).cast("int") * 1.15 - weird * 0.65
            - F.when((size == 1) & c.endswith(":"), 1.25).otherwise(0.0)
        )
        return F.when(c == "", -999.0).when(letters == 0, -80.0).otherwise(total)

    return let(clean, lambda c: let(reading_words(c), lambda words: let(F.array_distinct(lowered(words)), lambda low: score(c, words, low))))


def penalty(current: Column, other: Column) -> Column:
    """What a reading loses against the current one: many more words, almost twice as many, a sound or another bubble mixed in."""

    def lost(n: Column, m: Column) -> Column:
        over = m - n - F.greatest(F.lit(3), F.floor(n * 0.45))
        new = F.array_except(zone_categories(other), zone_categories(current))
        has = lambda c, p: F.when(F.array_contains(new, c), p).otherwise(0.0)
        total = F.when(over > 0, F.least(F.lit(8.0), over * 0.85)).otherwise(0.0) + F.when(m / n > 1.75, 2.2).otherwise(0.0) + has("sfx_mixed", 2.8) + has("fused_bubble", 1.8)
        return F.when(m == 0, 0.0).otherwise(total)

    return let(F.greatest(F.lit(1), F.size(reading_words(current))), lambda n: let(F.size(reading_words(other)), lambda m: lost(n, m)))


def is_safe(current: Column, other: Column, corrected: Column | None = None) -> Column:
    """Whether a normalised reading may replace the current one without a human.

    The words of the current text, three quarters of them at least, follow each
    other in the new one with nothing before or between, and few words come
    after; no single letters, bare numbers or brackets are brought in. A reading
    that is a local correction (``corrected``) may only keep its length.
    """

    def tests(now: Column, new: Column) -> Column:
        # matched so far, words before the first match, words between matches
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("before"), F.lit(0).alias("between"))

        def walk(s: Column, w: Column) -> Column:
            hit = (s["at"] < F.size(now)) & F.coalesce(w == F.get(now, s["at"]), F.lit(False))
            early = ~hit & (s["at"] == 0)
            inner = ~hit & (s["at"] > 0) & (s["at"] < F.size(now))
            return F.struct((s["at"] + hit.cast("int")).alias("at"), (s["before"] + early.cast("int")).alias("before"), (s["between"] + inner.cast("int")).alias("between"))

        found = F.aggregate(new, start, walk)
        n, m = F.size(now), F.size(new)
        single = F.exists(F.array_except(new, now), lambda w: (F.length(w) == 1) & ~w.isin("a", "i"))
        follows = let(found, lambda s: (s["at"] >= F.greatest(F.lit(1), F.floor(n * 0.75))) & (s["before"] == 0) & (s["between"] == 0))
        free = follows & (m - n <= F.greatest(F.lit(3), F.floor(n * 0.45))) & ~single & ~other.rlike(r"(?:^|\s)(?:[0-9]+|[(){}\[\]<>_|\\]+)(?:\s|$)")
        local = F.abs(m - n) <= 1
        return (n > 0) & (m > 0) & (free if corrected is None else F.when(corrected, local).otherwise(free))

    return (current != "") & (other != "") & (current != other) & let(lowered(reading_words(current)), lambda now: let(lowered(reading_words(other)), lambda new: tests(now, new)))


def ranked_readings(todo: DataFrame, candidates: DataFrame, **rules) -> DataFrame:
    """Readings of the blocks ``todo`` with their ``_place`` by score less penalties: the candidates and the current text.

    Candidates that differ in case or blanks only are one (the best). Further
    columns: engine, text, confidence, _score, _safe, and of the current text _now, _s0.
    """
    # the current texts are normalised and scored once and written: every use below reads what was found
    now = normalise(todo.select("block_id", F.col("ocr_text").alias("_now"), F.col("confidence").alias("_conf")), text_col="_now", out="_now_clean", **rules)
    now = settled(once(now, _s0=reading_score(F.col("_now"), F.col("_conf"), F.col("_now_clean"))), "readings")
    own = now.select("block_id", F.lit("current").alias("engine"), F.col("_now").alias("text"), F.col("_conf").alias("confidence"), F.lit(-1).alias("ord"), F.col("_now_clean").alias("_clean"), F.col("_s0").alias("_score"))
    c = candidates.select("block_id", F.col("engine") if "engine" in candidates.columns else F.lit("").alias("engine"), "text", "confidence", F.col("ord").cast("int").alias("ord"), F.col("bonus").cast("double").alias("bonus") if "bonus" in candidates.columns else F.lit(0.0).alias("bonus"))
    c = normalise(c.join(now.select("block_id"), "block_id", "left_semi"), text_col="text", out="_clean", **rules)
    x = once(c, _score=reading_score(F.col("text"), F.col("confidence"), F.col("_clean"), bonus=F.col("bonus"))).drop("bonus").unionByName(own)
    same = W.partitionBy("block_id", F.lower(squeeze(F.col("text")))).orderBy(F.desc("_score"), "ord")
    x = x.where(squeeze(F.col("text")) != "").withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_rn")
    x = x.join(now, "block_id")
    x = once(x, _score=F.col("_score") - penalty(F.col("_now"), F.col("text")), _safe=is_safe(F.col("_now_clean"), F.col("_clean"), F.col("engine") == "ocr-corrections"))
    return x.withColumn("_place", F.row_number().over(W.partitionBy("block_id").orderBy(F.desc("_score"), "ord")))


def _alternatives(keep: int) -> Column:
    """The first ``keep`` readings of a block, in order."""
    item = F.struct(F.col("_place").alias("place"), F.struct("engine", "text", "confidence", F.col("_score").alias("score"), F.lit("").alias("note")).alias("item"))
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= keep, item))), lambda s: s["item"]).alias("_alternatives")


def zone_alternatives(blocks: DataFrame, candidates: DataFrame, lang: str, *, apply_best: bool = False, keep: int = 8, **rules) -> DataFrame:
    """Further readings for blocks under review whose zone is in doubt; add ``updated``.

    Such a block gets its ``keep`` best readings as alternatives (none: an empty
    list) and a warning; with ``apply_best`` it is improved instead, as ``improve``
    does. Blocks of other languages, other states or with sound zones stay.
    """
    from inkloom.operators.blocks import with_warning, zone_fallback_candidate

    chosen = (F.col("source_lang") == lang) & (F.col("manual_status") == "review") & zone_fallback_candidate()
    x = once(blocks, _zone=F.coalesce(chosen, F.lit(False)))
    todo, rest = x.where("_zone").drop("_zone"), x.where("not _zone").drop("_zone").withColumn("updated", F.lit(False))
    if apply_best:
        done = improve(todo, candidates, only_suspect=False, keep=keep, **rules)
        done = done.withColumn("updated", F.col("improved") | (F.size("ocr_alternatives") > 0)).drop("improved")
    else:
        kind = blocks.schema["ocr_alternatives"].dataType
        best = settled(ranked_readings(todo, candidates, **rules).groupBy("block_id").agg(_alternatives(keep)), "best")
        found = F.coalesce(F.col("_alternatives").cast(kind), F.array().cast(kind))
        done = todo.join(best, "block_id", "left").select(*(
            found.alias(c) if c == "ocr_alternatives" else with_warning(F.lit(ZONE_READINGS)).alias(c) if c == "quality_warnings" else F.col(c) for c in blocks.columns
        ), F.lit(True).alias("updated"))
    return done.unionByName(rest)


def improve(blocks: DataFrame, candidates: DataFrame, *, only_suspect: bool = True, gain: float = 0.45, keep: int = 8, **rules) -> DataFrame:
    """Replace the raw texts of suspect blocks by their best safe candidate that gains ``gain``; add ``improved``.

    ``candidates``: block_id, engine, text, confidence, ord, and optionally a
    ``bonus``; the engine ``ocr-corrections`` marks local corrections. The
    current text competes too. Candidates that differ in case or blanks only are
    one (the best); penalties follow; the first ``keep`` become the block's
    alternatives. What was made from a replaced text is cleared.
    """
    todo = blocks.where(suspect()) if only_suspect else blocks.where(~F.col("manual_status").isin("validated", "ignored"))
    ranked = ranked_readings(todo, candidates, **rules)
    first = F.min(F.when(F.col("_safe"), F.struct("_place", "text", "engine", "confidence", "_score", "_s0", "_now"))).alias("_best")
    best = settled(ranked.groupBy("block_id").agg(first, _alternatives(keep)), "best")  # few, as a rule: then the blocks aren't shuffled
    y = blocks.join(best, "block_id", "left")
    b = F.col("_best")
    hit = F.coalesce((b["text"] != b["_now"]) & (b["_score"] >= b["_s0"] + gain), F.lit(False))
    y = y.withColumn("improved", hit)
    note = F.concat(F.lit("OCR fallback: "), b["engine"], F.lit(" a remplacé '"), b["_now"], F.lit("' par '"), b["text"], F.lit("'"))
    new = {
        "ocr_text": b["text"], "confidence": b["confidence"], **{n: F.lit("") for n in ("ocr_corrected_text", "normalized_source_text", "raw_translation_fr", "translation_fr")},
        "manual_status": F.when(F.col("manual_status") == "unchecked", "edited").otherwise(F.col("manual_status")), "quality_warnings": F.array_distinct(F.array_append("quality_warnings", note)),
    }
    kind = blocks.schema["ocr_alternatives"].dataType
    return y.select(*(
        F.when(F.col("improved"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.coalesce(F.col("_alternatives").cast(kind), F.col(c)).alias(c) if c == "ocr_alternatives" else F.col(c)
        for c in blocks.columns
    ), "improved")
