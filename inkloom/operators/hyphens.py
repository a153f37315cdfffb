"""Words cut by a hyphen at a line's end, judged by the corpus they come from.

A cut (``circum- stances``) may be a word torn apart, a compound whose hyphen
belongs (``well- known``), or a word broken off before the next one. Fixed tables
know some words; the corpus knows the rest: in how many texts the joined word
occurs, the compound, and both parts as words of their own.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.reading import CUT_OFF
from inkloom.functions.text import once

LETTER = r"[A-Za-z]"
#: Cuts are looked for at every word, also at the second half of a cut before it.
CUTS = rf"(?<![A-Za-z]){LETTER}{{2,}}(?=-\s+({LETTER}{{2,}})(?![A-Za-z]))"


def cuts_of(text: Column) -> Column:
    """The lower-cased (left, right) of every cut in a text."""

    def cuts(t: Column) -> Column:
        left = F.regexp_extract_all(t, F.lit(CUTS), F.lit(0))
        right = F.regexp_extract_all(t, F.lit(CUTS), F.lit(1))
        return F.arrays_zip(left.alias("left"), right.alias("right"))

    # most texts hold no cut: a short search tells
    return F.when(F.lower(text).rlike(r"[a-z]-\s+[a-z]"), cuts(F.lower(text)))


def hyphen_lexicon(rows: DataFrame, text_col: str = "ocr_text") -> DataFrame:
    """left, right, n, joined_docs, compound_docs, parts_docs, decision for every pair of halves that some text cuts.

    n counts the cuts; the others are texts (repeated texts count once each)
    that hold the joined word, the hyphened compound, and, of the rarer half, the
    half as a word outside cuts. ``decision``: apart where the second half is an
    answer to a word broken off; compound where the compound is in more texts
    than the joined word; apart where both halves occur as words and neither the
    joined word nor the compound does; else join. Null texts hold no cut.
    """
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    pairs = rows.select(F.explode(cuts_of(t)).alias("c")).groupBy(F.col("c.left").alias("left"), F.col("c.right").alias("right")).agg(F.count("*").alias("n"))
    # cuts are taken out before words are counted, so that their halves aren't words
    rest = F.when(t.rlike(r"[a-z]-\s+[a-z]"), F.regexp_replace(t, rf"(?<![A-Za-z]){LETTER}{{2,}}(?:-\s+{LETTER}{{2,}})+(?![A-Za-z])", " ")).otherwise(t)
    found = F.array_distinct(F.regexp_extract_all(rest, F.lit(rf"{LETTER}+(?:-{LETTER}+)*"), F.lit(0)))
    compounds = F.filter("w", lambda w: w.contains("-"))
    words = F.when(F.size(compounds) > 0, F.array_distinct(F.concat("w", F.flatten(F.transform(compounds, lambda w: F.split(w, "-")))))).otherwise(F.col("w"))
    # counted before they are joined: what travels is a word once a task, not once a text
    docs = once(rows, w=found).select(F.explode(words).alias("form")).groupBy("form").agg(F.count("*").alias("docs"))
    form = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("form"))
    forms = pairs.select("left", "right", "n", F.inline(F.array(form("joined", F.concat("left", "right")), form("compound", F.concat_ws("-", "left", "right")), form("left", F.col("left")), form("right", F.col("right")))))
    n_docs = lambda kind: F.max(F.when(F.col("kind") == kind, F.coalesce("docs", F.lit(0))))
    p = forms.join(docs, "form", "left").groupBy("left", "right").agg(F.first("n").alias("n"), n_docs("joined").alias("joined_docs"), n_docs("compound").alias("compound_docs"), F.least(n_docs("left"), n_docs("right")).alias("parts_docs"))
    joined, compound = F.col("joined_docs"), F.col("compound_docs")
    decision = (
        F.when(F.col("right").isin(CUT_OFF), "apart").when(compound > joined, "compound").when((joined == 0) & (compound == 0) & (F.col("parts_docs") > 0), "apart").otherwise("join")
    )
    return p.select("left", "right", "n", "joined_docs", "compound_docs", "parts_docs", decision.alias("decision"))


def mend(text: str, decisions: dict[tuple[str, str], str]) -> str:
    """Each cut as decided; a cut without a decision stays."""
    out, at = [], 0
    for m in re.finditer(CUTS, text):
        end = m.start(1)  # where the second half begins
        found = decisions.get((m[0].lower(), m[1].lower()))
        gap = {"join": "", "compound": "-"}.get(found)
        if gap is not None:
            out += [text[at : m.end()], gap]
            at = end
    return "".join([*out, text[at:]])


def mend_hyphens(rows: DataFrame, lexicon: DataFrame, text_col: str = "ocr_text", out: str = "mended") -> DataFrame:
    """Add ``out``: the text with its cuts joined, hyphened or left as the ``lexicon`` decides.

    The lexicon stays a table: a text meets the decisions on its own cuts alone,
    by its digest, so that texts travel once. Only texts with such decisions go
    to Python. Null texts are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = once(rows.select(text.alias("_t")), _cuts=F.array_distinct(cuts_of(F.col("_t")))).where("size(_cuts) > 0")
    cuts = once(own, _id=F.sha2("_t", 256)).select("_id", F.explode("_cuts").alias("c")).select("_id", "c.left", "c.right").distinct()
    found = cuts.join(lexicon.select("left", "right", "decision"), ["left", "right"]).groupBy("_id").agg(F.collect_list(F.struct("left", "right", "decision")).alias("_d"))  # the cuts of one text

    def run(texts: pd.Series, decisions: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else mend(t, {(r["left"], r["right"]): r["decision"] for r in d}) for t, d in zip(texts, decisions)], dtype=object)

    mended = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)
    x = rows.withColumn("_id", F.sha2(text, 256)).join(found, "_id", "left")
    x = x.withColumn("_m", mended(F.when(F.col("_d").isNotNull(), text), F.col("_d")))
    return x.withColumn(out, F.coalesce("_m", text)).drop("_id", "_d", "_m")
