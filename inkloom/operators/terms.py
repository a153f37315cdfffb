"""Terms that translation must leave alone: hidden behind placeholders before it, put back after it.

The result is that of a loop over the terms, the longest first (of equal
lengths the one listed first), each replaced wherever it still stands: case
doesn't count, a term of ASCII letters, digits and blanks doesn't match inside
a word, and what a placeholder covers is no longer searched.

No text runs through that loop. All places of all terms are found in one pass of
an automaton over the text, and only these places are settled, in the loop's
order; so time depends on the text and the places found, not on the number of
terms. The automaton is built once a worker from the broadcast term list. Longer
lists than ``most_chars`` stay a table: every term is joined on its rarest word
(or, where it may match inside words, its rarest run of up to three characters)
to the texts that hold it, and each text is settled with its own few terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkloom.functions.cascade import fold

MOST_CHARS = 1 << 24  # characters of all terms up to which the list is broadcast
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
MARK = r"(?i)MKTERM(\d{3,})TOKEN"

Term = tuple[str, str, int]  # source, target, number


def bounded(source: str) -> bool:
    """Letters, digits and blanks only: such a term matches whole words."""
    return all(c.isascii() and c.isalnum() for c in source if not c.isspace())


def in_order(terms: Iterable[Term]) -> list[Term]:
    return sorted(terms, key=lambda t: (-len(t[0]), t[2]))


class Finder:
    """All places of a list of terms (in the loop's order)."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.whole = [bounded(s) for s, _, _ in terms]
        self.automaton = ahocorasick.Automaton()
        for rank, (source, _, _) in enumerate(terms):
            if (key := fold(source)) not in self.automaton:
                self.automaton.add_word(key, rank)
        if terms:
            self.automaton.make_automaton()

    def places(self, folded: str) -> list[tuple[int, int, int]]:
        """(rank, start, end) of every place where a term may stand, in the loop's order."""
        out = []
        for last, rank in self.automaton.iter(folded) if self.terms else ():
            start, end = last + 1 - len(self.terms[rank][0]), last + 1
            if not (self.whole[rank] and (folded[start - 1 : start] in WORD or folded[end : end + 1] in WORD)):
                out.append((rank, start, end))
        return sorted(out)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rank) of the terms that the loop replaces, by start."""
        covered, out, before = bytearray(len(text) + 1), [], (-1, 0)
        for rank, start, end in self.places(fold(text)):
            if before[0] == rank and start < before[1]:
                continue  # overlaps this term's last place
            if covered.find(1, start, end) >= 0 or (self.whole[rank] and (covered[end] or (start and covered[start - 1]))):
                continue  # under a longer term, or right beside its placeholder
            covered[start:end] = b"\1" * (end - start)
            out.append((start, end, rank))
            before = (rank, end)
        return sorted(out)

    def hide(self, text: str) -> tuple[str, list[Term]]:
        """The text with placeholders, and the terms that it held, in the loop's order."""
        spans, parts, at = self.spans(text), [], 0
        for start, end, rank in spans:
            parts += [text[at:start], mark(self.terms[rank][2])]
            at = end
        used = [self.terms[r] for r in sorted({r for _, _, r in spans})]
        return "".join([*parts, text[at:]]), used


def mark(number: int) -> str:
    return f"MKTERM{number:03d}TOKEN"


def show(text: str, used: Iterable[Term]) -> str:
    """Placeholders of these terms, in any case, become their targets; others stay."""
    targets = {number: target for _, target, number in used}
    return re.sub(MARK, lambda m: targets.get(int(m[1]), m[0]), text)


@lru_cache(maxsize=4)
def _finder(terms: tuple[Term, ...]) -> Finder:
    return Finder(list(terms))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


@F.pandas_udf(ArrayType(StringType()))
def _needs(s: pd.Series) -> pd.Series:
    """What a text must hold for a term to match: the words of a bounded term, else its runs of three characters (fewer: the whole term)."""

    def one(source: str) -> list[str]:
        t = fold(source)
        if bounded(source):
            return sorted({"w" + w for w in t.split()})
        return sorted({"g" + t[i : i + 3] for i in range(max(1, len(t) - 2))})

    return s.map(one)


def _holds(lengths: list[int], words: bool):
    @F.pandas_udf(ArrayType(StringType()))
    def holds(s: pd.Series) -> pd.Series:
        def one(text: str) -> list[str]:
            t = fold(text)
            out = {"w" + w for w in re.findall(r"[a-z0-9]+", t)} if words else set()
            for n in lengths:
                out |= {"g" + t[i : i + n] for i in range(len(t) - n + 1)}
            return sorted(out)

        return s.map(one)

    return holds


def numbered_terms(terms: DataFrame) -> DataFrame:
    """source, target, number: one row for a source whatever its case; the last one's spelling counts, at the first one's place.

    Order: first_list and pos, if the table has them, else the order of its rows.
    Terms without a source are left out, a null target is the source.
    """
    from inkloom.sources.tables import ranked

    listed = [c for c in ("first_list", "pos") if c in terms.columns]
    x = terms.select(F.btrim("source").alias("source"), F.coalesce(F.btrim("target"), F.btrim("source")).alias("target"), *listed)
    x = x.where(F.coalesce(F.col("source"), F.lit("")) != "").withColumn("_row", F.monotonically_increasing_id())
    at = F.struct(*listed, "_row")
    x = x.groupBy(_casefold("source").alias("_key")).agg(F.min(at).alias("_at"), F.max_by(F.struct("source", "target"), at).alias("t"))
    return ranked(x.select("_at", "t.source", "t.target"), ["_at"], "number").drop("_at")


def protect_terms(rows: DataFrame, terms: DataFrame, text: str = "text", *, most_chars: int = MOST_CHARS) -> DataFrame:
    """Add ``protected`` (terms replaced by placeholders), ``used`` (source, target, number of the terms replaced) and ``restored`` (targets put in).

    Null texts read as empty and hold no term; without terms every text stays.
    Columns of these names are replaced; repeated rows stay.
    """
    t = numbered_terms(terms)
    x = rows.drop("protected", "used", "restored").withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    if (t.agg(F.sum(F.length("source") + F.length("target"))).first()[0] or 0) <= most_chars:
        listed = [(r.source, r.target, r.number) for r in t.collect()]  # at most ``most_chars`` characters
        sent = rows.sparkSession.sparkContext.broadcast(tuple(in_order(listed)))
        done = _settled(x.select("_text").distinct(), lambda p: [_finder(sent.value)] * len(p))
    else:
        done = _joined(x.select("_text").distinct(), t)
    return x.join(done, "_text").drop("_text")


RESULT = "_text string, protected string, used array<struct<source:string,target:string,number:long>>, restored string"


def _settled(texts: DataFrame, finders) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [f.hide(t) for f, t in zip(finders(p), p["_text"])]
            shown = [show(hidden, used) for hidden, used in got]
            used = [[{"source": s, "target": to, "number": n} for s, to, n in u] for _, u in got]
            yield pd.DataFrame({"_text": p["_text"], "protected": [h for h, _ in got], "used": used, "restored": shown})

    return texts.mapInPandas(run, RESULT)


def _joined(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Texts settled with the terms whose rarest need they hold."""
    needs = terms.select("source", "target", "number", F.explode(_needs("source")).alias("need"))
    kinds = needs.select("need").distinct().agg(F.collect_set(F.when(F.col("need").startswith("g"), F.length("need") - 1)).alias("n"), F.max(F.col("need").startswith("w")).alias("w")).first()
    holds = _holds(sorted(kinds["n"]), bool(kinds["w"]))
    held = texts.select(F.sha2("_text", 256).alias("_id"), F.explode(holds("_text")).alias("need"))
    often = held.join(needs.select("need").distinct(), "need", "left_semi").groupBy("need").agg(F.count("*").alias("n"))
    rarest = needs.join(often, "need", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.struct("need", "source", "target").alias("t"))).alias("m"))
    rarest = rarest.where("m.n > 0").select("number", "m.t.*")
    found = held.join(rarest, "need").groupBy("_id").agg(F.collect_list(F.struct("source", "target", "number")).alias("_terms"))  # terms of one text
    x = texts.withColumn("_id", F.sha2("_text", 256)).join(found, "_id", "left")
    return _settled(x, lambda p: [Finder(in_order((t["source"], t["target"], t["number"]) for t in (ts if ts is not None else ()))) for ts in p["_terms"]])


def restore_terms(text: Column, used: Column) -> Column:
    """A translation with its placeholders, in any case, replaced by the targets of ``used`` (of ``protect_terms``)."""
    plain = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    name = lambda n: F.concat(F.lit("(?i)MKTERM"), F.lpad(n.cast("string"), 3, "0"), F.lit("TOKEN"))
    long = lambda n: F.concat(F.lit("(?i)MKTERM"), n.cast("string"), F.lit("TOKEN"))
    return F.aggregate(used, text, lambda t, u: F.regexp_replace(t, F.when(u["number"] < 1000, name(u["number"])).otherwise(long(u["number"])), plain(u["target"])))
