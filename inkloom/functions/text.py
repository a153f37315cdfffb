"""Canonical keys, effective texts, labels and tokens, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space besides the blank, and some signs that are none.
OTHER_BLANKS = r"[\t\n\x0B\f\r\x85\xA0\u1680-\u3000]"
#: Latin letters: capitals and others. Java looks up listed letters in a table, and compares with each range.
ACCENTED = ["".join(map(chr, r)) for r in ([*range(192, 215), *range(216, 223)], [223, *range(224, 247), *range(248, 256)])]
CAPITALS, OTHERS = ascii_uppercase + ACCENTED[0], ascii_lowercase + ACCENTED[1]
QUOTES = "\"'`´‘’“” "


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once a row, however often they are used after; a column of such a name is replaced.

    A generator over one struct stands between: the optimizer neither copies
    an expression into its uses nor pushes a filter on it below.
    """
    new = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select(*(c for c in rows.columns if c not in columns), new)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(c: Column) -> Column:
    """Distinct runs of letters, digits and underscores, and an empty one at an edge."""
    return F.array_distinct(F.split(c, r"[^\p{L}\p{N}_]+"))


def any_of(words: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, listed)))


def squeeze(c: Column) -> Column:
    """White space, as Unicode defines it, collapsed and trimmed; texts without other white space than single blanks aren't searched."""
    return F.btrim(let(c, lambda t: F.when(~t.contains("  ") & ~t.rlike(OTHER_BLANKS), t).otherwise(F.regexp_replace(t, r"(?U)\s+", " "))))


def full(c: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(c, F.lit(""))


def source_normalized_first() -> Column:
    """Normalised, corrected or raw text: the first that isn't empty, then trimmed."""
    return squeezed_ends(F.coalesce(full(F.col("normalized_source_text")), full(F.col("ocr_corrected_text")), F.col("ocr_text"), F.lit("")))


def source_corrected_first() -> Column:
    """Corrected, normalised or raw text: the first that isn't blank."""
    t = lambda n: squeezed_ends(F.col(n))
    return F.coalesce(full(t("ocr_corrected_text")), full(t("normalized_source_text")), t("ocr_text"), F.lit(""))


def source_clean_normalized_first() -> Column:
    t = lambda n: squeeze(F.col(n))
    return F.coalesce(full(t("normalized_source_text")), full(t("ocr_corrected_text")), t("ocr_text"), F.lit(""))


def final_translation() -> Column:
    return F.coalesce(full(F.col("translation_fr")), F.col("raw_translation_fr"), F.lit(""))


def squeezed_ends(c: Column) -> Column:
    """White space at the ends taken off; texts that begin and end with something else aren't searched."""
    edges = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(~edges.rlike(r"(?U)\s"), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def words_up_to(c: Column, most: int) -> Column:
    """The number of words of ASCII letters and apostrophes, or ``most``, if there are more; no further ones are made."""
    return F.size(tokens(F.regexp_extract(c, spelled(rf"(?:[^A-Za-z']*+[A-Za-z']++){{1,{most}}}"), 0), "[A-Za-z']+"))


def ignore_key(c: Column) -> Column:
    """Key of the ignore and correction memories."""
    x = F.lower(squeeze(F.replace(c, F.lit("’"), F.lit("'"))))
    return squeeze(F.regexp_replace(F.btrim(x, F.lit(QUOTES)), r"\s+([,.;:!?])", "$1"))


def memory_key(c: Column) -> Column:
    """Key of the translation memory: the ignore key without a weak tail."""
    x = F.regexp_replace(ignore_key(c), r"[:.]+$", "")
    return F.regexp_replace(F.regexp_replace(x, r"!+$", "!"), r"\?+$", "?")


def replay_key(c: Column) -> Column:
    x = F.lower(squeeze(F.replace(c, F.lit("’"), F.lit("'"))))
    x = F.regexp_replace(x, r"\s+([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(x, "[“”\"`´]", ""), r"\.{2,}", "...")


def identity_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def punctuation(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[a-z0-9\s]", "")


def slug(c: Column, size: int = 80) -> Column:
    """A file name's safe part: runs of other characters are one underscore."""
    x = F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(full(F.substring(x, 1, size)), F.lit("item"))


def path_hash(c: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))).cast("binary")), 1, 10)


def path_labels(path: Column) -> tuple[Column, Column]:
    """(series, volume) from ``.../pages/<series>/<volume>/...``; empty where there is none."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    at = F.array_position(parts, "pages").cast("int")
    pick = lambda k: F.when(at > 0, F.coalesce(F.get(parts, at + k), F.lit(""))).otherwise("")
    return pick(0), pick(1)


def natural_key(c: Column) -> Column:
    """An array that orders names with digit runs by value and text in any case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    pad = lambda r: F.concat(F.lit("0"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0"))
    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), pad(r)).otherwise(F.concat(F.lit("1"), r)))


def tokens(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(spelled(pattern)), F.lit(0)), F.array().cast("array<string>"))


def spelled(pattern: str) -> str:
    """The pattern with its Latin letters listed, in place of ranges."""
    return pattern.replace("A-Za-z", ascii_uppercase + ascii_lowercase).replace("À-ÖØ-öø-ÿ", "".join(ACCENTED))


def decision_key(c: Column) -> Column:
    return F.replace(F.lower(F.btrim(F.coalesce(c, F.lit("")))), F.lit("à"), F.lit("a"))
