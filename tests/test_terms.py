"""Terms hidden and put back, against a plain loop over the terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkloom.operators import terms as T
from inkloom.plans import queries


def loop(text, terms):
    """The longest term first, each replaced in what is left of the text; placeholders are kept out of further searches."""
    parts = [(text, False)]
    used = []
    for source, target, number in sorted(terms, key=lambda t: (-len(t[0]), t[2])):
        whole = all(re.fullmatch("[A-Za-z0-9]", c) for c in source if c.strip())
        pattern = re.compile(rf"(?<![A-Za-z0-9]){re.escape(source)}(?![A-Za-z0-9])" if whole else re.escape(source), re.IGNORECASE)
        out = []
        for i, (part, done) in enumerate(parts):
            if done:
                out.append((part, done))
                continue
            before, after = ("T" if i else ""), ("T" if i + 1 < len(parts) else "")  # a placeholder ends and begins with a letter
            padded, at = before + part + after, len(before)
            for m in pattern.finditer(padded, len(before), len(padded)):
                if m.end() > len(padded) - len(after):
                    break
                out += [(padded[at : m.start()], False), (f"MKTERM{number:03d}TOKEN", True)]
                at = m.end()
                used.append(number)
            out.append((padded[at : len(padded) - len(after)], False))
        parts = [p for p in out if p[0] or p[1]]
    return "".join(p for p, _ in parts), sorted(set(used))


LISTED = ["sea", "sea king", "the and", "a", "king of the sea", "C++", "++", "-", "l'été", "é", "日本", "本", "x  y", "12", "ſun", "aa", "aba", "king"]


def texts(seed, n):
    rng = random.Random(seed)
    bits = [*LISTED, "bathe android", "seas", "THE SEA KING", "Kings", "ÉTÉ", "x", "y", " ", "_", ".", "MKTERM", "aaa", "ababa", "c+++", "Sun", "日", "token"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_places_equal_the_loop():
    rng = random.Random(4)
    for _ in range(60):
        some = [(s, f"<{s}>", i) for i, s in enumerate(rng.sample(LISTED, rng.randint(1, len(LISTED))))]
        finder = T.Finder(T.in_order(some))
        for t in texts(rng.random(), 60):
            hidden, used = finder.hide(t)
            assert (hidden, sorted(n for _, _, n in used)) == loop(t, some), (t, some)
    assert T.Finder([]).hide("as it is") == ("as it is", [])


def test_a_term_with_a_blank_stays_out_of_words():
    assert T.Finder([("the and", "x", 0)]).hide("bathe android and the and, THE AND")[0] == "bathe android and MKTERM000TOKEN, MKTERM000TOKEN"


def test_case_folds_one_for_one():
    for c in map(chr, range(0x110000)):
        if not "\ud800" <= c <= "\udfff":
            assert len(T.fold(c)) == 1


@pytest.mark.parametrize("most_chars", [1 << 20, 0])  # a broadcast list, and terms joined on their rarest word
def test_protected_terms(spark, most_chars):
    some = texts(7, 300) + ["", "sea", "sea"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some)] + [(-1, None)], "id long, text string").withColumn("used", F.lit("clash")).withColumn("_id", F.lit(1))
    table = spark.createDataFrame([(s, f"<{s}$1\\>", i) for i, s in enumerate(LISTED)] + [("SEA", "mer", 90), (" ", "x", 91), (None, "y", 92), ("kept", None, 93)], "source string, target string, pos long")
    want = [("SEA" if s == "sea" else s, "mer" if s == "sea" else f"<{s}$1\\>", i) for i, s in enumerate(LISTED)] + [("kept", "kept", len(LISTED))]
    got = T.protect_terms(rows, table, most_chars=most_chars)
    back = got.withColumn("shown", T.restore_terms(F.lower("protected"), F.col("used"))).collect()
    assert len(back) == len(some) + 1
    for r in back:
        hidden, used = loop(r.text or "", want)
        assert r.protected == hidden and [u.number for u in sorted(r.used, key=lambda u: u.number)] == used
        named = {n: t for _, t, n in want}
        assert r.restored == re.sub(r"MKTERM(\d{3})TOKEN", lambda m: named.get(int(m[1]), m[0]), hidden)
        assert r.shown == re.sub(r"mkterm(\d{3})token", lambda m: named.get(int(m[1]), m[0]), hidden.lower())
    assert T.protect_terms(rows.limit(0), table, most_chars=most_chars).count() == 0
    none = T.protect_terms(rows, table.limit(0), most_chars=most_chars)
    assert none.where("protected <> coalesce(text, '') or size(used) > 0").count() == 0 and none.count() == len(some) + 1


def test_protected_terms_query(spark, sf):
    listed = sorted(tuple(r) for r in queries.benchmark_terms(spark, sf).select("source", "target").collect())
    some = [(s, t, i) for i, (s, t) in enumerate(listed)]
    texts = {(r.conv_id, r.turn): r.text for r in queries.table(spark, sf, "conversations").collect()}
    got = queries.protected_terms(spark, sf).collect()
    finder = T.Finder(T.in_order(some))
    assert len(got) == len(texts) and len(some) > 500 and sum(r.n_terms > 0 for r in got) > 20
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn))[::9]:
        assert (r.protected, r.n_terms) == (lambda h, u: (h, len(u)))(*loop(texts[r.conv_id, r.turn] or "", some)) == (lambda h, u: (h, len(u)))(*finder.hide(texts[r.conv_id, r.turn] or ""))
