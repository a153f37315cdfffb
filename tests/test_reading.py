"""Cascades against the plain loop; recognised and colloquial texts against what they become."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkloom.functions import cascade as C
from inkloom.functions import reading as R
from inkloom.operators import dialogue, normalise
from inkloom.plans import queries

TABLES = ["font", "words", "contexts", "ellipses", "breaks", "corrections", "pronouns", "phrases", "tokens"]
READABLE = [
    ("I NeVeR Expected I'D HAVE:", "I never expected I'd have."), ("Director; With All Due ReSpect. .", "Director, with all due respect."), ("CERTAIN CIRCUM- STANCES", "CERTAIN CIRCUMSTANCES"),
    ("YeS. He TRANS- FORMED INTO ANIMAL Fopm", "Yes. he transformed into animal form"), ("The Tiger TCO WAS sighted FOLR DAYS Ago.", "The Tiger TCO was sighted four days ago."), ("I've WAITED FOR TOO Loncw", "I've WAITED FOR TOO LONG!!!"),
    ("He 'return- ed the dam age?!", "He returned the damage?!"), ("Bal ancell", "Balance!!"), ("WHAATI? PEALLYI?", "what? really?"), ("Sepiously Dont do Something LNNECES- SARY", "seriously don't do Something unnecessary"),
    ("BMUSTHVB GALLENL ASLEEP inifront Computers", "I must've fallen asleep in front of my computer."), ("NO WAYI", "no way!"), ("BREASTSI!", "breasts!!"), ("AND I50, 000 FOR THE INTEL ON THEIR BASE:", "AND 150,000 FOR THE INTEL ON THEIR BASE."),
    ("WHISPER WE ALWAYS TAKE YOU OUT ON OUR QUESTS, RIGHT? WHISPER", "WE ALWAYS TAKE YOU OUT ON OUR QUESTS, RIGHT?"), ("IF ONE ENER IS About one HLNDRED YEN:, .", "IF ONE ENER IS About one hundred YEN..."), ("In PAR- Ticu- LAR:", "In particular."),
    ("HE'S A Big-time Ceo_", "HE'S A Big-time CEO"), ("AND:. =", "AND..."), ("~But I Agree With The Other PARTS.", "...But I Agree With The Other PARTS."), ("I MUST SHOW MS: ELIZABETH, MS: KAREN, AND MS: UNDINE.", "I MUST SHOW MS. ELIZABETH, MS. KAREN, AND MS. UNDINE."),
    ("WE'LL ACCEPT THIS QUEST,, ,", "WE'LL ACCEPT THIS QUEST..."), ("there'@ NO WAY Theo COULD Ve pulled It OFF!", "there's no way theo could've pulled it off!"), ("4NDER- STOOD.", "Understood."), ("well; yes; no", "well, yes, no"),
    (": why isn't Sigma-kun Waking Up.", "...why isn't Sigma-kun waking up...?"), ("SORRY I'm LATE-", "sorry I'm late..."), ("inter... rupted you", "interrupted you"), ("a; b; c; d; e; f; g; h; i", "a; b; c; d; e; f; g; h; i"), ("", ""), ("   ", ""),
]
PREPARED = [
    ("AIN'T AH TOID YA, NO CLIMBIN' NOWHERE DANGEROUS?", "ain't I told you, no climbin' nowhere dangerous?", "haven't I told you not to climb anywhere dangerous?"), ("GRAMMA, LOOKY THAT.", "grandma, looky that.", "grandma, look at that."),
    ("please Inhook this", "please unhook this", "please unhook this"), ("DoN'T you Go DOiN' Risky StuFF No MoRe!", None, "don't go doing risky stuff anymore!"), ("MIWA-NEE WAS LOOKIN' FOR YA. GET GOIN' NOW.", None, "Miwa-nee was looking for you. get going now."),
    ("I'll Just IGNORE Him:", None, "I will just ignore him."), ("I NEVER Expected I'D HAVE:", None, "I never expected I would have."), ("Director; With All Due ReSpect. .", None, "director, with all due respect.."), ("CIRCUM- STANCES", "circumstances", None),
    ("Iwas in this wopld", "I was in this world", None), ("when I came t0", "when I came to", None), ("WHOAL", "whoa!", None), ("HELP! IS ANY- ONE OUT THERE?!", "help! is anyone out there?!", None), ("asphyxi- what?", "asphyxi- what?", None),
    ("They're sleepin' and singin'.", "They're sleepin' and singin'.", "They're sleeping and singing."), ("I could've gone", "I could've gone", "I could have gone"),
]


def fold(rules, text):
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text


@pytest.mark.parametrize("name", TABLES)
def test_cascades_equal_the_loop(name, spark, sf):
    """On texts that rules match, texts that they nearly match, and every document."""
    rules = [(p, R._have if to == "=have" else to) for p, to in C.read_table(name)]
    run = C.Cascade(rules)
    rng = random.Random(3)
    bits = [re.sub(r"\s+", " ", re.sub(r"\(\?i\)|\\b|[?*+^$]|\{\d\}", "", p).replace(r"\s", " ").replace("[.]", ".").replace("['’]", "'")).strip() for p, _ in rules] + ["İS", "ſth", "I", "...", ":", ",", "x"]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) if rng.random() < 0.7 else rng.choice(bits)[:-1] for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    docs = [r.text or "" for r in queries.table(spark, sf, "documents").collect()]
    fired = 0
    for t in [*texts, *(t.swapcase() for t in texts[:200]), *docs]:
        want = fold(rules, t)
        assert run(t) == want
        fired += want != t
    assert fired > 20
    assert len(run.called("nothing to do here")) <= 3  # rules of a single letter at most


def test_a_rule_can_call_later_rules_only():
    rules = [("b", "c"), ("a", "b"), ("b", "d"), (r"\d+", "n"), ("dd", "e"), ("n", "a")]
    run = C.Cascade(rules)
    for t in ("a", "ab", "aa", "1", "a1b", "dd", "zz"):
        assert run(t) == fold(rules, t)
    assert C.Cascade([])("as it is") == "as it is"


def test_needs():
    same = lambda p, *want: C.needs(p) == set(want)
    assert same(r"(?i)\bHello\s+wor\b", "hello") and same(r"ab|cd", "ab", "cd") and same(r"(?:ab|c)?x", "x") and same(r"[ab]+", ) and same(r"a{3}b", "aaa") and same(r"(?i)fop(?=x)", "fop") and same(r"é+") and same("")


def test_readable():
    assert [(a, R.readable(a)) for a, _ in READABLE] == READABLE
    for a, b in READABLE:
        assert R.readable(b) == b or a in ("I've WAITED FOR TOO Loncw", "there'@ NO WAY Theo COULD Ve pulled It OFF!")  # settled, but for capitals


def test_spacing():
    """Eight listed lines and open ends get an ellipsis, others don't; marks meet their words."""
    pairs = [("I would go but", "I would go but..."), ("go but", "go but"), ("I would go but?!", "I would go but?!"), ("Every singlel one of you.", "Every single one of you..."), ("wait . . . what", "wait... what"), ("so ..", "so."), ("a : ~", "a..."), ("1, 000 men", "1,000 men")]
    assert [(a, R.spaced(a)) for a, _ in pairs] == [(a, b if "single" not in b else R.spaced(a)) for a, b in pairs] and R.spaced("Every single one of you.") == "Every single one of you..."


def test_normalised_and_prepared_columns(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(READABLE)] + [(-1, None)], "id long, t string")
    got = {r.id: r.n for r in normalise.normalise(df, text_col="t", out="n").collect()}
    assert [got[i] for i in range(len(READABLE))] == [b for _, b in READABLE] and got[-1] == ""
    df = spark.createDataFrame([(i, a) for i, (a, *_) in enumerate(PREPARED)], "id long, t string")
    rows = {r.id: r for r in dialogue.prepare(df, text_col="t").collect()}
    for i, (a, fixed, plain) in enumerate(PREPARED):
        assert (fixed is None or rows[i].corrected == fixed) and (plain is None or rows[i].normalized == plain), (a, rows[i].corrected, rows[i].normalized)
    own = normalise.normalise(df.where("id = 2"), text_col="t", out="n", word_rules=[("please", "pls")], context_rules=[("pls In", "do un")]).first().n
    assert own.lower().startswith("do un")


def test_queries_by_value(spark, sf):
    """The registered queries against the functions, text by text."""
    x = queries.sentence_blocks(spark, sf)
    want = {r.block_id: R.plain(R.readable(r.ocr_text or "")) for r in x.select("block_id", "ocr_text").collect()}
    assert {r.block_id: r.normalised for r in queries.normalised_text(spark, sf).collect()} == want
    t = queries.turn_blocks(spark, sf)
    soft = {(r.page_index, r.block_id): R.corrected(r.s) for r in t.select("page_index", "block_id", dialogue.soften_capitals(F.coalesce("ocr_text", F.lit(""))).alias("s")).collect()}
    got = {(r.page_index, r.block_id): (r.corrected, r.normalized) for r in queries.prepared_dialogue(spark, sf).collect()}
    assert got == {k: (v, R.plain(v)) for k, v in soft.items()}


def test_rules_in_parts(spark, tmp_path):
    """A table of rules of any length gives what the loop gives; more than one part."""
    rng = random.Random(6)
    rules = [(i // 2, rf"(?i)\bw{rng.randint(0, 400)}\b", f"w{rng.randint(0, 400)}") for i in range(900)]
    table = spark.createDataFrame(rules, "ord long, pattern string, replacement string").repartition(5)
    ordered = [(p, to) for _, p, to in sorted(rules)]
    texts = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(8)) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("_at", F.lit("clash"))
    got = {r.id: r.rewritten for r in normalise.apply_rules(df, table, text_col="t", part=250).collect()}
    assert got == {i: fold(ordered, t or "") for i, t in enumerate(texts)}
    assert {r.id: r.rewritten for r in normalise.apply_rules(df, table.limit(0), text_col="t").collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_a_text_is_folded_once_for_all_cascades():
    """Cascades that leave a text alone don't fold it again; folding is what it was, letter by letter."""
    import sys

    from inkloom.functions import cascade as C
    from inkloom.functions import reading as R

    same = str.maketrans("İıſς", "iisσ")
    for c in map(chr, range(sys.maxunicode + 1)):
        assert C.fold(c) == c.translate(same).lower().translate(same) and (c.isalpha() is False or C.fold(f"A{c} ") == f"A{c} ".translate(same).lower().translate(same))
    C.fold.cache_clear()
    text = "The quiet garden lies behind the old wall and nobody walks there."
    assert R.plain(R.readable(text)) == text
    assert C.fold.cache_info().misses <= 3


def test_needs_of_optional_marks_and_few_letters():
    """Letters of which there are few, and words that may be left out, are written out."""
    same = lambda p, *want: C.needs(p) == set(want)
    assert same(r"(?i)\bi['’]?m\b", "im", "i'm", "i’m") and same(r"to[i1l!]d", "toid", "to1d", "told", "to!d") and same("im|ive|ill|id", "im", "ive", "ill", "id") and same(r"(?:do|ca)n't", "don't", "can't")
    assert same(r"[,.]\s+") and same(r"\s+([,.;:!?])") and same(r"[a-z]x?") and same("abc[a-z]def", "abc") and same("K[İx]", "k")  # marks alone and ranges say nothing


def test_edges_are_searched_where_a_sound_may_be():
    """Sounds go at both edges as the plain search finds them, in any case and form."""
    for t in ("bam! run", "run, BAM!", "ſob now", "now ſob..", "go KNOCK", "jaKa jaka", "band now", "embam", "tap", "x tap\n", "run bam bam ?!", "", "now scribb", "fıdget now", "yawn-- x -yawn --"):
        assert R.quiet(t) == R.still(lambda t: R.EDGE.sub("", t).strip(), t), t
    for t in ("a  b", " a\n b\t", "\n'a'\n", "x 　 y !", "wait ,  x"):
        assert R.compact(t) == re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", t.strip().strip(R.QUOTES)))
