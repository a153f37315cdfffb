"""Words cut at line ends: the lexicon and the mended texts against plain Python."""

import re
from collections import Counter

from inkloom.operators import hyphens as H
from inkloom.plans import queries

TEXTS = [
    "CIRCUM- STANCES are circumstances.", "a well- known man", "a well-known face, well known", "so- so", "asphyxi- what?", "mis- under- standing", "one misunderstanding here", "under- stand", "understand", "the- end", "the end", "the end",
    "x- ray", "re-  sult", "Re-\nsult", "result-", "- lead", "ab-cd- ef", None, "", "re- sult re- sult", "re- sult re- sult",
]


def plain_lexicon(texts):
    texts = [(t or "").lower() for t in texts]
    run = r"(?<![a-z])[a-z]{2,}(?:-\s+[a-z]{2,})+(?![a-z])"
    cuts, docs = Counter(), Counter()
    for t in texts:
        for m in re.findall(run, t):
            h = re.split(r"-\s+", m)
            cuts.update(zip(h, h[1:]))
        words = set()
        for w in re.findall("[a-z]+(?:-[a-z]+)*", re.sub(run, " ", t)):
            words |= {w, *w.split("-")}
        docs.update(words)
    out = {}
    for (a, b), n in cuts.items():
        j, c, p = docs[a + b], docs[f"{a}-{b}"], min(docs[a], docs[b])
        out[a, b] = (n, j, c, p, "apart" if b in ("what", "who", "where", "why", "huh") else "compound" if c > j else "apart" if j == c == 0 < p else "join")
    return out


def test_lexicon(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, ocr_text string")
    got = {(r.left, r.right): (r.n, r.joined_docs, r.compound_docs, r.parts_docs, r.decision) for r in H.hyphen_lexicon(df).collect()}
    assert got == plain_lexicon(TEXTS)
    assert got["well", "known"][-1] == "compound" and got["asphyxi", "what"][-1] == "apart" and got["circum", "stances"][-1] == "join" and got["the", "end"][-1] == "apart" and got["re", "sult"][0] == 6
    assert H.hyphen_lexicon(df.limit(0)).count() == 0


def counted(df, n):
    """The rows, each counted when it is made."""

    def run(batches):
        for p in batches:
            n.add(len(p))
            yield p

    return df.mapInPandas(run, df.schema)


def test_lexicon_makes_texts_twice(spark):
    """Once for the cuts, once for the words, which meet the cuts as counts in one join."""
    n = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, ocr_text string")
    x = H.hyphen_lexicon(counted(df, n))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert len(x.collect()) == len(plain_lexicon(TEXTS)) and n.value == 2 * len(TEXTS)


def test_mended(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, ocr_text string")
    got = {r.id: r.mended for r in H.mend_hyphens(df, H.hyphen_lexicon(df)).collect()}
    want = ["CIRCUMSTANCES are circumstances.", "a well-known man", "a well-known face, well known", "soso", "asphyxi- what?", "misunderstanding", "one misunderstanding here", "understand", "understand", "the- end", "the end", "the end"]
    assert [got[i] for i in range(len(want))] == want and got[13] == "result" and got[14] == "Result" and got[18] == "" and got[20] == "result result"
    assert H.mend_hyphens(df, H.hyphen_lexicon(df).limit(0)).where("mended <> coalesce(ocr_text, '')").count() == 0


def test_mended_texts_travel_once(spark):
    """Texts are never grouped or joined as a whole, repeated ones neither; Python gets those with decisions only."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id long, ocr_text string")
    n = spark.sparkContext.accumulator(0)
    lexicon = spark.createDataFrame([("re", "sult", "join"), ("so", "so", "apart")], "left string, right string, decision string")
    x = H.mend_hyphens(counted(df, n), lexicon)
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    got = {r.id: r.mended for r in x.collect()}
    assert len(got) == 3 * len(TEXTS) and n.value == 2 * len(got)
    assert all(got[i] == H.mend(t or "", {("re", "sult"): "join"}) for i, t in enumerate(TEXTS * 3))


def test_mended_query(spark, sf):
    x = {r.doc_id: r.ocr_text for r in queries.cut_documents(spark, sf).collect()}
    decisions = {k: v[-1] for k, v in plain_lexicon(x.values()).items()}
    import hashlib

    got = queries.mended_hyphens(spark, sf).collect()
    assert len(got) == len(x) and all(r.mended_sha256 == hashlib.sha256(H.mend(x[r.doc_id] or "", decisions).encode()).hexdigest() for r in got)
