import base64
import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import brute  # noqa: E402
import numpy as np  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from inkloom.llm import common, merkle, piece_bpe, queries, whitening  # noqa: E402

# 11: byte-level BPE through a sentencepiece model

ODD = [
    None, "", " ", "  \n\n x", "it's we'LL don't", "a\x1c b\u0085c d", "é😀漢字 ́x", "<unk></s><s>▁ ▁a", "x" * 30_000, " " * 70_000 + "y", "it's 123abc\n\n  z " * 9_000, "\x00\x01 �",
]


@pytest.fixture(scope="module")
def pieces():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=piece_bpe.read_ranks(path), special_tokens={})


def test_piece_bpe_equals_the_library(spark, sf, pieces):
    path, library = pieces
    texts = [r.text for r in common.table(spark, sf, "documents").collect()] + ODD
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in piece_bpe.encode(df, path).collect()}
    assert all(got[i].ids == library.encode_ordinary(t or "") and got[i].n_tokens == len(got[i].ids) for i, t in enumerate(texts))
    back = piece_bpe.decode(piece_bpe.encode(df, path), path)
    assert back.count() == len(texts) + 1 and all(r.text == (texts[r.doc_id] or "") for r in back.collect())
    digests = {r.doc_id: r for r in piece_bpe.round_trip(df, path).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in enumerate(texts):
        assert digests[i].ids_sha256 == sha(",".join(map(str, got[i].ids)).encode()) and digests[i].decoded_sha256 == sha((t or "").encode())
    assert piece_bpe.encode(df.limit(0), path).count() == 0 and piece_bpe.decode(back.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), path).first().text == ""


def ranks(*longer):
    return {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate(longer)}


def test_pieces_of_small_vocabularies(tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(5)
    for words in ((b"ab", b"bc", b"abc", b"aa", b"aaa"), (b"abcd", b"<unk>", b"</s>"), (b"ba", b"ab", b"abab")):  # some entries that no merge leads to
        r = ranks(*words)
        b = piece_bpe.PieceBPE(piece_bpe.serialise(r))
        library = tiktoken.Encoding("own", pat_str=r"[^ ]+| +", mergeable_ranks=r, special_tokens={})
        for _ in range(300):
            t = "".join(rng.choice("aabbcd") for _ in range(rng.randint(1, 12)))
            assert b.encode(t) == library.encode_ordinary(t)
        for t in ("abcd", "<unk>", "</s>"):
            assert b.encode(t) == [i for m in b.split.findall(t) for i in library.encode_ordinary(m)]
    for bad in ({b"a": 0}, ranks() | {b"zz": 300}, ranks(b"")):
        with pytest.raises(ValueError):
            piece_bpe.serialise(bad)
    f = tmp_path / "v"
    f.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for w, i in ranks(b"ab").items()) + b"\n\n")
    assert piece_bpe.read_ranks(str(f)) == ranks(b"ab")


def test_the_cache_turns_over(pieces, monkeypatch):
    path, library = pieces
    monkeypatch.setattr(piece_bpe, "CACHE", 50)
    monkeypatch.setattr(piece_bpe, "STEP", 40)
    b = piece_bpe.PieceBPE(piece_bpe.serialise(piece_bpe.read_ranks(path)))
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randint(0, 200)}" + "q" * (70 * (rng.random() < 0.05)) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    assert list(b.encode_all(texts)) == [library.encode_ordinary(t) for t in texts]
    assert len(b.cache) <= 200 and not any(len(t) > 64 for t in b.cache) and list(b.encode_all([])) == []


# 12: Merkle manifest


def tampered(r):
    hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    return (*r[:3], r[3] + 1 if hit else r[3], r[4])


def found(df, **how):
    hit = F.coalesce(F.crc32(df["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    claimed = [df["doc_id"], df["source"], df["lang"], F.when(hit, df["n_chars"] + 1).otherwise(df["n_chars"]), df["text"]]
    m = merkle.manifest(df, claimed=claimed, **how)
    h = merkle.hex_of
    return sorted((tuple(r) for r in m.select("doc_id", h("leaf"), h("subroot"), h("root"), merkle.proof_digest(F.col("path")), h("claimed_root"), "verified").collect()), key=repr)


@pytest.mark.parametrize(("n", "fanout", "block"), [(150, 2, 8), (40, 3, 9), (1, 2, 8), (0, 2, 8), (64, 2, 1024), (65, 5, 4)])
def test_manifest(spark, n, fanout, block):
    """Nulls in any column, ties, repeated rows, clashing names, hot groups, groups of one."""
    rng = random.Random(n)
    langs = ["en", "en", "en", "de", "é", "z", None, "\U0001f600", "￮", ""] if n > 50 else ["en"]
    rows = [(rng.choice([i, i, None, 3]), rng.choice(["s0", None, ""]), rng.choice(langs), rng.choice([i, None]), rng.choice(["texÿt " * 3, "", None])) for i in range(n)]
    rows += rows[:3] + [(7, "s", "only", 1, "x" * 100_000)] * (n > 50)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("idx", F.lit("x")).withColumn("grp", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("path", F.lit(3))
    assert found(df, fanout=fanout, block=block) == sorted(brute.manifest(rows, fanout, tampered), key=repr)
    if n > 50:
        whole = merkle.manifest(df, fanout=fanout, block=block)
        assert whole.where("not verified").count() == 0 and whole.count() == len(rows)


def test_manifest_needs_two_children(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.range(3).selectExpr("id doc_id"), columns=["doc_id"], fanout=1)


def test_op12(spark, sf):
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.op12_merkle_manifest(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute.manifest(rows, 2, tampered), key=repr)


# 13: whitening


def check_whitening(got, data, components=8, tolerance=1e-8):
    """Every row against the eigenvectors of the whole covariance, up to one sign for each component."""
    rows = [(i, v) for i, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    v = y.T @ y / n
    e, u = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(components, x.shape[1])
    want = y @ u[:, :k] / np.sqrt(e[:k])
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for (i, _), r in zip(rows, x)}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert by.keys() == {i for i, _ in rows} and all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    white = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i, _ in rows])
    sign = np.sign((white * want).sum(0))
    assert np.abs(white * sign - want).max() < tolerance
    assert all(r.deviation == deviation[r.vec_id] and r.n == n and r.identity_error < 1e-9 and abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9 for r in got)


def test_op13(spark, sf):
    data = [tuple(r) for r in common.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    check_whitening(queries.op13_whitening(spark, sf).collect(), data)


def planted(n, d, seed, decay):
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (rng.standard_normal((n, d)) * decay ** np.arange(d)) @ axes.T * 3


def test_whitening_of_odd_rows(spark):
    data = [(i, v.tolist()) for i, v in enumerate(planted(400, 24, 1, 0.9))]
    odd = [(900, None), (901, [float("nan")] * 24), (902, [None] + [1.0] * 23), (903, [float("inf")] * 24), (904, [0.0] * 24)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("component", F.lit(1))
    x = whitening.integers(df, scale=1024, shift=100_000)
    check_whitening(whitening.whiten(x).collect(), data + odd)
    ragged = df.unionByName(spark.createDataFrame([(905, [1.0]), (906, []), (907, [1e300] * 24)], "vec_id long, embedding array<double>"), allowMissingColumns=True)
    assert whitening.whiten(whitening.integers(ragged, scale=1024, shift=100_000)).count() == 401 * 8
    twice = whitening.whiten(x.unionByName(x)).collect()
    assert len(twice) == 401 * 16 and twice[0].n == 802
    for none in (x.limit(0), x.limit(1), x.where("vec_id = 904").unionByName(x.where("vec_id = 904"))):
        assert whitening.whiten(none).count() == 0
    short = [(i, v[:3]) for i, v in data]
    check_whitening(whitening.whiten(whitening.integers(spark.createDataFrame(short, "vec_id long, embedding array<double>"), scale=1024, shift=100_000)).collect(), short)


def test_the_range_finder_ends_early_only_when_residuals_allow(spark):
    for decay, full in ((0.3, False), (0.97, True)):
        raw = planted(600, 40, 3, decay) * 1000
        data = [(i, v.tolist()) for i, v in enumerate(raw)]
        x = whitening.integers(spark.createDataFrame(data, "vec_id long, embedding array<double>"), scale=1024, shift=100_000)
        model = whitening.fit(x, components=4, oversample=12, passes=4)
        assert model.full is full and model.passes == (5 if full else model.passes)
        got = whitening.transform(x, model).collect()
        check_whitening(got, data, 4, 1e-7)


def test_deviations_beyond_a_long_are_exact():
    flat = np.array([[10**14, -(10**14)], [0, 5]])
    sums = [int(s) for s in flat.sum(0)]
    assert whitening.deviations(flat, 2, sums) == [sum((2 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in flat]
