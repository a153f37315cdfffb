"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Fit: on a bounded sample, several rotations are learned by iterative
quantisation (each from its own random start); a vector's code is the first
``bits`` signs of its rotated components, cut into m substrings of 16 bits.

Index: blocks of stated size, each built once and written: its codes, and for
each substring its rows in order of that substring's value.

Search, by the pigeonhole principle: two codes at most r = m f + a bits apart
agree in one of the substrings 0..a up to f flips, or in one of the others up
to f - 1. Probing those buckets so retrieves every code within radius r. The
rows touched are ordered by Hamming distance, and the nearest ``shortlist`` of
each block are ranked again by their exact inner product in double precision.

The radius is what each query needs. On the sample, pairs at all angles tell at
which least radius probing meets them, and so the radius ``reach`` that meets a
share ``target`` of the vectors at an angle. A first pass probes with a small
radius (it meets half of the sample's own neighbours), wider where fewer than
4 k rows are touched. The k-th best found, over all blocks, bounds the angle of
the true k-th; queries whose bound asks for a greater radius search again with
that. So a vector within a cluster ends after a few buckets, one that stands
alone probes a good part of each block, and none has fewer than k rows unless
the table has.

Every (query block, block) keeps each query's best k, and a window for each
query merges them. For inner products of vectors of unequal length, codes are
of the vectors extended by sqrt(M^2 - |x|^2), M the greatest length in the
sample; longer ones extend by 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from inkloom.llm.common import settle
from inkloom.llm.vectors import sample, usable

WIDTH = 16  # bits of a substring: about the logarithm of a block's rows


@lru_cache(maxsize=WIDTH + 1)
def flips(f: int) -> np.ndarray:
    """Every substring value with exactly ``f`` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(WIDTH), f)], np.uint16)


def levels(m: int, radius: int) -> np.ndarray:
    """Flips to probe in each of the m substrings for a Hamming radius (-1: none)."""
    f, a = divmod(radius, m)
    return np.where(np.arange(m) <= a, f, f - 1)


@dataclass
class Coder:
    """Greatest length, mean and rotations (d + 1 by bits), the first radius, and radii by angle (bins up to ``angles``)."""

    top: float
    mean: np.ndarray
    rotation: np.ndarray
    radius: int = 0
    angles: np.ndarray = field(default_factory=lambda: np.zeros(1))
    radii: np.ndarray = field(default_factory=lambda: np.zeros(1, int))

    def reach(self, length: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The radius for queries of these lengths, whose k-th best inner products are ``score`` (NaN: fewer than k are known)."""
        angle = np.arccos(np.clip(score / (length * self.top), -1.0, 1.0))
        at = np.searchsorted(self.angles, angle)
        wider = self.radii[-1] + self.rotation.shape[1] // WIDTH  # beyond all angles of the sample
        most = self.rotation.shape[1]
        return np.where(np.isnan(score), most, np.minimum(np.append(self.radii, wider)[at], most))

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of uint16 substrings; queries are scaled to the greatest length."""
        if query:
            x = x * (self.top / np.sqrt((x * x).sum(1)))[:, None]
        bits = (extend(x, self.top) - self.mean) @ self.rotation >= 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn(x: np.ndarray, *, bits: int, rounds: int, k: int, share: float, target: float, seed: int, asked: int = 400, bins: int = 24) -> Coder:
    """Rotations by iterative quantisation, and the radii that meet ``target`` of the vectors at an angle.

    ``share``: the sample's part of all rows. Of the k neighbours in the table
    about k * share are in the sample, so as many (one at least) count there.
    """
    top = float(np.sqrt((x * x).sum(1).max()))
    y = extend(x, top)
    mean = y.mean(0)
    y = y - mean
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // y.shape[1])):
        r = np.linalg.qr(rng.standard_normal((y.shape[1], y.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        out.append(r)
    coder = Coder(top, mean, np.hstack(out)[:, :bits])
    at = rng.permutation(len(x))[:asked]
    near = min(max(1, int(np.ceil(k * share))), len(x) - 1)
    if near < 1:
        return coder
    product = x[at] @ x.T
    product[np.arange(len(at)), at] = -np.inf
    order = np.argsort(-product, axis=1)[:, : len(x) - 1]
    ranks = np.unique(np.r_[np.arange(near), np.geomspace(1, len(x) - 1, 24).astype(int) - 1])
    other = order[:, ranks]
    apart = np.bitwise_count(coder.codes(x)[other] ^ coder.codes(x[at], query=True)[:, None, :]).astype(int)
    m = apart.shape[2]
    met = (m * apart + np.arange(m)).min(2)  # the least radius whose probes touch each vector
    quantile = lambda v, q: int(np.quantile(v, q, method="higher"))
    coder.radius = quantile(met[:, ranks < near], 0.5)
    length = np.sqrt((x[at] ** 2).sum(1))[:, None]
    angle = np.arccos(np.clip(np.take_along_axis(product, other, 1) / (length * top), -1.0, 1.0)).ravel()
    by = np.argsort(angle, kind="stable")
    parts = np.array_split(by, min(bins, len(by)))
    coder.angles = np.array([angle[p[-1]] for p in parts])
    coder.radii = np.maximum.accumulate([quantile(met.ravel()[p], target) for p in parts])
    return coder


def extend(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))
    return np.hstack([x, rest[:, None]])


class Index:
    """The substring tables of one block: for each substring, rows in order of its value."""

    def __init__(self, code: np.ndarray, order: np.ndarray | None = None):
        self.code = np.ascontiguousarray(code)
        self.words = self.code.view(np.uint64)
        self.n, self.m = code.shape
        self.order = np.argsort(code.T, axis=1, kind="stable").astype(np.int32) if order is None else order
        counts = np.stack([np.bincount(column, minlength=1 << WIDTH) for column in code.T])
        self.starts = np.hstack([np.zeros((self.m, 1), np.int64), np.cumsum(counts, axis=1)]).astype(np.int32)

    def touched(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Rows in the buckets that hold every code within ``radius`` of ``q``, in order."""
        seen = np.zeros(self.n, bool)
        level = levels(self.m, radius)
        for f in range(min(WIDTH, int(level.max())) + 1):
            at = np.flatnonzero(level >= f)[:, None]
            bucket = (q[at] ^ flips(f)).astype(np.int64)
            start = self.starts[at, bucket]
            size = (self.starts[at, bucket + 1] - start).ravel()
            first = (start + at * self.n).ravel()
            on = size > 0
            first, size = first[on], size[on]
            skip = np.cumsum(size) - size
            seen[self.order.ravel()[np.repeat(first - skip, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(seen)

    def nearest_codes(self, q: np.ndarray, radius: int, least: int, shortlist: int) -> tuple[np.ndarray, int]:
        """Of the touched rows those up to the distance that holds ``shortlist``; and how many were touched.

        While fewer than ``least`` rows are touched, every substring has another bit flipped.
        """
        rows = self.touched(q, radius)
        while len(rows) < min(least, self.n) and radius < WIDTH * self.m:
            radius += self.m
            rows = self.touched(q, radius)
        if len(rows) <= shortlist:
            return rows, len(rows)
        apart = np.bitwise_count(self.words[rows] ^ q.view(np.uint64)).sum(1, dtype=np.int64)
        return rows[apart <= np.partition(apart, shortlist - 1)[shortlist - 1]], len(rows)


def build(vectors: DataFrame, coder, blocks: int, seed: int) -> DataFrame:
    """One row a block: block, n, ids, vectors, codes and substring orders in binary."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "x", F.lit(seed)), F.lit(blocks)).cast("int"))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")  # so that a stable sort by score leaves ties to smaller ids
        x = np.vstack(p["x"].to_numpy()).astype(float)
        index = Index(coder.value.codes(x))
        return pd.DataFrame({"block": [p["block"].iloc[0]], "n": [len(p)], "ids": [p["id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "code": [index.code.tobytes()], "orders": [index.order.tobytes()]})

    return dealt.groupBy("block").applyInPandas(one, "block int, n int, ids binary, x binary, code binary, orders binary")


def nearest(
    vectors: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    bits: int = 256,
    rounds: int = 12,
    fit_rows: int = 20_000,
    target: float = 0.95,
    shortlist: int = 1_024,
    block_rows: int = 16_384,
    query_rows: int = 4_096,
    seed: int = 3,
    with_touched: bool = False,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every``, its k nearest rows found.

    Score: inner product in double precision. Ties go to the smaller id. A
    query's own id is no candidate. Vectors that are null, empty, zero or hold
    null or non-finite components, rows without an id, and vectors of another
    length than most rows take no part; a repeated id counts once (its best
    score), and a repeated query id asks with its smallest vector. Of equal
    vectors the k + 1 smallest ids are indexed, as no other can be an answer.
    Empty tables give an empty result. ``with_touched`` adds the number of rows
    that the query's probes touched in the block where the answer was found.
    """
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    out = "query_id long, rank int, vec_id long, score double" + ", touched long" * with_touched
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    x = x.where(F.col("id").isNotNull() & usable(F.col("x")))
    dims = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return x.sparkSession.createDataFrame([], out)
    x = x.where(F.size("x") == dims["d"])
    fit = sample(x, fit_rows, seed)
    coder = x.sparkSession.sparkContext.broadcast(learn(fit, bits=bits, rounds=rounds, k=k, share=len(fit) / dims["count"], target=target, seed=seed))  # (d + 1) * bits numbers
    same = F.row_number().over(W.partitionBy("x").orderBy("id"))  # limited to k + 1 before the shuffle
    distinct = x.withColumn("same", same).where(F.col("same") <= k + 1).drop("same")
    nx, nq = -(-dims["count"] // block_rows), max(1, -(-dims["count"] // (every * query_rows)))
    index = settle(build(distinct, coder, nx, seed), "index")
    queries = x.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(nq)).cast("int"))
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    least = -(-4 * k // nx)  # rows that a query touches in a block

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float), "touched": np.array([], np.int64)})
        v = v.iloc[0]
        vid, vx = np.frombuffer(v["ids"], np.int64), np.frombuffer(v["x"], float).reshape(v["n"], -1)
        found = Index(np.frombuffer(v["code"], np.uint16).reshape(v["n"], -1), np.frombuffer(v["orders"], np.int32).reshape(-1, v["n"]))
        repeated = len(np.unique(vid)) < len(vid)
        qid, qx, radius = q["id"].to_numpy(), np.vstack(q["x"].to_numpy()).astype(float), q["radius"].to_numpy()
        ids, scores, size, touched = [np.zeros(0, np.int64)], [np.zeros(0)], [], []
        for i, code in enumerate(coder.value.codes(qx, query=True)):
            rows, seen = found.nearest_codes(code, int(radius[i]), least, shortlist)
            rows = rows[vid[rows] != qid[i]]
            score = vx[rows] @ qx[i]
            best = np.argsort(-score, kind="stable")
            if repeated:
                best = best[np.sort(np.unique(vid[rows[best]], return_index=True)[1])]
            best = best[:k]
            ids.append(vid[rows[best]])
            scores.append(score[best])
            size.append(len(best))
            touched.append(seen)
        return pd.DataFrame({"query_id": np.repeat(qid, size), "vec_id": np.concatenate(ids), "score": np.concatenate(scores), "touched": np.repeat(touched, size)})

    def best(asking: DataFrame, *before: DataFrame) -> DataFrame:
        by = ["part", "block"]
        left = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double, touched long")
        for b in before:
            found = found.unionByName(b)
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("touched").alias("touched"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    @F.pandas_udf("int")
    def reach(length: pd.Series, score: pd.Series) -> pd.Series:
        return pd.Series(coder.value.reach(length.to_numpy(float), score.to_numpy(float)))

    first = settle(best(queries.withColumn("radius", F.lit(coder.value.radius))), "first")
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    again = queries.join(bound, "id", "left").select("id", "x", "part", reach(length, "score").alias("radius"))
    again = settle(again.where(F.col("radius") > coder.value.radius), "again")
    found = best(again, first.drop("rank"))
    return found.select("query_id", "rank", "vec_id", "score", *(["touched"] * with_touched))
