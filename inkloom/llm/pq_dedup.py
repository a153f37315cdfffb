"""Near-duplicate vectors by product quantisation, without losing a link.

Fit, on a bounded sample: a coarse k-means gives the inverted lists, and a
k-means in each subspace gives the codes of the residuals. A vector x keeps
its list, its codes (so its approximation y), and the least product q.y that a
neighbour q can have. With unit vectors, s = x.y and t the length of the part
of y that is orthogonal to x, any q with cosine >= c has

    q.y >= c * s - sqrt(1 - c^2) * t,

so candidates are the rows whose table-lookup product q.list + sum(q.code)
reaches that bound, and none is missed. A list is probed when the angle from q
to its centre, less the list's greatest angle, is within arccos(c); that can't
miss one either. Candidates are judged by their exact cosine in double precision.

Lists of a label are packed into blocks of stated size; a list that is longer
is cut into several. A task compares two blocks, so no label, list or group of
copies lands in one task. Exact copies are one row with a count. A task gives
sums of links and a star of edges, linear in its rows however many pairs link.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from inkloom.llm.common import components, settle
from inkloom.llm.vectors import sample, usable


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest_centre(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096))])


class Quantiser:
    """Coarse centres (k by d) and codebooks (a (256, width) array for each subspace)."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, rounds: int, seed: int):
        x = unit(x)
        self.centres = kmeans(x, lists, rounds, seed)
        rest = x - self.centres[nearest_centre(x, self.centres)]
        self.cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], 256, rounds, seed + 1 + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, approximation) of unit vectors."""
        at = nearest_centre(x, self.centres)
        rest = x - self.centres[at]
        code = np.stack([nearest_centre(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)
        y = self.centres[at] + np.hstack([book[code[:, i]] for i, book in enumerate(self.books)])
        return at, code, y

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]

    def products(self, x: np.ndarray) -> np.ndarray:
        return x @ self.centres.T

    def angles(self, x: np.ndarray) -> np.ndarray:
        """Angles of unit vectors to the centres."""
        return np.arccos(np.clip(self.products(x) / np.maximum(np.sqrt((self.centres**2).sum(1)), 1e-300), -1, 1))


class Blank:
    """A quantiser that rules nothing out: one list, no codes, for vectors of any length."""

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(len(x), int), np.zeros((len(x), 0), np.uint8), np.zeros_like(x)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return []

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.full((len(x), 1), math.pi / 2)

    def products(self, x: np.ndarray) -> np.ndarray:
        return np.zeros((len(x), 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        for at in (a, b, low[a], low[b]):
            np.minimum.at(new, at, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def links(q: pd.DataFrame, v: pd.DataFrame, same: bool, model: Quantiser, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of v) with cosine >= ``cosine``; each once if ``same``."""
    qx, vx = unit(np.vstack(q["x"].to_numpy())), unit(np.vstack(v["x"].to_numpy()))
    lists = v["list"].to_numpy()
    code = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), -1)
    least, angle = v["least"].to_numpy(), v["angle"].to_numpy()
    members = {int(k): np.flatnonzero(lists == k) for k in np.unique(lists)}
    reach = math.acos(cosine) + 1e-7
    out = [np.zeros((2, 0), np.int64)]
    for start in range(0, len(q), 512):
        part = qx[start : start + 512]
        to_centre, away, tables = model.products(part), model.angles(part), model.tables(part)
        for k, rows in members.items():
            probe = np.flatnonzero(away[:, k] - angle[rows].max() <= reach)
            if not len(probe):
                continue
            score = np.repeat(to_centre[probe, k][:, None], len(rows), 1)
            for i, t in enumerate(tables):
                score += t[probe][:, code[rows, i]]
            a, b = np.nonzero(score >= least[rows] - 1e-9)
            a, b = probe[a] + start, rows[b]
            if same:
                keep = a < b
                a, b = a[keep], b[keep]
            for i in range(0, len(a), 1 << 17):
                x, y = a[i : i + (1 << 17)], b[i : i + (1 << 17)]
                ok = np.einsum("ij,ij->i", qx[x], vx[y]) >= cosine
                out.append(np.stack([x[ok], y[ok]]))
    a, b = np.concatenate(out, axis=1)
    return a, b


def near_duplicates(
    vectors: DataFrame,
    *,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    lists: int = 64,
    parts: int = 8,
    rounds: int = 8,
    fit_rows: int = 20_000,
    block_rows: int = 2_048,
    seed: int = 1,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine is
    ``cosine`` or more. Rows without an id, with a null label, or whose vector
    is null, empty, zero, or holds null or non-finite components link with
    nothing and are kept as their own component; vectors of unequal lengths
    don't link. Repeated rows are vectors of their own that share an id.
    """
    row = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), F.col(label_col).cast("string").alias("label"))
    takes = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x"))
    # two 64-bit hashes stand for the vector in keys
    keyed = row.withColumn("k1", F.when(takes, F.xxhash64("x", F.lit(1)))).withColumn("k2", F.when(takes, F.xxhash64(F.lit(2), "x")))
    reps = keyed.where("k1 is not null").groupBy("label", "k1", "k2").agg(F.min("id").alias("rid"), F.count("*").alias("mult"), F.first("x").alias("x"))
    reps = settle(reps.withColumn("label", F.concat("label", F.lit("/"), F.size("x"))), "vectors")
    dims = reps.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()  # one, unless lengths differ
    found = None
    if dims:
        most = F.size("x") == dims[0]["d"]
        n = dims[0]["count"]
        fit = sample(reps.where(most).select("x", F.col("rid").alias("id")), fit_rows, seed)
        found = _links(reps.where(most), Quantiser(fit, min(max(lists, math.isqrt(n) // 4), max(lists, fit_rows // 40)), parts, rounds, seed), cosine, block_rows, seed)
        if len(dims) > 1:  # vectors of rarer lengths meet in blocks without lists
            found = found.unionByName(_links(reps.where(~most), Blank(), cosine, block_rows, seed))
    found = settle(found, "links") if found is not None else reps.select("label", "k1", "k2", "rid", F.lit(0).cast("long").alias("links"), F.col("rid").alias("low")).limit(0)
    group = components(found.where("low < rid"), "low", "rid").withColumnRenamed("node", "rid")
    sums = found.groupBy("label", "rid", "k1", "k2").agg(F.sum("links").alias("links"))
    state = reps.select("label", "k1", "k2", "rid", "mult").join(sums, ["label", "rid", "k1", "k2"], "left").join(group, "rid", "left")
    y = keyed.withColumn("label", F.concat("label", F.lit("/"), F.size("x"))).select("id", "label", "k1", "k2").join(state, ["label", "k1", "k2"], "left")
    component = F.coalesce("component", "rid", "id")
    return y.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("mult") - 1, F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(reps: DataFrame, quantiser: Quantiser | Blank, cosine: float, block_rows: int, seed: int) -> DataFrame:
    """label, k1, k2, rid, links, low: the links of a class in one pair of blocks, and the smallest id reached there."""
    model = reps.sparkSession.sparkContext.broadcast(quantiser)  # lists * d + 256 * d numbers
    across = math.sqrt(1 - cosine * cosine)
    own = "label string, k1 long, k2 long, rid long, mult long, x array<double>"

    def coded_rows(p: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.vstack(p["x"].to_numpy()))
        at, codes, y = model.value.encode(x)
        s = np.einsum("ij,ij->i", x, y)
        t = np.sqrt(np.maximum(0, (y * y).sum(1) - s * s))
        # the bound falls with the cosine only while s >= -t * c / sqrt(1 - c^2); else nothing is ruled out
        least = np.where(s * across + t * cosine >= 0, cosine * s - across * t, -10.0)
        return p.assign(list=at.astype(np.int32), code=[r.tobytes() for r in codes], least=least, angle=model.value.angles(x)[np.arange(len(x)), at])

    def code(batches):
        for p in batches:
            for _, part in p.groupby(p["x"].map(len)):
                yield coded_rows(part)

    coded = settle(reps.select("label", "k1", "k2", "rid", "mult", "x").mapInPandas(code, own + ", list int, code binary, least double, angle double"), "codes")
    # lists of a label, in order, fill blocks; windows over one row for each label and list
    cells = coded.groupBy("label", "list").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
    order = W.partitionBy("label").orderBy("list").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    cells = cells.withColumn("from", F.floor(before / block_rows)).withColumn("to", F.floor((before + F.col("n") - 1) / block_rows))
    cells = settle(cells.withColumn("span", F.col("to") - F.col("from") + 1), "cells")
    placed = coded.join(cells.select("label", "list", "from", "span"), ["label", "list"])
    placed = settle(placed.withColumn("block", F.col("from") + F.pmod(F.xxhash64("k1", F.lit(seed)), "span")).drop("from", "span"), "placed")
    reach = math.acos(cosine) + 1e-6  # angles are rounded to floats here
    # the nearest that a block comes to each list says which blocks it has to meet; within a pair each vector probes its own lists
    def nearest(key, p: pd.DataFrame) -> pd.DataFrame:
        low = np.full(model.value.angles(unit(np.vstack(p["x"].iloc[:1].to_numpy()))).shape[1], np.inf)
        for _, part in p.groupby(p["x"].map(len)):
            for i in range(0, len(part), 512):
                low = np.minimum(low, model.value.angles(unit(np.vstack(part["x"].iloc[i : i + 512].to_numpy()))).min(0))
        return pd.DataFrame({"label": key[0], "block": key[1], "list": np.arange(len(low), dtype=np.int32), "angle": low.astype(np.float32)})

    near = placed.select("label", "block", "x").groupBy("label", "block").applyInPandas(nearest, "label string, block long, list int, angle float")
    pairs = (
        near.join(cells.select("label", "list", "widest", "from", "to"), ["label", "list"])
        .where(F.col("angle") - F.col("widest") <= reach)
        .withColumn("other", F.explode(F.sequence(F.greatest("from", "block"), F.greatest("to", "block"))))
        .where("other >= block and other <= to")
        .select("label", "block", "other")
        .distinct()
    )
    pairs = settle(pairs, "pairs")
    left = placed.join(pairs, ["label", "block"])
    right = placed.join(pairs.select("label", F.col("block").alias("a"), F.col("other").alias("block")), ["label", "block"])
    right = right.withColumnRenamed("block", "other").withColumnRenamed("a", "block").select(*left.columns)
    right = right.toDF(*right.columns)  # fresh column ids: both sides of the cogroup come from the same table

    def compare(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        names = ["label", "k1", "k2", "rid", "links", "low"]
        if not len(q) or not len(v):
            return pd.DataFrame({n: [] for n in names})
        same = key[1] == key[2]
        if same:
            v = q
        a, b = links(q, v, same, model.value, cosine)
        n = len(q)
        both = q if same else pd.concat([q, v], ignore_index=True)
        if not same:
            b = b + n
        mult, rid = both["mult"].to_numpy(), both["rid"].to_numpy()
        count = np.bincount(a, mult[b], len(both)) + np.bincount(b, mult[a], len(both))
        # rows in order of id, so that the smallest row of a component is its smallest id
        by_id = np.argsort(rid, kind="stable")
        at = np.empty_like(by_id)
        at[by_id] = np.arange(len(by_id))
        low = rid[by_id][local_components(len(both), at[a], at[b])[at]]
        out = both[["label", "k1", "k2", "rid"]].assign(links=count.astype(np.int64), low=low)
        return out[count > 0]

    keys = ["label", "block", "other"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "label string, k1 long, k2 long, rid long, links long, low long")
