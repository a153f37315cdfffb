"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words (the last may be shorter).
Each passage is encoded as style measures (symbols, capitals, repetition,
word lengths, separators) and hashed words; a learned layer gives h. Gated
attention weighs the passages,

    a = softmax over passages of w . (tanh(V h) * sigmoid(U h)),

and the score is sigmoid(c . sum(a h) + b). Only document labels are learned
from: all weights, attention included, are fitted by gradient descent.

The model is fitted on a bounded sample of labelled rows (``fit_rows`` rows,
whole texts, at most ``fit_passages`` passages); every whole text is scored,
by tasks that hold one Arrow batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from inkloom.llm.common import settle, slices, tidy

PASSAGE = 64
BUCKETS = 256
STYLE = 12
GROUP = 4096  # passages scored at once
LONG = 4_000_000  # characters from which a text is scored in parts
WORDS = re.compile(r"\S+")


class Lexicon:
    """Measures of the words seen by this worker, at most ``MOST`` of them at once."""

    MOST = 1 << 17

    def __init__(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, 8), np.int64)

    def _add(self, word: str) -> int:
        i = self.at[word] = len(self.at)
        if i == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = measures(word)
        return i

    def clear(self) -> None:
        self.__init__()

    def look(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.MOST:
            self.clear()
        at, get, add = list(map(self.at.get, words)), self.at.get, self._add
        if None in at:
            for k, i in enumerate(at):
                if i is None:
                    known = get(words[k])
                    at[k] = add(words[k]) if known is None else known
        return self.rows[at]


def measures(word: str) -> tuple:
    """(bucket, length, letters, capitals, digits, symbols, ends a sentence, hash)."""
    letters = sum(c.isalpha() for c in word)
    caps = sum(c.isupper() for c in word)
    digits = sum(c.isdigit() for c in word)
    plain = sum(c in ".,;:'\"-" for c in word)
    tail = word.rstrip("\"')")[-1:] in (".", "!", "?")
    return xxhash.xxh32_intdigest(word.lower()) % BUCKETS, len(word), letters, caps, digits, len(word) - letters - digits - plain, tail, xxhash.xxh32_intdigest(word)


_lexicon = Lexicon()


def encode(text: str | list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """(style measures, hashed word shares) of each passage of a text (or its words); an empty text is one empty passage."""
    words = text if isinstance(text, list) else (text or "").split()
    if not words:
        return np.zeros((1, STYLE), np.float32), np.zeros((1, BUCKETS), np.float32)
    m = _lexicon.look(words)
    n = len(m)
    starts = np.arange(0, n, PASSAGE)
    size = np.diff(np.r_[starts, n])
    at = np.repeat(np.arange(len(starts)), size)
    sums = np.add.reduceat(m[:, 1:7], starts, axis=0).astype(np.float32)
    chars, letters, caps, digits, symbols, ends = sums.T
    chars = np.maximum(chars, 1)
    order = np.lexsort((m[:, 7], at))
    w, p = m[order, 7], at[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])]
    distinct = np.bincount(p[new], minlength=len(starts))
    same_next = np.r_[(m[1:, 7] == m[:-1, 7]) & (at[1:] == at[:-1]), False]
    echo = np.bincount(at[same_next], minlength=len(starts))
    noise = np.bincount(at[m[:, 5] > 0], minlength=len(starts))
    upper = np.bincount(at[(m[:, 2] > 1) & (m[:, 3] == m[:, 2])], minlength=len(starts))
    bare = np.bincount(at[m[:, 2] == 0], minlength=len(starts))
    long = np.bincount(at[m[:, 1] > 14], minlength=len(starts))
    style = np.stack(
        [
            symbols / chars, noise / size, caps / chars, upper / size, digits / chars, bare / size,
            distinct / size, echo / size, ends / size, chars / size / 8, long / size, np.log1p(size) / 5,
        ],
        1,
    ).astype(np.float32)
    bag = np.bincount(at * BUCKETS + m[:, 0], minlength=len(starts) * BUCKETS).reshape(-1, BUCKETS)
    return style, (bag / np.sqrt(size)[:, None]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Encoder (mean, scale, E), attention (V, U, w) and classifier (c, b)."""

    weights: dict[str, np.ndarray]

    def hidden(self, style: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.weights
        x = np.hstack([np.clip((style - p["mean"]) * p["scale"], -6, 6), bag])
        return x, np.tanh(x @ p["E"] + p["e"])

    def forward(self, style: np.ndarray, bag: np.ndarray, starts: np.ndarray):
        p = self.weights
        x, h = self.hidden(style, bag)
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        size = np.diff(np.r_[starts, len(s)])
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), size))
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return x, h, t, g, a, z, size, _sigmoid(z @ p["c"] + p["b"])

    def scores(self, texts) -> np.ndarray:
        """The score of every whole text, a bounded number of passages at a time.

        The passages of a longer text are folded into running sums: attention
        needs no more than the sums of exp(s) and of exp(s) h, on one scale.
        """
        out, style, bag, starts, n = [np.zeros(0)], [], [], [], 0
        for i, t in enumerate(texts):
            t = t.as_py() if isinstance(t, pa.Scalar) else t
            if t is not None and len(t) > LONG:
                if n:
                    out.append(self.forward(np.vstack(style), np.vstack(bag), np.array(starts))[-1])
                    style, bag, starts, n = [], [], [], 0
                out.append(self.folded(t))
                continue
            s, b = encode(t)
            starts.append(n)
            style.append(s)
            bag.append(b)
            n += len(s)
            if n >= GROUP:
                out.append(self.forward(np.vstack(style), np.vstack(bag), np.array(starts))[-1])
                style, bag, starts, n = [], [], [], 0
        if n:
            out.append(self.forward(np.vstack(style), np.vstack(bag), np.array(starts))[-1])
        return np.concatenate(out)

    def folded(self, text: str) -> np.ndarray:
        """The score of one long text, GROUP passages at a time."""
        p = self.weights
        top, weight, z = -np.inf, 0.0, np.zeros(len(p["c"]))
        words = WORDS.finditer(text)
        while part := [m[0] for m in islice(words, GROUP * PASSAGE)]:
            _, h = self.hidden(*encode(part))
            s = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            new = max(top, float(s.max()))
            e = np.exp(s - new)
            shrink = np.exp(top - new)
            weight, z, top = weight * shrink + e.sum(), z * shrink + e @ h, new
        return _sigmoid(np.array([z / max(weight, 1e-300) @ p["c"] + p["b"]]))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, width: int = 24, inner: int = 12, rounds: int = 15, rate: float = 0.01, decay: float = 1e-3, seed: int = 2) -> Model:
    """Adam on the log loss of document labels, over shuffled groups of documents."""
    rng = np.random.default_rng(seed)
    style = np.vstack([s for s, _ in bags]) if bags else np.zeros((1, STYLE), np.float32)
    d = STYLE + BUCKETS
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    p = {
        "E": rng.normal(0, 0.1, (d, width)), "e": np.zeros(width), "V": rng.normal(0, 0.3, (width, inner)), "U": rng.normal(0, 0.3, (width, inner)),
        "w": rng.normal(0, 0.3, inner), "c": rng.normal(0, 0.1, width), "b": np.array(np.log(prior / (1 - prior))),
    }
    fixed = {"mean": style.mean(0), "scale": 1 / (style.std(0) + 1e-3)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for _ in range(rounds if len(bags) else 0):
        for pick in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
            step += 1
            starts = np.r_[0, np.cumsum([len(bags[i][0]) for i in pick])[:-1]]
            x, h, t, g, a, z, size, out = Model(p | fixed).forward(np.vstack([bags[i][0] for i in pick]), np.vstack([bags[i][1] for i in pick]), starts)
            err = (out - y[pick]) / len(pick)
            dz = err[:, None] * p["c"]
            dzr = np.repeat(dz, size, axis=0)
            da = (dzr * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
            dtg = ds[:, None] * p["w"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (a[:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"c": z.T @ err, "b": err.sum(), "w": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg, "E": x.T @ dh, "e": dh.sum(0)}
            for k, q in grad.items():
                q = q + decay * p[k] / 10 if k != "b" else q
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(p | fixed)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 3000, fit_passages: int = 60_000, text_passages: int = 512, seed: int = 2) -> Model:
    """Fit on the labelled, not held-out rows of the smallest keyed hashes.

    The bounds of the sample: ``fit_rows`` rows, of a longer text
    ``text_passages`` passages evenly over its whole length, and as many rows
    as keep within ``fit_passages``. Null labels and ids are left out; a
    document with several labels takes their majority, an id with several texts
    the smallest. Without labelled rows the score is the same for every text.
    """
    if fit_passages < text_passages:
        raise ValueError("fit_passages must hold the passages of one text")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    # the smallest hashes of the known ids, so that only those texts are read into the sample
    pick = known.select("id", "y", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h", "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(pick), "id")
    # at most fit_rows rows, read from the corpus once
    rows = settle(rows.groupBy("id", "y", "h").agg(F.min("text").alias("text")), "fit")
    size = F.greatest(F.ceil(F.regexp_count("text", F.lit(r"\S+")) / PASSAGE), F.lit(1))
    sizes = rows.select("id", "h", F.least(F.coalesce(size, F.lit(1)), F.lit(text_passages)).alias("size"))  # no text goes through the window
    fits = sizes.withColumn("run", F.sum("size").over(W.orderBy("h", "id"))).where(F.col("run") <= fit_passages).select("id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for i, y, h, text in zip(p["id"], p["y"], p["h"], p["text"]):
                style, bag = encode(text)
                if len(style) > text_passages:
                    some = np.linspace(0, len(style) - 1, text_passages).astype(int)
                    style, bag = style[some], bag[some]
                at = np.flatnonzero(bag.ravel())
                yield pd.DataFrame({"id": [i], "y": [y], "h": [h], "n": [len(style)], "style": [style.tobytes()], "at": [at.astype(np.int32).tobytes()], "bag": [bag.ravel()[at].astype(np.float16).tobytes()]})

    got = rows.join(F.broadcast(fits), "id").select("id", "y", "h", "text")
    got = got.mapInPandas(lambda batches: tidy(run(batches), _lexicon), "id long, y int, h long, n int, style binary, at binary, bag binary")
    bags, y = [], []
    for r in got.toPandas().sort_values(["h", "id"], kind="stable").itertuples():
        bag = np.zeros(r.n * BUCKETS, np.float32)
        bag[np.frombuffer(r.at, np.int32)] = np.frombuffer(r.bag, np.float16)
        bags.append((np.frombuffer(r.style, np.float32).reshape(-1, STYLE), bag.reshape(-1, BUCKETS)))
        y.append(r.y)
    return fit(bags, np.array(y, np.float32), seed=seed)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1) for every row; a column of that name is replaced.

    Null and empty texts have the score of an empty passage.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # about 30 kB
    own = [c for c in docs.columns if c != score_col]
    at = own.index(text_col)
    x = docs.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            s = held.value.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(np.float64))], names=[*own, score_col])

    schema = StructType([*x.schema.fields, StructField(score_col, DoubleType())])
    return x.mapInArrow(lambda batches: tidy(run(batches), _lexicon), schema)


def judged(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit_with) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **fit_with)
    x = score(docs.select(id_col, text_col), model, text_col=text_col)
    return x.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
