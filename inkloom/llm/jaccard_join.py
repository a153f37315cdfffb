"""Jaccard join of word-shingle sets with filters under several global token orders.

Sets with Jaccard >= t share a token of their prefixes (the first
n - ceil(t n) + 1 tokens) under any order that all documents follow. Candidates
must share one under each of three orders:

A. by document frequency, rarest first, hot tokens last. Tokens of one
   document only come first and can't be shared, so a document whose prefix
   they fill has no partner and leaves at once; most do.
B., C. two independent permutations of the hash space.

A filters the corpus; B and C are intersected with it where the survivors'
sets meet, and what is left is verified by exact intersection sizes.

Steps and what bounds them:

1. Every text gives its key (128 bits of its word sequence), its set size and
   the tokens that are common in its batch. Tokens whose counts reach a
   hundredth of all documents are hot: at most 100 times the mean set size of
   them, so they can be broadcast.
2. A slice of the corpus (8 MB of text) sends the other tokens of its distinct
   texts, in binary runs, to token buckets, which count frequencies over all
   documents and return those of tokens of two or more documents to the
   slice's home. The number of buckets follows the number of words, so a bucket
   stays at ``bucket_tokens``; slices are dealt to as many homes.
3. Documents keep the repeated part of their A prefix. Components of the graph
   document - prefix token give clusters; clusters are cut into blocks of
   stated size, and only pairs of blocks that share a prefix token are compared.
   A task's result is a star of edges, linear in its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkloom.llm.common import components, settle, slices, tidy
from inkloom.llm.pq_dedup import local_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = -(1 << 63)
WORDS = 1 << 17  # words whose hashes a worker keeps
_words: dict[bytes, int] = {}


def word_list(text: str | bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space (bytes.split takes just those six bytes)."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return data.translate(LOWER).split()


def mix(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * m
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; shorter texts are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > WORDS:
        _words.clear()
    h = np.fromiter((_words.get(w) or _words.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = mix(s + h[i : i + n], M1)
    return np.unique(s)


def key_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Prefix length n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def _light(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: doc_id, key, n, words for each row; kind 1: token, count of tokens common in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, texts = batch.column(0), batch.column(1)
            keys, sizes, counts, sets = [], [], [], {}
            for t in texts:
                w = word_list(t.as_py())
                key = key_of(w)
                if key not in sets:
                    sets[key] = shingles(w, k)
                keys.append(key.hex())
                sizes.append(len(sets[key]))
                counts.append(len(w))
            n = len(keys)
            common, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), return_counts=True)
            at = times >= max(16, 0.01 * n)
            common, times = common[at].view(np.int64), times[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), ids.cast(pa.int64()), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=names)
            none = pa.nulls(len(common))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(common), np.int32)), pa.array(common, pa.int64()), none.cast(pa.string()), pa.array(times, pa.int64()), none.cast(pa.int64())], names=names)

    names = ["kind", "id", "key", "n", "words"]
    return docs.mapInArrow(lambda batches: tidy(run(batches), _words), "kind int, id long, key string, n long, words long")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of stated types in one binary value, each behind its length."""
    return b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(run: bytes, *types: str) -> list[np.ndarray]:
    at, out = 0, []
    for t in types:
        n = int.from_bytes(run[at : at + 8], "little")
        out.append(np.frombuffer(run, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


HEADS = ("<i8", "V16", "<i4", "<i4", "<i4")  # slice, keys, sizes, number of hot tokens, those tokens by number
TOKENS = ("<i8", "<u2", "V5")  # slice, document in the slice, token
BACK = ("<i8", "<u2", "V5", "u1")  # and its frequency class


def narrow(tokens: np.ndarray) -> np.ndarray:
    """The low 40 bits as five bytes."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").ravel()


def wide(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros((len(tokens), 8), np.uint8)
    out[:, :5] = np.frombuffer(tokens.tobytes(), np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _runs(docs: DataFrame, k: int, buckets: int, hot) -> DataFrame:
    """(bucket, run): the tokens of a slice's distinct texts, dealt by their low bits.

    A token costs seven bytes: itself and its document's number in the slice.
    The documents' heads (key, size, hot tokens) go once to the slice's home,
    under the numbers from ``buckets`` on; there are as many homes as buckets,
    so no group hears of all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hottest, part = np.sort(hot.value), TaskContext.get().partitionId()
        for ordinal, batch in enumerate(slices(batches, 0)):
            seen, sets = set(), []
            for t in batch.column(0):
                w = word_list(t.as_py())
                if w and (key := key_of(w)) not in seen:
                    seen.add(key)
                    sets.append((key, shingles(w, k)))
            if not sets:
                continue
            number = np.array([part << 32 | ordinal], np.int64)  # the same when a task runs again
            keys, sizes = np.frombuffer(b"".join(k for k, _ in sets), "V16"), np.array([len(s) for _, s in sets])
            at, tokens = np.repeat(np.arange(len(sets)), sizes), np.concatenate([s for _, s in sets])
            i = np.searchsorted(hottest, tokens)
            is_hot = hottest[np.minimum(i, len(hottest) - 1)] == tokens if len(hottest) else np.zeros(len(tokens), bool)
            n_hot = np.bincount(at[is_hot], minlength=len(sets))
            heads = pack(number, keys, sizes.astype("<i4"), n_hot.astype("<i4"), i[is_hot].astype("<i4"))
            at, tokens = at[~is_hot], tokens[~is_hot]
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # documents stay in order within a bucket
            at, tokens, bucket = at[order].astype("<u2"), narrow(tokens[order] >> np.uint64(20)), bucket[order]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
            out_b, out_r = [buckets + home_of(number[0], buckets)], [heads]
            for x, y in zip(edge, [*edge[1:], len(bucket)]):
                out_b.append(int(bucket[x]))
                out_r.append(pack(number, at[x:y], tokens[x:y]))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_r, pa.binary())], names=["bucket", "run"])

    return docs.select("text").mapInArrow(lambda batches: tidy(run(batches), _words), "bucket int, run binary")


def home_of(number: int, homes: int) -> int:
    return int(mix(np.array([number], np.uint64), M1)[0] % np.uint64(homes))


def _frequencies(runs: DataFrame, homes: int) -> DataFrame:
    """Back to the slices' homes: tokens of two or more documents, with their frequency class."""

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= homes:  # heads
            return pa.table({"home": pa.array([bucket - homes] * len(table), pa.int32()), "head": pa.array([True] * len(table)), "run": table.column("run")})
        parts = [unpack(r, *TOKENS) for r in table.column("run").to_pylist()]
        tokens = wide(np.concatenate([p[2] for p in parts]))
        _, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
        df = n[at]  # a text that several slices hold counts for each
        cls = np.minimum(254, (16 * np.log2(df)).astype(int)).astype("u1")
        # a token's name is what the run keeps of it; adding the bucket makes it a corpus-wide one
        name = narrow((tokens * np.uint64(M2)) ^ np.uint64(bucket * 0x9E3779B1))
        out_h, out_r, end = [], [], 0
        for number, docs, _ in parts:
            begin, end = end, end + len(docs)
            keep = df[begin:end] >= 2
            if keep.any():
                out_h.append(home_of(number[0], homes))
                out_r.append(pack(number, docs[keep], name[begin:end][keep], cls[begin:end][keep]))
        return pa.table({"home": pa.array(out_h, pa.int32()), "head": pa.array([False] * len(out_h), pa.bool_()), "run": pa.array(out_r, pa.binary())})

    return runs.groupBy("bucket").applyInArrow(count, "home int, head boolean, run binary")


def _prefixes(back: DataFrame, percent: int, hot) -> DataFrame:
    """key, n, tokens of the documents whose A prefix holds a token that is not theirs alone: those tokens."""

    def cut(table: pa.Table) -> pa.Table:
        hottest = np.sort(hot.value).view(np.int64)
        is_head = table.column("head").to_numpy()
        heads = [unpack(r, *HEADS) for r in table.filter(pa.array(is_head)).column("run").to_pylist()]
        came: dict[int, list] = {}
        for r in table.filter(pa.array(~is_head)).column("run").to_pylist():
            p = unpack(r, *BACK)
            came.setdefault(int(p[0][0]), []).append(p)
        out_k, out_n, out_t = [], [], []
        for number, keys, sizes, n_hot, hot_at in heads:
            runs = came.get(int(number[0]), [])
            docs, name, cls = (np.concatenate([r[i] for r in runs] or [np.zeros(0, t)]) for i, t in ((1, "<u2"), (2, "V5"), (3, "u1")))
            name = wide(name).view(np.int64)
            order = np.lexsort((name, cls, docs))
            name, many = name[order], np.bincount(docs, minlength=len(keys))
            slots = needed(sizes.astype(np.int64), percent) - (sizes - many - n_hot)
            first, first_hot = np.cumsum(many) - many, np.cumsum(n_hot) - n_hot
            for i in np.flatnonzero(slots > 0):
                own = name[first[i] : first[i] + min(slots[i], many[i])]
                rest = hottest[hot_at[first_hot[i] : first_hot[i] + min(slots[i] - len(own), n_hot[i])]]  # hot ones follow each other by hash
                out_k.append(keys[i].tobytes().hex())
                out_n.append(int(sizes[i]))
                out_t.append(np.concatenate([own, rest]))
        return pa.table({"key": pa.array(out_k, pa.string()), "n": pa.array(out_n, pa.int64()), "tokens": pa.array(out_t, pa.list_(pa.int64()))})

    return back.groupBy("home").applyInArrow(cut, "key string, n long, tokens array<long>")


def shared(sets_a: list[np.ndarray], sets_b: list[np.ndarray], count: bool) -> np.ndarray:
    """For each pair of rows, how many tokens they share (or whether they share one)."""
    out = np.zeros((len(sets_a), len(sets_b)), np.int32 if count else bool)
    if not sets_a or not sets_b:
        return out
    t = np.concatenate([*sets_a, *sets_b])
    if not len(t):
        return out
    row = np.concatenate([np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (sets_a, sets_b)])
    side = np.repeat([0, 1], [sum(map(len, sets_a)), sum(map(len, sets_b))])
    order = np.lexsort((side, t))
    t, row, side = t[order], row[order], side[order]
    begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    end = np.r_[begin[1:], len(t)]
    middle = begin + np.add.reduceat(1 - side, begin)
    both = (middle > begin) & (middle < end)
    for a, m, b in zip(begin[both].tolist(), middle[both].tolist(), end[both].tolist()):
        if m - a == 1:
            i = row[a]
            if count:
                out[i, row[m:b]] += 1
            else:
                out[i, row[m:b]] = True
        elif count:
            out[np.ix_(row[a:m], row[m:b])] += 1
        else:
            out[np.ix_(row[a:m], row[m:b])] = True
    return out


def prefix(s: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The prefix of a set under permutation ``order`` of the hash space."""
    if order == 0:
        return s[: needed(np.array(len(s)), percent)]
    h = mix(s, M2)
    return h[np.argpartition(h, p - 1)[:p]] if (p := int(needed(np.array(len(s)), percent))) < len(h) else h


def compare(a: pd.DataFrame, b: pd.DataFrame, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row of a, row of b)."""
    sa, sb = ([shingles(word_list(zlib.decompress(z)), k) for z in x["z"]] for x in (a, b))
    na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
    ok = shared([np.asarray(t, np.int64) for t in a["tokens"]], [np.asarray(t, np.int64) for t in b["tokens"]], False)
    ok &= (100 * na[:, None] >= percent * nb) & (100 * nb >= percent * na[:, None])
    for order in (0, 1):
        rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(rows):
            return np.zeros(0, int), np.zeros(0, int)
        ok[np.ix_(rows, cols)] &= shared([prefix(sa[i], percent, order) for i in rows], [prefix(sb[i], percent, order) for i in cols], False)
    rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    both = shared([sa[i] for i in rows], [sb[i] for i in cols], True).astype(np.int64)
    hit = ok[np.ix_(rows, cols)] & (100 * both >= percent * (na[rows][:, None] + nb[cols] - both))
    x, y = np.nonzero(hit)
    return rows[x], cols[y]


def similar(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_tokens: int = 4_000_000,
    block_rows: int = 512,
    with_class: bool = False,
) -> DataFrame:
    """Per row: id, n_shingles, component_id; ``with_class`` adds ``key`` (of the row's words) and ``class`` (the least key of its component, null without words).

    Documents link when ``100 * intersection >= percent * union`` of their
    shingle sets. Null texts and texts without words have no shingles and link
    with nothing; texts of fewer words are one shingle. Copies share a
    component; rows without an id share it too but don't name it. Other
    columns aren't read; an empty table gives an empty result.
    """
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    light = settle(_light(x, words), "light")
    rows = light.where("kind = 0")
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    spark = docs.sparkSession
    common = light.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(64, total["docs"] // 100))
    hot_set = common.select("id").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)  # at most 100 mean set sizes
    hot = spark.sparkContext.broadcast(hot_set)
    buckets = 1 << max(3, int(np.ceil(np.log2(max(1, total["words"] / bucket_tokens)))))
    kept = settle(_prefixes(_frequencies(_runs(x, words, buckets, hot), buckets), percent, hot).dropDuplicates(["key"]), "prefixes")
    token = kept.select("key", F.explode(F.array_distinct("tokens")).alias("token"))
    group = token.groupBy("token").agg(F.min("key").alias("low"), F.count("*").alias("docs")).where("docs > 1")
    clusters = components(token.join(group, "token").where("low < key").select("low", "key").distinct(), "low", "key")
    size = clusters.groupBy("component").agg(F.count("*").alias("docs"))
    # small clusters are packed; larger ones are cut into blocks
    small = F.col("docs") <= block_rows // 4
    packs = F.greatest(F.lit(1), F.lit(int(np.ceil(_sum(size.where(small), "docs") / block_rows))))
    size = size.withColumn("home", F.when(small, F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), packs))).otherwise(F.col("component")))
    size = size.withColumn("cuts", F.when(small, 1).otherwise(F.ceil(F.col("docs") / block_rows)).cast("long"))
    placed = clusters.withColumnRenamed("node", "key").join(size, "component").select("key", "home", F.pmod(F.xxhash64("key"), "cuts").alias("block"))
    # texts of the clustered documents, one of each key: that with the smallest id
    first = rows.groupBy("key").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("id"))
    placed = _keyed(x).join(placed.join(kept.select("key", "tokens"), "key").join(first, "key"), ["id", "key"]).dropDuplicates(["id", "key"])
    placed = settle(placed.select("key", "home", "block", "z", "tokens"), "placed")
    at = placed.select("home", "block", F.explode("tokens").alias("token")).distinct()
    other = at.select("home", "token", F.col("block").alias("other"))
    pairs = settle(at.join(other, ["home", "token"]).where("block <= other").select("home", "block", "other").distinct(), "pairs")
    left = placed.join(pairs, ["home", "block"])
    right = placed.withColumnRenamed("block", "other").join(pairs, ["home", "other"]).select(*left.columns)
    right = right.toDF(*right.columns)

    def edges(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if key[1] == key[2]:
            b = a
        i, j = compare(a, b, words, percent)
        names = a["key"].to_numpy() if key[1] == key[2] else np.concatenate([a["key"].to_numpy(), b["key"].to_numpy()])
        j = j if key[1] == key[2] else j + len(a)
        low = names[local_components(len(names), i, j)]
        _words.clear()
        out = pd.DataFrame({"low": low, "key": names})
        return out[out["low"] != out["key"]]

    by = ["home", "block", "other"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(edges, "low string, key string")
    linked = components(found, "low", "key").withColumnRenamed("node", "key")
    named = rows.select("id", "n", "key").join(linked, "key", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("component", "key")))
    named = settle(named.select("id", "n", "class", *(["key"] * with_class)), "named")
    least = named.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    return named.join(least, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), *(["key", "class"] * with_class)
    )


def with_keys(texts: DataFrame, key_col: str = "key", text_col: str = "text") -> DataFrame:
    """``texts`` (of any columns) with the key of their words, as ``similar`` gives it."""
    at, names = texts.columns.index(text_col), [*texts.columns, key_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            keys = [key_of(word_list(t.as_py())).hex() for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=names)

    return texts.mapInArrow(lambda batches: tidy(run(batches), _words), StructType([*texts.schema, StructField(key_col, StringType())]))


def _sum(df: DataFrame, col: str) -> int:
    return df.agg(F.coalesce(F.sum(col), F.lit(0))).first()[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """id, key and the text compressed, for every row."""
    names = ["id", "key", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            keys = [key_of(word_list(t)).hex() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())], names=names)

    return docs.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text").mapInArrow(run, "id long, key string, z binary")
