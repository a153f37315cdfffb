"""Exact substring dedup by longest-previous-factor arrays over suffix order.

A byte goes when a string of ``length`` bytes that covers it also starts
elsewhere (``keep="none"``), or starts earlier in the corpus (``keep="first"``:
later copies go and the first stays). The steps:

1. Each string of ``length`` bytes has a signature, the least hash of the
   48-byte strings in it; equal strings have equal signatures, and neighbours
   mostly share theirs (about one signature for 75 bytes). Signatures are
   counted over all distinct texts; a string whose signature occurs once has
   no copy, and texts without a repeated signature leave here.
2. Runs of strings of one repeated signature travel as segments to the bucket
   of the signature. A bucket sorts its suffixes (by 8-byte words, ties by the
   next word), takes the lengths of common prefixes of neighbours, and from
   previous and next smaller positions in suffix order the longest previous
   factor of each position; with positions reversed, the longest later one.
3. Signatures of ``hot_texts`` texts or more (a passage that a third of the
   corpus shares) would overfill a bucket. Their strings travel as 128-bit
   hashes instead, one for each string of a batch, dealt by the hash; so no
   signature, passage or group of copies lands in one task. There the hashes are
   the suffix order as far as it is needed (equal strings are neighbours), and
   the same arrays of smaller positions give the factors of ``length`` bytes.
4. Marked strings return to their text, which loses the bytes they cover.
   Texts travel compressed.

Exact copies of a text are one row with a count throughout.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import settle, slices

GRAM = 48
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = -(1 << 63)
SEGMENTS = "kind int, bucket int, sid long, k1 long, k2 long, v long, start int, data binary"
MARKS = "k1 long, k2 long, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def words_at(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The 8-byte word at every offset of a uint8 array (a view)."""
    return np.ndarray((max(0, len(data) - 7),), order, data, strides=(1,))


def signatures(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature of each string of ``length`` bytes, hash of each of GRAM bytes)."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    w = words_at(data)
    n = len(data) - GRAM + 1
    h = w[:n]
    for o in range(8, GRAM, 8):
        h = mixed(h * M1 + w[o : o + n])
    h = mixed(h * M1)
    span, low, have = length - GRAM + 1, h, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return low, h


def key_of(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _light(docs: DataFrame, length: int) -> DataFrame:
    """sid, key, n_bytes, sha of each row, its signatures, and those that the text itself repeats."""
    names = ["sid", "k1", "k2", "n_bytes", "sha", "sigs", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = {n: [] for n in names}
            for sid, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
                sig, h = signatures(np.frombuffer(text, np.uint8), length)
                found = np.unique(sig)
                values, n = np.unique(h[np.isin(h, found)], return_counts=True)
                row = (sid, *key_of(text), len(text), hashlib.sha256(text).hexdigest(), found.view(np.int64), values[n > 1].view(np.int64))
                for name, x in zip(names, row):
                    out[name].append(x)
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=names)

    return docs.mapInArrow(run, "sid long, k1 long, k2 long, n_bytes long, sha string, sigs array<long>, again array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """sid, the text compressed, and its key; a row that a slice repeats is one row."""
    names = ["sid", "z", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = _bytes(batch.column(1))
            rows = {(sid, *key_of(t)): t for sid, t in zip(batch.column(0).to_pylist(), texts)}
            z = pa.array([zlib.compress(t, 1) for t in rows.values()], pa.binary())
            sid, k1, k2 = (pa.array([r[i] for r in rows], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([sid, z, k1, k2], names=names)

    return docs.mapInArrow(run, "sid long, z binary, k1 long, k2 long")


def hashes(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the strings of ``length`` bytes at ``at``."""
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for j, o in enumerate(offsets):
        x = mixed(words[at + o] + np.uint64((j + 1) * int(M1) % (1 << 64)))
        a += x
        b += mixed(x ^ M1)
    return a, b


def _segments(cand: DataFrame, length: int, buckets: int) -> DataFrame:
    """kind 0: segments of signatures; 1: marks found within a batch; 2: packed hashes of strings with a hot signature."""
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("sid", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("v", pa.int64()), ("start", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, 1 << 22):
            sids, k1s, k2s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            rows: list[tuple] = []
            hot_h1, hot_h2, hot_at, hot_text = [], [], [], []
            for i, (z, sigs, hot) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5))):
                text = zlib.decompress(z)
                data = np.frombuffer(text, np.uint8)
                low, _ = signatures(data, length)
                if not len(low):
                    continue
                sigs, hot = (np.array(x.as_py() or [], np.int64).view(np.uint64) for x in (sigs, hot))
                edge = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                end = np.r_[edge[1:], len(low)]
                v = low[edge]
                on, heat = np.isin(v, sigs), np.isin(v, hot)
                for a, b, x in zip(edge[on & ~heat].tolist(), end[on & ~heat].tolist(), v[on & ~heat].tolist()):
                    rows.append((0, x % buckets, sids[i], k1s[i], k2s[i], x - (1 << 64) if x >> 63 else x, a, text[a : b - 1 + length]))
                if heat.any():
                    at = np.concatenate([np.arange(a, b) for a, b in zip(edge[heat], end[heat])])
                    h1, h2 = hashes(words_at(data), at, length)
                    hot_h1.append(h1)
                    hot_h2.append(h2)
                    hot_at.append(at)
                    hot_text.append(np.full(len(at), i))
            if hot_h1:
                rows += _hot_rows(*map(np.concatenate, (hot_h1, hot_h2, hot_at, hot_text)), sids, k1s, k2s, buckets)
            for a in range(0, len(rows), 20_000):
                part = rows[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    return cand.select("sid", "k1", "k2", "z", "sigs", "hot").mapInArrow(run, SEGMENTS)


def _hot_rows(h1, h2, at, text, sids, k1s, k2s, buckets: int) -> list[tuple]:
    """One packed row for each bucket: h1, h2, text and offset of the first such string of the batch, and their number (2: or more)."""
    order = np.lexsort((at, text, sids[text], h2, h1))
    h1, h2, at, text = h1[order], h2[order], at[order], text[order]
    first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    many = np.diff(np.r_[first, len(h1)])
    later = np.ones(len(h1), bool)
    later[first] = False
    rows = [(1, int(k1s[i]) % buckets, sids[i], k1s[i], k2s[i], 0, 0, at[later & (text == i)].astype(np.int32).tobytes()) for i in np.unique(text[later])]
    h1, h2, at, text, many = h1[first], h2[first], at[first], text[first], np.minimum(many, 2)
    bucket = h1 % np.uint64(buckets)
    for b in np.unique(bucket):
        on = np.flatnonzero(bucket == b)
        used, local = np.unique(text[on], return_inverse=True)
        head = np.array([len(used), len(on)], np.int64)
        data = [head, sids[used], k1s[used], k2s[used], h1[on], h2[on], local.astype(np.int32), at[on].astype(np.int32), many[on].astype(np.int8)]
        rows.append((2, int(b), 0, 0, 0, 0, 0, b"".join(x.tobytes() for x in data)))
    return rows


def _unpacked(run: bytes) -> tuple:
    nt, n = np.frombuffer(run, np.int64, 2)
    at, out = 16, []
    for dtype, count in ((np.int64, nt), (np.int64, nt), (np.int64, nt), (np.uint64, n), (np.uint64, n), (np.int32, n), (np.int32, n), (np.int8, n)):
        out.append(np.frombuffer(run, dtype, count, at))
        at += count * np.dtype(dtype).itemsize
    sid, k1, k2, h1, h2, local, start, many = out
    return sid[local], k1[local], k2[local], h1, h2, start, many


def _marks(k1: np.ndarray, k2: np.ndarray, start: np.ndarray) -> pa.Table:
    """One row for each text: the offsets of its marked strings."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start = k1[order], k2[order], start[order]
    first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.zeros(0, int)
    data = [x.astype(np.int32).tobytes() for x in np.split(start, first[1:])] if len(k1) else []
    return pa.table({"k1": pa.array(k1[first], pa.int64()), "k2": pa.array(k2[first], pa.int64()), "data": pa.array(data, pa.binary())})


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``length`` bytes, and each one's common prefix with the one before (at most ``length``).

    Suffixes that agree in all of those bytes stay in the order of ``at``.
    """
    w = words_at(data, ">u8")
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    order = np.argsort(w[at].astype(np.uint64), kind="stable")
    key = w[at[order]].astype(np.uint64)
    lcp = np.full(len(at), length, np.int64)
    slots, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    steps = 256 ** np.arange(1, 9, dtype=object)

    def cut(slots, group, key, offset):
        """Set the prefixes where neighbours part, and keep the slots that are still tied."""
        differ = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        parted = np.flatnonzero(differ[1:] & (group[1:] == group[:-1])) + 1
        x = key[parted] ^ key[parted - 1]
        equal = 8 - sum((x >= np.uint64(s // 256)).astype(np.int64) for s in steps)
        lcp[slots[parted]] = np.minimum(lcp[slots[parted]], offset + equal)
        group = np.cumsum(differ)
        tied = ~(differ & np.r_[differ[1:], True])
        return slots[tied], group[tied]

    slots, group = cut(slots, group, key, 0)
    if len(at):
        lcp[0] = 0
    for j, o in enumerate(offsets[1:], 1):
        if not len(slots):
            break
        here = at[order[slots]]
        if j == 4:  # most that are tied here agree to the end: leave those groups out of the further words
            rest, _ = hashes(words_at(data), here, length)
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            uneven = np.minimum.reduceat(rest, begin) != np.maximum.reduceat(rest, begin)
            on = np.repeat(uneven, np.diff(np.r_[begin, len(group)]))
            slots, group, here = slots[on], group[on], here[on]
            if not len(slots):
                break
        key = w[here + o].astype(np.uint64)
        by = np.lexsort((key, group))
        order[slots] = order[slots[by]]
        slots, group = cut(slots, group, key[by], o)
    return order, lcp


def previous_factors(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each suffix (in suffix order), where it reaches ``least``; else less than that.

    ``position`` and ``lcp`` are in suffix order. Previous and next smaller
    positions are found by jumping along earlier answers.
    """
    n = len(position)
    best = np.zeros(n, np.int64)
    for backward in (False, True):
        p, common = (position, lcp) if not backward else (position[::-1], np.r_[0, lcp[:0:-1]])
        to, reach = np.arange(n) - 1, common.copy()
        active = np.flatnonzero((to >= 0) & (reach >= least))
        while len(active):
            found = p[to[active]] < p[active]
            active = active[~found]
            past = to[active]
            reach[active], to[active] = np.minimum(reach[active], reach[past]), to[past]
            active = active[(to[active] >= 0) & (reach[active] >= least)]
        got = np.where((to >= 0) & (reach >= least), reach, 0)
        best = np.maximum(best, got[::-1] if backward else got)
    return best


def factors_in_bucket(segments: list[bytes], length: int, keep: str) -> list[np.ndarray]:
    """For each segment (in corpus order), which of its strings have a copy: an earlier one, or with ``keep="none"`` any."""
    first: dict[bytes, int] = {}
    owner = [first.setdefault(s, i) for i, s in enumerate(segments)]
    copies = np.bincount(owner, minlength=len(segments))
    distinct = np.flatnonzero(copies)
    data = np.frombuffer(b"".join(segments[i] for i in distinct), np.uint8)
    sizes = np.array([len(segments[i]) for i in distinct])
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    many = sizes - length + 1
    at = np.concatenate([np.arange(b, b + m) for b, m in zip(base, many)]) if len(distinct) else np.zeros(0, int)
    order, lcp = suffix_order(data, at, length)
    flag = np.zeros(len(at), bool)
    flag[order] = previous_factors(order, lcp, length) >= length
    if keep == "none":
        flag[order] |= previous_factors(-order, lcp, length) >= length
    flags = dict(zip(distinct.tolist(), np.split(flag, np.cumsum(many)[:-1])))
    return [np.ones_like(flags[o]) if o != i or (keep == "none" and copies[o] > 1) else flags[o] for i, o in enumerate(owner)]


def dedup(
    docs: DataFrame,
    *,
    length: int = 200,
    keep: str = "none",
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_texts: int = 256,
    bucket_bytes: int = 8_000_000,
    with_text: bool = False,
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, ``kept``, if ``with_text``).

    Null texts are empty; texts shorter than ``length`` lose nothing; repeated
    rows are copies of each other. With ``keep="first"`` the corpus is ordered
    by id (null first); rows that share the smallest id of a text all count as
    the first, and keep what only they and later texts hold. Other columns aren't read; an empty table gives an empty result.
    """
    if length < GRAM + 16 or keep not in ("none", "first"):
        raise ValueError("length must be 64 or more, keep 'none' or 'first'")
    x = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("sid"), F.col(text_col).alias("text"))
    light = settle(_light(x, length), "light")
    texts = light.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("sid").alias("rep"), F.first("sigs").alias("sigs"), F.first("again").alias("again"))
    texts = settle(texts, "texts")
    sig = texts.select("k1", "k2", F.explode("sigs").alias("v"))
    counts = texts.select(F.explode(F.concat("sigs", "again")).alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    hot = F.col("n") >= hot_texts  # a bucket's signature has fewer segments than that, whatever the corpus
    found = sig.join(counts, "v").groupBy("k1", "k2").agg(F.collect_list("v").alias("sigs"), F.collect_list(F.when(hot, F.col("v"))).alias("hot"))
    cand = texts.select("k1", "k2", F.col("rep").alias("sid")).join(found, ["k1", "k2"])
    # rows that repeat a text's first id are one: none of them is an earlier copy of another
    cand = _keyed(x.where(F.octet_length("text") >= length)).join(cand, ["sid", "k1", "k2"]).dropDuplicates(["sid", "k1", "k2"])
    cand = settle(cand, "candidates")
    runs = cand.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0))).first()[0]
    segments = _segments(cand, length, max(32, runs * (length + 100) // bucket_bytes))

    def cold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sid", "ascending"), ("k1", "ascending"), ("start", "ascending")])
        parts = factors_in_bucket(table.column("data").to_pylist(), length, keep)
        k1, k2, start = (table.column(c).to_numpy() for c in ("k1", "k2", "start"))
        size = [int(p.sum()) for p in parts]
        starts = np.concatenate([np.flatnonzero(p) + s for p, s in zip(parts, start)]) if parts else start
        return _marks(np.repeat(k1, size), np.repeat(k2, size), starts)

    def hottest(table: pa.Table) -> pa.Table:
        parts = [_unpacked(r) for r in table.column("data").to_pylist()]
        sid, k1, k2, h1, h2, start, n = (np.concatenate(c) for c in zip(*parts))
        position = np.empty(len(sid), np.int64)
        position[np.lexsort((start, k1, sid))] = np.arange(len(sid))
        # hashes stand for the first ``length`` bytes in suffix order: neighbours share them all or, where hashes part, count as sharing nothing
        order = np.lexsort((position, h2, h1))
        position, k1, k2, h1, h2, start, n = (c[order] for c in (position, k1, k2, h1, h2, start, n))
        lcp = np.r_[0, np.where((h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]), length, 0)]
        on = previous_factors(position, lcp, length) >= length
        if keep == "none":
            on |= (previous_factors(-position, lcp, length) >= length) | (n > 1)
        return _marks(k1[on], k2[on], start[on])

    def bucket(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        parts = [table.filter(pa.array(kind == 1)).select(["k1", "k2", "data"])]
        parts += [f(table.filter(pa.array(kind == k))) for k, f in ((0, cold), (2, hottest)) if (kind == k).any()]
        return pa.concat_tables(p.cast(parts[0].schema) for p in parts)

    marks = segments.groupBy("bucket").applyInArrow(bucket, MARKS)
    marks = marks.groupBy("k1", "k2").agg(F.collect_list("data").alias("marks"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, lists in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = np.frombuffer(zlib.decompress(z), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                start = np.frombuffer(b"".join(lists), np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = data[~gone].tobytes()
                out.append((int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["k1", "k2", "n_removed", "n_spans", "new_sha", "kept"])

    cut = cand.select("k1", "k2", "z").join(marks, ["k1", "k2"]).mapInArrow(strip, "k1 long, k2 long, n_removed long, n_spans long, new_sha string, kept binary")
    state = texts.select("k1", "k2", "copies", "rep").join(cut.dropDuplicates(["k1", "k2"]), ["k1", "k2"], "left")
    y = light.drop("sigs", "again").join(state, ["k1", "k2"])
    again = (F.col("n_bytes") >= length) & ((F.col("copies") > 1) if keep == "none" else (F.col("sid") != F.col("rep")))
    value = lambda whole, part, own: F.when(again, whole).otherwise(F.coalesce(part, own))
    out = y.select(
        F.when(F.col("sid") != NO_ID, F.col("sid")).alias(id_col),
        "n_bytes",
        value(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        value(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        value(F.lit(hashlib.sha256(b"").hexdigest()), F.col("new_sha"), F.col("sha")).alias("kept_sha256"),
        *([F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return out
