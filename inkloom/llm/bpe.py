"""Byte-level BPE encoding and decoding of whole texts.

The merge loop keeps a priority queue of (rank, position) over a doubly linked
list of symbols; entries whose symbols have changed since they were pushed are
stale and skipped. A pretoken of n bytes costs O(n log n). Pretokens repeat, so
each worker keeps the ids of recent ones, in a cache of bounded size. Decoding
concatenates vocabulary strings and maps their characters back to bytes.

The vocabulary file is a parameter. The driver reads it once and broadcasts
its fixed size (about 1 MB), so executors need no copy of the file.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

from inkloom.llm.common import slices, tidy

#: The byte-level split, with white space as Unicode defines it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CACHE = 1 << 17  # pretokens whose ids a worker keeps, twice


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: itself, or the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def unsupported(d: dict) -> list[str]:
    """What a tokenizer file asks for that would change ids and isn't done here."""
    model, said = d["model"], []
    if d.get("normalizer"):
        said.append("normalizer")
    if model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        said.append("model")
    pre = d.get("pre_tokenizer") or {"type": "ByteLevel"}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        said.append("pre_tokenizer")
    if any(t.get(k) for t in d.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        said.append("added_tokens")
    return said


class ByteBPE:
    """Encoder and decoder for one byte-level vocabulary (a tokenizers JSON file)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        if said := unsupported(d):
            raise ValueError(f"this encoder doesn't know the file's {', '.join(said)}")
        vocab: dict[str, int] = d["model"]["vocab"]
        letters = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.piece = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for i, t in strings.items()}
        self.decimal = {i: str(i) for i in strings}
        self.split = regex.compile(SPLIT)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        #: Recent pretokens, and those before them that were used again.
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pretoken's bytes."""
        ids, n, merges = list(map(self.first.__getitem__, data)), len(data), self.merges.get
        if n == 1:
            return ids
        queue = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merges((a, b)))]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(queue)
        while queue:
            _, i, a, b, new = heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges((new, ids[k])):
                    heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges((ids[h], new))):
                heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _known(self, token: str) -> tuple[int, ...]:
        ids = self.cache.get(token) or self.old.pop(token, None) or tuple(self.merge(token.encode()))
        if len(token) <= 64:
            if len(self.cache) >= CACHE:
                self.cache, self.old = {}, self.cache
            self.cache[token] = ids
        return ids

    def clear(self) -> None:
        self.cache, self.old = {}, {}

    def encode(self, text: str | None) -> list[int]:
        out, get, known = [], self.cache.get, self._known
        for k, piece in enumerate(self.cut.split(text or "") if self.cut else (text or "",)):
            if k % 2:
                out.append((self.special[piece],))
            elif piece:
                out += [get(t) or known(t) for t in self.split.findall(piece)]
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def _loaded(spec: str) -> ByteBPE:
    return ByteBPE(spec)


def _broadcast(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _map(docs: DataFrame, keep: list[str], text_col: str, path: str, schema: str, row) -> DataFrame:
    """``row(bpe, text)`` gives the new columns' values; ``keep`` passes through."""
    spec = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch], bpe: ByteBPE) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)) if text else batches:
            got = [row(bpe, t.as_py()) for t in batch.column(len(keep))]
            cols = [*batch.columns[: len(keep)], *(pa.array([g[i] for g in got], t) for i, t in enumerate(types))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    new = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in new]
    x = docs.select(*keep, text_col)
    full = StructType([*(x.schema[c] for c in keep), *new])
    names = full.names
    text = isinstance(x.schema[text_col].dataType, StringType)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        return tidy(run(batches, bpe), bpe)

    return x.mapInArrow(task, full)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """``keep`` columns (all but the text) plus ``ids`` and ``n_tokens``; with ``check``, the SHA-256 of the decoded text too.

    Null and empty texts have no ids; very long texts are encoded whole;
    repeated rows stay. Kept columns named ids or n_tokens are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "ids", "n_tokens", "decoded_sha256")]

    def row(bpe: ByteBPE, text: str | None):
        ids = bpe.encode(text)
        return (ids, len(ids), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()) if check else (ids, len(ids))

    return _map(docs, keep, text_col, path, "ids array<int>, n_tokens long" + ", decoded_sha256 string" * check, row)


def decode(tokens: DataFrame, path: str, *, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the ids) plus ``text``; null ids decode to the empty text."""
    keep = [c for c in (tokens.columns if keep is None else keep) if c not in (ids_col, "text")]
    return _map(tokens, keep, ids_col, path, "text string", lambda bpe, ids: (bpe.decode(ids or []),))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the comma-joined ids and of the text decoded from them."""

    def row(bpe: ByteBPE, text: str | None):
        ids = bpe.encode(text)
        listed = ",".join(map(bpe.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return _map(docs, [id_col], text_col, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
