"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

A rank file lists a vocabulary of byte strings by merge rank. ``serialise``
writes it as a sentencepiece model, field by field, without training: every
byte string becomes a piece of printable stand-ins (one character a byte), its
score is its negative rank, and the normaliser is the identity (no prefix, no
white space removed or escaped). Merging the best score first is then merging
the least rank first, leftmost first among equals, as byte-level BPE asks.

Texts are split by the pattern, and each pretoken is encoded alone. A pretoken
that is a vocabulary entry is that entry, also where merges don't lead to it.
Workers keep the ids of recent pretokens in a cache of bounded size. Decoding
maps each piece's characters back to bytes.

The driver reads the file once and broadcasts the model (about 1 MB for 50,000
entries), so executors need no copy of the file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StringType, StructType

from inkloom.llm.bpe import byte_alphabet
from inkloom.llm.common import slices, tidy

#: The split of rank files, with white space as Unicode defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CACHE = 1 << 17  # pretokens whose ids a worker keeps, twice
STEP = 1 << 16  # pretokens of a text that are held at a time

LETTERS = byte_alphabet()
TO_LETTER = dict(enumerate(LETTERS))
TO_BYTE = {ord(c): b for b, c in enumerate(LETTERS)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a file with lines of base64 and rank; blank lines are skipped."""
    with open(path, "rb") as f:
        return {base64.b64decode(parts[0]): int(parts[1]) for line in f if len(parts := line.split()) == 2}


# The wire format of the model: tagged fields, numbers in groups of seven bits.


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(tag: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _number(tag << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(tag << 3 | 5) + struct.pack("<f", value)
    return _number(tag << 3) + _number(value)


def _spare_name(ranks: dict[bytes, int]) -> str:
    """A name for the unknown piece that no vocabulary entry has."""
    name = "<unk>"
    while name.encode() in ranks:
        name += "_"
    return name


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece at place i is the entry of rank i; the unknown piece comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if len(ranks) >= 1 << 24:
        raise ValueError("scores hold ranks below 2^24 only")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{len(missing)} single bytes have no rank, the first is {missing[0]}")
    if b"" in ranks:
        raise ValueError("an empty entry has no piece")
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for entry in sorted(ranks, key=ranks.__getitem__):
        piece = entry.decode("latin-1").translate(TO_LETTER).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(ranks[entry])) + _field(3, normal))
    name = _spare_name(ranks).encode()
    out += _field(1, _field(1, name) + _field(2, 0.0) + _field(3, unknown))
    out += _field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(45, name))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class PieceBPE:
    """Encoder and decoder over one serialised model."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size() - 1)]
        self.bytes = [p.translate(TO_BYTE).encode("latin-1") for p in pieces]
        self.decimal = [str(i) for i in range(len(pieces))]
        #: Entries that merges don't lead to.
        self.whole = {p: (i,) for i, (p, ids) in enumerate(zip(pieces, self.model.encode(pieces, num_threads=1))) if ids != [i]}
        self.split = regex.compile(PATTERN)
        #: Recent pretokens, and those before them that were used again.
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def clear(self) -> None:
        self.cache, self.old = {}, {}

    def _parts(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """Numbers and pretokens of texts, some ``STEP`` pretokens at a time: a part holds many short texts, a long one many parts."""
        held, size = [], 0
        for i, text in enumerate(texts):
            if len(text or "") <= STEP:
                tokens = iter((self.split.findall(text or ""),))
            else:
                found = (m.group() for m in self.split.finditer(text))
                tokens = iter(lambda: list(islice(found, STEP)), [])
            for some in tokens:
                held.append((i, some))
                size += len(some)
                if size >= STEP:
                    yield held
                    held, size = [], 0
        yield held

    def _learn(self, tokens: set[str]) -> None:
        """Put the ids of pretokens that the cache lacks into it."""
        again = [t for t in tokens if t in self.old]
        new = list(tokens.difference(again))
        mapped = [t.encode().decode("latin-1").translate(TO_LETTER) for t in new]
        self.cache.update(zip(again, map(self.old.__getitem__, again)))
        self.cache.update(zip(new, (self.whole.get(m) or tuple(ids) for m, ids in zip(mapped, self.model.encode(mapped, num_threads=1)))))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        at, ids = 0, None
        for part in self._parts(texts):
            unknown = set().union(*(tokens for _, tokens in part)).difference(self.cache)
            if unknown:
                self._learn(unknown)
            for i, tokens in part:
                if i > at:
                    yield ids
                    at, ids = i, None
                ids = [] if ids is None else ids
                ids += chain.from_iterable(map(self.cache.__getitem__, tokens))
            for t in unknown:
                if len(t) > 64:
                    del self.cache[t]
            if len(self.cache) >= CACHE:
                self.cache, self.old = {}, self.cache
        if ids is not None:
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all((text,)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> PieceBPE:
    return PieceBPE(model)


def _map(rows: DataFrame, keep: list[str], col: str, path: str, schema: str, some: Callable) -> DataFrame:
    """``keep`` passes through; ``some(bpe, values)`` gives a tuple of new columns for each value. Texts arrive as UTF-8 bytes."""
    model = rows.sparkSession.sparkContext.broadcast(serialise(read_ranks(path)))
    x = rows.select(*keep, col)
    new = StructType.fromDDL(schema)
    full = StructType([*(x.schema[c] for c in keep), *new])
    types, names, at = [to_arrow_type(f.dataType) for f in new], full.names, len(keep)
    text = isinstance(x.schema[col].dataType, (StringType, BinaryType))

    def run(batches: Iterator[pa.RecordBatch], bpe: PieceBPE) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 21) if text else batches:
            values = batch.column(at).cast(pa.binary()) if text else batch.column(at)
            got = list(some(bpe, (v.as_py() for v in values)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array([g[i] for g in got], t) for i, t in enumerate(types))], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(model.value)
        return tidy(run(batches, bpe), bpe)

    return x.mapInArrow(task, full)


def _texts(values: Iterable[bytes | None]) -> Iterator[str]:
    return ((raw or b"").decode("utf-8", errors="replace") for raw in values)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the text) plus ``ids`` and ``n_tokens``.

    Null and empty texts have no ids; texts and pretokens of any length are
    encoded whole; bytes that aren't UTF-8 read as U+FFFD; repeated rows stay.
    Kept columns named ids or n_tokens are replaced; an empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (text_col.lower(), "ids", "n_tokens")]
    return _map(docs, keep, text_col, path, "ids array<int>, n_tokens long", lambda bpe, values: ((ids, len(ids)) for ids in bpe.encode_all(_texts(values))))


def decode(tokens: DataFrame, path: str, *, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the ids) plus ``text``; null ids decode to the empty text, ids cut within a character to U+FFFD."""
    keep = [c for c in (tokens.columns if keep is None else keep) if c.lower() not in (ids_col.lower(), "text")]
    return _map(tokens, keep, ids_col, path, "text string", lambda bpe, values: ((bpe.decode(ids or []).decode("utf-8", errors="replace"),) for ids in values))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the comma-joined ids and of the bytes decoded from them; odd rows as in ``encode``."""

    def some(bpe: PieceBPE, values: Iterable[bytes | None]):
        for ids in bpe.encode_all(_texts(values)):
            listed = ",".join(map(bpe.decimal.__getitem__, ids))
            yield len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _map(docs, [id_col], text_col, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", some)
