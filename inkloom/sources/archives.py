"""Entries of ZIP archives, listed from central directories and read by range; and files extracted from them.

No archive is ever a row, and none is read whole: a listing reads the directory
at an archive's end, and a task that wants an entry reads that entry's bytes
alone. So a large archive is shared by as many tasks as its entries deserve.
Files open through ``pyarrow.fs``, by the paths that Spark's listing gives.

Extraction leaves nothing half done. Tasks stream entries to files of names of
their own in a staging folder; the rows that Spark commits say which of these
count (an attempt that was lost has no row); these are moved to their places, the
manifest with their digests is written last, and the staging folder goes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkloom.functions.text import natural_key

# Names of images in archives.
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff")
# End of the fixed values.
ENTRY = "archive string, entry string, bytes long, packed long, offset long, method int, crc long, error string"
STEP = 1 << 20  # bytes of an entry that are held at a time
MOST = (1 << 31) - (1 << 20)  # bytes of an entry that fit in a row
RANGE = 1 << 26  # packed bytes that a task reads, about


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def list_entries(spark: SparkSession, path: str, *, names: tuple[str, ...] | None = IMAGES, glob: str = "*.{cbz,zip,CBZ,ZIP}") -> DataFrame:
    """archive, entry, ordinal (natural order from 0), bytes, packed, offset, method, crc of the entries of the archives below ``path``.

    ``names``: endings of the entries to list, in any case (None: all but
    folders). An unreadable archive is one row with its ``error``; an archive
    without such entries, and an empty file, has no row. Entries of one name keep their order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for archive in p["path"]:
                try:
                    with _open(archive) as f, zipfile.ZipFile(f) as z:
                        rows = [
                            (archive, i.filename, i.file_size, i.compress_size, i.header_offset, -1 if i.flag_bits & 1 else i.compress_type, i.CRC, None)
                            for i in z.infolist() if not i.is_dir() and (names is None or i.filename.lower().endswith(names))
                        ]
                except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, ValueError) as e:
                    rows = [(archive, *[None] * 6, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")]).astype({c: "Int64" for c in ("bytes", "packed", "offset", "method", "crc")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")  # names alone: contents are pruned
    x = files.repartition(F.col("path")).mapInPandas(run, ENTRY)
    order = W.partitionBy("archive").orderBy(natural_key(F.col("entry")), "entry", "offset")
    return x.withColumn("ordinal", F.row_number().over(order) - 1)


def chunks(f, offset: int, packed: int, size: int, method: int, crc: int) -> Iterator[bytes]:
    """The bytes of the entry whose header is at ``offset``, in pieces; raises ValueError where they aren't what the directory says."""
    if method not in (0, 8):
        raise ValueError("encrypted" if method < 0 else f"compression method {method}")
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise ValueError("no entry where the directory says")
    f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    seen = check = 0
    for out in _unpacked(f, packed) if method else _plain(f, packed):
        seen, check = seen + len(out), zlib.crc32(out, check)
        if seen > size:
            raise ValueError("longer than the directory says")
        yield out
    if seen != size or check != crc:
        raise ValueError("not the bytes that the directory says")


def _plain(f, packed: int) -> Iterator[bytes]:
    while packed and (raw := f.read(min(packed, STEP))):
        packed -= len(raw)
        yield raw
    if packed:
        raise ValueError("the archive ends within the entry")


def _unpacked(f, packed: int) -> Iterator[bytes]:
    """Inflated pieces of at most ``STEP`` bytes, however far the entry is packed."""
    unpack = zlib.decompressobj(-15)
    try:
        for raw in _plain(f, packed):
            while out := unpack.decompress(raw, STEP):
                yield out
                raw = unpack.unconsumed_tail
        while out := unpack.decompress(b"", STEP):
            yield out
    except zlib.error as e:
        raise ValueError(str(e)) from None


def dealt(entries: DataFrame) -> DataFrame:
    """Entries dealt to tasks by ranges of their archives, so that one large archive is many tasks' work."""
    return entries.repartition(F.col("archive"), F.floor(F.col("offset") / RANGE))


def _with(entries: DataFrame, run, new: str) -> DataFrame:
    x = dealt(entries)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema), new])
    return x.mapInPandas(run, schema)


def read_entries(entries: DataFrame) -> DataFrame:
    """``entries`` (of ``list_entries``, filtered at will) with ``content`` and its ``sha256``; an entry that can't be read has an ``error`` instead.

    Entries of 2 GB or more don't fit in a row and are errors here; ``extract`` takes them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for i in range(len(p)):  # a row at a time: one entry is held
                row = p.iloc[i : i + 1]
                content = digest = None
                error = row["error"].iloc[0]
                if not error:
                    r = row.iloc[0]
                    try:
                        if r["bytes"] > MOST:
                            raise ValueError("too long for a row")
                        with _open(r["archive"]) as f:
                            content = b"".join(chunks(f, int(r["offset"]), int(r["packed"]), int(r["bytes"]), int(r["method"]), int(r["crc"])))
                        digest = hashlib.sha256(content).hexdigest()
                    except (OSError, ValueError) as e:
                        error = str(e) or type(e).__name__
                yield row.assign(error=error, content=[content], sha256=digest)

    return _with(entries.drop("content", "sha256"), run, "content binary, sha256 string")


def extract(entries: DataFrame, folder: str, *, path_col: str = "output_relpath") -> DataFrame:
    """Write each entry to ``folder``/``path_col``; the manifest (``entries`` with output_bytes, output_sha256 and error) is written to ``folder``/manifest and returned.

    Of entries with one path the first (by archive and offset) is written, the
    others are errors, as are paths that leave the folder and entries whose
    bytes aren't what their directory says; none of these leaves a file. A run
    that fails leaves no manifest and nothing but its staging folder; extracting
    again replaces files. Entries of any length are streamed.
    """
    spark = entries.sparkSession
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    w = W.partitionBy(path_col).orderBy("archive", "offset")
    bad = F.col(path_col).isNull() | (F.col(path_col) == "") | F.col(path_col).rlike(r"^/|(?:^|/)\.\.(?:/|$)|^_staging|^manifest(?:/|$)")
    x = entries.drop("output_bytes", "output_sha256").withColumn("_nth", F.row_number().over(w))
    x = x.withColumn("error", F.coalesce(F.col("error"), F.when(bad, "no path in the folder"), F.when(F.col("_nth") > 1, "another entry has this path"))).drop("_nth")

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = f"{staging}/{uuid.uuid4().hex}"  # of this attempt alone
        store, base = fs.FileSystem.from_uri(mine)
        store.create_dir(base, recursive=True)
        n = 0
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                staged = digest = size = None
                error = r.error
                if not error:
                    n += 1
                    staged = f"{mine}/{n}"
                    try:
                        hashed, size = hashlib.sha256(), 0
                        with _open(r.archive) as f, store.open_output_stream(f"{base}/{n}") as to:
                            for piece in chunks(f, int(r.offset), int(r.packed), int(r.bytes), int(r.method), int(r.crc)):
                                to.write(piece)
                                hashed.update(piece)
                                size += len(piece)
                        digest = hashed.hexdigest()
                    except (OSError, ValueError) as e:
                        error, staged, size = str(e) or type(e).__name__, None, None
                out.append((staged, size, digest, error))
            new = pd.DataFrame(out, columns=["_staged", "output_bytes", "output_sha256", "error"], index=p.index).astype({"output_bytes": "Int64"})
            yield p.drop(columns="error").assign(**new)[[*p.columns, "_staged", "output_bytes", "output_sha256"]]

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for p in batches:
            for staged, to in zip(p["_staged"], p[path_col]):
                if staged:
                    source, target = fs.FileSystem.from_uri(staged)[1], f"{base}/{to}"
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    if store.get_file_info(source).type == fs.FileType.File:  # else an attempt before this one has moved it
                        store.move(source, target)
            yield p.drop(columns="_staged")

    try:
        _with(x, stage, "_staged string, output_bytes long, output_sha256 string").write.parquet(f"{staging}/rows")
        staged = spark.read.parquet(f"{staging}/rows")
        done = staged.mapInPandas(move, staged.drop("_staged").schema)
        done.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    finally:
        store, base = fs.FileSystem.from_uri(staging)
        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest")
