"""Archives listed and read by range, and entries extracted: lost tasks, damage, clashes."""

import hashlib
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.operators import selection
from inkloom.sources import archives


def make(path, entries, method=zipfile.ZIP_DEFLATED):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)


@pytest.fixture
def shelf(tmp_path):
    """Two good archives, one damaged in an entry, one cut off, one encrypted by its flag, and an empty file."""
    rng = random.Random(1)
    top = str(tmp_path / "in")
    pages = {f"p{i}.{e}": rng.randbytes(rng.randint(0, 5000)) + b"\0" * 40_000 for i, e in ((1, "png"), (2, "jpg"), (10, "PNG"), (3, "webp"))}
    make(f"{top}/a/v1.cbz", [*pages.items(), ("notes.txt", b"no image"), ("sub/", b""), ("empty.png", b"")])
    make(f"{top}/a/v2.ZIP", [(n, d[::-1]) for n, d in pages.items()], zipfile.ZIP_STORED)
    make(f"{top}/b/hurt.zip", list(pages.items()), zipfile.ZIP_STORED)
    with open(f"{top}/b/hurt.zip", "r+b") as f:
        f.seek(60)
        f.write(b"damage")
    make(f"{top}/b/cut.zip", list(pages.items()))
    with open(f"{top}/b/cut.zip", "r+b") as f:
        f.truncate(50)
    open(f"{top}/b/none.zip", "wb").close()
    return top, pages


def test_listing_and_contents(spark, shelf):
    top, pages = shelf
    x = archives.list_entries(spark, top)
    got = {(r.archive.rsplit("/", 1)[1], r.entry): r for r in x.collect()}
    assert {k for k in got if k[0] == "v1.cbz"} == {("v1.cbz", n) for n in [*pages, "empty.png"]} and len(got) == 5 + 4 + 4 + 1
    assert [n for _, n in sorted((r.ordinal, r.entry) for k, r in got.items() if k[0] == "v2.ZIP")] == ["p1.png", "p2.jpg", "p3.webp", "p10.PNG"]
    assert got["cut.zip", None].error
    assert {r.entry for r in archives.list_entries(spark, f"{top}/a", names=None).where("archive like '%v1%'").collect()} == {*pages, "empty.png", "notes.txt"}
    read = {(r.archive.rsplit("/", 1)[1], r.entry): r for r in archives.read_entries(x.withColumn("more", F.lit(1))).collect()}
    for n, d in pages.items():
        assert bytes(read["v1.cbz", n].content) == d and bytes(read["v2.ZIP", n].content) == d[::-1] and read["v1.cbz", n].sha256 == hashlib.sha256(d).hexdigest()
    hurt = [r for (a, _), r in read.items() if a == "hurt.zip"]
    assert sum(r.error is not None and r.content is None for r in hurt) == 1 and read["cut.zip", None].content is None and bytes(read["v1.cbz", "empty.png"].content) == b""
    assert archives.read_entries(x.limit(0)).count() == 0


def test_pieces_of_far_packed_entries(tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "STEP", 1000)
    data = b"\0" * 300_000 + random.Random(2).randbytes(5000) + b"ab" * 50_000
    make(str(tmp_path / "x.zip"), [("a.png", data)])
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        i = z.getinfo("a.png")
    with open(tmp_path / "x.zip", "rb") as f:
        pieces = list(archives.chunks(f, i.header_offset, i.compress_size, i.file_size, 8, i.CRC))
        assert b"".join(pieces) == data and max(map(len, pieces)) <= 1000
        for wrong in ((i.header_offset + 1, i.compress_size, i.file_size, 8, i.CRC), (0, i.compress_size - 5, i.file_size, 8, i.CRC), (0, i.compress_size, i.file_size - 1, 8, i.CRC), (0, i.compress_size, i.file_size, 8, i.CRC ^ 1), (0, i.compress_size, i.file_size, 12, i.CRC), (0, 10**9, i.file_size, 0, i.CRC)):
            with pytest.raises(ValueError):
                list(archives.chunks(f, *wrong))


def files(folder):
    return {os.path.relpath(os.path.join(d, n), folder): os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if "/manifest" not in d}


def test_extraction(spark, shelf, tmp_path):
    top, pages = shelf
    out = f"file://{tmp_path}/out"
    x = archives.list_entries(spark, top).withColumn("output_relpath", F.concat_ws("/", F.lit("pages"), F.regexp_extract("archive", "([^/.]+)[.][^/]*$", 1), F.col("entry")))
    clash = x.where("entry = 'p1.png'").withColumn("output_relpath", F.lit("pages/one.png"))
    away = x.where("entry = 'p2.jpg' and archive like '%v1%'").withColumn("output_relpath", F.explode(F.array(F.lit("../x"), F.lit("/x"), F.lit(""), F.lit("a/../../x"))))
    m = archives.extract(x.unionByName(clash).unionByName(away), out).collect()
    kept = {r.output_relpath: r for r in m if r.error is None}
    found = files(f"{tmp_path}/out")
    assert set(found) == set(kept) and len(kept) == 5 + 4 + 3 + 1 and len(m) == 14 + 3 + 4
    for path, r in kept.items():
        data = open(found[path], "rb").read()
        assert hashlib.sha256(data).hexdigest() == r.output_sha256 and len(data) == r.output_bytes == r.bytes
    assert kept["pages/one.png"].archive.endswith("v1.cbz") or kept["pages/one.png"].archive.endswith("v2.ZIP")
    assert sum(r.error == "another entry has this path" for r in m) == 2 and sum(r.error == "no path in the folder" for r in m) == 4 and not os.path.exists(tmp_path / "x")
    again = archives.extract(x, out)
    assert set(files(f"{tmp_path}/out")) >= set(kept) and again.where("error is null").count() == 12
    assert archives.extract(x.limit(0), f"file://{tmp_path}/none").count() == 0


def test_a_failed_extraction_leaves_nothing(spark, shelf, tmp_path):
    """Tasks that die while staging leave neither entries nor a manifest nor the staging folder."""
    top, _ = shelf
    dies = F.udf(lambda a: 1 // 0 if a.endswith("v2.ZIP") else a, "string")
    x = archives.list_entries(spark, top).where("error is null").withColumn("output_relpath", dies("archive"))
    with pytest.raises(Exception, match="ZeroDivision"):
        archives.extract(x, f"file://{tmp_path}/out")
    assert files(f"{tmp_path}/out") == {} and not os.path.exists(tmp_path / "out/manifest")


def test_a_sample_is_extracted_with_its_digests(spark, shelf, tmp_path):
    top, pages = shelf
    entries = archives.list_entries(spark, f"{top}/a")
    chosen = selection.sample_corpus(entries, pages_per_volume=2, skip_first=0, skip_last=0)
    at = entries.select(F.col("archive").alias("source_path"), F.col("entry").alias("source_image_name"), "bytes", "packed", "offset", "method", "crc", "error")
    rows = chosen.join(at, ["source_path", "source_image_name"]).withColumnRenamed("source_path", "archive").withColumnRenamed("source_image_name", "entry")
    m = archives.extract(rows, f"file://{tmp_path}/out").collect()
    want = {hashlib.sha256(d).hexdigest() for d in [*pages.values(), *(d[::-1] for d in pages.values()), b""]}
    assert len(m) == 4 and all(r.error is None and r.output_sha256 in want for r in m) and len(files(f"{tmp_path}/out")) == 4
