"""Readers: projects, manifests, volume lists, review tables, memories, replay reports, archives."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions.text import full, ignore_key, memory_key, natural_key, path_labels
from inkloom.schema import PROJECT_SCHEMA, TEXTS, as_blocks
from inkloom.sources import archives
from inkloom.sources.archives import IMAGES

ARCHIVES = (".cbz", ".zip")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Block rows of project JSON documents, one document a file. Missing keys take their defaults; unknown keys are ignored."""
    docs = spark.read.schema(PROJECT_SCHEMA).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    return explode_project(docs, F.regexp_extract("_file", r"([^/]+?)(?:\.json)?$", 1))


def read_project_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_projects``, from files with a document on every line (as ``write_projects`` makes them)."""
    docs = spark.read.schema(PROJECT_SCHEMA + ", project_id string").json(path)
    return explode_project(docs, F.col("project_id"))


def explode_project(docs: DataFrame, project_id: Column) -> DataFrame:
    x = docs.select(project_id.alias("project_id"), F.posexplode("pages").alias("_p", "page"))
    x = x.select("project_id", "_p", "page", F.posexplode("page.blocks").alias("_b", "b"))
    series, volume = path_labels(F.col("page.image_name"))
    cols = ["bbox", "source_lang", *TEXTS, "confidence", "reading_order", "manual_status", "quality_warnings", "ocr_alternatives"]
    return as_blocks(
        x.select(
            "project_id", full(series).alias("series_label"), volume.alias("volume_label"), "page.page_index", "page.image_name", F.col("page.status").alias("page_status"),
            (F.col("_p").cast("long") * 1_000_000 + F.col("_b")).alias("seq"), F.col("b.id").alias("block_id"), *(F.col(f"b.{c}").alias(c) for c in cols),
        )
    )


#: Names under which manifests hold a value; the first that isn't empty counts.
PATHS = ("sample_path", "extracted_path", "output_path", "image_path", "sample_file", "relative_path", "output_relpath")
NUMBERS = ("sample_index", "page_number", "source_page_number")
SERIES = ("series_label", "series", "series_path")
VOLUMES = ("volume_label", "volume", "source_path")


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    known = [full(F.btrim(F.col(n).cast("string"))) for n in names if n in df.columns]
    return F.coalesce(*known, F.lit(None).cast("string")) if known else F.lit(None).cast("string")


def with_position(rows: DataFrame, name: str = "index") -> DataFrame:
    """Add each row's position from 0 in the order of the scan: its place in its partition after the rows of those before (one row for each partition)."""
    x = rows.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = x.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
    return x.withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_before")


def ranked(rows: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Add each row's position from 0 in the order of ``order`` (columns), however many rows there are; ties in any order.

    The sorted rows are written to the shared folder with their part and their
    place in it, and a part's first position is what the parts before it hold:
    no task sees more than a part, and no second evaluation can deal rows anew.
    """
    from inkloom.sources.views import scratch

    path = scratch(rows.sparkSession, "ranked")
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    x = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()).withColumn("_place", place).drop("_id")
    x.write.parquet(path)
    x = rows.sparkSession.read.schema(x.schema).parquet(path)
    sizes = x.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a part
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return x.join(before, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def manifest_entries(raw: DataFrame, index: str | None = None) -> DataFrame:
    """index, image_path, page_number, series_label, volume_label of manifest rows with any of the known column names.

    Rows without an image path are left out. A page number of 0 or none is the
    row's position from 1 (``index``, if given, is a column with positions from 0).
    """
    if index is None:
        raw, index = with_position(raw, "_index"), "_index"
    at = F.col(index).cast("long")
    number = full(F.regexp_replace(_first(raw, NUMBERS), "^0+(?:\\.0*)?$", ""))
    x = raw.select(at.alias("index"), _first(raw, PATHS).alias("image_path"), number.alias("_n"), _first(raw, SERIES).alias("_s"), _first(raw, VOLUMES).alias("_v"))
    series, volume = path_labels(F.col("image_path"))
    return x.where("image_path is not null").select(
        "index", "image_path", F.coalesce(F.col("_n").try_cast("int"), (F.col("index") + 1).cast("int")).alias("page_number"),
        F.coalesce("_s", full(series), F.lit("unknown")).alias("series_label"), F.coalesce("_v", volume).alias("volume_label"),
    )


def read_manifest_jsonl(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A JSON-lines manifest; blank lines are skipped, a bad line fails the read. ``columns``: its DDL schema."""
    return manifest_entries(spark.read.schema(columns).option("mode", "FAILFAST").json(path))


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    return manifest_entries(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def find_manifest(spark: SparkSession, root: str) -> str | None:
    """The manifest of a corpus folder: its own JSON lines, else its own CSV, else the only one below it (analysis and run folders aside).

    Only names are listed, by Spark's file source. Several manifests below a folder raise an error.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.{jsonl,csv}").load(root).select("path")
    base = root.rstrip("/")
    inside = F.regexp_extract("path", "^(?:[a-z]+:/*)?(.*)$", 1)
    rel = F.ltrim(F.replace(inside, F.lit(base.split(":", 1)[-1].lstrip("/")), F.lit("")), F.lit("/"))
    x = listed.select("path", rel.alias("rel")).where(~F.col("rel").rlike("(?:^|/)(?:analysis|corpus_run)/"))
    found = [r.path for r in x.orderBy(F.col("rel") != "manifest.jsonl", F.col("rel") != "manifest.csv", "rel").limit(3).collect()]
    own = [r for r in x.where("rel in ('manifest.jsonl', 'manifest.csv')").orderBy(F.col("rel").desc()).limit(2).collect()]
    if own:
        return own[0].path
    if len(found) > 1:
        raise ValueError(f"several manifests under {root}: {', '.join(found)}")
    return found[0] if found else None


def read_manifest(spark: SparkSession, path: str, columns: str = "image_path string, page_number string, series_label string, volume_label string") -> DataFrame:
    """Manifest entries of a manifest file, or of a folder: its manifest, or else the images in it."""
    if path.endswith(".jsonl"):
        return read_manifest_jsonl(spark, path, columns)
    if path.endswith(".csv"):
        return read_manifest_csv(spark, path)
    if found := find_manifest(spark, path):
        return read_manifest(spark, found, columns)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    x = manifest_from_pages(files).withColumn("page_number", F.col("source_page_index") + 1)
    return ranked(x, ["series_label", "volume_label", "source_page_index", "image_path"]).select("index", "image_path", "page_number", "series_label", "volume_label")


def manifest_from_pages(files: DataFrame, path: str = "path") -> DataFrame:
    """Manifest entries from image paths ``.../pages/<series>/<volume>/...__page_<number>.<ext>``."""
    series, volume = path_labels(F.col(path))
    x = files.where(F.lower(path).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in IMAGES) + ")$"))
    number = F.regexp_extract(path, r"__page_(\d+)\.[^./]+$", 1).try_cast("int")
    return x.select(F.col(path).alias("image_path"), series.alias("series_label"), volume.alias("volume_label"), F.greatest(F.lit(0), F.coalesce(number, F.lit(1)) - 1).alias("source_page_index"))


def read_volume_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a text list: blank lines and comments are skipped, a pair of quotes around a path goes, and a relative path is one beside the list."""
    line = F.btrim(F.regexp_replace("value", "^\ufeff", ""))
    x = spark.read.text(path).select(line.alias("line"), F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("base")).where("line <> '' and not startswith(line, '#')")
    bare = F.col("line")
    for quote in ('"', "'"):
        bare = F.regexp_replace(bare, f"^{quote}(.*){quote}$", "$1")
    whole = bare.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.\-]*:)")
    return x.select(F.when(whole, bare).otherwise(F.concat_ws("/", "base", bare)).alias("volume_path"))


def discover_series(files: DataFrame, path: str = "path", *, roots: DataFrame | None = None, recursive: bool = False) -> DataFrame:
    """series_path, volume_path, series_label, natural of archives among file paths; a folder is a series, each volume once.

    ``roots`` (root): only archives that are a root or lie in one count. A
    root's own archives are its series; archives deeper down count only if it
    has none of its own and ``recursive`` is set, a series for each folder.
    """
    x = files.where(F.lower(path).rlike(r"\.(?:cbz|zip)$")).select(F.regexp_replace(path, "/[^/]*$", "").alias("series_path"), F.col(path).alias("volume_path")).dropDuplicates(["volume_path"])
    if roots is not None:
        x = x.join(_under(x, roots, recursive).select("volume_path").distinct(), "volume_path", "left_semi")
    name = F.regexp_extract("volume_path", "[^/]*$", 0)
    return x.withColumn("series_label", F.regexp_extract("series_path", "[^/]*$", 0)).withColumn("natural", natural_key(name))


def _under(archives: DataFrame, roots: DataFrame, recursive: bool) -> DataFrame:
    """root, volume_path of the archives that count for a root: every folder above an archive is a key of the join."""
    r = roots.select(F.regexp_replace("root", "/+$", "").alias("root")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("volume_path", "/"))), lambda n: F.array_join(F.slice(F.split("volume_path", "/"), 1, n), "/"))
    x = archives.select("series_path", "volume_path", F.explode(above).alias("root")).join(r, "root")
    x = x.withColumn("direct", (F.col("series_path") == F.col("root")) | (F.col("volume_path") == F.col("root")))
    own = x.groupBy("root").agg(F.max("direct").alias("own"))
    return x.join(own, "root").where(F.col("direct") | (F.lit(recursive) & ~F.col("own")))


def rejected_roots(files: DataFrame, roots: DataFrame, path: str = "path", recursive: bool = False) -> DataFrame:
    """root, reason of roots that give no volume: a file of another kind, a folder without archives (of its own), or a path that isn't there."""
    x = files.select(F.regexp_replace(path, "/[^/]*$", "").alias("series_path"), F.col(path).alias("volume_path"))
    used = _under(x.where(F.lower("volume_path").rlike(r"\.(?:cbz|zip)$")), roots, recursive).select("root").distinct()
    r = roots.select(F.regexp_replace("root", "/+$", "").alias("root")).distinct().join(used, "root", "left_anti")
    seen = _under(x, roots, True).select("root").distinct().withColumn("there", F.lit(True))
    is_file = x.select(F.col("volume_path").alias("root")).distinct().withColumn("is_file", F.lit(True))
    why = F.when(F.col("is_file"), "unsupported file").when(F.col("there"), "no archive in folder").otherwise("not found")
    return r.join(seen, "root", "left").join(is_file, "root", "left").select("root", why.alias("reason"))


# The labels of a review table's columns in spreadsheets.
HEADERS = {
    "review_decision": "Décision", "suggested_action": "Action suggérée", "risk_score": "Risque", "risk_reasons": "Raisons risque", "quality_warnings": "Warnings QC", "review_notes": "Notes reviewer",
    "ocr_text": "OCR brut à lire", "corrected_ocr": "OCR corrigé à remplir", "ocr_corrected_text": "OCR corrigé auto", "source_for_review": "Source à vérifier", "corrected_source": "Source corrigée à remplir",
    "normalized_source_text": "Source normalisée auto", "translation_fr": "Traduction actuelle", "corrected_fr": "Traduction FR corrigée à remplir", "raw_translation_fr": "Trad brute", "series_label": "Série",
    "volume_label": "Tome", "page_number": "Page", "image_name": "Image", "block_id": "Block ID", "page_index": "Page index", "bbox": "BBox", "source_lang": "Langue source", "confidence": "Confiance OCR",
    "ocr_alternatives_count": "Nb alternatives OCR", "ocr_alternatives": "Alternatives OCR",
}
# End of the fixed values.
REVIEW_LABELS = {label.lower(): name for name, label in HEADERS.items()}


def find_review(spark: SparkSession, path: str) -> str:
    """The review table that ``path`` is, or the one below that folder: a CSV or TSV file, or a folder of parts; none or several raise an error."""
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    store, base = fs.FileSystem.from_uri(path)
    if store.get_file_info(base).type == fs.FileType.File:
        return path
    files = [f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith((".csv", ".tsv"))]
    found = sorted({f.rsplit("/", 1)[0] if f.rsplit("/", 1)[1].startswith("part-") else f for f in files})
    if len(found) != 1:
        raise ValueError(f"{len(found)} review tables below {path}: {', '.join(found[:5])}")
    return path if found[0] == base.rstrip("/") else f"{path.rstrip('/')}{found[0][len(base.rstrip('/')):]}"


def read_review_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A review table (CSV or TSV, all text); labels become column names, rows without any value are left out."""
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        sep = "\t" if head and head[0][0].count("\t") >= max(1, head[0][0].count(",")) else ","
    x = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    names = [c.strip().lstrip("\ufeff") for c in x.columns]
    x = x.toDF(*(REVIEW_LABELS.get(c.lower(), c) for c in names))
    return x.where(F.coalesce(*(full(F.btrim(F.col(c))) for c in x.columns)).isNotNull()).na.fill("")


def read_memory(spark: SparkSession, path: str, translation: bool = False, lines: bool = False) -> DataFrame:
    """key, value, seq of a memory; keys are made canonical, blanks dropped, the last of equal keys counts.

    A document {entries: {key: value}} or {entries: [{source or source_key,
    translation_fr}]}; with ``lines``, {key, value} on every line.
    """
    if lines:
        x = spark.read.schema("key string, value string").json(path).select(F.lit(0).cast("long").alias("seq"), F.col("key").alias("k"), "value")
    else:
        docs = spark.read.schema("entries string").option("multiLine", True).json(path)
        pairs = F.map_entries(F.from_json("entries", "map<string,string>"))
        items = F.from_json("entries", "array<struct<source:string,source_key:string,translation_fr:string>>")
        listed = F.transform(items, lambda e: F.struct(F.coalesce(e["source"], e["source_key"]).alias("key"), e["translation_fr"].alias("value")))
        found = F.when(F.btrim("entries").startswith("["), listed).otherwise(pairs)
        x = docs.select(F.posexplode(found).alias("seq", "e")).select(F.col("seq").cast("long").alias("seq"), F.col("e.key").alias("k"), F.col("e.value").alias("value"))
    x = x.select((memory_key if translation else ignore_key)(F.col("k")).alias("key"), F.btrim("value").alias("value"), "seq").where("key <> '' and value <> ''")
    return x.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("m")).select("key", F.col("m.value").alias("value"), F.col("m.seq").alias("seq"))


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """ord, pattern, replacement of a JSON-lines table of rules; rows without a pattern are left out."""
    x = spark.read.schema("ord long, pattern string, replacement string").json(path)
    return x.where("pattern is not null").select("ord", "pattern", F.coalesce("replacement", F.lit("")).alias("replacement"))


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, replacement) rules of a table, in order, as a list on the driver; ``normalise.apply_rules`` takes tables of any length."""
    return [(r.pattern, r.replacement) for r in rule_table(spark, path).orderBy("ord", "pattern").toLocalIterator()]


def failing_pages(spark: SparkSession, path: str, statuses: tuple[str, ...]) -> DataFrame:
    """Page indices of a replay report with results of these statuses."""
    docs = spark.read.schema("results array<struct<page_index:int,status:string>>").option("multiLine", True).json(path)
    return docs.select(F.explode("results").alias("r")).where(F.col("r.status").isin(*statuses)).select("r.page_index").distinct()


def page_list(spark: SparkSession, text: str) -> DataFrame:
    """Pages of a list such as ``p3,5-7,10``; reversed ranges are swapped."""
    parts = spark.sql("select explode(regexp_extract_all(:t, r'\\d+(?:\\s*-\\s*p?\\d+)?', 0)) as part", {"t": text})
    ends = F.transform(F.regexp_extract_all("part", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return parts.select(F.explode(F.sequence(F.array_min(ends), F.array_max(ends))).alias("page_index")).distinct()


def read_archive_entries(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """archive, entry, ordinal (natural order), bytes and, if asked for, content of the images of ZIP archives.

    An unreadable archive is one row with its ``error``, an unreadable entry has one; no archive is read whole (``sources.archives``).
    """
    x = archives.list_entries(spark, path)
    x = archives.read_entries(x) if contents else x.withColumn("content", F.lit(None).cast("binary"))
    return x.select("archive", "entry", "bytes", "content", "error", "ordinal")


def same_pages(cached: DataFrame, names: DataFrame) -> DataFrame:
    """project_id, usable: a cache may be used again only if its image names are exactly those of the archive, in order."""
    listed = lambda d, n: d.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "image_name"))), lambda s: s["image_name"]).alias(n))
    x = listed(names, "_new").join(listed(cached.select("project_id", "page_index", "image_name").distinct(), "_old"), "project_id", "left")
    return x.select("project_id", F.coalesce(F.col("_new") == F.col("_old"), F.lit(False)).alias("usable"))


