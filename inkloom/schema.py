"""The block row: one recognised text block of a page, flat and explicitly typed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALTERNATIVE = "struct<engine:string,text:string,confidence:double,score:double,note:string>"
TEXTS = ("ocr_text", "ocr_corrected_text", "normalized_source_text", "raw_translation_fr", "translation_fr", "review_notes")

#: Column, type and the default that fills a missing or null value (None: stays null).
BLOCK = (
    ("project_id", "string", "''"),
    ("series_label", "string", "'unknown'"),
    ("volume_label", "string", "''"),
    ("page_index", "int", None),
    ("image_name", "string", "''"),
    ("page_status", "string", "'new'"),
    ("seq", "long", "0L"),
    ("block_id", "string", None),
    ("bbox", "array<int>", "array(0, 0, 0, 0)"),
    ("source_lang", "string", "'en'"),
    *((t, "string", "''") for t in TEXTS),
    ("confidence", "double", None),
    ("reading_order", "int", "0"),
    ("manual_status", "string", "'unchecked'"),
    ("quality_warnings", "array<string>", "array()"),
    ("ocr_alternatives", f"array<{ALTERNATIVE}>", "array()"),
)
BLOCK_SCHEMA = ", ".join(f"{n} {t}" for n, t, _ in BLOCK)

#: One project document as it is stored: pages of blocks.
_STORED_BLOCK = "struct<" + ",".join(
    ["id:string", "bbox:array<int>", "source_lang:string", *(f"{t}:string" for t in TEXTS), "confidence:double", "reading_order:int", "manual_status:string", "quality_warnings:array<string>", f"ocr_alternatives:array<{ALTERNATIVE}>"]
) + ">"
PROJECT_SCHEMA = f"cbz_path string, version int, glossary_terms string, pages array<struct<page_index:int,image_name:string,status:string,blocks:array<{_STORED_BLOCK}>>>"


def as_blocks(df: DataFrame) -> DataFrame:
    """``df`` with every block column, in order: missing ones and nulls take their defaults; extra columns are dropped."""
    out = []
    for name, kind, default in BLOCK:
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if default is not None:
            c = F.coalesce(c, F.expr(default).cast(kind))
        out.append(c.alias(name))
    return df.select(*out)
