"""Five stages from raw documents to token ids, each one operator of inkloom.llm.

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept; all but the last return the columns of documents. Extra
columns of ``docs`` pass through the first four, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import MapType

from inkloom.llm import bpe, jaccard_join, mil_quality, mixing, surrogates
from inkloom.llm.common import settle, spare, table
from inkloom.llm.queries import pii_key

ORACLE_SQL = None  # learned weights and keyed draws: the stages are tested against brute force


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go.

    Null and empty texts have the score of an empty passage and are judged by
    it; texts of any length are scored whole; repeated rows are judged alike;
    an empty table stays empty.
    """
    model = mil_quality.train(docs, table(spark, sf_dir, "labels"))
    name = spare(docs, "score")
    return mil_quality.score(docs, model, score_col=name).where(F.col(name) >= 0.3).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one that names it (the smallest doc_id) stays.

    Texts that are null or without words link with nothing and stay. Of rows
    that repeat doc_id and words, one stays (that with the least hash of its
    other columns); rows of one doc_id with other words are judged apart, each
    by the group of its text. A row without doc_id stays only where no row of
    its group has one, and of several such rows that with the least key of its
    words stays. An empty table stays empty.
    """
    groups = jaccard_join.similar(docs.select("doc_id", "text"), with_class=True)
    bare, key, place, id_, key_ = (spare(docs, c) for c in ("bare", "key", "place", "kept_id", "same_key"))
    names = F.col("class").isNull() | F.when(F.col("doc_id").isNull(), F.col("component_id").isNull() & (F.col("key") == F.col("class"))).otherwise(F.col("doc_id") == F.col("component_id"))
    judged = groups.select("doc_id", F.col("key").alias(key), names.alias("stays"), F.col("class").isNull().alias(bare))
    by_id = judged.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max("stays").alias("stays"), F.max(bare).alias(bare))
    others = [f.name for f in docs.schema if not isinstance(f.dataType, MapType)]

    def one_each(x: DataFrame, *same) -> DataFrame:
        order = W.partitionBy("doc_id", *same, F.when(F.col(bare), F.col("text"))).orderBy(F.xxhash64(*others))
        return x.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)

    # an id whose rows share their words is judged by the id alone
    out = one_each(docs.join(by_id.where("low = high and stays").select("doc_id", bare), "doc_id"))
    several = by_id.where("low <> high").select("doc_id")
    if judged.where("doc_id is null").isEmpty() and several.isEmpty():
        return out
    odd = docs.where("doc_id is null").unionByName(docs.join(several, "doc_id", "left_semi"))
    kept = judged.where("stays").select(F.col("doc_id").alias(id_), F.col(key).alias(key_), bare).distinct()
    kept = jaccard_join.with_keys(odd, key).join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_)))
    return out.unionByName(one_each(kept.drop(id_, key_), key))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text where it changed.

    Null and empty texts and texts without mentions are unchanged; repeated
    rows read alike; an empty table stays empty.
    """
    name = spare(docs, "entities")
    new = surrogates.anonymise(docs, pii_key(spark), count_col=name)
    size = F.when(F.col(name) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return new.select(*(size.alias(c) if c == "n_chars" else c for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that the mix takes a document.

    Null and empty texts have no words; null sources are one source; repeated
    rows share their fate; an empty table stays empty.
    """
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the SHA-256 of the text that they decode to.

    Null and empty texts have no ids; other columns are left out; repeated rows
    stay; an empty table stays empty.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, keep=["doc_id", "lang", "source"], check=True)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("mix", mix_sources),
    ("tokens", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
