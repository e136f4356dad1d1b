"""A training-data pipeline over ``documents``: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of ``documents``. ``run`` writes each stage's rows to the
shared checkpoint folder and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlog.llm import jaccard, packing, passages, quality, toxicity
from siftlog.scratch import materialize, release


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row from its file and its place there, and the key's name; other inputs are written first."""
    name = "_row_key"
    while name in docs.columns:
        name += "_"
    place = lambda df: df.withColumn(name, F.xxhash64(df.metadataColumn("_metadata")["file_path"], df.metadataColumn("_metadata")["row_index"]))
    try:
        return place(docs), name
    except AnalysisException:
        return place(materialize(docs, "rows")), name


def _without(rows: DataFrame, key: str, rejected: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """``rows`` but those ``rejected(key, id)``, which are written once and broadcast only if they are few."""
    rejected = materialize(rejected, "rejected")
    few = F.broadcast(rejected) if rejected.count() <= broadcast_rows else rejected
    return rows.join(few, (rows[key] == few["key"]) & rows["doc_id"].eqNullSafe(few["id"]), "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that operator 4 predicts to be toxic; it learns from ``labels`` of this folder.

    Null and empty texts stay; the verdict is made on the row, so null and repeated ids lose no clean rows.
    Without labels the seed lexicon decides; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn_lexicon(docs, labels))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that operator 3 predicts to be of poor quality.

    Null and empty texts stay; rows are rejected by a key of their own, so null and repeated ids lose no
    clean rows; an empty table gives no rows.
    """
    rows, key = _keyed(docs)
    found = quality.classify(rows.select(F.col(key).alias("doc_id"), "text"))
    bad = found.where("predicted = 0").select(F.col("doc_id").alias("key"))
    return _without(rows, key, rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id")).join(bad, "key", "left_semi"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of operator 9 (five words, likeness 0.8) the row with the smallest id.

    Rows without an id and rows without words stay. A repeated id says nothing about its rows: of equal
    texts one row stays, of different ones all do. An empty table gives no rows.
    """
    rows, key = _keyed(docs)
    named = rows.where("doc_id is not null").select(F.col(key).alias("doc_id"), "text")
    found = jaccard.jaccard_components(named, k=5, percent=80).where("n_shingles > 0")
    groups = found.groupBy("component_id").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    found = found.join(groups, "component_id").select(F.col("doc_id").alias("key"), "component_id")
    found = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id")).join(found, "key")
    first = found.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    return _without(rows, key, found.join(first, "component_id").where("key <> first.key").select("key", "id"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of operator 7 out of every document but the first that has them.

    Null ids and null texts stay as they are, rows with a repeated id share their cuts; an empty table gives no rows.
    """
    return passages.remove_passages(docs, passages.repeated_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences with operator 5, every window in the proportions of the sources.

    Null and empty texts are a document of one id, null sources one queue; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("passages", cut_passages),
    ("packing", pack),
]

#: Learned models, chains and tokenisers are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written once and those before them freed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
