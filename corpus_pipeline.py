"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept.
All but the last return the columns of documents; a document without an id is never a
duplicate's loser and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, neardup, packing, passages, quality, queries, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_QUALITY = 0.3

#: Two stages hash word sequences and one trains by sampling, which SQL cannot express.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score MIN_QUALITY or more."""
    weights = quality.train_quality(docs, store.table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, weights, keep=COLUMNS[1:]).filter(F.col("score") >= MIN_QUALITY).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of their own for each row, stored so that it stays."""
    return store.stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "keyed")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of smallest id of each component of near copies (Jaccard 0.8 or more).

    Rows are judged each: of repeated rows one stays; rows without words or with a null id
    stay; a row with a null id is never the one that others are dropped for.
    """
    since = store.mark()
    rows = _keyed(docs)
    found = neardup.near_duplicates(rows, id_col="_row", percent=80).select(F.col("doc_id").alias("_row"), "component_id")
    named = found.join(rows.select("_row", "doc_id").filter("doc_id is not null"), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    losers = store.stored(named.join(first, "component_id").filter("_row != first._row").select("_row"), "losers")
    store.swept(since, rows, losers)
    return rows.join(losers, "_row", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier row has as well; n_chars is the new length.

    Rows are judged each and in stored order; null and empty texts stay as they are, and rows
    that consisted of such passages only go.
    """
    store.collected(spark)  # the shuffle files of the stage before
    rows = _keyed(docs)
    return passages.without_passages(rows, passages.repeated_passages(rows, id_col="_row"), id_col="_row").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever their id; null and empty texts stay."""
    return decontam.without_leaks(docs.select(*COLUMNS), store.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token sequences, with their ids."""
    return packing.pack(docs, *queries.vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread."""
    docs = store.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        since = store.mark()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.stored(docs, f"stage{i}")
            store.swept(since, docs)
    return docs
