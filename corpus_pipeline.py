"""The corpus pipeline: quality, near copies, benchmark passages, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of ``documents``; the last returns
the documents' places in the token shards. Stages meet through Parquet tables in the shared folder.

Every stage decides about rows, not ids: null and repeated doc_ids are judged like others. A row travels as one struct, so columns
beside doc_id, text, lang and source may have any names, and come back as they were. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import decontaminate, mixing, neardup, quality, tokens
from thicket.llm.shared import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row(docs: DataFrame) -> list:
    return [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")]


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents again, of a table with ``row``."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """number and row of each document, written, so that later reads give the same numbers."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("number"), *_row(docs)), name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1. Null and empty texts are judged by their shape, a very long text as a
    whole; equal texts get equal scores, so repeated rows stay or go together. Without labels all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _columns(quality.score(docs, model, carry="row").where("predicted = 1"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row: that of the least doc_id, nulls last; of equal doc_ids the first as read. Null, empty and blank
    texts are copies of each other. Very long texts are compared as wholes."""
    rows = numbered(docs, "pipeline-near-rows")
    found = neardup.near_copies(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), numbered=True).select(F.col("doc_id").alias("number"), "class_id")
    several = found.where(F.col("number") != F.col("class_id")).select("class_id").distinct()
    ids = rows.select("number", F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"))
    members = materialise(found.join(several, "class_id", "left_semi").join(ids, "number"), "pipeline-near-members")
    first = members.groupBy("class_id").agg(F.min(F.struct("none", "doc_id", "number")).alias("first")).select(F.col("first.number").alias("number"))
    copies = members.select("number").join(first, "number", "left_anti")
    return _columns(rows.join(copies, "number", "left_anti"), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item. Null and empty texts have none and stay; repeated rows stay or go together; a very long
    text goes for a single window."""
    rows = numbered(docs, "pipeline-leak-rows")
    found = decontaminate.find_leaks(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"))
    leaks = found.where("n_hit > 0").select(F.col("doc_id").alias("number"))
    return _columns(rows.join(leaks, "number", "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budget of each leaf takes, once for every epoch. Null languages and sources are nodes of their own; texts
    without words cost nothing; rows of equal doc_id, the null one included, have one place in a leaf's order and stay or go together."""
    chosen = mixing.mix(docs)
    return chosen.select(*(F.col(f"`{c}`") for c in docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, as read back from the shards: in ascending doc_id order, null first, equal ones by text. Null and
    empty texts are their end id alone."""
    return tokens.encode_documents(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("tokenize", write_tokens),
]

#: SQL can't train the classifier, align texts or encode tokens; every stage is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
