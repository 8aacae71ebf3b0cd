"""Corpus pipeline: toxicity, exact dedup, near-duplicate join, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again before the
next stage. All stages but the last return the columns of ``documents``. Rows with null ids or texts are kept by every
stage that has no reason against them: a null text is not toxic, is one of the equal empty texts, has no near copies and
no benchmark passage, and is encoded as no token. Rows that repeat an id are told apart in every stage. Empty documents
go through as empty tables, and without labels nothing is toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeforge.llm import bpe, decontamination, exact_dedup, ngram_join, toxicity
from lakeforge.llm.common import shared_folder, staged, table, text_session
from lakeforge.llm.labelled import fold


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. Labels are learned from the rows outside the held-out fold."""
    text_session(spark)
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    scored = toxicity.score(docs.select("text", F.struct("*").alias("__row")), toxicity.train(docs, labels))
    return scored.filter("predicted = 0").select("__row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts stays, that with the largest doc_id."""
    return exact_dedup.distinct_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles the row with the smallest doc_id
    stays. Rows are numbered, so that a decision finds the row it was made for, also where ids are null (the largest here)
    or repeat."""
    folder, row = shared_folder(spark), f"row_{uuid.uuid4().hex[:8]}"
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), folder, "numbered")
    linked = ngram_join.link(numbered.select(row, "text"), n=5, percent=80, id_col=row)
    own = linked.select(row, F.col("component_id").alias("component"))
    group = own.filter(F.col(row) != F.col("component")).select("component").distinct()
    members = own.join(group.hint("merge"), "component").join(numbered.select(row, "doc_id").hint("merge"), row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = members.groupBy("component").agg(F.min(order).getField(row).alias("first"))
    dropped = staged(members.join(first.hint("merge"), "component").filter(F.col(row) != F.col("first")).select(row), folder, "dropped")
    return numbered.join(dropped.hint("merge"), row, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go."""
    text_session(spark)
    marked = decontamination.mark(docs.select("text", F.struct("*").alias("__row")), table(spark, sf_dir, "benchmark"))
    return marked.filter("not contaminated").select("__row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, for the documents that are left."""
    text_session(spark)
    return bpe.encode(docs.select("doc_id", "text"), bpe.default_path()).select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]
#: Toxicity is learned, so SQL cannot state the rows; tests/llm/test_pipeline.py follows every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)  # the last stage's table is the result
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), folder, name)
    return docs
