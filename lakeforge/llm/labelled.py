"""Bounded samples of labelled documents, drawn by hash so that they are spread over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, label`` of at most ``rows`` labelled documents, those whose ids hash lowest.

    The ids chosen are at most ``rows`` and are broadcast; the documents are not shuffled. Of rows that repeat an id only
    one is drawn, that whose text hashes lowest, so the bound holds for rows as well. Rows with a null id or label are not
    used; an id that is labelled twice has its largest label; a null text counts as empty.
    """
    ids = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias(label))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(rows)
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = docs.select(id_col, text.alias(text_col)).join(F.broadcast(ids), id_col)
    return met.groupBy(id_col, label).agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col))).alias(text_col)).select(id_col, text_col, label)
