"""Normalisation of declared text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import TableSpec


def normalize(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Trim and change the case of the declared columns. Nulls stay null; columns that are absent are passed over."""
    present = set(df.columns)
    return df.withColumns(
        {c: F.lower(F.trim(c)) for c in spec.lower_trim if c in present} | {c: F.upper(F.trim(c)) for c in spec.upper_trim if c in present}
    )


def drop_columns_of_origin(df: DataFrame) -> DataFrame:
    """Without the partition column that only the raw layer has."""
    return df.drop("ingestion_date")
