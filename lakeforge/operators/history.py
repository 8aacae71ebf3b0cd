"""Reprocessing: one day, the whole history, or some tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Registry, TableSpec


def scope(raw: DataFrame, day: date | None = None, full: bool = False) -> DataFrame:
    """Rows to process: all of them, one day's, or by default those of the last day ingested."""
    if full:
        return raw
    if day is not None:
        return raw.filter(F.col("ingestion_date") == F.lit(day))
    last = raw.agg(F.max("ingestion_date").alias("_last"))
    return raw.join(F.broadcast(last), F.col("ingestion_date") == F.col("_last")).drop("_last")


def subset(registry: Registry, names: Iterable[str] | None = None) -> list[TableSpec]:
    """Specs of some tables, in load order; an unknown name is an error."""
    wanted = list(registry) if names is None else list(names)
    unknown = [n for n in wanted if n not in registry]
    if unknown:
        raise ValueError("unknown tables: " + ", ".join(unknown))
    return [s for n, s in registry.items() if n in wanted]
