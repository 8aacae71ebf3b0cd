"""Upserts as DataFrames, and reading earlier states."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import TableSpec
from .dedup import deduplicate


def upsert(target: DataFrame | None, batch: DataFrame, spec: TableSpec, policy: str = "overwrite") -> DataFrame:
    """The table after the batch: keys in the batch are replaced, new ones added, all others stay.

    ``overwrite`` takes the batch's row whatever the target has; ``ordered`` lets the spec's order decide between both, so
    that reprocessing an old day does not undo newer rows. Doing the same batch twice changes nothing.
    """
    if target is None:  # a table of the batch's schema without rows, which Catalyst folds away
        target = batch.limit(0)
    if policy == "ordered":
        return deduplicate(target.unionByName(batch, allowMissingColumns=True), dataclasses.replace(spec))
    if policy != "overwrite":
        raise ValueError(f"policy {policy!r} is neither overwrite nor ordered")
    keys = batch.select(*spec.business_key)
    return target.join(keys, list(spec.business_key), "left_anti").select(*target.columns).unionByName(batch, allowMissingColumns=True)


def update_where(target: DataFrame, changes: DataFrame, keys: list[str], updates: dict[str, Column]) -> DataFrame:
    """``target`` with ``updates`` (columns over both frames, those of ``changes`` as ``change.*``) in rows whose keys match."""
    change = changes.select(*keys, F.struct("*").alias("change"))
    joined = target.join(change, keys, "left")
    changed = F.col("change").isNotNull()
    return joined.select(*[F.when(changed, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in target.columns])


def as_of_version(history: DataFrame, keys: list[str], version: int, version_column: str = "version") -> DataFrame:
    """The table as it was: of each key the row with the greatest version up to ``version``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version_column).desc()))
    return history.filter(F.col(version_column) <= version).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
