"""One row per business key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import lake
from ..spec import TableSpec


def deduplicate(df: DataFrame, spec: TableSpec, tie_break: str = "_ingested_at", parts: int | None = None) -> DataFrame:
    """Keep the latest row per key, or with ``dedup_keep="first"`` the first one; nulls lose either way.

    Without an order there is no telling which row is right, so that is an error and not a guess. Rows that the order leaves
    equal are told apart by a hash of all their values, so the choice is the same in every run. One shuffle on the key;
    ``row_number() == 1`` lets Spark cut each group before that shuffle.
    With ``parts`` rows are dealt by the first column of the key into so many partitions (see ``lake.task_parts``), which a
    join by that column uses again.
    """
    if not spec.dedup_order:
        raise ValueError(f"{spec.name}: no order to choose among rows with the same key")
    columns = [c for c in (*spec.dedup_order, tie_break) if c in df.columns]
    if not columns:
        raise ValueError(f"{spec.name}: none of the columns {spec.dedup_order} is there")
    order = [F.col(c).desc_nulls_last() if spec.dedup_keep == "latest" else F.col(c).asc_nulls_last() for c in columns]
    order.append(F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]))
    rank = F.row_number().over(Window.partitionBy(*spec.business_key).orderBy(*order))
    return lake.dealt(df, parts, spec.business_key[0]).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
