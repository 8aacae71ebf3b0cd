"""Reading and writing the layers: raw appends by day, derived tables by month or day, quarantine, reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ONE_FILE_ROWS, FILES = 500_000, 8
#: Bytes of a file, and rows of the sample on which the size of a row is measured.
FILE_BYTES, SAMPLE_ROWS = 256 << 20, 20_000
#: Rows of a partition that a task puts in order, joins or groups, where rows are dealt by key.
TASK_ROWS = 500_000
TRANSFORMS = {"years": "year", "months": "month", "days": "day", "hours": "hour"}


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; a local one only where both are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeforge-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def add_lineage(df: DataFrame, batch_id: str, ingested_at: datetime, system: str) -> DataFrame:
    """Four columns of origin, the same for the whole batch."""
    at = F.lit(ingested_at).cast("timestamp")
    return df.withColumns({"_ingested_at": at, "_source_system": F.lit(system), "_batch_id": F.lit(batch_id), "ingestion_date": at.cast("date")})


def append_raw(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("ingestion_date").parquet(path)


def replace_batch(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Write the partitions that ``df`` has, and replace no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_raw(spark: SparkSession, path: str, ingestion_date: date | None = None) -> DataFrame:
    """All days or one; only that day's folder is listed for reading. A day that is not there has no rows, and neither has a
    batch that was staged and not published."""
    from .publication import published

    df = published(spark.read.parquet(path), path)
    return df if ingestion_date is None else df.filter(F.col("ingestion_date") == F.lit(ingestion_date))


def partition_column(transform: str) -> tuple[str, Column]:
    """Name and values of the column that ``months(order_date)`` and the like stand for."""
    m = re.fullmatch(r"\s*(\w+)\s*\(\s*(\w+)\s*\)\s*", transform)
    if not m or m[1] not in TRANSFORMS:
        raise ValueError(f"{transform!r} is none of " + ", ".join(f"{t}(column)" for t in TRANSFORMS))
    unit = TRANSFORMS[m[1]]
    cut = F.date_trunc(unit, F.col(m[2]).cast("timestamp"))
    return f"{m[2]}_{unit}", cut if unit == "hour" else cut.cast("date")


def replace_table(df: DataFrame, path: str, transform: str | None = None) -> None:
    """The whole derived table anew; rows of a partition are brought together so that each has few files;
    adaptive execution splits a large one among tasks."""
    if transform is None:
        df.write.mode("overwrite").parquet(path)
        return
    name, values = partition_column(transform)
    df.withColumn(name, values).hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def write_quarantine(refused: DataFrame, path: str, batch_id: str, at: datetime) -> None:
    """A batch that is repeated replaces its own refused rows: only the partitions written are overwritten."""
    stamped = refused.withColumns({"_quarantined_at": F.lit(at).cast("timestamp"), "_batch_id": F.lit(batch_id), "_quarantine_date": F.lit(at).cast("timestamp").cast("date")})
    replace_batch(stamped, path, ["_batch_id", "_quarantine_date"])


def task_parts(table: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """Partitions by which the rows of a table are dealt so that none has many more than ``rows``, or None where the session's
    number is enough, which adaptive execution then lowers or splits. A Parquet table is counted from its footers."""
    n = -(-table.count() // rows)
    return n if n > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` in ``parts`` partitions by its keys; as it is where ``parts`` is None."""
    return df.repartition(parts, *keys) if parts else df


def sized(df: DataFrame, rows: int) -> DataFrame:
    """One file up to half a million rows, eight beyond; for sizes in bytes see ``write_sized``."""
    return df.coalesce(1) if rows <= ONE_FILE_ROWS else df.repartition(FILES)


def stored_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def row_bytes(df: DataFrame, rows: int) -> float:
    """Bytes that a row takes when it is stored, measured on a sample that is written and thrown away."""
    spark, path = df.sparkSession, f"{work_folder(df.sparkSession)}/sample"
    sample = df if rows <= SAMPLE_ROWS else df.sample(min(1.0, SAMPLE_ROWS / rows), seed=1)
    sample.coalesce(1).write.parquet(path)  # a bounded sample; the files to come are as full
    n = spark.read.parquet(path).count()
    size = stored_bytes(spark, path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return size / n if n else 0.0


def write_sized(df: DataFrame, path: str, file_bytes: int = FILE_BYTES, rows: int | None = None) -> int:
    """Write a table in files of about ``file_bytes`` each, from the measured size of a row; returns how many files were
    asked for. ``rows``, where it is known (a database or a catalog counts faster than a scan), spares counting."""
    rows = df.count() if rows is None else rows
    files = max(1, round(rows * row_bytes(df, rows) / file_bytes)) if rows else 1
    df.repartition(files).write.mode("overwrite").parquet(path)
    return files


def write_report(report: DataFrame, path: str) -> None:
    """A small aggregate as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
