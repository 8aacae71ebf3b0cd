"""Raw batches published once: rows are staged in a folder of their own, and readers see them by a commit record.

A batch that breaks off before its record is written is not seen, and when it is repeated it replaces what it staged. One
that has its record is not staged again. The record also carries the mark that the batch moves, so data and mark are
published by the same write, whatever becomes of the mark store afterwards.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import lake

#: ``after``: the sequence number of the table's last mark when the batch began.
RECORD = "batch string, ingestion_date date, rows bigint, mark timestamp, after bigint"
FOLDER = "_batch"


def _exists(spark: SparkSession, path: str, make: bool = False) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) or (make and fs.mkdirs(p))


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """A row for each batch published; None for a table that is not published by records."""
    folder = f"{path}/_commits"
    return spark.read.schema(RECORD).option("recursiveFileLookup", True).parquet(folder) if _exists(spark, folder) else None


def record(spark: SparkSession, path: str, batch_id: str) -> Row | None:
    found = records(spark, path)
    return None if found is None else found.filter(F.col("batch") == batch_id).select("*", F.unix_micros("mark").alias("mark_us")).first()


def stage(df: DataFrame, path: str, batch_id: str) -> None:
    """Write the batch's rows (with ``ingestion_date``) where no reader looks yet."""
    _exists(df.sparkSession, f"{path}/_commits", make=True)  # before any row, so that a table is never read without its records
    lake.replace_batch(df.withColumn(FOLDER, F.lit(f"b_{batch_id}")), path, ["ingestion_date", FOLDER])


def commit(spark: SparkSession, path: str, batch_id: str, day: date, rows: int, mark: datetime | None, after: int) -> None:
    """One row in one file: from now on the batch is seen."""
    spark.createDataFrame([(batch_id, day, rows, mark, after)], RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/_commits/b_{batch_id}")


def published(rows: DataFrame, path: str) -> DataFrame:
    """Of a table's rows as they lie in its folder, those that readers may see. There is a record for each batch, so their
    table is small beside the rows, and Spark prunes the folders by it."""
    found = records(rows.sparkSession, path)
    if found is None or FOLDER not in rows.columns:
        return rows if found is None else rows.limit(0)
    seen = found.select("ingestion_date", F.concat(F.lit("b_"), "batch").alias(FOLDER))
    return rows.join(seen, ["ingestion_date", FOLDER], "left_semi").select(*[c for c in rows.columns if c != FOLDER])
