"""Incremental and parallel reads from a database, and loads with a check afterwards."""

from __future__ import annotations

import tempfile
import zipfile
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import JdbcSource
from .lake import FILE_BYTES, write_sized

#: Rows of a partition, and the accuracy of its bounds as a share of all rows.
ROWS_PER_PARTITION, ACCURACY = 50_000, 0.001


def reader(spark: SparkSession, options: dict[str, str]) -> DataFrameReader:
    return spark.read.format("jdbc").options(**options)


def table_name(source: JdbcSource, table: str) -> str:
    return f"{source.schema}.{table}" if source.schema else table


def scalar(spark: SparkSession, options: dict[str, str], sql: str) -> dict:
    """The only row of a query that the database answers."""
    return reader(spark, options).option("query", sql).load().first().asDict()


def pending(df: DataFrame, watermark: str, mark, partition_column: str | None = None) -> DataFrame:
    """One row: rows beyond the mark, least and greatest partition value, greatest mark. Filter and columns are pushed
    down to the source."""
    column = partition_column or watermark
    return df.filter(F.col(watermark) > F.lit(mark)).agg(F.count("*").alias("rows"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.max(watermark).alias("new_mark"))


def partitions(rows: int, most: int = 8) -> int:
    """Connections for so many rows, at most as many as the database is to bear."""
    return min(most, max(1, rows // ROWS_PER_PARTITION))


def literal(value) -> str:
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'" if isinstance(value, datetime) else f"DATE '{value}'" if isinstance(value, date) else str(value)


def quantile_predicates(df: DataFrame, column: str, n: int) -> list[str]:
    """Conditions that cut the values of a column (a number, a date or a time) into ``n`` parts of about as many rows, nulls
    in the first. Bounds are drawn from the values that are there, so a dense stretch gets many parts and a wide gap none; a
    value of very many rows cannot be cut and is a part of its own, and there are fewer parts then."""
    kind = df.schema[column].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    number = F.unix_micros(F.col(column).cast("timestamp")) if timed else F.col(column)
    found = df.select(number.cast("double").alias("v")).approxQuantile("v", [i / n for i in range(1, n)], ACCURACY)
    whole = timed or isinstance(kind, T.IntegralType)
    bounds = sorted({round(v) if whole else v for v in found})
    if timed:
        moments = [datetime(1970, 1, 1) + timedelta(microseconds=v) for v in bounds]
        bounds = sorted({m.date() if isinstance(kind, T.DateType) else m for m in moments})
    ends = [literal(b) for b in bounds]
    if not ends:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(ends, ends[1:], strict=False)]
    return [f"{column} < {ends[0]} OR {column} IS NULL", *middle, f"{column} >= {ends[-1]}"]


def read_parts(spark: SparkSession, options: dict[str, str], source: JdbcSource, table: str, stats: Row) -> DataFrame:
    """A table over as many connections as its rows ask for, each with about the same number of rows. The partition column
    alone is read first, over equal strides, to see where its values lie; ``stats`` has ``rows, lo, hi``."""
    name, n = table_name(source, table), partitions(stats["rows"], source.most_connections)
    read = reader(spark, options).option("dbtable", name)
    if n == 1 or not source.partition_column or stats["lo"] is None or stats["lo"] == stats["hi"]:
        return read.load()
    strides = read.options(partitionColumn=source.partition_column, lowerBound=str(stats["lo"]), upperBound=str(stats["hi"]), numPartitions=str(n))
    predicates = quantile_predicates(strides.load().select(source.partition_column), source.partition_column, n)
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], name, predicates=predicates, properties=rest)


def read_incremental(spark: SparkSession, options: dict[str, str], source: JdbcSource, table: str, mark, stats: Row) -> DataFrame:
    """Rows beyond the mark; in parallel over the partition column (a number or a time) where there are enough of them."""
    return read_parts(spark, options, source, table, stats).filter(F.col(source.watermark_column) > F.lit(mark))


def load(df: DataFrame, options: dict[str, str], table: str, batch_size: int = 5000, mode: str = "append") -> None:
    df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch_size).mode(mode).save()


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"
DERBY_TYPES = {T.LongType(): "BIGINT", T.IntegerType(): "INTEGER", T.DoubleType(): "DOUBLE", T.TimestampType(): "TIMESTAMP", T.DateType(): "DATE"}


def embedded(df: DataFrame, table: str, path: str) -> dict[str, str]:
    """A table of numbers and times as an embedded database that the driver and all executors can open; its options.

    Such a database is written by one process and may then be read by many, if it is a closed archive. So tasks stage the
    rows as files below ``path``, a folder that all share and that has a plain path, the database in the driver's process
    imports one file after the other, and what it stored is packed. No row becomes one of the driver's.
    """
    spark = df.sparkSession
    folder = Path(spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath())
    zone = spark._jvm.java.util.TimeZone.getDefault().getID()  # in which times are read from a database
    df.write.options(timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timeZone=zone, compression="none").csv(f"{path}/staged")
    columns = ", ".join(f"{f.name} {DERBY_TYPES[f.dataType]}" for f in df.schema)
    driver, nothing = spark._jvm.org.apache.derby.jdbc.EmbeddedDriver(), spark._jvm.java.util.Properties()
    with tempfile.TemporaryDirectory(prefix="lakeforge-derby-") as local:
        url = f"jdbc:derby:{local}/db"
        connection = driver.connect(f"{url};create=true", nothing)
        statement = connection.createStatement()
        statement.execute(f"CREATE TABLE {table} ({columns})")
        for part in sorted((folder / "staged").glob("part-*")):
            statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{part}', NULL, NULL, 'UTF-8', 0)")
        connection.close()
        try:
            driver.connect(f"{url};shutdown=true", nothing)
        except Exception as closed:  # a database that closes says so by an error
            if "shutdown" not in str(closed):
                raise
        with zipfile.ZipFile(folder / "db.jar", "w", zipfile.ZIP_STORED) as archive:
            for f in sorted(Path(local, "db").rglob("*")):
                if f.is_file() and f.suffix != ".lck":
                    archive.write(f, f.relative_to(local))
    return {"url": f"jdbc:derby:jar:({folder}/db.jar)db", "driver": DERBY}


def mismatches(written: DataFrame, found: DataFrame) -> DataFrame:
    """Tables whose row counts (``table, rows``) differ between what was written and what is found."""
    joined = written.withColumnRenamed("rows", "written").join(found.withColumnRenamed("rows", "found"), "table", "full_outer")
    return joined.filter(~F.col("written").eqNullSafe(F.col("found")))


def verify(spark: SparkSession, options: dict[str, str], written: DataFrame, tables: list[str]) -> None:
    """Read the targets' counts again and fail where they are not what was written."""
    found = None
    for t in tables:
        one = reader(spark, options).option("dbtable", t).load().agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
        found = one if found is None else found.unionByName(one)
    wrong = mismatches(written, found).collect()
    if wrong:
        raise ValueError("counts differ after the load: " + ", ".join(f"{r['table']} {r['written']} / {r['found']}" for r in wrong))


def export(spark: SparkSession, options: dict[str, str], source: JdbcSource, table: str, path: str, file_bytes: int = FILE_BYTES) -> int:
    """A whole table as Parquet in files of about ``file_bytes``, read over as many connections as its rows ask for. The
    database counts and finds the ends of the partition column. Returns the number of files."""
    whole = reader(spark, options).option("dbtable", table_name(source, table)).load()
    column = source.partition_column
    ends = (F.min(column).alias("lo"), F.max(column).alias("hi")) if column else (F.lit(None).alias("lo"), F.lit(None).alias("hi"))
    stats = whole.agg(F.count("*").alias("rows"), *ends).first()
    return write_sized(read_parts(spark, options, source, table, stats), path, file_bytes, stats["rows"])
