"""High-water marks kept as rows of a dataset: the latest row of a table counts, a row without a mark resets it."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
SCHEMA = "`table` string, mark timestamp, written_at timestamp, sequence bigint"


def canonical(column: str | Column) -> Column:
    """Text of a time in UTC, to the microsecond; zone-less texts are UTC already (the session's zone is UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(F.to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def latest(marks: DataFrame) -> DataFrame:
    """``table, mark`` as of the last row written; epoch after a reset."""
    rows = marks.groupBy("table").agg(F.max_by(F.struct("mark"), F.struct("written_at", "sequence")).alias("last"))
    return rows.select("table", F.coalesce("last.mark", F.lit(EPOCH).cast("timestamp")).alias("mark"))


def read_start(mark: str | Column, lookback: timedelta) -> Column:
    """Where to read from: the mark less the lookback."""
    return (F.col(mark) if isinstance(mark, str) else mark) - F.lit(lookback)


class MarkStore:
    """Marks in a Parquet folder; every write is one appended row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def frame(self) -> DataFrame:
        jvm = self.spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(self.path)
        exists = there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if exists else self.spark.createDataFrame([], SCHEMA)

    def read(self, table: str) -> datetime:
        """The table's mark; epoch for a new table, which makes its first load a full one."""
        row = latest(self.frame().filter(F.col("table") == table)).select(F.unix_micros("mark")).first()
        return EPOCH + timedelta(microseconds=row[0]) if row else EPOCH

    def last(self, table: str) -> int:
        """Sequence number of the last row written for a table; 0 where there is none."""
        return self.frame().filter(F.col("table") == table).agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]

    def write(self, table: str, mark: datetime | None) -> None:
        """To be called after the data are written, with the greatest value that was read."""
        mark = mark.replace(tzinfo=timezone.utc) if mark is not None and mark.tzinfo is None else mark
        rows = self.spark.createDataFrame([(table, mark)], "`table` string, mark timestamp")
        last = self.frame().agg(F.coalesce(F.max("sequence"), F.lit(0)) + 1).first()[0]
        rows.withColumns({"written_at": F.current_timestamp(), "sequence": F.lit(last).cast("bigint")}).coalesce(1).write.mode("append").parquet(self.path)

    def reset(self, tables: list[str]) -> list[str]:
        """Forget marks, as after the source was built anew; returns those that were set."""
        set_ = {r["table"] for r in latest(self.frame()).filter(F.col("table").isin(tables) & (F.col("mark") > F.lit(EPOCH).cast("timestamp"))).collect()}
        for t in sorted(set_):
            self.write(t, None)
        return [t for t in tables if t in set_]


def ingest_step(source: DataFrame, store: MarkStore, table: str, watermark: str, lookback: timedelta, path: str, batch_id: str, at: datetime, system: str) -> int:
    """Mark, lookback, what is pending, read, lineage, publication, new mark; returns the rows that this call has published.
    Nothing pending, or a batch that is published already: nothing written, mark unmoved.

    The step may break off anywhere and be repeated, under its own name or another: rows are seen from the commit record on,
    and a mark that a published batch could not write any more is written by the next step. Rows are read up to the greatest
    value counted, so a source that grows meanwhile is left to the next batch.
    """
    from . import publication
    from .jdbc import pending
    from .lake import add_lineage

    spark, column = source.sparkSession, F.col(watermark)
    settle(store, table, path)
    if publication.record(spark, path, batch_id) is not None:
        return 0
    start = store.read(table) - lookback
    zoneless = source.schema[watermark].dataType.simpleString() == "timestamp_ntz"
    start = start.replace(tzinfo=None) if zoneless else start
    stats = pending(source, watermark, start).first()
    if not stats["rows"]:
        return 0
    mark = stats["new_mark"] if zoneless else stats["new_mark"].astimezone(timezone.utc)
    publication.stage(add_lineage(source.filter((column > F.lit(start)) & (column <= F.lit(mark))), batch_id, at, system), path, batch_id)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    publication.commit(spark, path, batch_id, at.astimezone(timezone.utc).date(), stats["rows"], mark.replace(tzinfo=timezone.utc), store.last(table))
    settle(store, table, path)
    return stats["rows"]


def settle(store: MarkStore, table: str, path: str) -> None:
    """Write the mark of a batch that is published and after which the table's mark has not been written."""
    from .publication import records

    found = records(store.spark, path)
    if found is None:
        return
    open_ = found.filter((F.col("after") == store.last(table)) & F.col("mark").isNotNull()).agg(F.unix_micros(F.max("mark"))).first()[0]
    if open_ is not None:
        store.write(table, EPOCH + timedelta(microseconds=open_))
