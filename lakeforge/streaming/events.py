"""Streaming counterparts of the event operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.landing import unseen
from ..sources.versions import KeyedTable


def first_arrivals(events: DataFrame, key: str = "event_id", time: str = "received_at", delay: str = "48 hours") -> DataFrame:
    """At-least-once delivery made once: the first arrival of each key stays while its state is kept."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def visits(events: DataFrame, gap: str = "30 minutes", visitor: str = "session_id", time: str = "event_time", delay: str = "48 hours") -> DataFrame:
    """Visits by inactivity. Times are cut to whole seconds so that the edge of a window is that of the batch operator."""
    cut = events.withColumn("_at", F.date_trunc("second", F.col(time).cast("timestamp"))).withWatermark("_at", delay)
    return cut.groupBy(visitor, F.session_window("_at", gap).alias("w")).agg(
        F.count("*").alias("events"), F.min("_at").alias("session_start"), F.max("_at").alias("session_end"), F.max("customer_id").alias("customer_id"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    )


def split_late(batch: DataFrame, time: str, newest: object, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows later than the delay allows), so that the latter are seen and do not vanish."""
    limit = F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
    at = F.col(time).cast("timestamp")
    return batch.filter((at >= limit) | at.isNull()), batch.filter(at < limit)


def route_late(events: DataFrame, time: str, delay_seconds: int, on_time: str, late: str, checkpoint: str) -> StreamingQuery:
    """Append rows in time to one folder and late ones to another. The newest time seen up to each micro-batch is written
    beside the checkpoint, one row a batch, and only the row of the batch before is read: a restarted query goes on where
    it was, a batch that is repeated finds the same, and nothing grows with what has been written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        progress = lambda n: f"{checkpoint}/progress/batch={n}"
        own = batch.agg(F.max(F.col(time).cast("timestamp")).alias("newest"))
        before = spark.read.schema("newest timestamp").parquet(progress(batch_id - 1)) if batch_id else None
        own.unionByName(before if before is not None else own).agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(progress(batch_id))
        newest = before.first()[0] if before is not None else None
        newest = newest if newest is not None else own.first()[0]
        good, bad = split_late(batch, time, newest, delay_seconds) if newest is not None else (batch, batch.limit(0))
        for rows, folder in ((good, on_time), (bad, late)):
            rows.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(folder)
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing(spark: SparkSession, path: str, checkpoint: str, accepted: Callable[[], DataFrame | None], process: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Files of a landing zone once each: the checkpoint knows the paths, the control table the contents."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.sha2("content", 256).alias("content_hash"))
    return named.writeStream.foreachBatch(lambda batch, n: process(unseen(batch, accepted()), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(batches: DataFrame, table: KeyedTable, checkpoint: str, policy: str = "overwrite") -> StreamingQuery:
    """Upsert each micro-batch as a version of its own, which rewrites the buckets of the batch's keys and no others. A batch
    that is replayed finds its version and changes nothing."""
    return batches.writeStream.foreachBatch(lambda batch, n: table.upsert(batch, n, policy=policy)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
