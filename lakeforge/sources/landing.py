"""Landing zone: files as rows, what was processed before, and what is missing in a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lake

CONTROL = (
    "name string, content_hash string, settlement_date date, sequence int, details bigint, amount decimal(18,2), "
    "outcome string, reason string, processed_at timestamp, batch_id string"
)


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, content, content_hash`` of every file. In a zone of folders ``name=...``, which Spark writes itself, the name is
    that of the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.col("name").cast("string") if "name" in files.columns else F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "content", F.sha2("content", 256).alias("content_hash"))


def unseen(files: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Files whose content was not accepted before, and of equal ones in the batch the first by name. Refused files may
    come again."""
    rank = F.row_number().over(Window.partitionBy("content_hash").orderBy("name"))
    first = files.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    if accepted is None:
        return first
    return first.join(accepted.filter("outcome = 'accepted'").select("content_hash"), "content_hash", "left_anti").select(*files.columns)


def register(control: DataFrame, path: str, replace_batch: bool = False) -> None:
    """Append to the control table, in its declared schema whatever the batch holds; or with a folder for each batch, so that
    a batch that is repeated replaces its own rows."""
    columns = [c.strip().split(" ")[:2] for c in CONTROL.replace("decimal(18,2)", "decimal(18;2)").split(",")]
    rows = control.select(*[F.col(n).cast(t.replace(";", ",")).alias(n) for n, t in columns])
    if replace_batch:
        lake.replace_batch(rows, path, ["batch_id"])
    else:
        rows.write.mode("append").parquet(path)


def quarantine_files(files: DataFrame, refused: DataFrame, path: str) -> None:
    """Whole files, byte for byte, with the reason (``name, reason``)."""
    files.select("name", "content").join(refused.select("name", "reason"), "name").withColumn("_quarantine_date", F.current_date()).write.mode("append").partitionBy("_quarantine_date").parquet(path)


#: Numbers of a range that are ordered together, as a power of two, and those of a hole that are expanded at once.
RANGE_BITS = 16


def sequence_gaps(received: DataFrame, sequence: str = "sequence", group: list[str] | None = None) -> DataFrame:
    """Numbers that are missing between the least and greatest received, per group. Only the holes are expanded.

    Numbers are compared with the next one inside ranges of 2^16; then the ranges, by their least and greatest number, inside
    ranges of ranges, and so on until one is left. No window holds more than 2^16 rows, with a group or without.
    """
    group, kind = group or [], received.schema[sequence].dataType
    bits = 64 if kind.simpleString() == "bigint" else 32
    edges = received.filter(F.col(sequence).isNotNull()).select(*group, F.col(sequence).cast("bigint").alias("_lo")).distinct().withColumn("_hi", F.col("_lo"))
    holes = None
    for shift in range(RANGE_BITS, bits + 1, RANGE_BITS):
        edges = edges.withColumn("_range", F.shiftright("_lo", shift) if shift < bits else F.lit(0).cast("bigint"))
        following = F.lead("_lo").over(Window.partitionBy(*group, "_range").orderBy("_lo"))
        found = edges.withColumn("_next", following).filter(F.col("_next") > F.col("_hi") + 1).select(*group, (F.col("_hi") + 1).alias("_from"), (F.col("_next") - 1).alias("_to"))
        holes = found if holes is None else holes.unionByName(found)
        edges = edges.groupBy(*group, "_range").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_range")
    step = F.lit(1 << RANGE_BITS).cast("bigint")
    pieces = holes.select(*group, "_to", F.explode(F.sequence(F.col("_from"), F.col("_to"), step)).alias("_from"))
    whole = F.sequence(F.col("_from"), F.least(F.col("_from") + step - 1, F.col("_to")))
    return pieces.select(*group, F.explode(whole).alias("missing")).withColumn("missing", F.col("missing").cast(kind))
