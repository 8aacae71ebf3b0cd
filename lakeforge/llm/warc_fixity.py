"""Fixity audit of replicas of WARC files with Merkle trees.

Records are hashed; the hashes of a file are folded over ordered ranges of byte offsets: first ranges of ``RANGE`` bytes,
then ``FANOUT`` neighbouring ranges at a time, and the topmost ones into the file's root. Two replicas are compared by
their roots. Only below a range whose hashes differ are the ranges of the next level looked at, down to the records, so
that the work of finding damage follows the damage and not the archive.

Every node is a grouped aggregation of at most ``FANOUT`` children (or of the records that fit into ``RANGE`` bytes); the
number of levels follows the largest file. Offsets are running sums over ranges of the packing order, whatever file the
records belong to, so no file is ever gathered in one task, however large. The levels are written to the shared folder
and read again while descending.

Defined results
    * A null page id, url or body is empty in the record; all pages without an id are in file -1.
    * Pages are packed in the order of page id, url and SHA-256 of the record, nulls first; repeated pages are records of
      their own.
    * A record that one replica lacks, or has at another offset, is damaged in it; so is the record on the other side.
    * Empty replicas have no roots and no damage. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, staged, table

RANGE, FANOUT, LEVELS = 1 << 16, 16, 4
PAGES_PER_FILE = 500


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A response record as text; its bytes are its UTF-8."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text(page_id),
        F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Length: "), F.octet_length(text(body)).cast("string"),
        F.lit("\r\n\r\n"), text(body), F.lit("\r\n\r\n"),
    )


def pack(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, warc, record_offset, record_length, record``: pages as records of files of some hundred ids each."""
    made = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), record(F.col(id_col), F.col(url_col), F.col(body_col)).alias("record"))
    made = made.withColumn("digest", F.sha2(F.col("record").cast("binary"), 256)).withColumns({"warc": F.coalesce(F.floor(F.col("page_id") / PAGES_PER_FILE).cast("bigint"), F.lit(-1).cast("bigint")), "record_length": F.octet_length("record").cast("bigint")})
    # Equal records may stand in any order among themselves, so a number drawn at random divides a hot one among ranges.
    order = ["warc", "page_id", "url", "digest", "_salt"]
    ranges = made.withColumn("_salt", F.rand(9)).repartitionByRange(*order).sortWithinPartitions(*order).select("page_id", "warc", "record_length", "record")
    placed = staged(ranges.mapInArrow(running, f"{made.select('page_id').schema.simpleString()[7:-1].replace(':', ' ')}, warc bigint, record_length bigint, record string, part int, place bigint"), shared_folder(pages.sparkSession), "placed")
    # A file that goes on from range to range: what its earlier ranges hold. At most one file does so in each range.
    sums = placed.groupBy("warc", "part").agg(F.sum("record_length").alias("bytes"))
    earlier = Window.partitionBy("warc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("ahead", F.sum("bytes").over(earlier)).filter("ahead > 0").drop("bytes")
    return placed.join(F.broadcast(ahead), ["warc", "part"], "left").select("page_id", "warc", (F.col("place") + F.coalesce("ahead", F.lit(0))).alias("record_offset"), "record_length", "record")


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows the number of their range and the bytes before them in it of the same file."""
    part, file, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, lengths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("warc", "record_length"))
        before = np.cumsum(lengths) - lengths
        starts = np.flatnonzero(np.r_[True, files[1:] != files[:-1]])
        base = -before[starts]
        base[0] += total if files[0] == file else 0
        place = before + np.repeat(base, np.diff(np.r_[starts, len(files)]))
        file, total = files[-1], int(place[-1] + lengths[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(files), part, np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "part", "place"])


def levels(*replicas: DataFrame) -> int:
    """How many levels of ranges the largest file needs, so that its root has at most ``FANOUT`` children; at least ``LEVELS``."""
    last = max(r.agg(F.max("record_offset")).first()[0] or 0 for r in replicas)
    out = LEVELS
    while last // RANGE // FANOUT ** (out - 1) >= FANOUT:
        out += 1
    return out


class Tree:
    """The levels of one replica, from records (level 0) to roots, as tables ``warc, node, parent, hash``."""

    def __init__(self, records: DataFrame, folder: str, name: str, depth: int = LEVELS):
        """``records``: ``warc, record_offset, record``; ``depth``: see ``levels``."""
        width = RANGE
        level = records.select("warc", F.col("record_offset").alias("node"), F.floor(F.col("record_offset") / width).cast("bigint").alias("parent"), F.sha2(F.col("record").cast("binary"), 256).alias("hash"))
        self.levels = [staged(level, folder, f"{name}_0")]
        for k in range(1, depth + 1):
            parent = F.floor(F.col("node") / FANOUT).cast("bigint") if k < depth else F.lit(0).cast("bigint")
            grouped = self.levels[-1].groupBy("warc", F.col("parent").alias("node")).agg(self.folded())
            self.levels.append(staged(grouped.select("warc", "node", parent.alias("parent"), "hash"), folder, f"{name}_{k}"))
        self.roots = staged(self.levels[-1].groupBy("warc").agg(self.folded()), folder, f"{name}_root")

    @staticmethod
    def folded() -> Column:
        """Hash of the children's hashes in the order of their ranges."""
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "").cast("binary"), 256).alias("hash")


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes that the two sides do not have alike."""
    one = a.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("x"))
    two = b.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("y"))
    return one.join(two, keys, "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select(*keys)


def damage(a: Tree, b: Tree, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files whose roots differ, and ``warc, record_offset`` of the records that differ, found from the roots down."""
    files = staged(differing(a.roots, b.roots, ["warc"]), folder, "files")
    open_nodes = files.withColumn("parent", F.lit(0).cast("bigint"))
    for k in range(len(a.levels) - 1, -1, -1):
        below = [t.levels[k].join(open_nodes, ["warc", "parent"], "left_semi") for t in (a, b)]
        found = staged(differing(*below, ["warc", "node"]), folder, f"differing_{k}")
        open_nodes = found.withColumnRenamed("node", "parent")
    return files, found.withColumnRenamed("node", "record_offset")


def audit(records_a: DataFrame, records_b: DataFrame) -> tuple[Tree, Tree, DataFrame, DataFrame]:
    """Trees of both replicas, the files that differ, and the records that differ."""
    folder = shared_folder(records_a.sparkSession)
    depth = levels(records_a, records_b)
    a, b = Tree(records_a, folder, "a", depth), Tree(records_b, folder, "b", depth)
    return a, b, *damage(a, b, folder)


def second_replica(records: DataFrame) -> DataFrame:
    """A copy with damage that SQL can state as well: the last character of some records is another one."""
    hurt = F.concat(F.expr("left(record, char_length(record) - 1)"), F.lit("~"))
    return records.withColumn("record", F.when(F.col("page_id") % 97 == 13, hurt).otherwise(F.col("record")))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "pages"))
    a, _, files, records = audit(packed, second_replica(packed))
    leaves = a.levels[0].select("warc", F.col("node").alias("record_offset"), F.col("hash").alias("record_sha256"))
    return (
        packed.select("page_id", "warc", "record_offset", "record_length")
        .join(leaves, ["warc", "record_offset"])
        .join(a.roots.withColumnRenamed("hash", "file_root"), "warc")
        .join(files.withColumn("file_differs", F.lit(True)), "warc", "left")
        .join(records.withColumn("record_differs", F.lit(True)), ["warc", "record_offset"], "left")
        .fillna(False, ["file_differs", "record_differs"])
    )


SQL = """
WITH made AS (
    SELECT page_id, url, coalesce(page_id // 500, -1) AS warc,
           'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
           || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
           || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
    FROM pages
), packed AS (
    SELECT page_id, warc, strlen(record) AS record_length, sha256(record) AS record_sha256,
           CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY warc ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset
    FROM made
), one AS (SELECT warc, record_offset // 65536 AS node, sha256(string_agg(record_sha256, '' ORDER BY record_offset)) AS hash FROM packed GROUP BY ALL),
two AS (SELECT warc, node // 16 AS node, sha256(string_agg(hash, '' ORDER BY one.node)) AS hash FROM one GROUP BY warc, one.node // 16),
three AS (SELECT warc, node // 16 AS node, sha256(string_agg(hash, '' ORDER BY two.node)) AS hash FROM two GROUP BY warc, two.node // 16),
four AS (SELECT warc, node // 16 AS node, sha256(string_agg(hash, '' ORDER BY three.node)) AS hash FROM three GROUP BY warc, three.node // 16),
root AS (SELECT warc, sha256(string_agg(hash, '' ORDER BY node)) AS file_root FROM four GROUP BY warc)
SELECT page_id, warc, record_offset, record_length, record_sha256, file_root,
       coalesce(bool_or(page_id % 97 = 13) OVER (PARTITION BY warc), false) AS file_differs,
       coalesce(page_id % 97 = 13, false) AS record_differs
FROM packed JOIN root USING (warc)
"""
