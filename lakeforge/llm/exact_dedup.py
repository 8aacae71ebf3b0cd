"""Exact de-duplication against a persistent digest index, with DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest, so a new batch is compared by a sort-merge anti-join for
which only the batch is shuffled; the batch's new digests are then appended in the same buckets.

Defined results
    * A null text is the empty text; texts are compared by the SHA-256 of their UTF-8 bytes after no change.
    * Of equal texts in one batch the row with the largest id stays, a null id ranks below all others; of rows that
      repeat id and text exactly one stays.
    * A text that an earlier batch brought keeps that batch's row: none of the new rows stays. A batch that is repeated
      under its name, after a failure at any point, gets its first verdict.
    * Ids may be of any type that has an order: numbers, texts, dates, structs of them.
    * An empty batch gives an empty result and leaves the index as it was.
    * Columns other than id and text are not read; they may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, shared_folder, staged, table

#: Digests that hold more than this share of a batch's rows are joined by broadcast: there are at most 1 / share of them.
HOT_SHARE = 0.001
#: Digests that a bucket of the index is made for, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 64
#: Ids from which the cuts between batches are taken.
SAMPLE = 1000


def buckets_for(rows: int) -> int:
    """Buckets follow the rows, so that what one task holds does not."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """Digests seen so far: ``digest binary, keep_id, seen long, batch string``, bucketed and sorted by ``digest``.

    A batch has a name. Its verdict is written before its digests are appended, and digests of its own name are passed over
    when it is compared, so a batch that broke off anywhere and is repeated gets the same verdict again."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = LEAST_BUCKETS, id_type: str = "bigint"):
        self.spark, self.name, self.path, self.buckets, self.id_type = spark, name, path, buckets, id_type
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {id_type}, seen BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        dropped(self.spark, self.path)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add digests of a batch, without those that an earlier attempt has added."""
        own = self.frame().filter(F.col("batch") == batch).select("digest")
        rows = groups.join(own.hint("merge"), "digest", "left_anti").select("digest", "keep_id", "seen", F.lit(batch).alias("batch"))
        self._write(staged(rows, shared_folder(self.spark), "appended"))

    def _write(self, rows: DataFrame) -> None:
        # by the bucket that Spark's writer computes, so a bucket gets one file however many partitions there are
        rows = rows.repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.name)

    def compacted(self, name: str, path: str) -> DigestIndex:
        """The same digests in a new index under ``name``: one sorted file a bucket, where each append had left one, and as
        many buckets as they ask for by now. Nothing is changed in place, so this index is whole if it breaks off, and goes
        by ``drop`` when its readers have gone over."""
        rows = self.frame()
        new = DigestIndex(self.spark, name, path, buckets_for(rows.count()), self.id_type)
        new._write(rows)
        return new

    def fresh(self, rows: DataFrame, batch: str) -> DataFrame:
        """``digest, keep_id, keep_row, seen`` of the texts that no earlier batch has, which are appended. ``rows``: ``id,
        digest, row``."""
        groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("seen"))
        known = self.frame().filter(F.col("batch") != batch).select("digest")
        new = groups.join(known.hint("merge"), "digest", "left_anti").select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), "seen")
        new = staged(new, shared_folder(self.spark), "fresh")
        self.append(new, batch)
        return new

    def deduplicate(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None) -> DataFrame:
        """Compare ``batch`` with itself and the index, append what is new, and return one row per row of ``batch``:
        ``id_col, keep_id, group_size, kept, text_sha256, row`` (``row`` tells repeated rows apart)."""
        name = name or uuid.uuid4().hex
        rows = digests(batch, id_col, text_col)
        new = self.fresh(rows, name)
        groups = rows.groupBy("digest").agg(F.count("*").alias("seen"))
        earlier = self.frame().filter(F.col("batch") != name).select("digest", "keep_id")
        old = groups.join(earlier.hint("merge"), "digest").select("digest", "keep_id", F.lit(None).cast("bigint").alias("keep_row"), "seen")
        return verdicts(rows, staged(new.unionByName(old), shared_folder(self.spark), "groups"), id_col)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, row`` of every row, written."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    return staged(rows, shared_folder(docs.sparkSession), "digests")


def verdicts(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """Every row with what its digest's group (``digest, keep_id, keep_row, seen``) says of it."""
    total = rows.groupBy().agg(F.count("*").alias("rows"))
    hot = groups.join(F.broadcast(total), F.col("seen") > F.col("rows") * HOT_SHARE).select("digest", F.struct("keep_id", "keep_row", "seen").alias("hot"))
    # at most 1 / HOT_SHARE digests can be hot, whatever the input; their rows never meet in one task
    marked = rows.join(F.broadcast(hot), "digest", "left")
    cold = marked.filter("hot is null").drop("hot").join(groups, "digest")
    out = marked.filter("hot is not null").select("id", "row", "digest", "hot.*").unionByName(cold.select("id", "row", "digest", "keep_id", "keep_row", "seen"))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("seen").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def fresh_index(spark: SparkSession, id_type: str = "bigint", rows: int = 0) -> DigestIndex:
    """An empty index in the shared folder, with buckets for so many rows."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}", f"{shared_folder(spark)}/index", buckets_for(rows), id_type)


def cut_points(ids: DataFrame, batches: int) -> list:
    """Values that cut ``ids`` (one column of any type that has an order) into batches, the largest first: quantiles of the
    SAMPLE ids with the least hashes. They decide how even the batches are, and nothing else."""
    name = ids.columns[0]
    some = ids.filter(F.col(name).isNotNull()).orderBy(F.xxhash64(name)).limit(SAMPLE)
    found = [r[0] for r in some.orderBy(name).collect()]
    return list(dict.fromkeys(found[len(found) * k // batches] for k in range(batches - 1, 0, -1))) if found else []


def fed(index: DigestIndex, rows: DataFrame, batches: int, by: str = "id") -> DataFrame:
    """``digest, keep_id, keep_row`` of every text, after ``rows`` (``id, digest, row``) went through an empty index in some
    batches, those with the largest values of ``by`` first (rows without one last), so that of equal texts the row with the
    largest id is always the one that the index has. A batch is compared with the index by a sort-merge anti-join."""
    winners, left, order = None, rows, F.col(by)
    for n, cut in enumerate([*cut_points(rows.select(order.alias("by")), batches), None]):
        here = order > F.lit(cut) if cut is not None else F.lit(True)
        one = index.fresh(left.filter(here), f"batch{n}").drop("seen")
        winners = one if winners is None else winners.unionByName(one)
        left = left.filter(~F.coalesce(here, F.lit(False)))
    return winners


def distinct_rows(docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay when ``docs`` go through a fresh index in some batches.

    Rows are numbered once and staged, so that the decision finds exactly the row it was made for, also where ids are
    null or repeat.
    """
    spark = docs.sparkSession
    own = f"row_{uuid.uuid4().hex[:8]}"
    order = F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    numbered = staged(docs.withColumn(own, order), shared_folder(spark), "numbered")
    rows = digests(numbered, own, text_col)
    index = fresh_index(spark, dict(numbered.dtypes)[own], rows.count())
    kept = fed(index, rows, batches, "id.id").select(F.col("keep_id").alias(own))
    index.drop()
    return numbered.join(kept, own, "left_semi").drop(own)


def in_batches(docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``DigestIndex.deduplicate`` for ``docs`` as one batch, from some batches, see ``fed``."""
    spark = docs.sparkSession
    rows = digests(docs, id_col, text_col)
    index = fresh_index(spark, dict(docs.dtypes)[id_col], rows.count())
    sizes = rows.groupBy("digest").agg(F.count("*").alias("seen"))
    groups = staged(fed(index, rows, batches).join(sizes.hint("merge"), "digest"), shared_folder(spark), "groups")
    index.drop()
    return verdicts(rows, groups, id_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_batches(table(spark, sf_dir, "documents")).drop("row")


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
