"""Tables of which a commit rewrites only the parts that it touches, with every earlier state to be read again.

A part is a bucket of keys, a day or the like. ``data/version=n/part=p`` holds part p as commit n wrote it, and
``manifests/version=n`` says for each part which commit wrote what it holds now. A commit writes its parts, then its
manifest in one move: a reader sees all of it or nothing, one that breaks off before leaves no trace in what is read, and
one that is repeated finds its manifest or starts again. A manifest has a row for each part, whatever the rows of the table.

One writer at a time commits to a table, as a stream or a scheduled flow does.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import deduplicate
from ..operators.upsert import upsert
from ..spec import TableSpec

MANIFEST = "part string, written bigint, at timestamp, schema string"
PART = "part"


def instant(at: datetime) -> datetime:
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class VersionedTable:
    """A table in parts; see the module. Columns ``part`` and ``version`` are its own and may not be the table's; names of
    parts are numbers, dates or other plain words."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files ------------------------------------------------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _rename(self, source: str, target: str) -> None:
        fs, a = self._fs(source)
        b = self._fs(target)[1]
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"{source} could not be moved to {target}")

    # -- manifests ----------------------------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        """Commits in their order."""
        fs, folder = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def manifest(self, version: int) -> list:
        """A row for each part: its name, the commit that wrote it, and that commit's time and schema."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/version={version}").collect()

    def version_at(self, at: datetime) -> int | None:
        """The last commit at or before a time."""
        if not self.versions():
            return None
        heads = self.spark.read.schema(f"{MANIFEST}, version bigint").parquet(f"{self.path}/manifests").filter("part is null")
        return heads.filter(F.col("at") <= F.lit(instant(at)).cast("timestamp")).agg(F.max("version")).first()[0]

    # -- reading ------------------------------------------------------------------------------------------------------
    def read(self, version: int | None = None, at: datetime | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """The table now, as of a commit, or as of a time; of all parts or some. None before the first commit."""
        known = self.versions()
        if at is not None:
            version = self.version_at(at)
            if version is None:
                return None
        elif version is None:
            version = known[-1] if known else None
        if version not in known:
            return None
        rows = self.manifest(version)
        schema = next(T.StructType.fromJson(json.loads(r["schema"])) for r in rows if r["part"] is None)
        wanted = None if parts is None else set(parts)
        paths = [f"{self.path}/data/version={r['written']}/{PART}={r['part']}" for r in rows if r["part"] is not None and (wanted is None or r["part"] in wanted)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema, T.StructField("version", T.LongType()), T.StructField(PART, T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    # -- writing ------------------------------------------------------------------------------------------------------
    def commit(self, version: int, rows: DataFrame, part: Column, touched: list[str], at: datetime | None = None) -> bool:
        """``rows`` are all that the touched parts hold from now on; a touched part without rows is gone. Returns whether
        something was written: a version that was committed before stays as it is."""
        known = self.versions()
        if version in known:
            return False
        if known and version < known[-1]:
            raise ValueError(f"version {version} comes after version {known[-1]}")
        before = self.manifest(known[-1]) if known else []
        data = f"{self.path}/data/version={version}"
        rows.withColumn(PART, part.cast("string")).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(data)
        fs, folder = self._fs(data)
        there = {s.getPath().getName().removeprefix(f"{PART}=") for s in fs.listStatus(folder)}
        outside = {n for n in there if not n.startswith("_")} - set(touched)
        if outside:
            raise ValueError(f"rows outside the parts that are touched: {sorted(outside)[:5]}")
        now = {r["part"]: r["written"] for r in before if r["part"] is not None and r["part"] not in touched}
        now |= {p: version for p in touched if p in there}
        when = instant(at or datetime.now(timezone.utc))
        old = next((T.StructType.fromJson(json.loads(r["schema"])) for r in before if r["part"] is None), T.StructType())
        schema = T.StructType([*old, *(T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in old.names)])
        lines = [(p, w, when, None) for p, w in sorted(now.items())] + [(None, version, when, schema.json())]
        attempt = f"{self.path}/work/manifest{version}"
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(attempt)
        self._rename(attempt, f"{self.path}/manifests/version={version}")
        return True

    def vacuum(self, keep: int = 1) -> list[int]:
        """Forget all but the last ``keep`` states, and remove data that none of them reads. Returns the commits whose
        data went whole."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        used = {(r["written"], r["part"]) for v in kept for r in self.manifest(v) if r["part"] is not None}
        for v in gone:
            fs, folder = self._fs(f"{self.path}/manifests/version={v}")
            fs.delete(folder, True)
        removed = []
        for v in known:
            fs, folder = self._fs(f"{self.path}/data/version={v}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                name = status.getPath().getName()
                if name.startswith(f"{PART}=") and (v, name.removeprefix(f"{PART}=")) not in used:
                    fs.delete(status.getPath(), True)
            if v in gone and not any(w == v for w, _ in used):
                fs.delete(folder, True)
                removed.append(v)
        return removed


class KeyedTable(VersionedTable):
    """Rows by business key in buckets of keys; an upsert rewrites the buckets of the batch's keys.

    ``buckets`` stays the same for the life of a table: it should make a bucket about as large as a file ought to be."""

    def __init__(self, spark: SparkSession, path: str, spec: TableSpec, buckets: int = 64):
        super().__init__(spark, path)
        self.spec, self.buckets = spec, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.spec.business_key), F.lit(self.buckets)).cast("string")

    def upsert(self, batch: DataFrame, version: int, at: datetime | None = None, policy: str = "overwrite") -> bool:
        """Keys of the batch replaced or added, see ``operators.upsert``; a batch that was committed before changes nothing."""
        if version in self.versions():
            return False
        batch = deduplicate(batch, self.spec)
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())  # at most ``buckets``
        after = upsert(self.read(parts=touched), batch, self.spec, policy)
        return self.commit(version, after, self.bucket(), touched, at)
