"""Tables of which a commit rewrites only what it touches."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lakeforge.sources.versions import KeyedTable, VersionedTable
from lakeforge.spec import TableSpec

SPEC = TableSpec("t", ("id",), ("at",))
SCHEMA = "id bigint, at bigint, v string"
MONDAY = datetime(2026, 3, 16, tzinfo=timezone.utc)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(df):
    return sorted((r["id"], r["at"], r["v"]) for r in df.collect())


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet")) if folder.exists() else 0


def test_an_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SPEC, buckets=32)
    base = spark.range(20_000).select("id", F.lit(1).cast("bigint").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert table.read() is None and table.upsert(base, 1)
    whole = size(tmp_path / "t/data/version=1")
    assert table.upsert(rows(spark, (7, 2, "x")), 2)
    assert len(list((tmp_path / "t/data/version=2").glob("part=*"))) == 1 and size(tmp_path / "t/data/version=2") < whole / 16
    assert sum(r["written"] == 2 for r in table.manifest(2) if r["part"]) == 1 and len(table.manifest(2)) == 33
    table.upsert(base.filter("id < 200"), 3)
    assert table.read().count() == 20_000 and held(table.read(version=2).filter("id = 7")) == [(7, 2, "x")]


def test_replay_policies_and_earlier_states(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SPEC, buckets=4)
    table.upsert(rows(spark, (1, 5, "a"), (2, 5, "b"), (2, 4, "old")), 1, MONDAY)
    for _ in range(2):  # the second is a replay, whatever it brings
        table.upsert(rows(spark, (1, 1, "stale"), (3, 1, "c")), 2, MONDAY + timedelta(days=1), policy="ordered")
    assert not table.upsert(rows(spark, (1, 99, "other")), 2)
    assert held(table.read()) == [(1, 5, "a"), (2, 5, "b"), (3, 1, "c")]
    table.upsert(rows(spark, (1, 1, "stale")), 3, MONDAY + timedelta(days=2))
    assert held(table.read()) == [(1, 1, "stale"), (2, 5, "b"), (3, 1, "c")]
    assert held(table.read(version=1)) == [(1, 5, "a"), (2, 5, "b")]
    assert held(table.read(at=MONDAY + timedelta(days=1, hours=3))) == [(1, 5, "a"), (2, 5, "b"), (3, 1, "c")]
    assert table.read(at=MONDAY - timedelta(seconds=1)) is None and table.read(version=9) is None
    with pytest.raises(ValueError):
        table.commit(1, rows(spark), table.bucket(), []) or table.commit(0, rows(spark), table.bucket(), [])


def test_a_commit_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SPEC, buckets=4)
    table.upsert(rows(spark, (1, 1, "a"), (2, 1, "b")), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_rename", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            table.upsert(rows(spark, (1, 2, "half"), (9, 2, "half")), 1)
    assert table.versions() == [0] and held(table.read()) == [(1, 1, "a"), (2, 1, "b")]
    table.upsert(rows(spark, (2, 2, "c")), 1)
    assert held(table.read()) == [(1, 1, "a"), (2, 2, "c")]


def test_new_columns_and_empty_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SPEC, buckets=4)
    table.upsert(rows(spark), 1)
    assert table.read().count() == 0 and table.read().columns == ["id", "at", "v"]
    table.upsert(rows(spark, (1, 1, "a"), (2, 1, None)), 2)
    table.upsert(rows(spark), 3)
    table.upsert(rows(spark, (3, 1, "c")).withColumn("extra", F.lit(5)), 4)
    assert sorted((r["id"], r["v"] or "", r["extra"] or 0) for r in table.read().collect()) == [(1, "a", 0), (2, "", 0), (3, "c", 5)]


def test_parts_that_go_and_what_is_outside(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    day = F.concat(F.lit("d"), F.col("at").cast("string"))
    table.commit(1, rows(spark, (1, 1, "a"), (2, 2, "b"), (3, 3, "c")), day, ["d1", "d2", "d3"])
    table.commit(2, rows(spark, (2, 3, "b"), (3, 3, "c")), day, ["d2", "d3"])  # day 2 is empty now
    assert held(table.read()) == [(1, 1, "a"), (2, 3, "b"), (3, 3, "c")] and {r["part"] for r in table.manifest(2)} == {None, "d1", "d3"}
    assert held(table.read(parts=["d3", "d9"])) == [(2, 3, "b"), (3, 3, "c")] and table.read(parts=[]).count() == 0
    with pytest.raises(ValueError):
        table.commit(3, rows(spark, (5, 5, "x")), day, ["d1"])
    assert table.versions() == [1, 2]


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SPEC, buckets=2)
    for n in range(5):
        table.upsert(rows(spark, *((i, n, f"v{n}") for i in range(6))), n)
    now = held(table.read())
    assert table.vacuum(keep=2) == [0, 1, 2] and table.versions() == [3, 4]
    assert held(table.read()) == now and held(table.read(version=3)) == [(i, 3, "v3") for i in range(6)]
    assert sorted(p.name for p in (tmp_path / "t/data").iterdir()) == ["version=3", "version=4"]
