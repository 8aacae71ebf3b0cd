import glob
import os
import random
from datetime import date, datetime, timedelta, timezone

import pyspark
import pytest
from pyspark.sql import functions as F

from lakeforge.functions import text
from lakeforge.operators import facts, history, settlements
from lakeforge.plans.domain import REGISTRY
from lakeforge.sources import jdbc, lake, landing, marks, publication
from lakeforge.spec import JdbcSource

HEAD, TAIL = "C;LIQ;20260315;001;PSP_ACME", "P;2;80,40;1,25"
BODY = ["D;15/03/2026;ORD-000000001;PAGO;125,40;2,50;EUR;TARJETA;Operación", "D;15/03/2026;ORD-000000002;DEVOL;-45,00;-1,25;EUR;TARJETA;Devolución"]


def files(spark, **contents):
    return spark.createDataFrame([(n, "\n".join(c).encode("latin-1")) for n, c in contents.items()], "name string, content binary")


def test_good_file_and_accents(spark):
    f = files(spark, a=[HEAD, *BODY, TAIL, ""])
    cut = settlements.lines(f)
    verdict = settlements.verdicts(f, cut)
    assert verdict.first().asDict()["reason"] is None
    rows = settlements.flatten(cut, verdict).orderBy("line").collect()
    assert [(r["line"], r["order_id"], float(r["amount"]), r["concept"]) for r in rows] == [(1, 1, 125.4, "Operación"), (2, 2, -45.0, "Devolución")]
    assert facts.settlement_facts(settlements.flatten(cut, verdict)).count() == 2


def test_reasons_and_whole_file_refusal(spark):
    f = files(
        spark, empty=[""], no_tail=[HEAD, *BODY], no_head=[*BODY, TAIL], short=[HEAD, "D;15/03/2026;x", TAIL], truncated=[HEAD, BODY[0], TAIL], amount=[HEAD, *BODY, "P;2;80,41;1,25"], fee=[HEAD, *BODY, "P;2;80,40;1,30"],
        bad_number=[HEAD, BODY[0].replace("125,40", "x"), BODY[1], TAIL], other=[HEAD, "X;ignored", *BODY, TAIL],
    )
    cut = settlements.lines(f)
    verdict = settlements.verdicts(f, cut)
    got = {r["name"]: r["reason"] for r in verdict.collect()}
    assert got == {
        "empty": "fichero_vacio", "no_tail": "pie_ausente_o_repetido", "no_head": "cabecera_ausente_o_repetida", "short": "detalle_invalido", "bad_number": "detalle_invalido", "other": None,
        "truncated": "pie_descuadrado: detalles_declarados=2 leidos=1", "amount": "pie_descuadrado: importe_declarado=80.41 real=80.40", "fee": "pie_descuadrado: comision_declarada=1.30 real=1.25",
    }
    assert {r["file"] for r in settlements.flatten(cut, verdict).collect()} == {"other"}


def test_texts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [str(value(text.amount(F.lit(x)))) for x in ("125,40", "-45,00", "1.234,56", "x")] == ["125.40", "-45.00", "1234.56", "None"]
    assert value(text.day_first_date(F.lit("03/04/2026"))) == date(2026, 4, 3)
    assert [value(text.order_reference(F.lit(x))) for x in ("ORD-000481219", "ORD-000", "AJUSTE-MENSUAL", "", " 481219 ")] == [481219, None, None, None, 481219]
    name = F.lit("LIQ_20260315_007_R.txt")
    assert (value(text.name_date(name)), value(text.name_sequence(name)), value(text.name_is_resend(name))) == (date(2026, 3, 15), 7, True)


def test_sequence_gaps(spark):
    numbers = lambda *x: spark.createDataFrame([(i,) for i in x], "sequence int")
    assert [[r[0] for r in landing.sequence_gaps(numbers(*x)).orderBy("missing").collect()] for x in ((1, 2, 4, 5), (10, 14), (), (3,))] == [[3], [11, 12, 13], [], []]


def test_sequence_gaps_over_ranges(spark):
    rng = random.Random(3)
    for kind in ("int", "bigint"):
        starts = {rng.randrange(-70_000, 300_000) for _ in range(6)} | {-65_537, -1, 65_535, 131_072}  # holes at and over the edges of ranges
        near = sorted({s + i for s in starts for i in (0, 1, 3)})
        got = landing.sequence_gaps(spark.createDataFrame([(x, 1) for x in near for _ in range(2)] + [(None, 1)], f"sequence {kind}, x int"))
        assert dict(got.dtypes) == {"missing": kind}
        assert sorted(r[0] for r in got.collect()) == sorted(set(range(near[0], near[-1])) - set(near))
    far = landing.sequence_gaps(spark.createDataFrame([(-(1 << 62),), ((1 << 62),), (3 - (1 << 62),)], "sequence bigint").filter("sequence < 0"))
    assert sorted(r[0] for r in far.collect()) == [1 - (1 << 62), 2 - (1 << 62)]
    grouped = spark.createDataFrame([("a", 1), ("a", 4), ("b", 70_000), ("b", 140_000), (None, 5), (None, 7)], "g string, sequence bigint")
    found = landing.sequence_gaps(grouped, group=["g"])
    assert {r["g"]: r["n"] for r in found.groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 69_999, None: 1}
    plan = landing.sequence_gaps(spark.range(10).toDF("sequence"))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("SinglePartition")[-1].count("hashpartitioning") >= 3  # only the ranges of ranges of ranges, 2^16 at most, meet in one task


def test_landing_register_and_quarantine(spark, tmp_path):
    zone = tmp_path / "zone"
    zone.mkdir()
    for name, content in (("a.txt", b"one"), ("b.txt", b"one"), ("c.txt", b"tw\xf3")):
        (zone / name).write_bytes(content)
    found = landing.scan(spark, str(zone))
    first = landing.unseen(found)
    assert sorted(r["name"] for r in first.collect()) == ["a.txt", "c.txt"]
    control = first.select("name", "content_hash", F.lit(None).alias("settlement_date"), F.lit(None).alias("sequence"), F.lit(1).alias("details"), F.lit(None).alias("amount"), F.when(F.col("name") == "a.txt", "accepted").otherwise("rejected").alias("outcome"), F.lit(None).alias("reason"), F.current_timestamp().alias("processed_at"), F.lit("b").alias("batch_id"))
    landing.register(control, str(tmp_path / "control"))
    again = landing.unseen(landing.scan(spark, str(zone)), spark.read.parquet(str(tmp_path / "control")))
    assert [r["name"] for r in again.collect()] == ["c.txt"]  # refused files may come again
    landing.quarantine_files(found, spark.createDataFrame([("c.txt", "bad")], "name string, reason string"), str(tmp_path / "quarantine"))
    assert bytes(spark.read.parquet(str(tmp_path / "quarantine")).first()["content"]) == b"tw\xf3"


def test_marks(spark, tmp_path):
    store = marks.MarkStore(spark, str(tmp_path / "marks"))
    assert store.read("orders") == marks.EPOCH
    at = datetime(2026, 3, 15, 14, 30, 45, 123456, tzinfo=timezone.utc)
    store.write("orders", at)
    assert store.read("orders") == at and store.read("other") == marks.EPOCH
    store.write("orders", at + timedelta(hours=1))
    assert store.read("orders") == at + timedelta(hours=1)
    assert store.reset(["orders", "other"]) == ["orders"] and store.read("orders") == marks.EPOCH
    assert spark.range(1).select(marks.canonical(F.lit("2026-03-15T16:30:45+02:00"))).first()[0] == "2026-03-15T14:30:45.000000+00:00"


def ingest_source(spark, *days):
    day = datetime(2026, 3, 15, tzinfo=timezone.utc)
    return spark.createDataFrame([(i, day + timedelta(days=i - 1)) for i in days], "id bigint, updated_at timestamp")


def test_ingest_step(spark, tmp_path):
    store, path = marks.MarkStore(spark, str(tmp_path / "marks")), str(tmp_path / "raw")
    source = ingest_source(spark, 1, 2)
    step = lambda df, batch, hours=0: marks.ingest_step(df, store, "t", "updated_at", timedelta(hours=hours), path, batch, datetime(2026, 3, 20), "shop")
    assert (step(source, "b1"), step(source, "b2"), step(source, "b3", 48)) == (2, 0, 2)
    more = source.unionByName(ingest_source(spark, 3))
    assert step(more, "b4") == 1 and lake.read_raw(spark, path, date(2026, 3, 20)).count() == 5 and lake.read_raw(spark, path, date(2026, 3, 1)).count() == 0
    assert set(lake.read_raw(spark, path).columns) == {"id", "updated_at", "_ingested_at", "_source_system", "_batch_id", "ingestion_date"}
    assert step(more, "b3", 48) == 0 and step(more, "b1") == 0 and lake.read_raw(spark, path).count() == 5  # repeated batches
    store.reset(["t"])
    assert step(more, "007") == 3 and lake.read_raw(spark, path).filter("_batch_id = '007'").count() == 3  # and a full load after a reset


@pytest.mark.parametrize("again", ["b1", "b2"])
@pytest.mark.parametrize("broken", ["before the record", "before the mark"])
def test_ingest_step_broken_and_repeated(spark, tmp_path, monkeypatch, again, broken):
    store, path = marks.MarkStore(spark, str(tmp_path / "marks")), str(tmp_path / "raw")
    step = lambda df, batch, day=20: marks.ingest_step(df, store, "t", "updated_at", timedelta(0), path, batch, datetime(2026, 3, day), "shop")

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(*((publication, "commit") if broken == "before the record" else (store, "write")), stop)
        with pytest.raises(RuntimeError):
            step(ingest_source(spark, 1, 2), "b1")
    assert lake.read_raw(spark, path).count() == (0 if broken == "before the record" else 2)
    # the source has grown, and a day has passed
    step(ingest_source(spark, 1, 2, 3), again, 21)
    step(ingest_source(spark, 1, 2, 3), "b3", 22)
    rows = lake.read_raw(spark, path)
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3]
    assert store.read("t") == datetime(2026, 3, 17, tzinfo=timezone.utc)


def test_lake_writes(spark, tmp_path):
    df = spark.sql("select 1 id, timestamp'2026-03-15 10:00:00' at union all select 2, timestamp'2026-04-01 10:00:00'")
    lake.replace_table(df, str(tmp_path / "t"), "months(at)")
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "t/at_month=*"))) == ["at_month=2026-03-01", "at_month=2026-04-01"]
    lake.replace_table(df.limit(1), str(tmp_path / "t2"))
    lake.replace_table(df, str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 2
    with pytest.raises(ValueError):
        lake.partition_column("weeks(at)")
    lake.write_quarantine(df.withColumn("_quality_errors", F.array(F.lit("x"))), str(tmp_path / "q"), "b", datetime(2026, 3, 15))
    assert spark.read.parquet(str(tmp_path / "q")).columns[-1] == "_quarantine_date"
    lake.write_report(df.select("id"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert lake.sized(df, 10).rdd.getNumPartitions() == 1 and lake.sized(df, 600_000).rdd.getNumPartitions() == 8


@pytest.mark.skipif(not glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars/derby-*.jar")), reason="no embedded database")
def test_jdbc(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(0, 1000).select(F.col("id").alias("ORDER_ID"), F.timestamp_seconds(F.lit(1773532800) + F.col("id") * 60).alias("UPDATED_AT"))
    jdbc.load(rows, options, "ORDERS")
    source = JdbcSource(schema="", watermark_column="UPDATED_AT", partition_column="ORDER_ID")
    whole = jdbc.reader(spark, options).option("dbtable", "ORDERS").load()
    mark = datetime(2026, 3, 15, 10)
    stats = jdbc.pending(whole, "UPDATED_AT", mark, "ORDER_ID").first()
    assert stats["rows"] == 399 and jdbc.scalar(spark, options, "select count(*) n from ORDERS")["N"] == 1000
    read = jdbc.read_incremental(spark, options, source, "ORDERS", mark, stats)
    assert read.count() == 399 and "PushedFilters: [" in read._jdf.queryExecution().toString()
    many = stats.asDict() | {"rows": 200_000}
    from pyspark.sql import Row

    wide = jdbc.read_incremental(spark, options, source, "ORDERS", mark, Row(**many))
    assert wide.rdd.getNumPartitions() == 4 and wide.count() == 399
    assert [jdbc.partitions(n) for n in (0, 49_999, 100_000, 10_000_000)] == [1, 1, 2, 8]
    good = spark.createDataFrame([("ORDERS", 1000)], "`table` string, rows bigint")
    jdbc.verify(spark, options, good, ["ORDERS"])
    with pytest.raises(ValueError):
        jdbc.verify(spark, options, good.withColumn("rows", F.lit(7).cast("bigint")), ["ORDERS"])
    jdbc.export(spark, options, source, "ORDERS", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_quantile_predicates_cut_skewed_values_evenly(spark):
    """Half of the values in a thousandth of the range, a wide gap, nulls, and one value of very many rows."""
    ids = spark.range(0, 40_000)
    dense = ids.select(F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.col("id") * 1000).alias("v"))
    times = ids.select(F.timestamp_seconds(F.pow(F.col("id") / 1000, 5)).alias("v"))
    days = ids.select(F.date_add(F.lit(date(2020, 1, 1)), F.sqrt("id").cast("int")).alias("v"))
    parts = ids.select((F.col("id") / 7).alias("v"))
    for df in (dense, times, days, parts):
        predicates = jdbc.quantile_predicates(df, "v", 16)
        counts = [df.filter(p).count() for p in predicates]
        assert len(predicates) == 16 and sum(counts) == 40_000 and max(counts) < 2 * 40_000 / 16
    hot = ids.select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(5)).otherwise(F.col("id")).alias("v"))
    counts = [hot.filter(p).count() for p in jdbc.quantile_predicates(hot, "v", 16)]
    assert sum(counts) == 40_000 and len(counts) >= 8
    assert jdbc.quantile_predicates(ids.select(F.lit(1).alias("v")), "v", 4) and jdbc.quantile_predicates(ids.limit(0), "id", 4) == ["1 = 1"]


def test_jdbc_parts_of_a_skewed_column(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jdbc, "ROWS_PER_PARTITION", 500)
    options = {"url": f"jdbc:derby:{tmp_path}/skewed;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(0, 4000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("ID"), F.timestamp_seconds(F.col("id")).alias("AT"), F.sha2(F.col("id").cast("string"), 256).alias("V"))
    jdbc.load(rows.coalesce(2), options, "T")
    source = JdbcSource(schema="", watermark_column="AT", partition_column="ID", most_connections=16)
    read = jdbc.read_parts(spark, options, source, "T", spark.createDataFrame([(4000, 0, 3999 * 1_000_000)], "rows bigint, lo bigint, hi bigint").first())
    counts = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 8 and sum(counts) == 4000 and max(counts) < 2 * 500
    assert jdbc.export(spark, options, source, "T", str(tmp_path / "out"), file_bytes=60_000) > 2
    sizes = [os.path.getsize(f) for f in glob.glob(str(tmp_path / "out/*.parquet"))]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000 and all(30_000 < s < 120_000 for s in sizes)


@pytest.mark.parametrize("file_bytes", [40_000, 400_000, 1 << 30])
def test_files_of_a_size(spark, tmp_path, file_bytes):
    df = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    files = lake.write_sized(df, str(tmp_path / "t"), file_bytes)
    sizes = [os.path.getsize(f) for f in glob.glob(str(tmp_path / "t/*.parquet"))]
    assert len(sizes) == files and spark.read.parquet(str(tmp_path / "t")).count() == 60_000
    assert files == 1 if file_bytes > 1 << 29 else all(file_bytes / 2 < s < file_bytes * 2 for s in sizes)
    assert lake.write_sized(df.limit(0), str(tmp_path / "none"), file_bytes) == 1 and spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_files_of_many_parts(spark, tmp_path):
    """A day with most of the orders, in ranges of 20 KB and chunks of 100 lines: the same lines as with each file in a row."""
    orders = spark.range(1, 3001).select(F.col("id").alias("order_id"), F.when(F.col("id") % 5 > 0, F.lit("2026-03-15")).otherwise(F.lit("2026-03-1")).alias("d"), F.when(F.col("id") % 7 == 0, -F.col("id") / 8).otherwise(F.col("id") / 4).alias("amount"))
    orders = orders.select("order_id", F.to_date(F.when(F.length("d") == 9, F.concat("d", (F.col("order_id") % 9).cast("string"))).otherwise(F.col("d"))).alias("order_date"), "amount")
    path = str(tmp_path / "zone")
    settlements.write_files(orders, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        settlements.read_lines(spark, path).write.parquet(str(tmp_path / "lines"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    cut = spark.read.parquet(str(tmp_path / "lines"))
    plain = settlements.lines(settlements.write_extract(orders))
    shown = lambda df: sorted((r["name"], r["position"], r["record"], r["line"]) for r in df.collect())
    assert shown(cut) == shown(plain)
    verdict = settlements.verdicts(cut.select("name").distinct(), cut)
    assert verdict.filter("outcome <> 'accepted'").count() == 0
    rows = settlements.numbered(settlements.details(cut), "name", "position", "number", chunk=100).collect()
    assert all(r["number"] == r["position"] for r in rows) and len(rows) == 3000
    large = sum(i % 5 > 0 or i % 9 == 5 for i in range(1, 3001))
    assert sorted(r["line"] for r in settlements.flatten(cut, verdict).filter("file like 'LIQ_20260315%'").collect()) == list(range(1, large + 1))


def test_reprocessing(spark):
    raw = spark.sql("select 1 id, date'2026-03-14' ingestion_date union all select 2, date'2026-03-15'")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert (ids(history.scope(raw)), ids(history.scope(raw, date(2026, 3, 14))), ids(history.scope(raw, full=True))) == ([2], [1], [1, 2])
    assert [s.name for s in history.subset(REGISTRY, ["orders", "customers"])] == ["customers", "orders"]
    with pytest.raises(ValueError):
        history.subset(REGISTRY, ["nothing"])


def test_embedded_database_opens_in_another_process(spark, tmp_path):
    """What the driver's process has loaded is there for a process of its own, while the session reads it too."""
    import subprocess
    from pathlib import Path

    import pyspark

    from lakeforge.sources import jdbc

    rows = spark.range(2500).selectExpr("id AS K", "id / 7 AS X", "timestamp'2024-03-01 10:00:00.25' + id * INTERVAL 1 SECOND AS T").repartition(3)
    options = jdbc.embedded(rows, "T1", f"file:{tmp_path}/base")
    read = jdbc.reader(spark, options).option("dbtable", "T1").load()
    assert sorted(read.collect()) == sorted(rows.collect())
    script = tmp_path / "count.sql"
    script.write_text(f"connect '{options['url']}'; SELECT 'found ' || CAST(count(*) AS CHAR(6)) FROM T1;")
    java = spark._jvm.java.lang.System.getProperty("java.home") + "/bin/java"
    out = subprocess.run([java, "-cp", f"{Path(pyspark.__file__).parent}/jars/*", "org.apache.derby.tools.ij", str(script)], capture_output=True, text=True, timeout=60, cwd=tmp_path)
    assert "found 2500" in out.stdout, out.stdout + out.stderr
