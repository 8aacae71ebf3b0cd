import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeforge.functions import timezone as tz
from lakeforge.operators import aggregates, reconcile, sessions
from lakeforge.plans.flows import refresh_visits
from lakeforge.sources.versions import KeyedTable, VersionedTable
from lakeforge.spec import TableSpec
from lakeforge.streaming import events as streaming

EVENTS = "event_id bigint, session_id string, event_time timestamp, customer_id bigint, event_type string, device string, utm_source string, amount double"
NOON = datetime(2026, 3, 15, 12)


def events(spark, *rows):
    full = [(i, r.get("who", "v"), NOON + timedelta(seconds=r["at"]), r.get("customer"), r.get("type", "page_view"), r.get("device"), r.get("source"), r.get("amount")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


@pytest.mark.parametrize(("second", "visits"), [(1800, 1), (1801, 2)])
def test_gap_is_strict(spark, second, visits):
    assert sessions.summarize_visits(events(spark, {"at": 0}, {"at": second})).count() == visits


def test_two_visits_with_their_durations(spark):
    got = sessions.summarize_visits(events(spark, {"at": 0}, {"at": 300}, {"at": 7500})).orderBy("session_key").collect()
    assert [(r["session_key"], r["duration_seconds"], r["events"]) for r in got] == [("v#1", 300, 2), ("v#2", 0, 1)]


def test_visit_attributes(spark):
    df = events(
        spark, {"at": 0, "device": None, "source": "ads"}, {"at": 5, "device": "movil", "source": "mail", "type": "product_view"}, {"at": 9, "customer": 7, "device": "tablet", "type": "purchase", "amount": 12.5}, {"at": 0, "who": "w"}
    )
    a, b = sessions.summarize_visits(df).orderBy("session_key").collect()
    assert (a["device"], a["utm_source"], a["customer_id"], a["anonymous"], a["product_views"], a["purchased"], float(a["amount"])) == ("movil", "ads", 7, False, 1, True, 12.5)
    assert (b["anonymous"], b["purchased"], float(b["amount"]), b["device"]) == (True, False, 0.0, None)


def orders(spark, rows):
    return spark.createDataFrame(rows, "order_id bigint, order_date string, total_amount double").withColumn("order_date", F.to_date("order_date"))


def settled(spark, rows):
    return spark.createDataFrame(rows, "operation_date string, kind string, amount double, fee double").withColumn("operation_date", F.to_date("operation_date"))


def test_reconciliation_balances_gross(spark):
    r = reconcile.reconcile(orders(spark, [(1, "2026-03-15", 100.0)]), settled(spark, [("2026-03-15", "PAGO", 100.0, 2.25)])).first()
    assert (float(r["imbalance"]), float(r["expected"]), r["balanced"]) == (0.0, 97.75, True)


def test_reconciliation_inside_the_covered_period(spark):
    o = orders(spark, [(1, "2026-03-14", 50.0), (2, "2026-03-15", 1000.0), (3, "2026-03-16", 10.0), (4, "2026-03-17", 5.0), (5, "2026-04-01", 5.0)])
    s = settled(spark, [("2026-03-15", "PAGO", 500.0, 0.0), ("2026-03-17", "PAGO", 5.0, 0.0), ("2026-03-17", "DEVOL", -1.0, 0.0)])
    got = {str(r["day"]): (r["balanced"], r["movements"]) for r in reconcile.reconcile(o, s).collect()}
    assert got == {"2026-03-15": (False, 1), "2026-03-16": (False, 0), "2026-03-17": (True, 2)}
    assert reconcile.summarize(reconcile.reconcile(o, s)).first()["unbalanced_days"] == 2
    assert reconcile.reconcile(o, s.limit(0)).count() == 5


def test_unexplained_money(spark):
    r = reconcile.reconcile(orders(spark, [(1, "2026-03-15", 1.0)]), settled(spark, [("2026-03-16", "PAGO", 5.0, 0.0)])).collect()
    assert [(str(x["day"]), x["balanced"], x["relative"]) for x in r] == [("2026-03-16", False, None)]


def test_average_ticket_is_per_order(spark):
    facts = spark.createDataFrame([(1, 9, 1, 100.0), (1, 9, 1, 100.0), (2, 9, 1, 100.0), (2, 8, 1, 100.0)], "order_id bigint, product_key bigint, quantity int, line_amount double").withColumn("order_date", F.lit("2026-03-15").cast("date"))
    products = spark.createDataFrame([(9, "c"), (8, "c")], "product_key bigint, category string")
    r = aggregates.daily_sales(facts, products).first()
    assert (r["avg_ticket"], r["orders"], r["lines"], r["revenue"]) == (200.0, 2, 4, 400.0) and aggregates.ticket_faults(aggregates.daily_sales(facts, products)).count() == 0


def test_clock_changes(spark):
    days = spark.sql("select explode(sequence(date'2025-08-01', date'2026-07-31')) as date")
    assert sorted((str(r[0]), r[1]) for r in tz.transitions(days, "Europe/Madrid").collect()) == [("2025-10-26", "back"), ("2026-03-29", "forward")]
    df = spark.sql("select timestamp(x) as x from values ('2025-10-26 02:30:00'), ('2026-03-29 02:30:00'), ('2026-06-15 02:30:00'), ('2025-10-26 03:00:00'), ('2025-10-26 01:59:59') as t(x)")
    got = {str(r[0]): (r[1], r[2]) for r in df.select("x", tz.ambiguous(F.col("x"), "Europe/Madrid"), tz.missing(F.col("x"), "Europe/Madrid")).collect()}
    assert got == {"2025-10-26 02:30:00": (True, False), "2026-03-29 02:30:00": (False, True), "2026-06-15 02:30:00": (False, False), "2025-10-26 03:00:00": (False, False), "2025-10-26 01:59:59": (False, False)}


# -- streaming over a replayed folder ---------------------------------------------------------------------------------
def stream(spark, tmp_path, *batches):
    for n, df in enumerate(batches):
        df.coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))


def memory(query_frame, name, tmp_path, mode="append"):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_frame.sparkSession.table(name)


def test_stream_first_arrivals(spark, tmp_path):
    a = events(spark, {"at": 0}, {"at": 10}).withColumn("received_at", F.col("event_time"))
    got = memory(streaming.first_arrivals(stream(spark, tmp_path, a, a)), "first_arrivals", tmp_path)
    assert got.count() == 2


def test_stream_visits_equal_batch(spark, tmp_path):
    df = events(spark, {"at": 0}, {"at": 1800}, {"at": 3700, "type": "purchase"}, {"at": 5, "who": "w"})
    closing = events(spark, {"at": 900000, "who": "z"})
    got = memory(streaming.visits(stream(spark, tmp_path, df, closing, closing)), "visits", tmp_path)
    batch = sessions.summarize_visits(df)
    assert sorted((r["session_id"], r["events"]) for r in got.filter("session_id <> 'z'").collect()) == sorted((r["session_key"].split("#")[0], r["events"]) for r in batch.collect())


def test_stream_late_rows_are_routed(spark, tmp_path):
    old, new = events(spark, {"at": 0}), events(spark, {"at": 400000}, {"at": -1})
    source = stream(spark, tmp_path, new, old)
    q = streaming.route_late(source, "event_time", 48 * 3600, str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    good, late = spark.read.parquet(str(tmp_path / "good")).count(), spark.read.parquet(str(tmp_path / "late")).count()
    assert good + late == 3 and late >= 1


def test_stream_upsert(spark, tmp_path):
    spec = TableSpec("t", ("id",), ("at",))
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id bigint, at bigint, v string")
    b = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "id bigint, at bigint, v string")
    table = KeyedTable(spark, str(tmp_path / "table"), spec, buckets=8)
    q = streaming.upsert_stream(stream(spark, tmp_path, a, b), table, str(tmp_path / "ck"), policy="ordered")
    q.awaitTermination(120)
    assert sorted((r["id"], r["v"]) for r in table.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_late_rows_read_one_row_of_progress(spark, tmp_path):
    batches = [events(spark, {"at": 100_000 * n}, {"at": 0}) for n in range(4)]
    q = streaming.route_late(stream(spark, tmp_path, *batches), "event_time", 150_000, str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "ck"))
    q.awaitTermination(240)
    progress = spark.read.parquet(str(tmp_path / "ck/progress")).orderBy("batch").collect()
    assert [r["batch"] for r in progress] == [0, 1, 2, 3] and all(a["newest"] <= b["newest"] for a, b in zip(progress, progress[1:], strict=False))
    assert spark.read.parquet(str(tmp_path / "good")).count() + spark.read.parquet(str(tmp_path / "late")).count() == 8


# -- visits on two levels and by day -----------------------------------------------------------------------------------
def plain_visits(rows, gap):
    """(visitor, first, last, events) of rows (visitor, second)."""
    out = []
    for who in {w for w, _ in rows}:
        times = sorted(t for w, t in rows if w == who)
        for t in times:
            if out and out[-1][0] == who and t - out[-1][2] <= gap:
                out[-1][2:] = [t, out[-1][3] + 1]
            else:
                out.append([who, t, t, 1])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("chunk", [10, 700, 86_400])
def test_visits_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(20_000)) for _ in range(700)] + [("hot", 5), ("hot", 5)]
    df = events(spark, *({"at": t, "who": w} for w, t in rows)).unionByName(spark.createDataFrame([(9999, "hot", None, None, "x", None, None, None)], EVENTS))
    marked = sessions.mark_visits(df, timedelta(seconds=60), chunk=chunk)
    second = F.unix_seconds("event_time") - F.unix_seconds(F.lit(NOON))
    got = marked.filter("event_time is not null").groupBy("session_id", "session_key").agg(F.min(second).alias("a"), F.max(second).alias("b"), F.count("*").alias("n")).collect()
    assert sorted(((r["session_id"], r["a"], r["b"], r["n"]) for r in got), key=str) == plain_visits(rows, 60)
    hot = sorted((r for r in got if r["session_id"] == "hot"), key=lambda r: r["a"])
    assert [r["session_key"] for r in hot] == [f"hot#{i + 1}" for i in range(len(hot))]
    assert marked.count() == len(rows) + 1 and marked.filter("event_time is null and session_key is null").count() == 1


def test_visits_of_one_visitor_are_linear(spark):
    """The rows that are joined follow the events, not events times visits."""
    n = 80_000
    one = spark.range(n).select(F.lit("v").alias("session_id"), F.timestamp_seconds(F.col("id") * 2000).alias("event_time"))
    began = time.perf_counter()
    assert sessions.mark_visits(one).agg(F.count_distinct("session_key")).first()[0] == n
    assert time.perf_counter() - began < 60
    plan = sessions.mark_visits(one)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_only_touched_days_are_rebuilt(spark, tmp_path, seed):
    rng, day = random.Random(seed), 86_400
    first = [{"at": rng.randrange(12) * day + rng.randrange(day), "who": rng.choice("abc"), "device": rng.choice([None, "d"])} for _ in range(300)]
    first += [{"at": 13 * day - 43_200 + 600, "who": "edge"}]  # just after midnight
    late = [{"at": rng.randrange(4, 6) * day + rng.randrange(day), "who": rng.choice("abz")} for _ in range(20)]
    late += [{"at": 13 * day - 43_200 - 600, "who": "edge"}]  # the visit now starts the day before
    everything = events(spark, *first, *late)
    known = everything.filter(F.col("event_id") < len(first))
    table = VersionedTable(spark, str(tmp_path / "visits"))
    refresh_visits(table, known, None, 1)
    before = {r["part"]: r["written"] for r in table.manifest(1)}
    for _ in range(2):
        got = refresh_visits(table, everything, everything.filter(F.col("event_id") >= len(first)), 2)
    wanted = sessions.summarize_visits(everything)
    assert sorted(map(str, got.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    after = {r["part"]: r["written"] for r in table.manifest(2)}
    assert {p for p, w in after.items() if p and w == 2} <= {"2026-03-18", "2026-03-19", "2026-03-20", "2026-03-21", "2026-03-27", "2026-03-28"}
    assert "2026-03-28" not in after or before["2026-03-28"] == 1 and sum(w == 1 for p, w in after.items() if p) >= 5


def test_stream_landing_once(spark, tmp_path):
    (tmp_path / "zone").mkdir()
    for name, text in (("a.txt", b"one"), ("b.txt", b"one"), ("c.txt", b"two")):
        (tmp_path / "zone" / name).write_bytes(text)
    seen = []
    for _ in range(2):
        streaming.landing(spark, str(tmp_path / "zone"), str(tmp_path / "ck"), lambda: None, lambda df, n: seen.extend(r["name"] for r in df.collect())).awaitTermination(120)
    assert sorted(seen) == ["a.txt", "c.txt"]
