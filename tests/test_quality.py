import dataclasses
from datetime import timedelta

import pytest

from lakeforge.operators import quality
from lakeforge.operators.dedup import deduplicate
from lakeforge.operators.normalize import normalize
from lakeforge.plans.domain import REGISTRY
from lakeforge.spec import Registry, TableSpec, TimeSanity

CUSTOMER = "customer_id bigint, email string, country_code string, segment string, created_at timestamp, updated_at timestamp, _ingested_at timestamp"


def customers(spark, rows):
    from datetime import datetime

    at = datetime(2026, 3, 15)
    filled = [(*r, *(None,) * (4 - len(r)), at, at, at) for r in rows]
    return spark.createDataFrame(filled, CUSTOMER)


def reasons(refused, key="customer_id"):
    return {r[key]: sorted(r[quality.REASONS]) for r in refused.collect()}


def test_normalize_keeps_nulls_and_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, "  A@B.Com ", " es"), (2, None, None)], "customer_id bigint, email string, country_code string")
    assert [tuple(r) for r in normalize(df, REGISTRY["customers"]).orderBy("customer_id").collect()] == [(1, "a@b.com", "ES"), (2, None, None)]
    assert normalize(df.select("customer_id"), REGISTRY["customers"]).columns == ["customer_id"]


def test_null_email_has_exactly_one_reason(spark):
    _, refused = quality.split(customers(spark, [(1, None, "ES", "building")]), REGISTRY["customers"])
    assert reasons(refused) == {1: ["email_nulo"]}


def test_all_reasons_and_no_row_lost(spark):
    df = customers(spark, [(1, "x", "ESP", "nothing"), (2, "a@b.co", "ES", "building"), (3, None, None, None)])
    valid, refused = quality.split(df, REGISTRY["customers"])
    assert reasons(refused)[1] == ["country_code_formato", "email_formato", "segment_valor_no_admitido"]
    assert valid.count() + refused.count() == 3 and valid.columns == df.columns


def test_bounds_are_inclusive(spark):
    spec = TableSpec("t", ("id",), ranges={"q": (1, 1000)})
    df = spark.createDataFrame([(1, 1), (2, 1000), (3, 0), (4, 5000), (5, None)], "id bigint, q bigint")
    _, refused = quality.split(df, spec)
    assert reasons(refused, "id") == {3: ["q_bajo_minimo"], 4: ["q_sobre_maximo"]}


def test_time_rule_counts_fractions_and_tolerance(spark):
    spec = TableSpec("t", ("id",), time_sanity=(TimeSanity("a", "b", timedelta(seconds=1)),))
    df = spark.sql("select 1 id, timestamp'2026-01-01 00:00:01.000' a, timestamp'2026-01-01' b union all select 2, timestamp'2026-01-01 00:00:01.001', timestamp'2026-01-01' union all select 3, null, timestamp'2026-01-01'")
    assert list(reasons(quality.split(df, spec)[1], "id")) == [2]


def test_orphans_against_the_whole_batch(spark):
    spec = TableSpec("orders", ("order_id",), references={"customer_id": ("customers", "customer_id")})
    orders = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "order_id bigint, customer_id bigint")
    parents = {"customers": spark.createDataFrame([(10,), (10,)], "customer_id bigint")}
    valid, refused = quality.split(orders, spec, parents)
    assert reasons(refused, "order_id") == {2: ["customer_id_huerfano"]} and valid.count() == 2
    assert quality.split(orders, spec)[1].count() == 0  # no parent given, nothing checked


def test_no_rules_means_valid_and_empty_report(spark):
    df = spark.createDataFrame([(1,)], "id bigint")
    valid, refused = quality.split(df, TableSpec("t", ("id",)))
    assert (valid.count(), refused.count()) == (1, 0)
    assert quality.report(quality.judge(df.limit(0), TableSpec("t", ("id",))), "t").first().asDict() == {"table": "t", "total": 0, "valid": 0, "quarantined": 0, "rate": 0.0}


def test_gate(spark):
    registry = Registry(TableSpec("a", ("id",), quarantine_threshold=0.05), TableSpec("b", ("id",), quarantine_threshold=0.01))
    reports = spark.createDataFrame([("a", 100, 95, 5, 0.05), ("b", 100, 98, 2, 0.02)], "`table` string, total bigint, valid bigint, quarantined bigint, rate double")
    assert quality.gate(reports, registry).first().asDict() == {"passed": False, "tables_over": 1, "total": 200, "quarantined": 7, "rate": 0.035}


@pytest.mark.parametrize(("keep", "wanted"), [("latest", "new"), ("first", "old")])
def test_dedup_nulls_lose(spark, keep, wanted):
    spec = TableSpec("t", ("id",), ("at",), keep)
    df = spark.createDataFrame([(1, 2, "new"), (1, 1, "old"), (1, None, "none")], "id bigint, at bigint, v string")
    once = deduplicate(df, spec)
    assert [r["v"] for r in once.collect()] == [wanted] and deduplicate(once, spec).count() == 1


def test_dedup_ties_by_ingestion_and_refuses_to_guess(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b")], "id bigint, at bigint, _ingested_at bigint, v string")
    assert deduplicate(df, TableSpec("t", ("id",), ("at",))).first()["v"] == "b"
    with pytest.raises(ValueError):
        deduplicate(df, TableSpec("t", ("id",)))


@pytest.mark.parametrize(
    "change",
    [
        {"business_key": ()}, {"not_null": ()}, {"dedup_order": ()}, {"allowed_values": {"a": ()}}, {"ranges": {"a": (None, None)}}, {"ranges": {"a": (2, 1)}},
        {"time_sanity": (TimeSanity("a", "a"),)}, {"time_sanity": (TimeSanity("a", "b", timedelta(seconds=-1)),)}, {"references": {"a": ("later", "id")}},
    ],
)
def test_registry_refuses_contradictions(change):
    good = TableSpec("t", ("id",), ("at",), not_null=("id",))
    Registry(good).validate()
    with pytest.raises(ValueError):
        Registry(dataclasses.replace(good, **change)).validate()


def test_registry_by_source():
    assert [s.name for s in REGISTRY.files()] == ["settlements"] and "web_events" in {s.name for s in REGISTRY.jdbc()}


def test_lines_are_dealt_by_their_number(spark):
    """A task holds a bounded share of the lines, and orders are counted as before."""
    from lakeforge.operators import aggregates
    from lakeforge.sources import lake

    rows = spark.range(1200).selectExpr("date_add(date'2024-01-01', CAST(id % 3 AS INT)) AS order_date", "id % 7 AS product_key", "IF(id % 50 = 0, NULL, id % 90) AS order_id", "2.0D AS quantity", "0.335D + id AS line_amount")
    goods = spark.range(6).selectExpr("id AS product_key", "concat('c', id % 2) AS category")
    assert lake.task_parts(rows) is None and lake.task_parts(rows, 100) == 12
    whole, dealt = aggregates.daily_sales(rows, goods), aggregates.daily_sales(rows, goods, 12)
    assert "hashpartitioning(order_id" in dealt._jdf.queryExecution().toString() and ", 12)" in dealt._jdf.queryExecution().toString()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    exact = {(str(r[0]), r[1]): r[2] for r in rows.join(goods, "product_key", "left").selectExpr("order_date", "category", "order_id").distinct().filter("order_id is not null").groupBy("order_date", "category").count().collect()}
    assert {(str(r["sale_date"]), r["category"]): r["orders"] for r in dealt.collect()} == exact


@pytest.mark.parametrize("name", ["agg_daily_sales", "chk_avg_ticket"])
def test_sales_of_many_lines(spark, duck, monkeypatch, name):
    from lakeforge.plans import queries
    from lakeforge.sources import lake

    from .conftest import DATA, rows_of

    few = lake.task_parts
    monkeypatch.setattr(lake, "task_parts", lambda table: few(table, 4_000))
    out = queries.QUERIES[name](spark, DATA)
    assert ", 15)" in out._jdf.queryExecution().toString()  # 60,000 lines
    assert rows_of(out.toPandas()) == rows_of(duck.sql(queries.ORACLES[name]).df())
