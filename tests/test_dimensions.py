from datetime import datetime

from pyspark.sql import functions as F

from lakeforge.operators import dimensions as dim
from lakeforge.operators import facts, upsert
from lakeforge.spec import TableSpec

VERSIONS = "customer_key bigint, customer_id bigint, segment string, country_code string, valid_from timestamp, valid_to timestamp, is_current boolean"
A, B, END = datetime(2020, 1, 1), datetime(2026, 6, 1), datetime(9999, 12, 31)


def two_versions(spark):
    return spark.createDataFrame([(100, 1, "bronze", "ES", A, B, False), (200, 1, "gold", "ES", B, END, True)], VERSIONS)


def test_surrogate_key_is_stable_positive_and_null_for_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string").withColumn("s", dim.surrogate_key("k"))
    got = [r["s"] for r in df.collect()]
    assert got[0] == got[1] != got[2] and min(got[:3]) >= 0 and got[3] is None


def test_unknown_member_has_the_schema(spark):
    out = dim.with_unknown(two_versions(spark), "customer_key", {"is_current": F.lit(True)})
    row = out.filter("customer_key = -1").first()
    assert out.schema.names == two_versions(spark).schema.names and row["segment"] == "(desconocido)" and row["customer_id"] is None and row["is_current"]


def test_as_of_join_old_new_edge_orphan(spark):
    orders = spark.createDataFrame([(1, 1, datetime(2021, 5, 1)), (2, 1, B), (3, 9, B), (4, None, B), (5, 1, datetime(2019, 1, 1)), (6, 1, None)], "order_id bigint, customer_id bigint, order_date timestamp")
    got = {r["order_id"]: r["customer_key"] for r in dim.as_of_join(orders, two_versions(spark), "customer_id", "order_date", "customer_key").collect()}
    assert got == {1: 100, 2: 200, 3: -1, 4: -1, 5: -1, 6: -1}


def test_as_of_join_is_no_nested_loop(spark):
    orders = spark.createDataFrame([(1, 1, B)], "order_id bigint, customer_id bigint, order_date timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dim.as_of_join(orders, two_versions(spark), "customer_id", "order_date", "customer_key")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan


def incoming(spark, rows):
    return spark.createDataFrame([(*r, datetime(2026, 7, 1)) for r in rows], "customer_id bigint, segment string, country_code string, _change timestamp")


def test_scd2_changes(spark):
    current = spark.createDataFrame(
        [(1, 1, "a", "ES", A, END, True), (2, 2, "a", None, A, END, True), (3, 3, "a", "ES", A, END, True), (4, 4, "a", "ES", A, B, False), (5, 4, "b", "ES", B, END, True)], VERSIONS
    )
    rows = incoming(spark, [(1, "a", "ES"), (2, "a", "PT"), (3, "a", None), (4, "b", "ES"), (7, "x", "ES")])
    closed, opened = dim.scd2_changes(rows, current, "customer_id", ["segment", "country_code"])
    assert sorted(r["customer_id"] for r in closed.collect()) == [2, 3]
    assert sorted(r["customer_id"] for r in opened.collect()) == [2, 3, 7]


def test_scd2_apply_keeps_the_invariants_and_does_nothing_twice(spark):
    first = dim.scd2_first(incoming(spark, [(1, "a", "ES"), (2, "b", "ES")]), "customer_id", ["segment", "country_code"], "customer_key")
    later = incoming(spark, [(1, "z", "ES"), (3, "c", "ES")])
    arguments = ("customer_id", ["segment", "country_code"], "_change", "customer_key", ["segment", "country_code"])
    once = dim.scd2_apply(later, first, *arguments)
    assert once.count() == 4 and dim.scd2_faults(once, "customer_id").count() == 0
    assert dim.scd2_apply(later, once, *arguments).count() == 4


def test_facts_are_not_multiplied_and_unknown_is_visible(spark):
    items = spark.createDataFrame([("a", 1, 5, 2, 10.0, 20.0), ("b", 1, 99, 1, 5.0, 5.0), ("c", 77, 5, 1, 1.0, 1.0)], "order_item_id string, order_id bigint, product_id bigint, quantity int, unit_price double, line_amount double")
    orders = spark.createDataFrame([(1, 1, "paid", "EUR", B)], "order_id bigint, customer_id bigint, status string, currency string, order_date timestamp")
    products = spark.createDataFrame([(50, 5), (-1, None)], "product_key bigint, product_id bigint")
    got = {r["order_item_id"]: (r["customer_key"], r["product_key"], r["date_key"]) for r in facts.order_item_facts(items, orders, two_versions(spark), products).collect()}
    assert got == {"a": (200, 50, 20260601), "b": (200, -1, 20260601), "c": (-1, 50, None)}


def test_upsert_twice_is_once_and_policies_differ(spark):
    spec = TableSpec("t", ("id",), ("at",))
    target = spark.createDataFrame([(1, 5, "new"), (2, 1, "same")], "id bigint, at bigint, v string")
    batch = spark.createDataFrame([(1, 3, "old"), (3, 1, "added")], "id bigint, at bigint, v string")
    shown = lambda df: sorted((r["id"], r["v"]) for r in df.collect())
    once = upsert.upsert(target, batch, spec)
    assert shown(once) == [(1, "old"), (2, "same"), (3, "added")] == shown(upsert.upsert(once, batch, spec))
    assert shown(upsert.upsert(target, batch, spec, "ordered")) == [(1, "new"), (2, "same"), (3, "added")]
    assert shown(upsert.upsert(None, batch, spec)) == [(1, "old"), (3, "added")]


def test_update_where_and_earlier_states(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    changes = spark.createDataFrame([(2, "z")], "id bigint, v string")
    assert [r["v"] for r in upsert.update_where(target, changes, ["id"], {"v": F.col("change.v")}).orderBy("id").collect()] == ["a", "z"]
    history = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 3)], "id bigint, v string, version int")
    assert [(r["id"], r["v"]) for r in upsert.as_of_version(history, ["id"], 2).collect()] == [(1, "b")]
