"""The registered queries, each with the DuckDB text that must give the same rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import timezone as tz
from ..operators import aggregates, dimensions, eventtime, facts, quality, reconcile, sessions, settlements, upsert
from ..operators.dedup import deduplicate
from ..operators.normalize import normalize
from ..sources import jdbc, lake, landing, marks
from .domain import EMAIL, REGISTRY, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def stamp(column: str):
    """Seconds since 1970, the form in which times are compared."""
    return F.col(column).cast("timestamp").cast("long").alias(column)


def day(column: str):
    return F.date_format(F.col(column).cast("date"), "yyyy-MM-dd").alias(column)


def spec(name: str, **changes):
    return dataclasses.replace(REGISTRY[name], **changes)


# -- cleaned tables ---------------------------------------------------------------------------------------------------
RAW = {"customers": "customers_raw", "products": "products_raw", "orders": "orders_raw", "order_items": "items_raw", "web_events": "events_raw"}


GIVEN = {"customers": "customer", "products": "part", "orders": "orders", "order_items": "lineitem", "web_events": "events"}


def parts_of(spark: SparkSession, d: str, name: str) -> int | None:
    """Partitions for the rows of a table, from the given one that it is derived from."""
    return lake.task_parts(view(spark, d, GIVEN[name]))


def clean(spark: SparkSession, d: str, name: str, raw: str) -> DataFrame:
    return deduplicate(normalize(view(spark, d, raw), REGISTRY[name]), REGISTRY[name], parts=parts_of(spark, d, name))


def parents(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Keys of the parents' whole batches, refused rows included."""
    return {
        "customers": quality.key_universe(view(spark, d, "customers_raw"), "customer_id"),
        "products": quality.key_universe(view(spark, d, "products_raw"), "product_id"),
        "orders": quality.key_universe(view(spark, d, "orders_raw"), "order_id"),
    }


def judged(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    return quality.split(clean(spark, d, name, RAW[name]), REGISTRY[name], parents(spark, d))


def marked(spark: SparkSession, d: str, name: str) -> DataFrame:
    return quality.judge(clean(spark, d, name, RAW[name]), REGISTRY[name], parents(spark, d))


CUSTOMERS = """customers AS (
    SELECT customer_id, lower(trim(email)) AS email, full_name, upper(trim(country_code)) AS country_code, segment, marketing_opt_in, created_at, updated_at
    FROM {customers_raw} QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC NULLS LAST) = 1)"""
PRODUCTS = "products AS (SELECT product_id, upper(trim(sku)) AS sku, name, lower(trim(category)) AS category, unit_price, is_active, created_at, updated_at FROM {products_raw})"
ORDERS = "clean_orders AS (SELECT order_id, customer_id, order_date, lower(trim(status)) AS status, upper(trim(currency)) AS currency, total_amount, updated_at FROM {orders_raw})"
ITEMS = """items AS (
    SELECT * FROM {items_raw} QUALIFY row_number() OVER (PARTITION BY order_id, line_number ORDER BY updated_at DESC NULLS LAST, product_id DESC, supplier_id DESC) = 1)"""
EVENTS = """clean_events AS (
    SELECT event_id, event_time, received_at, session_id, customer_id, lower(trim(event_type)) AS event_type, quantity, amount, lower(trim(device)) AS device, lower(trim(utm_source)) AS utm_source
    FROM {events_raw} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST) = 1)"""
CUSTOMER_REASONS = f"""list_filter([
    CASE WHEN customer_id IS NULL THEN 'customer_id_nulo' END, CASE WHEN email IS NULL THEN 'email_nulo' END,
    CASE WHEN segment NOT IN ('automobile', 'building', 'furniture', 'household', 'machinery') THEN 'segment_valor_no_admitido' END,
    CASE WHEN epoch(created_at) > epoch(updated_at) + 1 THEN 'created_at_posterior_a_updated_at' END,
    CASE WHEN NOT regexp_matches(email, '{EMAIL}') THEN 'email_formato' END,
    CASE WHEN NOT regexp_matches(country_code, '^[A-Z][A-Z]$') THEN 'country_code_formato' END], lambda x: x IS NOT NULL)"""
PRODUCT_REASONS = """list_filter([
    CASE WHEN product_id IS NULL THEN 'product_id_nulo' END, CASE WHEN sku IS NULL THEN 'sku_nulo' END, CASE WHEN unit_price < 0 THEN 'unit_price_negativo' END,
    CASE WHEN category NOT IN ('economy', 'large', 'medium', 'promo', 'small', 'standard') THEN 'category_valor_no_admitido' END,
    CASE WHEN epoch(created_at) > epoch(updated_at) + 1 THEN 'created_at_posterior_a_updated_at' END], lambda x: x IS NOT NULL)"""
ORDER_REASONS = """list_filter([
    CASE WHEN order_id IS NULL THEN 'order_id_nulo' END, CASE WHEN customer_id IS NULL THEN 'customer_id_nulo' END, CASE WHEN order_date IS NULL THEN 'order_date_nulo' END,
    CASE WHEN total_amount < 0 THEN 'total_amount_negativo' END, CASE WHEN status NOT IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled', 'returned') THEN 'status_valor_no_admitido' END,
    CASE WHEN currency NOT IN ('EUR') THEN 'currency_valor_no_admitido' END,
    CASE WHEN customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer) THEN 'customer_id_huerfano' END], lambda x: x IS NOT NULL)"""
ITEM_REASONS = """list_filter([
    CASE WHEN order_id IS NULL THEN 'order_id_nulo' END, CASE WHEN line_number IS NULL THEN 'line_number_nulo' END, CASE WHEN product_id IS NULL THEN 'product_id_nulo' END,
    CASE WHEN quantity < 0 THEN 'quantity_negativo' END, CASE WHEN line_amount < 0 THEN 'line_amount_negativo' END, CASE WHEN quantity > 1000 THEN 'quantity_sobre_maximo' END,
    CASE WHEN order_id NOT IN (SELECT o_orderkey FROM orders) THEN 'order_id_huerfano' END, CASE WHEN product_id NOT IN (SELECT p_partkey FROM part) THEN 'product_id_huerfano' END], lambda x: x IS NOT NULL)"""
EVENT_REASONS = """list_filter([
    CASE WHEN event_id IS NULL THEN 'event_id_nulo' END, CASE WHEN session_id IS NULL THEN 'session_id_nulo' END, CASE WHEN amount < 0 THEN 'amount_negativo' END,
    CASE WHEN quantity > 1000 THEN 'quantity_sobre_maximo' END,
    CASE WHEN event_type NOT IN ('page_view', 'product_view', 'add_to_cart', 'remove_from_cart', 'checkout_start', 'purchase') THEN 'event_type_valor_no_admitido' END,
    CASE WHEN device NOT IN ('movil', 'escritorio', 'tablet') THEN 'device_valor_no_admitido' END,
    CASE WHEN epoch_us(event_time) > epoch_us(received_at) + 300000000 THEN 'event_time_posterior_a_received_at' END,
    CASE WHEN customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer) THEN 'customer_id_huerfano' END], lambda x: x IS NOT NULL)"""
ALL_REASONS = [("customers", CUSTOMERS, "customers", CUSTOMER_REASONS), ("products", PRODUCTS, "products", PRODUCT_REASONS), ("orders", ORDERS, "clean_orders", ORDER_REASONS), ("order_items", ITEMS, "items", ITEM_REASONS), ("web_events", EVENTS, "clean_events", EVENT_REASONS)]
VISITS = """opened AS (
    SELECT *, sum(CASE WHEN pause IS NULL OR pause > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT *, CAST(floor(epoch(event_time)) AS BIGINT) - lag(CAST(floor(epoch(event_time)) AS BIGINT)) OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS pause FROM good)
), visits AS (
    SELECT concat(session_id, '#', n) AS session_key, min(event_time) AS session_start, max(event_time) AS session_end,
           CAST(floor(epoch(max(event_time))) - floor(epoch(min(event_time))) AS BIGINT) AS duration_seconds, count(*) AS events, max(customer_id) AS customer_id, max(customer_id) IS NULL AS anonymous,
           arg_min(device, (event_time, event_id)) FILTER (device IS NOT NULL) AS device, arg_min(utm_source, (event_time, event_id)) FILTER (utm_source IS NOT NULL) AS utm_source,
           count(*) FILTER (event_type = 'product_view') AS product_views, coalesce(bool_or(event_type = 'add_to_cart'), false) AS added_to_cart, coalesce(bool_or(event_type = 'checkout_start'), false) AS started_checkout,
           coalesce(bool_or(event_type = 'purchase'), false) AS purchased, coalesce(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (event_type = 'purchase'), 0) AS amount
    FROM opened GROUP BY 1
)"""
GOOD = f"{EVENTS}, good AS (SELECT * FROM clean_events WHERE len({EVENT_REASONS}) = 0)"


def good_visits(gap: int) -> str:
    return GOOD + ", " + VISITS.replace("{gap}", str(gap))


# -- ingestion --------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def src_incremental_filter(spark, d):
    df = view(spark, d, "orders")
    return df.filter(F.col("o_orderdate") > F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz")).select("o_orderkey", stamp("o_orderdate"), "o_totalprice")


@query("SELECT count(*) AS rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(epoch(max(o_orderdate)) AS BIGINT) AS new_mark FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-01'")
def inc_pending_stats(spark, d):
    return jdbc.pending(view(spark, d, "orders"), "o_orderdate", datetime(1999, 6, 1), "o_orderkey").select("rows", "lo", "hi", stamp("new_mark"))


@query("SELECT event_id, CAST(epoch_us(received_at) AS BIGINT) AS received_at FROM {events_raw} WHERE received_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOUR")
def inc_lookback(spark, d):
    rows = view(spark, d, "events_raw")
    start = marks.read_start(F.lit("2024-01-20 00:00:00").cast("timestamp"), REGISTRY["web_events"].source.lookback)
    return rows.filter(F.col("received_at") > start).select("event_id", F.unix_micros("received_at").alias("received_at"))


MARKS = """written AS (
    SELECT o_orderpriority AS "table", CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS mark, CAST(o_orderdate AS TIMESTAMP) AS written_at, o_orderkey AS sequence FROM orders)"""


@query(f'WITH {MARKS} SELECT "table", coalesce(CAST(epoch(arg_max((mark,), (written_at, sequence))[1]) AS BIGINT), 0) AS mark FROM written GROUP BY 1')
def inc_marks_latest(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    written = view(spark, d, "orders").select(F.col("o_orderpriority").alias("table"), F.when(F.col("o_orderkey") % 7 == 3, None).otherwise(at).alias("mark"), at.alias("written_at"), F.col("o_orderkey").alias("sequence"))
    return marks.latest(written).select("table", stamp("mark"))


@query("""WITH seen AS (SELECT DISTINCT o_custkey AS g, o_orderkey % 500 AS s FROM orders), span AS (SELECT g, unnest(range(min(s), max(s))) AS missing FROM seen GROUP BY g)
    SELECT g, missing FROM span WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.g = span.g AND seen.s = missing)""")  # fmt: skip
def inc_sequence_gaps(spark, d):
    received = view(spark, d, "orders").select(F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 500).alias("s"))
    return landing.sequence_gaps(received, "s", ["g"])


FILES = "SELECT concat('f', CAST(e AS STRING)) AS name, props AS content FROM (SELECT event_id AS e, props FROM {events})"


@query(f"WITH f AS ({FILES.replace('{events}', 'events')}) SELECT name, content FROM f WHERE content NOT IN (SELECT content FROM f WHERE name LIKE 'f%77') QUALIFY row_number() OVER (PARTITION BY content ORDER BY name) = 1")
def inc_content_dedup(spark, d):
    files = spark.sql(FILES, events=view(spark, d, "events")).withColumn("content_hash", F.sha2("content", 256))
    accepted = files.filter(F.col("name").like("f%77")).select("content_hash", F.lit("accepted").alias("outcome"))
    return landing.unseen(files, accepted).select("name", "content")


@query("SELECT p_partkey, CAST(1773585045 AS BIGINT) AS _ingested_at, 'shop' AS _source_system, 'b1' AS _batch_id, '2026-03-15' AS ingestion_date FROM part")
def lin_columns(spark, d):
    at = datetime(2026, 3, 15, 14, 30, 45)
    out = lake.add_lineage(view(spark, d, "part").select("p_partkey"), "b1", at, "shop")
    return out.select("p_partkey", stamp("_ingested_at"), "_source_system", "_batch_id", day("ingestion_date"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS o_orderdate_month FROM orders")
def snk_partition_transform(spark, d):
    name, values = lake.partition_column("months(o_orderdate)")
    return view(spark, d, "orders").select("o_orderkey", values.alias(name)).select("o_orderkey", day(name))


@query("""WITH w AS (SELECT 'orders' AS "table", count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part),
    f AS (SELECT 'orders' AS "table", count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part)
    SELECT "table", w.n AS written, f.n AS found FROM w FULL JOIN f USING ("table") WHERE w.n IS DISTINCT FROM f.n""")  # fmt: skip
def snk_load_verification(spark, d):
    count = lambda t, df: df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
    o, c, p = (view(spark, d, t) for t in ("orders", "customer", "part"))
    same = count("customer", c).unionByName(count("part", p))
    return jdbc.mismatches(count("orders", o).unionByName(same), count("orders", o.filter("o_orderkey % 10 <> 3")).unionByName(same))


@query("SELECT 'orders' AS \"table\", count(*) AS rows, CAST(epoch(max(updated_at)) AS BIGINT) AS last_change FROM {orders_raw} UNION ALL SELECT 'customers', count(*), CAST(epoch(max(updated_at)) AS BIGINT) FROM {customers_raw}")
def agg_source_state(spark, d):
    return aggregates.table_state({"orders": (view(spark, d, "orders_raw"), "updated_at"), "customers": (view(spark, d, "customers_raw"), "updated_at")})


# -- cleaning ---------------------------------------------------------------------------------------------------------
@query("SELECT customer_id, lower(trim(email)) AS email, upper(trim(country_code)) AS country_code, segment FROM {customers_raw}")
def nrm_lower_upper(spark, d):
    return normalize(view(spark, d, "customers_raw"), REGISTRY["customers"]).select("customer_id", "email", "country_code", "segment")


@query(f"WITH {ITEMS} SELECT order_id, line_number, product_id, supplier_id, quantity, line_amount, CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM items")
def ded_latest(spark, d):
    return clean(spark, d, "order_items", "items_raw").select("order_id", "line_number", "product_id", "supplier_id", "quantity", "line_amount", stamp("updated_at"))


@query(f"WITH {EVENTS} SELECT event_id, epoch_us(received_at) AS received_at, event_type FROM clean_events")
def ded_first(spark, d):
    return clean(spark, d, "web_events", "events_raw").select("event_id", F.unix_micros("received_at").alias("received_at"), "event_type")


def only(spark, d, name, raw, **kept):
    """Reasons of one family of rules on a whole table."""
    bare = dataclasses.replace(REGISTRY[name], not_null=(), non_negative=(), ranges={}, allowed_values={}, patterns={}, time_sanity=(), references={})
    _, refused = quality.split(normalize(view(spark, d, raw), bare), dataclasses.replace(bare, **kept), parents(spark, d))
    return refused.withColumn("reasons", F.array_join(F.array_sort(quality.REASONS), "|"))


@query("SELECT customer_id, 'email_nulo' AS reasons FROM {customers_raw} WHERE email IS NULL")
def dq_not_null(spark, d):
    return only(spark, d, "customers", "customers_raw", not_null=("customer_id", "email")).select("customer_id", "reasons")


@query("SELECT order_id, line_number, product_id, supplier_id, 'quantity_negativo' AS reasons FROM {items_raw} WHERE quantity < 0")
def dq_non_negative(spark, d):
    return only(spark, d, "order_items", "items_raw", non_negative=("quantity", "line_amount")).select("order_id", "line_number", "product_id", "supplier_id", "reasons")


@query("SELECT order_id, line_number, product_id, supplier_id, quantity, CASE WHEN quantity < 2 THEN 'quantity_bajo_minimo' ELSE 'quantity_sobre_maximo' END AS reasons FROM {items_raw} WHERE quantity < 2 OR quantity > 1000")
def dq_ranges(spark, d):
    return only(spark, d, "order_items", "items_raw", ranges={"quantity": (2, 1000)}).select("order_id", "line_number", "product_id", "supplier_id", "quantity", "reasons")


@query("SELECT order_id, 'status_valor_no_admitido' AS reasons FROM {orders_raw} WHERE lower(trim(status)) NOT IN ('pending', 'paid', 'shipped', 'delivered', 'cancelled', 'returned')")
def dq_allowed(spark, d):
    s = REGISTRY["orders"]
    return only(spark, d, "orders", "orders_raw", allowed_values={"status": s.allowed_values["status"]}).select("order_id", "reasons")


@query("SELECT event_id, epoch_us(received_at) AS received_at, 'event_time_posterior_a_received_at' AS reasons FROM {events_raw} WHERE epoch_us(event_time) > epoch_us(received_at) + 300000000")
def dq_time_sanity(spark, d):
    return only(spark, d, "web_events", "events_raw", time_sanity=REGISTRY["web_events"].time_sanity).select("event_id", F.unix_micros("received_at").alias("received_at"), "reasons")


@query(f"SELECT customer_id, segment, concat_ws('|', CASE WHEN NOT regexp_matches(upper(trim(country_code)), '^[A-Z][A-Z]$') THEN 'country_code_formato' END, CASE WHEN NOT regexp_matches(lower(trim(email)), '{EMAIL}') THEN 'email_formato' END) AS reasons FROM {{customers_raw}} WHERE NOT regexp_matches(upper(trim(country_code)), '^[A-Z][A-Z]$') OR NOT regexp_matches(lower(trim(email)), '{EMAIL}')")
def dq_patterns(spark, d):
    return only(spark, d, "customers", "customers_raw", patterns=REGISTRY["customers"].patterns).select("customer_id", "segment", "reasons")


@query("SELECT order_id, customer_id, 'customer_id_huerfano' AS reasons FROM {orders_raw} WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer)")
def dq_orphans(spark, d):
    return only(spark, d, "orders", "orders_raw", references=REGISTRY["orders"].references).select("order_id", "customer_id", "reasons")


@query("SELECT customer_id FROM {customers_raw} UNION SELECT customer_id FROM {orders_raw}")
def dq_key_universe(spark, d):
    return quality.key_universe(view(spark, d, "customers_raw"), "customer_id", view(spark, d, "orders_raw"))


@query(f"WITH {CUSTOMERS} SELECT customer_id, email, country_code, segment FROM customers WHERE len({CUSTOMER_REASONS}) = 0")
def dq_split_valid(spark, d):
    return judged(spark, d, "customers")[0].select("customer_id", "email", "country_code", "segment")


@query(f"WITH {ORDERS} SELECT order_id, array_to_string(list_sort(r), '|') AS reasons FROM (SELECT order_id, {ORDER_REASONS} AS r FROM clean_orders) WHERE len(r) > 0")
def dq_quarantine_reasons(spark, d):
    return judged(spark, d, "orders")[1].select("order_id", F.array_join(F.array_sort(quality.REASONS), "|").alias("reasons"))


def reports(spark, d) -> DataFrame:
    out = None
    for name, *_ in ALL_REASONS:
        one = quality.report(marked(spark, d, name), name)
        out = one if out is None else out.unionByName(one)
    return out


REPORT = "WITH " + ", ".join(r[1] for r in ALL_REASONS) + ", report AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "table", count(*) AS total, count(*) FILTER (r = 0) AS valid, count(*) FILTER (r > 0) AS quarantined, coalesce(count(*) FILTER (r > 0) / count(*), 0.0) AS rate FROM (SELECT len({reasons}) AS r FROM {cte})"""
    for n, _, cte, reasons in ALL_REASONS
) + ")"


@query(REPORT + " SELECT * FROM report")
def dq_report(spark, d):
    return reports(spark, d)


@query(f"WITH {ORDERS} SELECT reason, count(*) AS rows FROM (SELECT unnest({ORDER_REASONS}) AS reason FROM clean_orders) GROUP BY reason")
def dq_reason_histogram(spark, d):
    return quality.reason_histogram(judged(spark, d, "orders")[1])


LIMITS = ", ".join(f"('{s.name}', {s.quarantine_threshold})" for s in REGISTRY.values())


@query(REPORT + f""" SELECT bool_and(rate <= threshold) AS passed, count(*) FILTER (rate > threshold) AS tables_over, CAST(sum(total) AS BIGINT) AS total, CAST(sum(quarantined) AS BIGINT) AS quarantined,
    round(sum(quarantined) / sum(total), 6) AS rate FROM report JOIN (VALUES {LIMITS}) l(t, threshold) ON t = "table" """)  # fmt: skip
def dq_gate(spark, d):
    return quality.gate(reports(spark, d), REGISTRY)


DAY2 = """SELECT order_id, customer_id, order_date, CASE WHEN status = 'paid' THEN 'shipped' WHEN status = 'pending' THEN 'paid' ELSE status END AS status, currency, total_amount, updated_at + INTERVAL 1 DAY AS updated_at
    FROM {orders_raw} WHERE order_id % 20 = 7 UNION ALL SELECT order_id + 100000000, customer_id, order_date, status, currency, total_amount, updated_at + INTERVAL 1 DAY FROM {orders_raw} WHERE order_id % 50 = 11"""
UPSERT = f"WITH day2 AS ({DAY2}), merged AS (SELECT * FROM {{orders_raw}} WHERE order_id NOT IN (SELECT order_id FROM day2) UNION ALL SELECT * FROM day2) SELECT order_id, customer_id, status, CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM merged"


def second_day(spark, d) -> DataFrame:
    return spark.sql(DAY2, orders_raw=view(spark, d, "orders_raw"))


def brief(df: DataFrame) -> DataFrame:
    return df.select("order_id", "customer_id", "status", stamp("updated_at"))


@query(UPSERT)
def ups_upsert(spark, d):
    return brief(upsert.upsert(view(spark, d, "orders_raw"), second_day(spark, d), REGISTRY["orders"]))


@query(UPSERT)
def ups_upsert_twice(spark, d):
    once = upsert.upsert(view(spark, d, "orders_raw"), second_day(spark, d), REGISTRY["orders"])
    return brief(upsert.upsert(once, second_day(spark, d), REGISTRY["orders"]))


@query(f"WITH day2 AS ({DAY2}) SELECT order_id, customer_id, status, CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM (SELECT * FROM day2 UNION ALL SELECT * FROM {{orders_raw}}) QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC) = 1")
def ups_upsert_ordered(spark, d):
    return brief(upsert.upsert(second_day(spark, d), view(spark, d, "orders_raw"), REGISTRY["orders"], policy="ordered"))


@query(f"WITH day2 AS ({DAY2}), h AS (SELECT *, 1 AS version FROM {{orders_raw}} UNION ALL SELECT *, 2 FROM day2 UNION ALL SELECT * REPLACE ('cancelled' AS status), 3 FROM {{orders_raw}} WHERE order_id % 100 = 7) SELECT order_id, status, version FROM h WHERE version <= 2 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY version DESC) = 1")
def his_as_of_version(spark, d):
    first = view(spark, d, "orders_raw")
    v = lambda df, n: df.withColumn("version", F.lit(n))
    third = first.filter("order_id % 100 = 7").withColumn("status", F.lit("cancelled"))
    return upsert.as_of_version(v(first, 1).unionByName(v(second_day(spark, d), 2)).unionByName(v(third, 3)), ["order_id"], 2).select("order_id", "status", "version")


@query("SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(sum(sum(CAST(o_totalprice AS DECIMAL(18, 2)))) OVER (PARTITION BY o_orderpriority ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS DOUBLE) AS running FROM orders GROUP BY 1, 2")
def win_running_total(spark, d):
    rows = view(spark, d, "orders").select("o_orderpriority", day("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    return aggregates.running_total(rows, ["o_orderpriority"], "day", "total").withColumns({c: F.col(c).cast("double") for c in ("total", "running")})


# -- dimensions -------------------------------------------------------------------------------------------------------
TRACKED = ["segment", "country_code", "marketing_opt_in"]
ATTRIBUTES = ["email", "full_name", "country_code", "segment", "marketing_opt_in"]
CHANGE = "2020-06-01 00:00:00"  # when the second load takes effect


def first_customers(spark, d) -> DataFrame:
    return normalize(view(spark, d, "customers_base"), REGISTRY["customers"]).filter("customer_id % 10 <> 9")


def versions(spark, d) -> DataFrame:
    """The customer dimension after a first load and a later one that brings changes and new customers."""
    loaded = dimensions.scd2_first(first_customers(spark, d), "customer_id", ATTRIBUTES, "customer_key")
    incoming = clean(spark, d, "customers", "customers_raw").withColumn("_change", F.lit("1998-06-01 12:00:00").cast("timestamp"))
    return dimensions.scd2_apply(incoming, loaded, "customer_id", TRACKED, "_change", "customer_key", ATTRIBUTES)


def product_dimension(spark, d) -> DataFrame:
    rows = clean(spark, d, "products", "products_raw").select(
        dimensions.surrogate_key(F.col("product_id").cast("string")).alias("product_key"), "product_id", "sku", F.col("name").alias("product_name"), "category", F.col("unit_price").alias("list_price"), "is_active"
    )
    return dimensions.with_unknown(rows, "product_key")


BASE = """base AS (SELECT customer_id, lower(trim(email)) AS email, full_name, upper(trim(country_code)) AS country_code, segment, marketing_opt_in FROM {customers_base} WHERE customer_id % 10 <> 9),
changed AS (SELECT c.customer_id FROM customers c JOIN base b USING (customer_id) WHERE c.segment IS DISTINCT FROM b.segment OR c.country_code IS DISTINCT FROM b.country_code OR c.marketing_opt_in IS DISTINCT FROM b.marketing_opt_in),
opened AS (SELECT * FROM customers c WHERE customer_id IN (SELECT customer_id FROM changed) OR customer_id NOT IN (SELECT customer_id FROM base)),
versions AS (
    SELECT customer_id, segment, country_code, marketing_opt_in, TIMESTAMP '1970-01-01' AS valid_from,
           CASE WHEN customer_id IN (SELECT customer_id FROM changed) THEN TIMESTAMP '1998-06-01 12:00:00' ELSE TIMESTAMP '9999-12-31' END AS valid_to, customer_id NOT IN (SELECT customer_id FROM changed) AS is_current
    FROM base UNION ALL SELECT customer_id, segment, country_code, marketing_opt_in, TIMESTAMP '1998-06-01 12:00:00', TIMESTAMP '9999-12-31', true FROM opened)"""
VERSION_COLUMNS = "customer_id, segment, country_code, marketing_opt_in, CAST(epoch(valid_from) AS BIGINT) AS valid_from, CAST(epoch(valid_to) AS BIGINT) AS valid_to, is_current"


@query("""WITH d AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS t FROM orders)
    SELECT CAST(strftime(t, '%Y%m%d') AS INTEGER) AS date_key, strftime(t, '%Y-%m-%d') AS date, CAST(year(t) AS INTEGER) AS year, CAST(quarter(t) AS INTEGER) AS quarter, CAST(month(t) AS INTEGER) AS month,
           strftime(t, '%B') AS month_name, CAST(day(t) AS INTEGER) AS day, CAST(dayofweek(t) + 1 AS INTEGER) AS day_of_week, strftime(t, '%A') AS day_name, CAST(weekofyear(t) AS INTEGER) AS week_of_year,
           dayofweek(t) IN (0, 6) AS is_weekend FROM d""")  # fmt: skip
def dim_date(spark, d):
    return dimensions.date_dimension(view(spark, d, "orders"), "o_orderdate").withColumn("date", day("date"))


@query(f"""WITH {PRODUCTS} SELECT false AS unknown, product_id, sku, name AS product_name, category, unit_price AS list_price, is_active FROM products
    UNION ALL SELECT true, NULL, '(desconocido)', '(desconocido)', '(desconocido)', NULL, NULL""")  # fmt: skip
def dim_product(spark, d):
    return product_dimension(spark, d).select((F.col("product_key") == -1).alias("unknown"), "product_id", "sku", "product_name", "category", "list_price", "is_active")


@query(f"""WITH {CUSTOMERS}, {BASE} SELECT customer_id, segment, country_code, is_current FROM versions UNION ALL SELECT NULL, '(desconocido)', '??', true""")
def dim_unknown_member(spark, d):
    out = dimensions.with_unknown(versions(spark, d), "customer_key", {"country_code": F.lit("??"), "is_current": F.lit(True)})
    return out.select("customer_id", "segment", "country_code", "is_current")


@query(f"WITH {CUSTOMERS}, {BASE} SELECT customer_id, segment, country_code, marketing_opt_in FROM opened")
def scd2_open(spark, d):
    loaded = dimensions.scd2_first(first_customers(spark, d), "customer_id", ATTRIBUTES, "customer_key")
    return dimensions.scd2_changes(clean(spark, d, "customers", "customers_raw"), loaded, "customer_id", TRACKED)[1].select("customer_id", *TRACKED)


@query(f"WITH {CUSTOMERS}, {BASE} SELECT customer_id FROM changed")
def scd2_close(spark, d):
    loaded = dimensions.scd2_first(first_customers(spark, d), "customer_id", ATTRIBUTES, "customer_key")
    return dimensions.scd2_changes(clean(spark, d, "customers", "customers_raw"), loaded, "customer_id", TRACKED)[0].select("customer_id")


@query(f"WITH {CUSTOMERS}, {BASE} SELECT {VERSION_COLUMNS} FROM versions")
def scd2_applied(spark, d):
    return versions(spark, d).select("customer_id", *TRACKED, stamp("valid_from"), stamp("valid_to"), "is_current")


@query(f"WITH {CUSTOMERS}, {BASE} SELECT customer_id, count(*) AS versions, count(*) FILTER (is_current) AS current FROM versions GROUP BY 1")
def scd2_invariants(spark, d):
    v = versions(spark, d)
    per_key = v.groupBy("customer_id").agg(F.count("*").alias("versions"), F.count_if("is_current").alias("current"))
    return per_key.join(dimensions.scd2_faults(v, "customer_id").select("customer_id"), "customer_id", "left_anti")


ASOF = "LEFT JOIN versions v ON o.customer_id = v.customer_id AND CAST(o.order_date AS TIMESTAMP) >= v.valid_from AND CAST(o.order_date AS TIMESTAMP) < v.valid_to"


@query(f"WITH {CUSTOMERS}, {BASE} SELECT o.order_id, v.segment, v.customer_id IS NULL AS unknown FROM {{orders_raw}} o {ASOF}")
def asof_join(spark, d):
    v = versions(spark, d)
    out = dimensions.as_of_join(view(spark, d, "orders_raw"), v, "customer_id", "order_date", "customer_key")
    named = v.select("customer_key", "segment")
    return out.join(named, "customer_key", "left").select("order_id", "segment", (F.col("customer_key") == -1).alias("unknown"))


# -- facts and aggregates ---------------------------------------------------------------------------------------------
def lines(spark, d) -> DataFrame:
    rows = clean(spark, d, "order_items", "items_raw")
    return rows.select(F.concat_ws("-", "order_id", "line_number").alias("order_item_id"), "order_id", F.col("product_ref").alias("product_id"), "quantity", F.try_divide("line_amount", "quantity").alias("unit_price"), "line_amount")


def line_facts(spark, d) -> DataFrame:
    orders = clean(spark, d, "orders", "orders_raw")
    return facts.order_item_facts(lines(spark, d), orders, versions(spark, d), product_dimension(spark, d))


FACTS = f"""{CUSTOMERS}, {BASE}, {PRODUCTS}, {ORDERS}, {ITEMS}, fct AS (
    SELECT i.order_id, i.line_number, o.order_date, o.status AS order_status, v.segment, v.customer_id IS NULL AS no_customer, p.product_id IS NULL AS no_product, p.category, i.quantity, i.line_amount
    FROM items i LEFT JOIN clean_orders o ON i.order_id = o.order_id {ASOF} LEFT JOIN products p ON i.product_ref = p.product_id)"""


@query(f"WITH {FACTS} SELECT concat(order_id, '-', line_number) AS order_item_id, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS date_key, order_status, no_customer, no_product, quantity, line_amount FROM fct")
def fct_order_items(spark, d):
    return line_facts(spark, d).select("order_item_id", "date_key", "order_status", (F.col("customer_key") == -1).alias("no_customer"), (F.col("product_key") == -1).alias("no_product"), "quantity", "line_amount")


@query(f"""WITH {ITEMS}, sales AS (
        SELECT CAST(o.o_orderdate AS DATE) AS sale_date, lower(p.category) AS category, sum(CAST(i.line_amount AS DECIMAL(18, 2))) AS revenue, CAST(sum(i.quantity) AS BIGINT) AS units, count(DISTINCT i.order_id) AS orders, count(*) AS lines
        FROM items i JOIN orders o ON i.order_id = o.o_orderkey LEFT JOIN {{products_raw}} p ON i.product_id = p.product_id WHERE o.o_orderkey % 75 <> 14 GROUP BY 1, 2)
    SELECT strftime(sale_date, '%Y-%m-%d') AS sale_date, category, CAST(revenue AS DOUBLE) AS revenue, units, orders, lines, ((2 * CAST(revenue * 100 AS HUGEINT) + orders) // (2 * orders)) / 100 AS avg_ticket FROM sales""")  # fmt: skip
def agg_daily_sales(spark, d):
    """The flagship: latest order lines, their orders and products, revenue per day and category."""
    items = clean(spark, d, "order_items", "items_raw")
    orders = view(spark, d, "orders_raw").filter("order_date is not null").select("order_id", "order_date")
    products = normalize(view(spark, d, "products_raw"), REGISTRY["products"]).select(F.col("product_id").alias("product_key"), "category")
    rows = items.select("order_id", F.col("product_id").alias("product_key"), "quantity", "line_amount").join(orders, "order_id")
    return aggregates.daily_sales(rows, products, parts_of(spark, d, "order_items")).withColumn("sale_date", day("sale_date"))


@query(f"WITH {FACTS} SELECT segment, CAST(sum(CAST(line_amount AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, count(*) AS lines FROM (SELECT CASE WHEN no_customer THEN '(desconocido)' ELSE segment END AS segment, line_amount FROM fct) GROUP BY 1")
def agg_segment_revenue(spark, d):
    return aggregates.revenue_by_attribute(line_facts(spark, d), dimensions.with_unknown(versions(spark, d), "customer_key"), "customer_key", "segment")


@query(f"WITH {FACTS} SELECT count(*) AS lines, count(*) FILTER (no_customer) AS without_customer, count(*) FILTER (no_product) AS without_product, coalesce(CAST(sum(CAST(line_amount AS DECIMAL(18, 2))) FILTER (no_customer OR no_product) AS DOUBLE), 0) AS revenue_unknown FROM fct")
def agg_unknown_share(spark, d):
    return aggregates.unknown_share(line_facts(spark, d))


@query(f"""WITH {FACTS}, silver AS (SELECT sum(CAST(line_amount AS DECIMAL(18, 2))) AS x FROM items), gold AS (SELECT sum(CAST(line_amount AS DECIMAL(18, 2))) AS x FROM fct)
    SELECT CAST(silver.x AS DOUBLE) AS silver, CAST(gold.x AS DOUBLE) AS gold, silver.x = gold.x AS balanced FROM silver, gold""")
def chk_layer_balance(spark, d):
    return aggregates.layer_balance(lines(spark, d), line_facts(spark, d))


@query("""SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS sale_date, p_type AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    GROUP BY CAST(o_orderdate AS DATE), p_type HAVING CAST(sum(l_quantity) AS BIGINT) % 7 = 3""")
def chk_avg_ticket(spark, d):
    """Average tickets that are twice too high on some days are found, and no others."""
    parts = parts_of(spark, d, "order_items")
    rows = lake.dealt(view(spark, d, "lineitem"), parts, "l_orderkey").join(view(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderdate").cast("date").alias("order_date"), F.col("l_partkey").alias("product_key"), F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("line_amount"))
    sales = aggregates.daily_sales(rows, view(spark, d, "part").select(F.col("p_partkey").alias("product_key"), F.col("p_type").alias("category")), parts)
    hurt = sales.withColumn("avg_ticket", F.when(F.col("units") % 7 == 3, 2 * F.col("avg_ticket")).otherwise(F.col("avg_ticket")))
    return aggregates.ticket_faults(hurt).select(day("sale_date"), "category")


# -- reconciliation ---------------------------------------------------------------------------------------------------
def extract(spark, d) -> DataFrame:
    return settlements.write_extract(view(spark, d, "sold"))


def judged_files(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extract files, of which those of some days lose their last detail or their trailer; their lines; verdicts."""
    made = extract(spark, d)
    number = F.substring("name", 5, 8).cast("int")
    content = F.when(number % 40 == 7, F.regexp_replace("content", r"\nD[^\n]*\nP", "\nP")).when(number % 40 == 9, F.regexp_replace("content", r"\nP[^\n]*$", "")).otherwise(F.col("content"))
    files = made.withColumn("content", content)
    cut = settlements.lines(files)
    return files, cut, settlements.verdicts(files, cut)


SETTLED = """details AS (
    SELECT strftime(order_date, '%Y-%m-%d') AS day, CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS ymd, order_id, CAST(amount AS DECIMAL(18, 2)) AS amount,
           CAST(round(0.25 + abs(CAST(amount AS DECIMAL(18, 2))) * 0.019, 2) * CASE WHEN amount < 0 THEN -1 ELSE 1 END AS DECIMAL(18, 2)) AS fee FROM {sold}
), good AS (SELECT * FROM details WHERE ymd % 40 NOT IN (7, 9)),
ours AS (SELECT strftime(order_date, '%Y-%m-%d') AS day, sum(CAST(total_amount AS DECIMAL(18, 2))) AS orders_amount, count(DISTINCT order_id) AS orders FROM {orders_raw} WHERE lower(trim(status)) IN ('paid', 'shipped', 'delivered', 'returned') GROUP BY 1),
theirs AS (SELECT day, coalesce(sum(amount) FILTER (amount >= 0), 0) AS receipts, coalesce(sum(-amount) FILTER (amount < 0), 0) AS refunds, sum(fee) AS fees, count(*) AS movements FROM good GROUP BY 1),
met AS (SELECT coalesce(ours.day, theirs.day) AS day, coalesce(orders_amount, 0) AS orders_amount, coalesce(orders, 0) AS orders, coalesce(receipts, 0) AS receipts, coalesce(refunds, 0) AS refunds, coalesce(fees, 0) AS fees, coalesce(movements, 0) AS movements
        FROM ours FULL JOIN theirs ON ours.day = theirs.day),
result AS (SELECT day, orders_amount, orders, receipts, refunds, fees, movements, receipts - refunds AS settled, orders_amount - refunds - fees AS expected, receipts - orders_amount AS imbalance,
        CASE WHEN orders_amount <> 0 THEN CAST(sign(orders_amount) AS INTEGER) * ((2 * 10000 * CAST(abs(receipts - orders_amount) * 100 AS HUGEINT) + CAST(abs(orders_amount) * 100 AS HUGEINT)) // (2 * CAST(abs(orders_amount) * 100 AS HUGEINT))) / 10000 END AS relative
        FROM met WHERE day BETWEEN (SELECT min(day) FROM good) AND (SELECT max(day) FROM good)),
final AS (SELECT *, CASE WHEN orders_amount = 0 THEN settled = 0 ELSE relative <= 0.02 END AS balanced FROM result)"""


def reconciled(spark, d) -> DataFrame:
    _, cut, verdict = judged_files(spark, d)
    orders = normalize(view(spark, d, "orders_raw"), REGISTRY["orders"]).filter("order_date is not null")
    return reconcile.reconcile(reconcile.paid_orders(orders), settlements.flatten(cut, verdict))


RECONCILED = ("orders_amount", "receipts", "refunds", "fees", "settled", "expected", "imbalance", "relative")


@query(f"WITH {SETTLED} SELECT day, orders, movements, balanced, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in RECONCILED) + " FROM final")
def agg_reconciliation(spark, d):
    return reconciled(spark, d).select(day("day"), "orders", "movements", "balanced", *[F.col(c).cast("double").alias(c) for c in RECONCILED])


@query(f"""WITH {SETTLED} SELECT count(*) AS days, count(*) FILTER (NOT balanced) AS unbalanced_days, CAST(sum(orders_amount) AS DOUBLE) AS orders_amount, CAST(sum(settled) AS DOUBLE) AS settled, CAST(sum(fees) AS DOUBLE) AS fees,
    CAST(max(relative) AS DOUBLE) AS worst_relative, CAST(0.02 AS DOUBLE) AS tolerance, count(*) FILTER (NOT balanced) = 0 AS passed FROM final""")  # fmt: skip
def agg_reconciliation_summary(spark, d):
    return reconcile.summarize(reconciled(spark, d))


@query(f"WITH {SETTLED} SELECT order_id, day AS operation_date, day AS settlement_date, CASE WHEN amount < 0 THEN 'DEVOL' ELSE 'PAGO' END AS kind, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, row_number() OVER (PARTITION BY day ORDER BY order_id) AS line FROM good")
def prj_settlement_fact(spark, d):
    _, cut, verdict = judged_files(spark, d)
    fact = facts.settlement_facts(settlements.flatten(cut, verdict))
    return fact.select("order_id", day("operation_date"), day("settlement_date"), "kind", F.col("amount").cast("double").alias("amount"), F.col("fee").cast("double").alias("fee"), F.col("line").cast("bigint").alias("line"))


@query(f"WITH {SETTLED} SELECT order_id, day AS operation_date, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee FROM details")
def fil_details(spark, d):
    """Files written from the orders and parsed again give the orders."""
    rows = settlements.details(settlements.lines(extract(spark, d)))
    return rows.filter("not bad").select("order_id", day("operation_date"), F.col("amount").cast("double").alias("amount"), F.col("fee").cast("double").alias("fee"))


@query(f"""WITH {SETTLED}, f AS (SELECT ymd, count(*) AS n, sum(amount) AS amount, max_by(amount, order_id) AS last FROM details GROUP BY 1)
    SELECT concat('LIQ_', ymd) AS file, CASE WHEN ymd % 40 = 9 THEN 'pie_ausente_o_repetido' WHEN ymd % 40 = 7 THEN concat('pie_descuadrado: detalles_declarados=', n, ' leidos=', n - 1) END AS reason FROM f""")  # fmt: skip
def fil_trailer_balance(spark, d):
    verdict = judged_files(spark, d)[2]
    return verdict.select(F.substring("name", 1, 12).alias("file"), "reason")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS amount, CAST(NULL AS DOUBLE) AS malformed FROM orders")
def fil_amounts(spark, d):
    value = F.col("o_totalprice").cast("decimal(18,2)")
    shown = F.concat(F.lit(" "), F.replace(F.format_number(F.floor(value), 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad(((value % 1) * 100).cast("int").cast("string"), 2, "0"))
    return view(spark, d, "orders").select("o_orderkey", texts.amount(shown).cast("double").alias("amount"), texts.amount(F.concat(shown, F.lit("x"))).cast("double").alias("malformed"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, CAST(NULL AS VARCHAR) AS wrong FROM orders")
def fil_dates(spark, d):
    shown = F.date_format("o_orderdate", "dd/MM/yyyy")
    return view(spark, d, "orders").select("o_orderkey", F.date_format(texts.day_first_date(shown), "yyyy-MM-dd").alias("parsed"), F.date_format(texts.day_first_date(F.date_format("o_orderdate", "yyyy-MM-dd")), "yyyy-MM-dd").alias("wrong"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 4 OR o_orderkey = 0 THEN NULL ELSE o_orderkey END AS parsed FROM orders")
def fil_references(spark, d):
    shown = F.when(F.col("o_orderkey") % 9 == 4, "AJUSTE-MENSUAL").otherwise(F.concat(F.lit(" ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" ")))
    return view(spark, d, "orders").select("o_orderkey", texts.order_reference(shown).alias("parsed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 8 <> 5 THEN CAST(o_orderkey % 1000 AS INTEGER) END AS sequence, CASE WHEN o_orderkey % 8 <> 5 THEN o_orderkey % 3 = 0 END AS resend FROM orders")
def fil_names(spark, d):
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 8 == 5, "notes_").otherwise("LIQ_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad((key % 1000).cast("string"), 3, "0"), F.when(key % 3 == 0, "_R").otherwise(""), F.lit(".txt"))
    return view(spark, d, "orders").select("o_orderkey", F.date_format(texts.name_date(name), "yyyy-MM-dd").alias("date"), texts.name_sequence(name).alias("sequence"), texts.name_is_resend(name).alias("resend"))


# -- events -----------------------------------------------------------------------------------------------------------
def good_events(spark, d) -> DataFrame:
    return judged(spark, d, "web_events")[0]


VISIT_COLUMNS = "session_key, epoch_us(session_start) AS session_start, epoch_us(session_end) AS session_end, duration_seconds, events, customer_id, anonymous, device, utm_source, product_views, added_to_cart, started_checkout, purchased, CAST(amount AS DOUBLE) AS amount"


def shown_visits(df: DataFrame) -> DataFrame:
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("session_start", "session_end")}
    return df.withColumns(micros | {"amount": F.col("amount").cast("double")})


@query(f"WITH {good_visits(1800)} SELECT event_id, concat(session_id, '#', n) AS session_key FROM opened")
def ses_mark(spark, d):
    return sessions.mark_visits(good_events(spark, d)).select("event_id", "session_key")


@query(f"WITH {good_visits(1800)} SELECT {VISIT_COLUMNS} FROM visits")
def ses_summary_30m(spark, d):
    return shown_visits(sessions.summarize_visits(good_events(spark, d)))


@query(f"WITH {good_visits(21600)} SELECT {VISIT_COLUMNS} FROM visits")
def ses_summary_6h(spark, d):
    return shown_visits(sessions.summarize_visits(good_events(spark, d), timedelta(hours=6)))


@query(f"WITH {good_visits(21600)}, known AS (SELECT customer_id FROM {{customers_base}} WHERE customer_id % 10 <> 9) SELECT session_key, strftime(session_start, '%Y-%m-%d') AS session_date, visits.customer_id IS NULL OR visits.customer_id NOT IN (SELECT customer_id FROM known) AS no_customer, events, purchased, CAST(amount AS DOUBLE) AS amount FROM visits")
def fct_sessions(spark, d):
    loaded = dimensions.scd2_first(first_customers(spark, d), "customer_id", ATTRIBUTES, "customer_key")
    out = facts.visit_facts(sessions.summarize_visits(good_events(spark, d), timedelta(hours=6)), loaded)
    return out.select("session_key", day("session_date"), (F.col("customer_key") == -1).alias("no_customer"), "events", "purchased", F.col("amount").cast("double").alias("amount"))


@query(f"""WITH {good_visits(21600)} SELECT strftime(session_start, '%Y-%m-%d') AS session_date, utm_source, device, count(*) AS visits, count(*) FILTER (product_views > 0) AS with_product, count(*) FILTER (added_to_cart) AS with_cart,
    count(*) FILTER (started_checkout) AS with_checkout, count(*) FILTER (purchased) AS with_purchase, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(duration_seconds) AS DOUBLE) / count(*) AS mean_duration,
    count(*) FILTER (purchased) / count(*) AS conversion, CASE WHEN count(*) FILTER (added_to_cart) > 0 THEN 1 - count(*) FILTER (purchased) / count(*) FILTER (added_to_cart) END AS abandonment FROM visits GROUP BY 1, 2, 3""")  # fmt: skip
def agg_funnel(spark, d):
    visits = sessions.summarize_visits(good_events(spark, d), timedelta(hours=6)).withColumn("session_date", F.col("session_start").cast("date"))
    return aggregates.daily_funnel(visits).withColumn("session_date", day("session_date"))


@query("SELECT count(*) FILTER (epoch_us(received_at) - epoch_us(event_time) > 3600000000) AS late, count(*) AS events FROM {events_raw}")
def evt_late(spark, d):
    return eventtime.late_events(view(spark, d, "events_raw"))


@query("SELECT count(*) AS events, count(*) - count(DISTINCT event_id) AS resends FROM {events_raw}")
def evt_resends(spark, d):
    return eventtime.resends(view(spark, d, "events_raw"))


@query("SELECT count(*) FILTER (event_time > received_at) AS ahead FROM {events_raw}")
def evt_clock_ahead(spark, d):
    return eventtime.clock_ahead(view(spark, d, "events_raw"))


@query("SELECT count(*) FILTER (customer_id IS NULL) AS anonymous, count(*) AS events FROM {events_raw}")
def evt_anonymous(spark, d):
    return eventtime.anonymous(view(spark, d, "events_raw"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders), h AS (
        SELECT t, (epoch(timezone('Europe/Madrid', CAST(t + INTERVAL 1 DAY AS TIMESTAMP))) - epoch(timezone('Europe/Madrid', CAST(t AS TIMESTAMP)))) / 3600 AS hours FROM d)
    SELECT strftime(t, '%Y-%m-%d') AS date, CASE WHEN hours < 24 THEN 'forward' ELSE 'back' END AS direction FROM h WHERE hours <> 24""")  # fmt: skip
def tz_transitions(spark, d):
    days = view(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return tz.transitions(days, "Europe/Madrid").withColumn("date", day("date"))


SHIFTED = "SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 290 DAY AS moment FROM {events}"


@query(f"""WITH e AS ({SHIFTED.replace('{events}', 'events')}) SELECT strftime(timezone('Europe/Madrid', timezone('UTC', moment)), '%Y-%m-%d %H') AS local_hour, count(DISTINCT date_trunc('hour', moment)) AS utc_hours, count(*) AS events
    FROM e GROUP BY 1 HAVING count(DISTINCT date_trunc('hour', moment)) > 1""")  # fmt: skip
def tz_repeated_hours(spark, d):
    return tz.repeated_hours(spark.sql(SHIFTED, events=view(spark, d, "events")), "moment", "Europe/Madrid")


@query("SELECT event_id, CAST(moment AS DATE) = DATE '2024-10-27' AND hour(moment) = 2 AS ambiguous, false AS missing FROM (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 290 DAY AS moment FROM events)")
def tz_local_hours(spark, d):
    local = F.col("moment")
    return spark.sql(SHIFTED, events=view(spark, d, "events")).select("event_id", tz.ambiguous(local, "Europe/Madrid").alias("ambiguous"), tz.missing(local, "Europe/Madrid").alias("missing"))

@query("SELECT event_id, CAST(moment AS DATE) = DATE '2024-03-31' AND hour(moment) = 2 AS missing FROM (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 80 DAY AS moment FROM events)")
def tz_missing_hour(spark, d):
    moved = view(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp") + F.expr("interval 80 days")).alias("moment"))
    return moved.select("event_id", tz.missing(F.col("moment"), "Europe/Madrid").alias("missing"))


from . import stored  # noqa: E402, F401  its queries register themselves here
