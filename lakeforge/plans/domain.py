"""The shop's tables, derived from the given ones, with defects placed by arithmetic on the keys.

Each view is SQL that Spark and DuckDB read alike, so that both sides of a comparison start from the same rows.
``{name}`` stands for a table or for a view above it.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from ..spec import FileSource, JdbcSource, Registry, TableSpec, TimeSanity

# Vocabularies, patterns and tolerances of the rules.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
COUNTRY = r"^[A-Z]{2}$"
SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")
CATEGORIES = ("economy", "large", "medium", "promo", "small", "standard")
STATUSES = ("pending", "paid", "shipped", "delivered", "cancelled", "returned")
CURRENCIES = ("EUR",)
EVENT_TYPES = ("page_view", "product_view", "add_to_cart", "remove_from_cart", "checkout_start", "purchase")
DEVICES = ("movil", "escritorio", "tablet")
SETTLEMENT_KINDS = ("PAGO", "DEVOL", "AJUSTE")
CLOCK, CLIENT_CLOCK, LOOKBACK = timedelta(seconds=1), timedelta(minutes=5), timedelta(hours=48)

REGISTRY = Registry(
    TableSpec(
        "customers", ("customer_id",), ("updated_at",), source=JdbcSource(partition_column="customer_id"), lower_trim=("email",), upper_trim=("country_code",),
        not_null=("customer_id", "email"), patterns={"email": EMAIL, "country_code": COUNTRY}, allowed_values={"segment": SEGMENTS},
        time_sanity=(TimeSanity("created_at", "updated_at", CLOCK),), quarantine_threshold=0.06,
    ),
    TableSpec(
        "products", ("product_id",), ("updated_at",), source=JdbcSource(partition_column="product_id"), upper_trim=("sku",), lower_trim=("category",),
        not_null=("product_id", "sku"), non_negative=("unit_price",), allowed_values={"category": CATEGORIES}, time_sanity=(TimeSanity("created_at", "updated_at", CLOCK),), quarantine_threshold=0.03,
    ),
    TableSpec(
        "orders", ("order_id",), ("updated_at",), source=JdbcSource(partition_column="order_id"), lower_trim=("status",), upper_trim=("currency",),
        not_null=("order_id", "customer_id", "order_date"), non_negative=("total_amount",), allowed_values={"status": STATUSES, "currency": CURRENCIES},
        references={"customer_id": ("customers", "customer_id")}, quarantine_threshold=0.05, partition="months(order_date)",
    ),
    TableSpec(
        "order_items", ("order_id", "line_number"), ("updated_at", "product_id", "supplier_id"), source=JdbcSource(partition_column="order_id"), not_null=("order_id", "line_number", "product_id"),
        non_negative=("quantity", "line_amount"), ranges={"quantity": (None, 1000)}, references={"order_id": ("orders", "order_id"), "product_id": ("products", "product_id")}, quarantine_threshold=0.05,
    ),
    TableSpec(
        "web_events", ("event_id",), ("received_at",), "first", source=JdbcSource(schema="analytics", watermark_column="received_at", partition_column="received_at", lookback=LOOKBACK),
        lower_trim=("event_type", "device", "utm_source"), not_null=("event_id", "event_time", "received_at", "session_id", "event_type"), non_negative=("amount",), ranges={"quantity": (None, 1000)},
        allowed_values={"event_type": EVENT_TYPES, "device": DEVICES}, time_sanity=(TimeSanity("event_time", "received_at", CLIENT_CLOCK),),
        references={"customer_id": ("customers", "customer_id")}, quarantine_threshold=0.06, partition="days(event_time)",
    ),
    TableSpec(
        "settlements", ("file", "line"), ("file",), source=FileSource("landing/settlements"), upper_trim=("kind", "currency", "method"), not_null=("file", "line", "operation_date", "amount"),
        ranges={"amount": (-1_000_000.0, 1_000_000.0)}, allowed_values={"kind": SETTLEMENT_KINDS, "currency": CURRENCIES}, references={"order_id": ("orders", "order_id")},
        quarantine_threshold=0.03, partition="months(settlement_date)",
    ),
).validate()

VIEWS = {
    "customers_base": """
        SELECT c_custkey AS customer_id,
               CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 50 = 7 THEN concat('  USER', CAST(c_custkey AS STRING), '@Example.COM ')
                    WHEN c_custkey % 50 = 11 THEN concat('user', CAST(c_custkey AS STRING), 'example.com') ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
               c_name AS full_name,
               CASE WHEN c_custkey % 60 = 9 THEN 'ESP' WHEN c_custkey % 40 = 5 THEN ' es' WHEN c_nationkey % 6 = 0 THEN 'ES' WHEN c_nationkey % 6 = 1 THEN 'PT'
                    WHEN c_nationkey % 6 = 2 THEN 'FR' WHEN c_nationkey % 6 = 3 THEN 'IT' WHEN c_nationkey % 6 = 4 THEN 'DE' ELSE 'NL' END AS country_code,
               CASE WHEN c_custkey % 80 = 13 THEN 'unknown' ELSE lower(c_mktsegment) END AS segment,
               c_acctbal > 0 AS marketing_opt_in,
               TIMESTAMP '1990-01-01 00:00:00' + (c_custkey % 365) * INTERVAL 1 DAY AS created_at,
               TIMESTAMP '1990-01-01 00:00:00' + (c_custkey % 365 + CASE WHEN c_custkey % 90 = 17 THEN -1 ELSE c_custkey % 30 END) * INTERVAL 1 DAY AS updated_at
        FROM {customer}""",
    "customers_raw": """
        SELECT * FROM {customers_base} UNION ALL
        SELECT customer_id, email, full_name, country_code, CASE WHEN segment = 'building' THEN 'furniture' ELSE 'building' END AS segment, NOT marketing_opt_in AS marketing_opt_in, created_at,
               updated_at + INTERVAL 2 DAY AS updated_at
        FROM {customers_base} WHERE customer_id % 25 = 4""",
    "products_raw": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 60 = 3 THEN NULL WHEN p_partkey % 30 = 2 THEN concat(' sku-', CAST(p_partkey AS STRING), ' ') ELSE concat('SKU-', CAST(p_partkey AS STRING)) END AS sku,
               p_name AS name, CASE WHEN p_partkey % 45 = 6 THEN 'oddments' ELSE p_type END AS category,
               CASE WHEN p_partkey % 70 = 8 THEN -p_retailprice ELSE p_retailprice END AS unit_price, p_size % 2 = 0 AS is_active,
               TIMESTAMP '1990-01-01 00:00:00' AS created_at, TIMESTAMP '1990-06-01 00:00:00' AS updated_at
        FROM {part}""",
    "orders_raw": """
        SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 35 = 6 THEN o_custkey + 10000000 ELSE o_custkey END AS customer_id,
               CASE WHEN o_orderkey % 75 = 14 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
               CASE WHEN o_orderkey % 55 = 12 THEN 'weird' WHEN o_orderkey % 45 = 10 THEN ' PAID ' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'paid' ELSE 'pending' END AS status,
               CASE WHEN o_orderkey % 85 = 20 THEN ' eur' ELSE 'EUR' END AS currency,
               CASE WHEN o_orderkey % 65 = 9 THEN -o_totalprice ELSE o_totalprice END AS total_amount,
               CAST(o_orderdate AS TIMESTAMP) AS updated_at
        FROM {orders}""",
    "items_raw": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id, l_suppkey AS supplier_id,
               CASE WHEN (l_orderkey + l_partkey) % 400 = 1 THEN 5000.0 WHEN (l_orderkey + l_partkey) % 300 = 2 THEN -l_quantity ELSE l_quantity END AS quantity,
               CASE WHEN l_partkey % 120 = 5 THEN l_partkey + 10000000 ELSE l_partkey END AS product_ref,
               l_extendedprice AS line_amount, CAST(l_shipdate AS TIMESTAMP) AS updated_at
        FROM {lineitem}""",
    "events_base": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS event_time,
               CASE WHEN event_id % 40 = 9 THEN CAST(ts AS TIMESTAMP) + INTERVAL 5 HOUR WHEN event_id % 50 = 13 THEN CAST(ts AS TIMESTAMP) - INTERVAL 10 MINUTE
                    ELSE CAST(ts AS TIMESTAMP) + (event_id % 7) * INTERVAL 1 MINUTE END AS received_at,
               user_id AS session_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS customer_id,
               CASE WHEN event_id % 90 = 31 THEN 'teleport' WHEN event_type = 'view' THEN 'product_view' WHEN event_type = 'click' THEN 'add_to_cart' WHEN event_type = 'signup' THEN 'checkout_start'
                    WHEN event_type = 'purchase' THEN ' Purchase' ELSE 'page_view' END AS event_type,
               CASE WHEN event_id % 100 = 57 THEN 5000 ELSE 1 END AS quantity, value AS amount,
               CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'movil' WHEN user_id % 3 = 2 THEN 'escritorio' ELSE 'tablet' END AS device,
               CASE WHEN event_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'email' ELSE 'search' END AS utm_source
        FROM {events}""",
    "events_raw": """
        SELECT * FROM {events_base} UNION ALL
        SELECT event_id, event_time, received_at + INTERVAL 30 SECOND AS received_at, session_id, customer_id, event_type, quantity, amount, device, utm_source FROM {events_base} WHERE event_id % 20 = 6""",
    "sold": """
        SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, CASE WHEN o_orderkey % 17 = 5 THEN -o_totalprice ELSE o_totalprice END AS amount
        FROM {orders} WHERE o_orderstatus = 'F'""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def with_views(body: str) -> str:
    """DuckDB text: ``body`` below the views that it names as ``{view}``, each as a common table expression."""
    needed: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in VIEWS and n not in needed:
                add(VIEWS[n])
                needed.append(n)

    add(body)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    views = [f"{n} AS ({plain(VIEWS[n])})" for n in needed]
    body = plain(body).strip()
    if not views:
        return body
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(views) + ",\n" + body[4:].strip()
    return "WITH " + ",\n".join(views) + "\n" + body
