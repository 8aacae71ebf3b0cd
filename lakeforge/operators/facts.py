"""Facts at line and visit grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dimensions import UNKNOWN_KEY, as_of_join


def order_item_facts(items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order line, never more: the order's date and status, the customer's version of that date, the product.

    Whatever is missing points to the unknown member. The orders meet the customer versions first, so that the lines take
    part in one large join only.
    """
    heads = orders.select("order_id", "customer_id", F.col("status").alias("order_status"), "currency", "order_date")
    heads = as_of_join(heads, customers, "customer_id", "order_date", "customer_key").drop("customer_id")
    lines = items.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_amount").join(heads, "order_id", "left")
    known = products.filter(F.col("product_key") != UNKNOWN_KEY).select("product_id", "product_key")
    return lines.join(known, "product_id", "left").select(
        F.date_format("order_date", "yyyyMMdd").cast("int").alias("date_key"),
        F.coalesce("customer_key", F.lit(UNKNOWN_KEY).cast("bigint")).alias("customer_key"),
        F.coalesce("product_key", F.lit(UNKNOWN_KEY).cast("bigint")).alias("product_key"),
        "order_id", "order_item_id", "order_status", "currency", "order_date", "quantity", "unit_price", "line_amount",
    )


def visit_facts(visits: DataFrame, customers: DataFrame) -> DataFrame:
    """Visits with their day, and with the key of the customer's version instead of the customer."""
    dated = visits.withColumn("session_date", F.to_date(F.col("session_start").cast("timestamp")))
    return as_of_join(dated, customers, "customer_id", "session_start", "customer_key").drop("customer_id")


def settlement_facts(details: DataFrame) -> DataFrame:
    return details.select("file", "line", "settlement_date", "operation_date", "order_id", "kind", "method", F.round("amount", 2).alias("amount"), F.round("fee", 2).alias("fee"), "concept")
