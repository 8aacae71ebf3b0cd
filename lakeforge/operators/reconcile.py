"""Reconciliation of orders with what a third party settled, per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import money

TOLERANCE = 0.02
PAID = ("paid", "shipped", "delivered", "returned")
MEASURES = ("orders_amount", "orders", "receipts", "refunds", "fees", "movements")


def paid_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(*PAID))


def reconcile(orders: DataFrame, settlements: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Both sides are summed per day before they meet in a full outer join, so neither multiplies the other.

    Only days inside the period that the settlements cover count, if there are any settlements. Adjustments count among
    movements and fees, and are neither receipts nor refunds.
    """
    ours = orders.groupBy(F.col("order_date").cast("date").alias("day")).agg(F.round(F.sum(money("total_amount")), 2).alias("orders_amount"), F.count_distinct("order_id").alias("orders"))
    kind = lambda k, x: F.coalesce(F.round(F.sum(F.when(F.col("kind") == k, x)), 2), F.lit(0))
    theirs = settlements.groupBy(F.col("operation_date").cast("date").alias("day")).agg(
        kind("PAGO", money("amount")).alias("receipts"), kind("DEVOL", -money("amount")).alias("refunds"), F.round(F.sum(money("fee")), 2).alias("fees"), F.count("*").alias("movements")
    )
    period = settlements.agg(F.min(F.col("operation_date").cast("date")).alias("_a"), F.max(F.col("operation_date").cast("date")).alias("_b"))
    met = ours.join(theirs, "day", "full_outer").join(F.broadcast(period)).filter("_a is null or day between _a and _b")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint" if c in ("orders", "movements") else "decimal(20,2)") for c in MEASURES}
    out = met.select("day", *[x.alias(c) for c, x in zero.items()])
    share = F.when(F.col("orders_amount") != 0, F.round(F.abs("imbalance") / F.col("orders_amount"), 4))
    return (
        out.withColumns({"settled": F.round(F.expr("receipts - refunds"), 2), "expected": F.round(F.expr("orders_amount - refunds - fees"), 2), "imbalance": F.round(F.expr("receipts - orders_amount"), 2)})
        .withColumn("relative", share)
        .withColumn("balanced", F.when(F.col("orders_amount") == 0, F.col("settled") == 0).otherwise(F.col("relative") <= tolerance))
    )


def summarize(reconciliation: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row; a failed reconciliation is a signal in it, not an error."""
    total = lambda c: F.coalesce(F.round(F.sum(c), 2), F.lit(0)).cast("double").alias(c)
    return reconciliation.agg(
        F.count("*").alias("days"), F.count_if(~F.col("balanced")).alias("unbalanced_days"), total("orders_amount"), total("settled"), total("fees"),
        F.round(F.max("relative"), 4).cast("double").alias("worst_relative"),
    ).withColumns({"tolerance": F.lit(tolerance), "passed": F.col("unbalanced_days") == 0})
