"""Aggregates of the publishing layer. Money is summed, divided and rounded as a decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import lake

MONEY, TOTAL = "decimal(18,2)", "decimal(28,2)"


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(MONEY)


def daily_sales(facts: DataFrame, products: DataFrame, parts: int | None = None) -> DataFrame:
    """Per day and category: revenue, units, distinct orders, lines, and revenue per order (not per line).

    Orders are summed first, so that distinct ones are counted as rows. ``parts`` are the partitions by which lines are dealt
    (see ``lake.task_parts``): what a task joins or groups is then bounded, however many lines there are."""
    sold = lake.dealt(facts.select("order_date", "product_key", "order_id", "quantity", "line_amount"), parts, "product_key")
    joined = sold.join(products.select("product_key", "category"), "product_key", "left")
    per_order = lake.dealt(joined, parts, "order_id").groupBy("order_date", "category", "order_id").agg(F.sum(money("line_amount")).alias("revenue"), F.sum("quantity").alias("units"), F.count("*").alias("lines"))
    out = per_order.groupBy(F.col("order_date").alias("sale_date"), "category").agg(
        F.sum("revenue").cast(TOTAL).alias("revenue"), F.sum("units").cast("bigint").alias("units"), F.count("order_id").alias("orders"), F.sum("lines").alias("lines")
    )
    return out.withColumn("avg_ticket", F.round(F.try_divide("revenue", F.col("orders").cast("decimal(20,0)")), 2).cast("double")).withColumn("revenue", F.round("revenue", 2).cast("double"))


#: Stages of the funnel, each with what a visit must have done.
STAGES = {"with_product": "product_views > 0", "with_cart": "added_to_cart", "with_checkout": "started_checkout", "with_purchase": "purchased"}


def daily_funnel(visits: DataFrame) -> DataFrame:
    """Per day, source and device: visits per stage, amount, mean duration, conversion, abandonment (null without carts)."""
    counts = {"visits": F.count("*")} | {stage: F.count_if(F.expr(done)) for stage, done in STAGES.items()}
    sums = {"amount": F.sum(money("amount")).cast("double"), "mean_duration": F.avg("duration_seconds")}
    daily = visits.groupBy("session_date", "utm_source", "device").agg(*[x.alias(name) for name, x in (counts | sums).items()])
    return daily.selectExpr("*", "try_divide(with_purchase, visits) AS conversion", "1 - try_divide(with_purchase, nullif(with_cart, 0)) AS abandonment")


def revenue_by_attribute(facts: DataFrame, dimension: DataFrame, key: str, attribute: str) -> DataFrame:
    """Revenue and lines by an attribute of a dimension, the unknown member included, the greatest first."""
    joined = facts.select(key, "line_amount").join(dimension.select(key, attribute), key, "left")
    return joined.groupBy(attribute).agg(F.sum(money("line_amount")).cast("double").alias("revenue"), F.count("*").alias("lines")).orderBy(F.desc("revenue"), attribute)


def unknown_share(facts: DataFrame) -> DataFrame:
    """Facts without a customer or product, with their revenue."""
    lost = (F.col("customer_key") == -1) | (F.col("product_key") == -1)
    return facts.agg(
        F.count("*").alias("lines"), F.count_if(F.col("customer_key") == -1).alias("without_customer"), F.count_if(F.col("product_key") == -1).alias("without_product"),
        F.coalesce(F.sum(F.when(lost, money("line_amount"))), F.lit(0)).cast("double").alias("revenue_unknown"),
    )


def layer_balance(silver_lines: DataFrame, gold_facts: DataFrame) -> DataFrame:
    """Revenue of both layers and whether it is the same to the cent."""
    a = silver_lines.agg(F.coalesce(F.sum(money("line_amount")), F.lit(0)).alias("silver"))
    b = gold_facts.agg(F.coalesce(F.sum(money("line_amount")), F.lit(0)).alias("gold"))
    return a.join(F.broadcast(b)).select(F.col("silver").cast("double").alias("silver"), F.col("gold").cast("double").alias("gold"), (F.col("silver") == F.col("gold")).alias("balanced"))


def ticket_faults(sales: DataFrame) -> DataFrame:
    """Rows of the daily sales whose mean ticket times orders is not the revenue, but for rounding."""
    return sales.filter(F.abs(F.col("avg_ticket") * F.col("orders") - F.col("revenue")) > 0.005 * F.col("orders") + 0.005)


def table_state(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and last change of each table, given as name -> (frame, column of change)."""
    out = None
    for name, (df, column) in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.max(F.col(column).cast("timestamp").cast("long")).alias("last_change")).select(F.lit(name).alias("table"), "rows", "last_change")
        out = one if out is None else out.unionByName(one)
    return out


def running_total(df: DataFrame, by: list[str], order: str, value: str, name: str = "running") -> DataFrame:
    """``by, order``, the sum of ``value`` there, and ``name``: the sum up to there in the group. Rows are summed before they
    are put in order, so a window holds a row for each value of ``order``, such as the days of a calendar."""
    sums = df.groupBy(*by, order).agg(F.sum(value).alias(value))
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn(name, F.sum(value).over(frame))
