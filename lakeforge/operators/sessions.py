"""Visits from events by inactivity."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = timedelta(minutes=30)


#: Columns of a visit that only ask whether, or how often, something happened in it.
HAPPENED = {"added_to_cart": "add_to_cart", "started_checkout": "checkout_start", "purchased": "purchase"}


def _inactivity(time: str, gap: timedelta):
    """Spark's session window over whole seconds: the window of an event lasts ``gap`` and windows that touch are one, so an event
    exactly ``gap`` later still belongs to it."""
    return F.session_window(F.date_trunc("second", F.col(time).cast("timestamp")), f"{int(gap.total_seconds())} seconds")


#: Seconds of a visitor that are put in order together: at most so many rows, however many events a visitor has.
CHUNK = 86_400


def visit_seconds(events: DataFrame, gap: timedelta = GAP, visitor: str = "session_id", time: str = "event_time", chunk: int = CHUNK) -> DataFrame:
    """``_visitor, _at, _visit``: every second in which a visitor did something, and the number of the visit it is in.

    Two levels: seconds are ordered inside chunks of a visitor's time, where a pause opens a visit; then the chunks, of which
    each has one row, are stitched by whether the pause between their edges is one too, and count the visits before them. A
    visitor with a third of all events is spread over the chunks.
    """
    most = int(gap.total_seconds())
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    seconds = events.filter(F.col(time).isNotNull()).select(F.col(visitor).alias("_visitor"), at.alias("_at")).distinct()
    inside = Window.partitionBy("_visitor", "_chunk").orderBy("_at")
    pause = F.col("_at") - F.lag("_at").over(inside)
    opened = seconds.withColumn("_chunk", F.floor(F.col("_at") / chunk)).withColumn("_opens", (F.coalesce(pause, F.lit(0)) > most).cast("bigint"))
    counted = opened.withColumn("_inside", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = opened.groupBy("_visitor", "_chunk").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("_opens").alias("_within"))
    order = Window.partitionBy("_visitor").orderBy("_chunk")
    before = F.lag("_last").over(order)
    edges = edges.withColumn("_opens", (before.isNull() | (F.col("_first") - before > most)).cast("bigint"))
    visits_before = F.coalesce(F.sum(F.col("_within") + F.col("_opens")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(F.col("_visitor").alias("_v"), F.col("_chunk").alias("_c"), (visits_before + F.col("_opens")).alias("_base"))
    stitched = counted.join(edges, F.col("_visitor").eqNullSafe(F.col("_v")) & (F.col("_chunk") == F.col("_c")))
    return stitched.select("_visitor", "_at", (F.col("_base") + F.col("_inside")).alias("_visit"))


def mark_visits(events: DataFrame, gap: timedelta = GAP, visitor: str = "session_id", time: str = "event_time", chunk: int = CHUNK) -> DataFrame:
    """Add ``session_key``. A visit goes on as long as no more than ``gap`` of whole seconds passes between two events;
    events without a time belong to none."""
    seconds = visit_seconds(events, gap, visitor, time, chunk).withColumnRenamed("_at", "_second")
    same = F.col(visitor).eqNullSafe(F.col("_visitor")) & (F.unix_seconds(F.col(time).cast("timestamp")) == F.col("_second"))
    key = F.when(F.col("_visit").isNotNull(), F.concat_ws("#", F.col(visitor).cast("string"), F.col("_visit").cast("string")))
    return events.join(seconds, same, "left").withColumn("session_key", key).drop("_visitor", "_second", "_visit")


def affected_spans(visits: DataFrame, arrived: DataFrame, gap: timedelta = GAP, visitor: str = "session_id", time: str = "event_time") -> DataFrame:
    """``_visitor, _from, _to`` in seconds: the stretches of time in which events that arrived open, extend or join visits.

    New events are reduced to their own visits; these and the stored visits of the same visitors are merged where no more than
    ``gap`` lies between them. What is merged from a new event is affected, and nothing else is: the next visit on either side
    is further away than the gap. A visitor has at most a day's seconds by ``gap`` visits in a day, so its rows are few.
    """
    most = int(gap.total_seconds())
    fresh = visit_seconds(arrived, gap, visitor, time).groupBy("_visitor", "_visit").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to")).drop("_visit")
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    known = visits.select(F.col(visitor).alias("_visitor"), second("session_start").alias("_from"), second("session_end").alias("_to"))
    among = fresh.select(F.col("_visitor").alias("_v")).distinct()
    known = known.join(among, F.col("_visitor").eqNullSafe(F.col("_v")), "left_semi")
    both = fresh.withColumn("_new", F.lit(1)).unionByName(known.withColumn("_new", F.lit(0)))
    order = Window.partitionBy("_visitor").orderBy("_from", "_to", "_new")
    reach = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = both.withColumn("_opens", (reach.isNull() | (F.col("_from") - reach > most)).cast("int"))
    grouped = opens.withColumn("_group", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy("_visitor", "_group").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_new").alias("_new")).filter("_new = 1").select("_visitor", "_from", "_to")


def within(rows: DataFrame, spans: DataFrame, time: str, visitor: str = "session_id", how: str = "left_semi") -> DataFrame:
    """Rows whose time lies in a span of their visitor (or, by ``how``, those that lie in none). Spans are cut into days, so
    that a row meets the few spans of its visitor's day."""
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    days = F.sequence(F.floor(F.col("_from") / CHUNK), F.floor(F.col("_to") / CHUNK))
    cut = spans.select("_visitor", "_from", "_to", F.explode(days).alias("_day"))
    same = F.col(visitor).eqNullSafe(F.col("_visitor")) & (F.floor(at / CHUNK) == F.col("_day")) & (at >= F.col("_from")) & (at <= F.col("_to"))
    return rows.join(cut, same, how)


def visit_rows(events: DataFrame, gap: timedelta = GAP, visitor: str = "session_id", time: str = "event_time") -> DataFrame:
    """The visitor and one row per visit, grouped by session window with partial aggregation. Device and source are those of the first event
    that has one; a customer known late counts for the whole visit; the amount is that of purchases, 0 where there is none."""
    second, bought = F.unix_timestamp(F.col(time).cast("timestamp")), F.col("event_type") == "purchase"
    measures = {"session_start": F.min(time), "session_end": F.max(time), "duration_seconds": F.max(second) - F.min(second), "events": F.count("*"), "customer_id": F.max("customer_id"), "anonymous": F.count("customer_id") == 0}
    measures |= {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(time, "event_id"))) for c in ("device", "utm_source")}
    measures |= {"product_views": F.count_if(F.col("event_type") == "product_view")} | {c: F.count_if(F.col("event_type") == kind) > 0 for c, kind in HAPPENED.items()}
    measures["amount"] = F.coalesce(F.sum(F.when(bought, F.col("amount").cast("decimal(18,2)"))), F.lit(0)).cast("decimal(18,2)")
    visits = events.groupBy(visitor, _inactivity(time, gap).alias("window")).agg(*[value.alias(name) for name, value in measures.items()])
    return visits.select(visitor, *measures)


def numbered(visits: DataFrame, visitor: str = "session_id") -> DataFrame:
    """Visits with ``session_key``, visitor#n in the order of the visits, in place of the visitor; the rows numbered are
    visits, not events."""
    number = F.row_number().over(Window.partitionBy(visitor).orderBy(F.date_trunc("second", F.col("session_start").cast("timestamp"))))
    key = F.concat_ws("#", F.col(visitor).cast("string"), number.cast("string"))
    return visits.select(key.alias("session_key"), *[c for c in visits.columns if c != visitor])


def summarize_visits(events: DataFrame, gap: timedelta = GAP, visitor: str = "session_id", time: str = "event_time") -> DataFrame:
    """One row per visit with its key, see ``visit_rows``."""
    return numbered(visit_rows(events, gap, visitor, time), visitor)
