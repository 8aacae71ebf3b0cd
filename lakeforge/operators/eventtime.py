"""Diagnostics of two clocks: when it happened and when it arrived."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import seconds


def late_events(events: DataFrame, limit: timedelta = timedelta(hours=1), happened: str = "event_time", arrived: str = "received_at") -> DataFrame:
    return events.agg(F.count_if(seconds(arrived) - seconds(happened) > limit.total_seconds()).alias("late"), F.count("*").alias("events"))


def resends(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.agg(F.count("*").alias("events"), (F.count("*") - F.count_distinct(key)).alias("resends"))


def clock_ahead(events: DataFrame, happened: str = "event_time", arrived: str = "received_at") -> DataFrame:
    return events.agg(F.count_if(seconds(happened) > seconds(arrived)).alias("ahead"))


def anonymous(events: DataFrame, column: str = "customer_id") -> DataFrame:
    return events.agg(F.count_if(F.col(column).isNull()).alias("anonymous"), F.count("*").alias("events"))
