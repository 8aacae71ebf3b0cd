"""Local times: clock changes, ambiguous and missing hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transitions(days: DataFrame, zone: str, day: str = "date") -> DataFrame:
    """Days of a zone's clock changes among ``days``: 23 hours long is forward, 25 is back."""
    start = F.to_utc_timestamp(F.col(day).cast("timestamp"), zone).cast("long")
    end = F.to_utc_timestamp(F.date_add(F.col(day), 1).cast("timestamp"), zone).cast("long")
    return days.select(day, ((end - start) / 3600).alias("hours")).filter("hours <> 24").select(day, F.when(F.col("hours") < 24, "forward").otherwise("back").alias("direction"))


def ambiguous(local: Column, zone: str, shift_hours: int = 1) -> Column:
    """The local time occurs twice."""
    utc = F.to_utc_timestamp(local, zone)
    shift = F.expr(f"interval {shift_hours} hours")
    return (F.from_utc_timestamp(utc + shift, zone) == local) | (F.from_utc_timestamp(utc - shift, zone) == local)


def missing(local: Column, zone: str) -> Column:
    """The local time does not occur."""
    return F.from_utc_timestamp(F.to_utc_timestamp(local, zone), zone) != local


def repeated_hours(events: DataFrame, time: str, zone: str) -> DataFrame:
    """Local hours that several UTC hours map to, with their events."""
    at = F.col(time).cast("timestamp")
    return (
        events.groupBy(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH").alias("local_hour"))
        .agg(F.count_distinct(F.date_trunc("hour", at)).alias("utc_hours"), F.count("*").alias("events"))
        .filter("utc_hours > 1")
    )
