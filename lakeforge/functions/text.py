"""Parsing of the texts that settlement files carry, as column expressions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_NAME = r"^LIQ_(\d{8})_(\d{3})(_R)?\.txt$"


def amount(text: Column) -> Column:
    """1.234,56 as 1234.56."""
    return F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def day_first_date(text: Column) -> Column:
    return F.try_to_date(F.trim(text), "dd/MM/yyyy")


def order_reference(text: Column) -> Column:
    """ORD-000481219 as 481219; references to something else are null."""
    return F.regexp_extract(F.trim(text), r"^(?:ORD-)?0*([1-9][0-9]*)$", 1).try_cast("bigint")


def name_date(name: Column) -> Column:
    return F.try_to_date(F.regexp_extract(name, FILE_NAME, 1), "yyyyMMdd")


def name_sequence(name: Column) -> Column:
    return F.regexp_extract(name, FILE_NAME, 2).try_cast("int")


def name_is_resend(name: Column) -> Column:
    return F.when(name.rlike(FILE_NAME), F.regexp_extract(name, FILE_NAME, 3) != "")


def comma(value: Column) -> Column:
    """1234.56 as 1234,56."""
    return F.replace(value.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
