"""Declarative description of tables: how they are keyed, cleaned, validated, partitioned and obtained."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta


@dataclass(frozen=True)
class TimeSanity:
    """``earlier`` may not lie after ``later`` by more than ``tolerance``."""

    earlier: str
    later: str
    tolerance: timedelta = timedelta(0)


@dataclass(frozen=True)
class JdbcSource:
    """A database table read by a high-water mark."""

    schema: str = "public"
    system: str = "jdbc"
    watermark_column: str = "updated_at"
    partition_column: str | None = None
    lookback: timedelta = timedelta(0)
    most_connections: int = 8  # that the database is to bear at once


@dataclass(frozen=True)
class FileSource:
    """Files dropped into a landing zone."""

    landing_prefix: str
    system: str = "files"
    encoding: str = "ISO-8859-1"
    date_format: str = "dd/MM/yyyy"
    decimal_comma: bool = True


@dataclass(frozen=True)
class TableSpec:
    name: str
    business_key: tuple[str, ...]
    dedup_order: tuple[str, ...] = ()
    dedup_keep: str = "latest"  # or "first"
    source: JdbcSource | FileSource | None = None
    lower_trim: tuple[str, ...] = ()
    upper_trim: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    allowed_values: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    patterns: Mapping[str, str] = field(default_factory=dict)
    time_sanity: tuple[TimeSanity, ...] = ()
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # column -> (parent table, parent column)
    quarantine_threshold: float = 0.05
    partition: str | None = None  # such as "months(order_date)"


class Registry(dict):
    """Specs by table name in load order; ``validate`` refuses a registry that contradicts itself."""

    def __init__(self, *specs: TableSpec):
        super().__init__((s.name, s) for s in specs)

    def jdbc(self) -> list[TableSpec]:
        return [s for s in self.values() if isinstance(s.source, JdbcSource)]

    def files(self) -> list[TableSpec]:
        return [s for s in self.values() if isinstance(s.source, FileSource)]

    def validate(self) -> Registry:
        seen: set[str] = set()
        for s in self.values():

            def need(ok: bool, what: str, s: TableSpec = s) -> None:
                if not ok:
                    raise ValueError(f"{s.name}: {what}")

            need(bool(s.business_key), "a business key is needed")
            need(set(s.business_key) <= set(s.not_null), "the business key must be among the columns that may not be null")
            need(bool(s.dedup_order), "an order for de-duplication is needed")
            need(s.dedup_keep in ("latest", "first"), "dedup_keep is latest or first")
            need(all(s.allowed_values.values()), "a list of allowed values is empty")
            for column, (lo, hi) in s.ranges.items():
                need(lo is not None or hi is not None, f"the range of {column} has no bound")
                need(lo is None or hi is None or lo <= hi, f"the range of {column} is empty")
            for t in s.time_sanity:
                need(t.earlier != t.later, "a time rule compares a column with itself")
                need(t.tolerance >= timedelta(0), "a tolerance is negative")
            for column, (parent, key) in s.references.items():
                need(parent in seen, f"{column} refers to {parent}, which does not come before")
                need(key in self[parent].business_key, f"{column} refers to {parent}.{key}, which is not its business key")
            need(0 <= s.quarantine_threshold <= 1, "the threshold is a share")
            seen.add(s.name)
        return self
