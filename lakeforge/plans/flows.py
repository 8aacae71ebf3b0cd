"""The flows over paths: databases and files to raw, raw to clean with quarantine and gate, clean to published with checks.

Each output has one plan; counts for reports come from the written data, and no frame is counted before it is written.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, dimensions, facts, quality, reconcile, sessions, settlements
from ..operators.dedup import deduplicate
from ..operators.history import scope, subset
from ..operators.normalize import drop_columns_of_origin, normalize
from ..operators.upsert import upsert
from ..sources import lake, landing, marks
from ..sources.versions import VersionedTable
from ..spec import FileSource, JdbcSource, Registry, TableSpec

TRACKED = ("segment", "country_code", "marketing_opt_in")  # a change of one of these opens a version


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest(sources: dict[str, DataFrame], registry: Registry, root: str, batch_id: str, at: datetime) -> dict[str, int]:
    """Rows beyond each table's mark appended to the raw layer; returns how many."""
    spark = next(iter(sources.values())).sparkSession
    store = marks.MarkStore(spark, f"{root}/control/marks")
    out = {}
    for spec in registry.values():
        if spec.name in sources and isinstance(spec.source, JdbcSource):
            out[spec.name] = marks.ingest_step(sources[spec.name], store, spec.name, spec.source.watermark_column, spec.source.lookback, f"{root}/raw/{spec.name}", batch_id, at, spec.source.system)
    return out


def ingest_files(files: DataFrame, spec: TableSpec, root: str, batch_id: str, at: datetime) -> dict[str, int]:
    """Settlement files (see ``landing.scan``) parsed and appended to the raw layer; returns files by outcome.

    Content that was accepted before, or that comes twice under two names, is left out. A file is accepted or refused as a
    whole; refused ones go to quarantine byte for byte and may come again. The control table is written last: a batch that
    dies before is repeated with the same files, and what it had already written is replaced, since raw rows, quarantine
    and control rows of a batch lie in folders of their own.
    """
    if not isinstance(spec.source, FileSource):
        raise ValueError(f"{spec.name} is not read from files")
    spark, control = files.sparkSession, f"{root}/control/files/{spec.name}"
    before = spark.read.schema(landing.CONTROL).parquet(control).filter(F.col("batch_id") != batch_id) if there(spark, control) else None
    new, work = landing.unseen(files, before), f"{root}/work/{batch_id}/files_{spec.name}"
    new.write.mode("overwrite").parquet(f"{work}/new")
    new = spark.read.parquet(f"{work}/new")
    settlements.lines(new, spec.source.encoding).write.mode("overwrite").parquet(f"{work}/lines")
    cut = spark.read.parquet(f"{work}/lines")
    settlements.verdicts(new, cut).join(new.select("name", "content_hash"), "name").write.mode("overwrite").parquet(f"{work}/verdicts")
    judged = spark.read.parquet(f"{work}/verdicts")
    rows = lake.add_lineage(settlements.flatten(cut, judged), batch_id, at, spec.source.system)
    lake.replace_batch(rows, f"{root}/raw/{spec.name}", ["ingestion_date", "_batch_id"])
    refused = new.join(judged.filter("outcome = 'rejected'").select("name", "reason"), "name").withColumns({"_batch_id": F.lit(batch_id), "_quarantine_date": F.lit(at).cast("timestamp").cast("date")})
    lake.replace_batch(refused, f"{root}/quarantine/files/{spec.name}", ["_batch_id", "_quarantine_date"])
    landing.register(judged.withColumns({"processed_at": F.lit(at).cast("timestamp"), "batch_id": F.lit(batch_id)}), control, replace_batch=True)
    return {r["outcome"]: r["files"] for r in judged.groupBy("outcome").agg(F.count("*").alias("files")).collect()}  # two outcomes


def missing_files(spark: SparkSession, spec: TableSpec, root: str, cycle: int = 1000) -> DataFrame:
    """``cycle, missing``: file numbers that never came, accepted or not. Numbers follow the days and start again after
    ``cycle`` days, so the days since 1970 tell the rounds apart."""
    received = spark.read.schema(landing.CONTROL).parquet(f"{root}/control/files/{spec.name}").filter("sequence is not null")
    rounds = F.floor(F.datediff("settlement_date", F.lit("1970-01-01").cast("date")) / cycle).alias("cycle")
    return landing.sequence_gaps(received.select(rounds, "sequence"), group=["cycle"])


def refine(spark: SparkSession, registry: Registry, root: str, batch_id: str, at: datetime, tables: list[str] | None = None, day: date | None = None, full: bool = False, policy: str = "ordered") -> dict:
    """Raw rows cleaned, refused ones to quarantine, the rest upserted into version ``batch_id`` of each clean table.

    Returns the gate's verdict; the report is always written, whether or not there was anything to do. Children are
    checked against the whole batch of their parents and what is stored of them. A batch that is repeated starts from the
    version before its own and replaces what it wrote, so it ends in the same state.
    """
    parents: dict[str, DataFrame] = {}
    reports = None
    for spec in subset(registry, tables):
        raw_path, current, target = f"{root}/raw/{spec.name}", f"{root}/clean/{spec.name}/pointers", f"{root}/clean/{spec.name}/versions/{batch_id}"
        stored = version(spark, root, spec.name, before=batch_id)
        for key in spec.business_key[:1]:
            if stored is not None:
                parents[spec.name] = quality.key_universe(stored, key)
        if not there(spark, raw_path):
            continue
        raw = drop_columns_of_origin(scope(lake.read_raw(spark, raw_path), day, full))
        rows = deduplicate(normalize(raw, spec), spec, parts=lake.task_parts(raw))
        work = f"{root}/work/{batch_id}/{spec.name}"  # judged once; what follows reads it
        quality.judge(rows, spec, parents).write.mode("overwrite").parquet(work)
        judged = spark.read.parquet(work)
        lake.write_quarantine(judged.filter(F.size(quality.REASONS) > 0), f"{root}/quarantine/{spec.name}", batch_id, at)
        valid = judged.filter(F.size(quality.REASONS) == 0).drop(quality.REASONS)  # one row a key already
        lake.replace_table(valid if stored is None else upsert(stored, valid, spec, policy), target, spec.partition)
        spark.createDataFrame([(target, at)], "target string, at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{current}/batch={batch_id}")
        parents[spec.name] = quality.key_universe(judged, spec.business_key[0], stored)
        one = quality.report(judged, spec.name)
        reports = one if reports is None else reports.unionByName(one)
    empty = spark.createDataFrame([], "`table` string, total bigint, valid bigint, quarantined bigint, rate double")
    verdict = quality.gate(reports if reports is not None else empty, registry).withColumn("batch_id", F.lit(batch_id))
    lake.write_report(verdict, f"{root}/reports/quality/{batch_id}")
    return spark.read.json(f"{root}/reports/quality/{batch_id}").first().asDict()


def version(spark: SparkSession, root: str, name: str, before: str | None = None, layer: str = "clean") -> DataFrame | None:
    """The last version of a table, without that of batch ``before``; None where there is none. Every batch has a
    pointer of its own, so none is ever overwritten by another."""
    pointers = f"{root}/{layer}/{name}/pointers"
    if not there(spark, pointers):
        return None
    found = spark.read.schema("target string, at timestamp, batch string").parquet(pointers)
    last = found.filter(F.col("batch") != F.lit(before)) if before is not None else found
    target = last.agg(F.max_by("target", F.struct("at", "batch"))).first()[0]
    return spark.read.parquet(target) if target else None


def clean_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    out = version(spark, root, name)
    if out is None:
        raise ValueError(f"{name}: no version has been written")
    return out


def register_tables(spark: SparkSession, root: str, names: list[str]) -> None:
    """The last versions of clean tables by name in the session's catalog, for ``spark.table`` and SQL."""
    for name in names:
        clean_table(spark, root, name).createOrReplaceTempView(name)


def refresh_visits(table: VersionedTable, events: DataFrame, arrived: DataFrame | None, batch: int, at: datetime | None = None, gap: timedelta = sessions.GAP) -> DataFrame:
    """The table of visits by the day of their start, after events arrived late or not. ``events`` are all events, those that
    arrived included; without ``arrived`` the table is built anew.

    Only visits in stretches of time that an arrived event affects are made again, from the events in those stretches, and
    only the days are written in which one of them started before or starts now. Visits are stored without their number,
    since a visit that comes to light late would renumber all later ones; it is added when they are read.
    """
    day = F.to_date(F.col("session_start").cast("timestamp")).cast("string")
    stored = table.read()
    if batch not in table.versions():
        if arrived is None or stored is None:
            visits = sessions.visit_rows(events, gap)
            days, spans = visits.select(day.alias("d")).distinct(), None
        else:
            folder = f"{table.path}/work/batch={batch}"  # what follows reads the spans several times
            found = sessions.affected_spans(stored, arrived, gap)
            found.write.mode("overwrite").parquet(folder)
            spans = table.spark.read.schema(found.schema).parquet(folder)
            visits = sessions.visit_rows(sessions.within(events, spans, "event_time"), gap)
            replaced = sessions.within(stored, spans, "session_start")
            days = replaced.select(day.alias("d")).unionByName(visits.select(day.alias("d"))).distinct()
        touched = sorted(r["d"] for r in days.collect())  # days of the calendar
        if spans is not None:
            visits = sessions.within(table.read(parts=touched), spans, "session_start", how="left_anti").unionByName(visits)
        table.commit(batch, visits, day, touched, at)
    return sessions.numbered(table.read())


def customer_history(customers: DataFrame, root: str, batch_id: str, at: datetime) -> DataFrame:
    """The customer dimension after the batch: the first one loads it, later ones close and open versions at the time of
    the customer's change. A batch that is repeated starts from the history before its own."""
    spark, key, name = customers.sparkSession, "customer_key", "dim_customer"
    attributes = [c for c in customers.columns if c not in ("customer_id", "created_at", "updated_at") and not c.startswith("_")]
    stored, target = version(spark, root, name, before=batch_id, layer="published"), f"{root}/published/{name}/versions/{batch_id}"
    if stored is None:
        history = dimensions.scd2_first(customers, "customer_id", attributes, key)
    else:
        known = stored.filter(F.col(key) != dimensions.UNKNOWN_KEY)
        history = dimensions.scd2_apply(customers, known, "customer_id", [c for c in attributes if c in TRACKED], "updated_at", key, attributes)
    lake.replace_table(dimensions.with_unknown(history, key), target)
    spark.createDataFrame([(target, at)], "target string, at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{root}/published/{name}/pointers/batch={batch_id}")
    return spark.read.parquet(target)


def publish(customers: DataFrame, products: DataFrame, orders: DataFrame, lines: DataFrame, events: DataFrame, settled: DataFrame, root: str, batch_id: str, at: datetime) -> dict:
    """Visits, dimensions, facts and aggregates written under ``root``. Revenue that differs between the layers is an error; a
    reconciliation that fails is only reported."""
    spark = orders.sparkSession
    write = lambda df, name, transform=None: (lake.replace_table(df, f"{root}/{name}", transform), spark.read.parquet(f"{root}/{name}"))[1]
    write(dimensions.date_dimension(orders, "order_date"), "dim_date")
    people = customer_history(customers, root, batch_id, at)
    goods = products.select(dimensions.surrogate_key(F.col("product_id").cast("string")).alias("product_key"), "product_id", "sku", F.col("name").alias("product_name"), "category", F.col("unit_price").alias("list_price"), "is_active")
    goods = write(dimensions.with_unknown(goods, "product_key"), "dim_product")
    sold = write(facts.order_item_facts(lines, orders, people, goods), "fct_order_items", "months(order_date)")
    write(aggregates.daily_sales(sold, goods, lake.task_parts(sold)), "agg_daily_sales")
    visits = write(sessions.summarize_visits(events), "clean/web_sessions", "days(session_start)").drop("session_start_day")  # anew, since a late event may change an old visit
    visits = write(facts.visit_facts(visits, people), "fct_sessions", "days(session_start)")
    write(aggregates.daily_funnel(visits), "agg_funnel")
    write(facts.settlement_facts(settled), "fct_settlements", "months(settlement_date)")
    days = write(reconcile.reconcile(reconcile.paid_orders(orders), settled), "agg_reconciliation")
    balance = aggregates.layer_balance(lines, sold).first()
    if not balance["balanced"]:
        raise ValueError(f"revenue differs between the layers: {balance['silver']} and {balance['gold']}")
    lake.write_report(reconcile.summarize(days), f"{root}/reports/reconciliation")
    return spark.read.json(f"{root}/reports/reconciliation").first().asDict()
