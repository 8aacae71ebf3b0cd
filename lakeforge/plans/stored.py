"""Registered queries that write, and read what they wrote: sources, sinks, marks, landing zone, flows and streams.

Each works in a folder of its own below the shared one. The tables written are those given, or views of them.
"""

from __future__ import annotations

import dataclasses
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, normalize, settlements
from ..sources import jdbc, lake, landing, marks
from ..sources.versions import KeyedTable, VersionedTable
from ..spec import JdbcSource, Registry
from ..streaming import events as streaming
from .domain import REGISTRY, view
from .flows import clean_table, customer_history, ingest_files, missing_files, publish, refine, refresh_visits, register_tables, version
from .queries import ALL_REASONS, BASE, ITEMS, PRODUCTS, CUSTOMER_REASONS, CUSTOMERS, ORDER_REASONS, ORDERS, RAW, REPORT, SETTLED, VISIT_COLUMNS, VISITS, clean, day, extract, first_customers, good_events, good_visits, judged, judged_files, lines, parents, query, shown_visits, stamp

FIRST, SECOND = datetime(2024, 3, 1, 12, tzinfo=timezone.utc), datetime(2024, 3, 2, 12, tzinfo=timezone.utc)


def two_days(spark, d) -> str:
    """Orders appended to the raw layer on two days; the path."""
    orders, path = view(spark, d, "orders"), f"{lake.work_folder(spark)}/orders"
    for rest, at in ((0, FIRST), (1, SECOND)):
        lake.append_raw(lake.add_lineage(orders.filter(F.col("o_orderkey") % 2 == rest), f"batch{rest}", at, "shop"), path)
    return path


@query("""SELECT o_orderkey, o_totalprice, concat('batch', o_orderkey % 2) AS _batch_id, CASE WHEN o_orderkey % 2 = 0 THEN '2024-03-01' ELSE '2024-03-02' END AS ingestion_date FROM orders""")
def snk_raw_append(spark, d):
    return lake.read_raw(spark, two_days(spark, d)).select("o_orderkey", "o_totalprice", "_batch_id", day("ingestion_date"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def src_raw_one_day(spark, d):
    return lake.read_raw(spark, two_days(spark, d), date(2024, 3, 1)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'last' ELSE 'day' END AS scope FROM orders")
def his_scopes(spark, d):
    raw = lake.read_raw(spark, two_days(spark, d))
    last, first = history.scope(raw), history.scope(raw, date(2024, 3, 1))
    return last.select("o_orderkey", F.lit("last").alias("scope")).unionByName(first.select("o_orderkey", F.lit("day").alias("scope")))


@query("SELECT o_orderkey, o_custkey, concat('batch', o_orderkey % 2) AS _batch_id, 'shop' AS _source_system FROM orders")
def lin_dropped(spark, d):
    """What only the raw layer has is gone: the day of ingestion."""
    raw = normalize.drop_columns_of_origin(lake.read_raw(spark, two_days(spark, d)))
    return raw.select([c for c in raw.columns if c not in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "_ingested_at")])


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS o_orderdate_month, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def snk_replaced_table(spark, d):
    """Written twice: the second run replaces the first."""
    orders, path = view(spark, d, "orders"), f"{lake.work_folder(spark)}/orders"
    lake.replace_table(orders.limit(10), path, "months(o_orderdate)")
    lake.replace_table(orders, path, "months(o_orderdate)")
    return spark.read.parquet(path).groupBy(day("o_orderdate_month")).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"WITH {CUSTOMERS} SELECT customer_id, array_to_string({CUSTOMER_REASONS}, ',') AS reasons, 'b1' AS _batch_id FROM customers WHERE len({CUSTOMER_REASONS}) > 0")
def snk_row_quarantine(spark, d):
    """A batch that is repeated does not count twice."""
    from ..operators import quality

    _, refused = quality.split(clean(spark, d, "customers", "customers_raw"), REGISTRY["customers"], parents(spark, d))
    path = f"{lake.work_folder(spark)}/quarantine"
    for _ in range(2):
        lake.write_quarantine(refused, path, "b1", FIRST)
    return spark.read.parquet(path).select("customer_id", F.array_join(quality.REASONS, ",").alias("reasons"), F.col("_batch_id").cast("string").alias("_batch_id"))


@query("""SELECT o_orderpriority AS "table", CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE CAST(epoch(max(o_orderdate)) AS BIGINT) END AS mark FROM orders GROUP BY 1""")
def inc_mark_store(spark, d):
    """The greatest time of each priority as a mark, written twice; one of them is reset."""
    store = marks.MarkStore(spark, f"{lake.work_folder(spark)}/marks")
    found = view(spark, d, "orders").groupBy("o_orderpriority").agg(F.max("o_orderdate").alias("at")).orderBy("o_orderpriority").collect()  # a few priorities
    for r in found:
        store.write(r["o_orderpriority"], datetime(1999, 1, 1))
        store.write(r["o_orderpriority"], r["at"])
    store.reset([r["o_orderpriority"] for r in found if r["o_orderpriority"].startswith("1")])
    return marks.latest(store.frame()).select("table", stamp("mark"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'b1' ELSE 'b2' END AS _batch_id FROM orders")
def inc_ingest_steps(spark, d):
    """The source grows between two runs; a third one finds nothing."""
    orders, root = view(spark, d, "orders"), lake.work_folder(spark)
    store = marks.MarkStore(spark, f"{root}/marks")
    old = orders.filter(F.col("o_orderdate") < F.lit(datetime(1997, 1, 1)).cast("timestamp_ntz"))
    for source, batch, at in ((old, "b1", FIRST), (orders, "b2", SECOND), (orders, "b3", SECOND)):
        marks.ingest_step(source, store, "orders", "o_orderdate", timedelta(0), f"{root}/raw", batch, at, "shop")
    return lake.read_raw(spark, f"{root}/raw").select("o_orderkey", "_batch_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS mark FROM orders")
def inc_canonical_text(spark, d):
    return view(spark, d, "orders").select("o_orderkey", marks.canonical(F.col("o_orderdate").cast("string")).alias("mark"))


@query("SELECT o_orderkey, o_totalprice, CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'")
def src_jdbc_incremental(spark, d):
    """Orders loaded into an embedded database, whose counts are verified, and read beyond a mark, by whichever process a
    task runs in."""
    orders = view(spark, d, "orders").select(F.col("o_orderkey").alias("O_ORDERKEY"), F.col("o_totalprice").alias("O_TOTALPRICE"), F.col("o_orderdate").cast("timestamp").alias("O_ORDERDATE"))
    options = jdbc.embedded(orders, "ORDERS", lake.work_folder(spark))
    jdbc.verify(spark, options, orders.agg(F.count("*").alias("rows")).select(F.lit("ORDERS").alias("table"), "rows"), ["ORDERS"])
    whole = jdbc.reader(spark, options).option("dbtable", "ORDERS").load()
    mark = datetime(1996, 1, 1, tzinfo=timezone.utc)
    stats = jdbc.pending(whole, "O_ORDERDATE", mark, "O_ORDERKEY").first()
    assert jdbc.scalar(spark, options, "SELECT count(*) AS N FROM ORDERS")["N"] >= stats["rows"]
    source = JdbcSource(schema="", watermark_column="O_ORDERDATE", partition_column="O_ORDERKEY")
    read = jdbc.read_incremental(spark, options, source, "ORDERS", mark, stats)
    return read.select(F.col("O_ORDERKEY").alias("o_orderkey"), F.col("O_TOTALPRICE").alias("o_totalprice"), stamp("O_ORDERDATE").alias("o_orderdate"))


# -- landing zone -----------------------------------------------------------------------------------------------------
def zone(spark, d) -> str:
    """A file for each nation with the names of its customers."""
    path = f"{lake.work_folder(spark)}/zone"
    lines = view(spark, d, "customer").select("c_nationkey", "c_name").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_name")
    lines.write.partitionBy("c_nationkey").text(path)
    return path


FILES = "files AS (SELECT c_nationkey, sha256(string_agg(c_name, chr(10) ORDER BY c_name) || chr(10)) AS content_hash, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, count(*) AS details FROM customer GROUP BY 1)"


@query(f"WITH {FILES} SELECT content_hash, bytes FROM files")
def src_landing_scan(spark, d):
    return landing.scan(spark, f"{zone(spark, d)}/*").select("content_hash", F.octet_length("content").cast("bigint").alias("bytes"))


@query(f"WITH {FILES} SELECT content_hash, details, CASE WHEN details % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS outcome, details % 2 = 0 AS known FROM files")
def inc_control_register(spark, d):
    """Accepted files are known afterwards, refused ones may come again."""
    path, root = zone(spark, d), lake.work_folder(spark)
    found = landing.unseen(landing.scan(spark, f"{path}/*"))
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    none = {c: F.lit(None) for c in ("settlement_date", "sequence", "amount", "reason")}
    control = found.withColumns(none | {"details": lines, "outcome": F.when(lines % 2 == 0, "accepted").otherwise("rejected"), "processed_at": F.lit(FIRST).cast("timestamp"), "batch_id": F.lit("b1")})
    landing.register(control, f"{root}/control")
    stored = spark.read.parquet(f"{root}/control")
    again = landing.unseen(landing.scan(spark, f"{path}/*"), stored).select("content_hash", F.lit(False).alias("_new"))
    return stored.join(again, "content_hash", "left").select("content_hash", "details", "outcome", F.coalesce("_new", F.lit(True)).alias("known"))


@query(f"WITH {FILES} SELECT content_hash, 'odd' AS reason FROM files WHERE details % 2 = 1")
def snk_file_quarantine(spark, d):
    root, found = lake.work_folder(spark), landing.scan(spark, f"{zone(spark, d)}/*").withColumn("name", F.col("content_hash"))  # names of a zone are unique
    odd = F.size(F.split(F.col("content").cast("string"), "\n")) % 2 == 0
    landing.quarantine_files(found, found.filter(odd).select("name", F.lit("odd").alias("reason")), f"{root}/quarantine")
    return spark.read.parquet(f"{root}/quarantine").select(F.sha2("content", 256).alias("content_hash"), "reason")


# -- flows ------------------------------------------------------------------------------------------------------------
@query(f"WITH {CUSTOMERS} SELECT customer_id, email, country_code, CAST(epoch(updated_at) AS BIGINT) AS updated_at, strftime(date_trunc('month', updated_at), '%Y-%m-%d') AS updated_at_month FROM customers WHERE len({CUSTOMER_REASONS}) = 0")
def flw_refined_customers(spark, d):
    """Raw to clean over paths, in declared partitions; the batch runs twice and ends in the same state."""
    root = lake.work_folder(spark)
    registry = Registry(dataclasses.replace(REGISTRY["customers"], partition="months(updated_at)"))
    lake.append_raw(lake.add_lineage(view(spark, d, "customers_raw"), "b1", FIRST, "shop"), f"{root}/raw/customers")
    for _ in range(2):
        refine(spark, registry, root, "b1", FIRST)
    return clean_table(spark, root, "customers").select("customer_id", "email", "country_code", stamp("updated_at"), day("updated_at_month"))


@query(f"WITH {CUSTOMERS} SELECT country_code, count(*) AS customers FROM customers WHERE len({CUSTOMER_REASONS}) = 0 GROUP BY 1")
def src_catalog_scan(spark, d):
    """A clean table read by its name in the catalog."""
    root = lake.work_folder(spark)
    lake.append_raw(lake.add_lineage(view(spark, d, "customers_raw"), "b1", FIRST, "shop"), f"{root}/raw/customers")
    refine(spark, Registry(REGISTRY["customers"]), root, "b1", FIRST)
    register_tables(spark, root, ["customers"])
    return spark.table("customers").groupBy("country_code").agg(F.count("*").alias("customers"))


CHANGES = BASE.split("versions AS (")[0].replace("SELECT c.customer_id FROM customers c JOIN", "SELECT c.customer_id, c.updated_at FROM customers c JOIN")


@query(f"""WITH {CUSTOMERS}, {CHANGES} versions AS (
    SELECT b.customer_id, b.segment, TIMESTAMP '1970-01-01' AS valid_from, coalesce(changed.updated_at, TIMESTAMP '9999-12-31') AS valid_to, changed.customer_id IS NULL AS is_current FROM base b LEFT JOIN changed USING (customer_id)
    UNION ALL SELECT customer_id, segment, updated_at, TIMESTAMP '9999-12-31', true FROM opened)
    SELECT customer_id, segment, CAST(epoch(valid_from) AS BIGINT) AS valid_from, CAST(epoch(valid_to) AS BIGINT) AS valid_to, is_current FROM versions""")
def flw_customer_history(spark, d):
    """Two batches; the second one runs twice and ends in the same state."""
    root = lake.work_folder(spark)
    customer_history(first_customers(spark, d), root, "b1", FIRST)
    for _ in range(2):
        people = customer_history(clean(spark, d, "customers", "customers_raw"), root, "b2", SECOND)
    return people.filter("customer_key <> -1").select("customer_id", "segment", stamp("valid_from"), stamp("valid_to"), "is_current")


@query(REPORT + ' SELECT "table", valid, quarantined FROM report')
def flw_refined_all(spark, d):
    """Every table from raw to clean in one run, children against the whole batch of their parents; rows kept and refused."""
    root, tables = lake.work_folder(spark), [n for n, *_ in ALL_REASONS]
    for name in tables:
        lake.append_raw(lake.add_lineage(view(spark, d, RAW[name]), "b1", FIRST, "shop"), f"{root}/raw/{name}")
    refine(spark, REGISTRY, root, "b1", FIRST, tables)
    count = lambda df, name, valid: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(valid).alias("valid"), "n")
    found = None
    for name in tables:
        bad = count(spark.read.parquet(f"{root}/quarantine/{name}"), name, False)
        one = count(clean_table(spark, root, name), name, True).unionByName(bad)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("table").agg(F.sum(F.when(F.col("valid"), F.col("n"))).alias("valid"), F.sum(F.when(~F.col("valid"), F.col("n"))).alias("quarantined"))


MONEY = "CAST(sum(CAST({} AS DECIMAL(18, 2))) AS DOUBLE)"
NO_MONEY = "CAST(NULL AS DOUBLE)"


@query(f"""WITH {CUSTOMERS}, {PRODUCTS}, {ITEMS}, {good_visits(1800)}, {SETTLED.replace("good", "accepted")}
    SELECT 'dim_date' AS "table", CAST(max(CAST(order_date AS DATE)) - min(CAST(order_date AS DATE)) + 1 AS BIGINT) AS rows, {NO_MONEY} AS amount FROM {{orders_raw}}
    UNION ALL SELECT 'dim_customer', count(*) + 1, {NO_MONEY} FROM customers
    UNION ALL SELECT 'dim_product', count(*) + 1, {NO_MONEY} FROM products
    UNION ALL SELECT t, count(*), {MONEY.format("line_amount")} FROM items, (VALUES ('fct_order_items'), ('agg_daily_sales')) v(t) GROUP BY t
    UNION ALL SELECT 'fct_sessions', count(*), {MONEY.format("amount")} FROM visits
    UNION ALL SELECT 'agg_funnel', count(*), {NO_MONEY} FROM visits
    UNION ALL SELECT 'fct_settlements', count(*), {MONEY.format("amount")} FROM accepted
    UNION ALL SELECT 'agg_reconciliation', count(*), {MONEY.format("settled")} FROM final""")  # fmt: skip
def flw_publish(spark, d):
    """Dimensions, facts and aggregates published in one run, which is repeated; each table with its rows (aggregates: the
    rows that they stand for) and what its amounts come to. What is published from is written first, as a clean layer is, so
    that neither run makes it again."""
    root = lake.work_folder(spark)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/given/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/given/{name}")

    orders = clean(spark, d, "orders", RAW["orders"]).filter("order_date is not null")
    files = kept(judged_files(spark, d)[0], "files")
    cut = kept(settlements.lines(files), "file_lines")
    tables = {"customers": clean(spark, d, "customers", RAW["customers"]), "products": clean(spark, d, "products", RAW["products"]), "orders": orders, "lines": lines(spark, d), "events": good_events(spark, d), "settled": settlements.flatten(cut, settlements.verdicts(files, cut))}
    given = [kept(df, name) for name, df in tables.items()]
    for _ in range(2):
        publish(*given, root, "b1", FIRST)
    one = lambda name, df, rows=F.count("*"), amount=F.lit(None): df.agg(rows.cast("bigint").alias("rows"), amount.cast("double").alias("amount")).select(F.lit(name).alias("table"), "rows", "amount")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    written = lambda name: spark.read.parquet(f"{root}/{name}")
    out = one("dim_customer", version(spark, root, "dim_customer", layer="published"))
    for name, *measures in (
        ("dim_date",), ("dim_product",), ("fct_order_items", F.count("*"), money("line_amount")), ("agg_daily_sales", F.sum("lines"), money("revenue")),
        ("fct_sessions", F.count("*"), money("amount")), ("agg_funnel", F.sum("visits")), ("fct_settlements", F.count("*"), money("amount")), ("agg_reconciliation", F.count("*"), money("settled")),
    ):
        out = out.unionByName(one(name, written(name), *measures))
    return out


@query(f"WITH {ORDERS} SELECT reason, count(*) AS rows FROM (SELECT unnest({ORDER_REASONS}) AS reason FROM clean_orders) GROUP BY reason")
def snk_report_json(spark, d):
    """A report written as JSON, twice, and read back."""
    from ..operators import quality

    path = f"{lake.work_folder(spark)}/report"
    histogram = quality.reason_histogram(judged(spark, d, "orders")[1])
    for _ in range(2):
        lake.write_report(histogram, path)
    return spark.read.json(path)


MOVED = "WITH moved AS (SELECT * REPLACE (CASE WHEN order_id % 3 = 0 THEN CAST('1995-06-17' AS TIMESTAMP) ELSE order_date END AS order_date) FROM {sold}), " + SETTLED.split("), good AS")[0].replace("{sold}", "moved") + ")"


@query(MOVED + " SELECT nullif(order_id, 0) AS order_id, day AS operation_date, CAST(amount AS DOUBLE) AS amount, CAST(fee AS DOUBLE) AS fee, row_number() OVER (PARTITION BY day ORDER BY order_id) AS line FROM details")
def fil_large_files(spark, d):
    """A third of all orders on one day: files written in parts, read by byte ranges, judged and numbered in chunks. A
    reference of zeros only is none, so an order 0 comes back without its number."""
    root, sold = lake.work_folder(spark), view(spark, d, "sold")
    moved = sold.withColumn("order_date", F.when(F.col("order_id") % 3 == 0, F.lit("1995-06-17").cast(sold.schema["order_date"].dataType)).otherwise(F.col("order_date")))
    settlements.write_files(moved, f"{root}/zone")
    settlements.read_lines(spark, f"{root}/zone").write.parquet(f"{root}/lines")
    cut = spark.read.parquet(f"{root}/lines")
    rows = settlements.flatten(cut, settlements.verdicts(cut.select("name").distinct(), cut))
    return rows.select("order_id", day("operation_date"), F.col("amount").cast("double").alias("amount"), F.col("fee").cast("double").alias("fee"), F.col("line").cast("bigint").alias("line"))


def file_batches(spark, d) -> str:
    """Settlement files of all days, by the day as a number modulo 40: 7 lost its last detail, 9 its trailer, 11 never came,
    13 comes a second time under the name of a resend. The second batch has all files again. The folder written to."""
    made, root = extract(spark, d), lake.work_folder(spark)
    number = F.substring("name", 5, 8).cast("int") % 40
    content = F.when(number == 7, F.regexp_replace("content", r"\nD[^\n]*\nP", "\nP")).when(number == 9, F.regexp_replace("content", r"\nP[^\n]*$", "")).otherwise(F.col("content"))
    sent = made.filter(number != 11).withColumn("content", F.encode(content, "ISO-8859-1")).withColumn("content_hash", F.sha2("content", 256))
    again = sent.filter(number == 13).withColumn("name", F.replace("name", F.lit(".txt"), F.lit("_R.txt")))
    for batch, files, at in (("b1", sent, FIRST), ("b2", sent.unionByName(again), SECOND), ("b2", sent.unionByName(again), SECOND)):
        ingest_files(files, REGISTRY["settlements"], root, batch, at)
    return root


@query(f"WITH {SETTLED} SELECT order_id, day AS operation_date, day AS settlement_date, 'PSP_ACME' AS provider, 'Operación' AS concept, CAST(amount AS DOUBLE) AS amount, 'b1' AS _batch_id, 'files' AS _source_system FROM good WHERE ymd % 40 <> 11")
def flw_settlement_files(spark, d):
    rows = lake.read_raw(spark, f"{file_batches(spark, d)}/raw/settlements")
    return rows.select("order_id", day("operation_date"), day("settlement_date"), "provider", "concept", F.col("amount").cast("double").alias("amount"), "_batch_id", "_source_system")


DAYS = "days AS (SELECT ymd, day, count(*) AS n, CAST(date_diff('day', DATE '1970-01-01', CAST(day AS DATE)) AS BIGINT) AS number FROM details WHERE ymd % 40 <> 11 GROUP BY 1, 2)"


@query(f"""WITH {SETTLED}, {DAYS} SELECT day AS settlement_date, CAST(number % 1000 AS INTEGER) AS sequence, n - CASE WHEN ymd % 40 = 7 THEN 1 ELSE 0 END AS details,
    CASE WHEN ymd % 40 IN (7, 9) THEN 'rejected' ELSE 'accepted' END AS outcome, batch_id FROM days JOIN (SELECT unnest(['b1', 'b2']) AS batch_id) ON batch_id = 'b1' OR ymd % 40 IN (7, 9)""")
def flw_file_control(spark, d):
    """Accepted content is known in the second batch; refused files are judged again."""
    return spark.read.parquet(f"{file_batches(spark, d)}/control/files/settlements").select(day("settlement_date"), "sequence", "details", "outcome", "batch_id")


@query(f"""WITH {SETTLED}, {DAYS}, ends AS (SELECT number // 1000 AS cycle, min(number % 1000) AS a, max(number % 1000) AS b FROM days GROUP BY 1)
    SELECT cycle, CAST(s AS INTEGER) AS missing FROM (SELECT cycle, unnest(generate_series(a, b)) AS s FROM ends) WHERE cycle * 1000 + s NOT IN (SELECT number FROM days)""")
def flw_missing_files(spark, d):
    return missing_files(spark, REGISTRY["settlements"], file_batches(spark, d))


# -- versions ---------------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey AS order_id, 'first' AS state, o_totalprice AS total FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, 'second', o_totalprice + CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 3 <> 0 THEN 1 ELSE 0 END FROM orders""")
def his_stored_times(spark, d):
    """A stored table read as of two earlier times, after a third commit; the second commit runs twice."""
    rows = view(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.lit(1).alias("updated_at"))
    old, new = rows.filter("order_id % 3 <> 0"), rows.filter("order_id % 3 = 0")
    changed = old.filter("order_id % 10 = 0").select("order_id", (F.col("total") + 1).alias("total"), F.lit(2).alias("updated_at"))
    table = KeyedTable(spark, f"{lake.work_folder(spark)}/orders", dataclasses.replace(REGISTRY["orders"], dedup_order=("updated_at",), references={}), buckets=16)
    last = rows.withColumn("total", F.lit(0.0))
    for version, batch, at in ((1, old, FIRST), (2, changed.unionByName(new), SECOND), (2, last, SECOND), (3, last, SECOND + timedelta(days=1))):
        table.upsert(batch, version, at)
    shown = lambda at, name: table.read(at=at).select("order_id", F.lit(name).alias("state"), "total")
    return shown(FIRST + timedelta(hours=1), "first").unionByName(shown(SECOND, "second"))


@query(f"WITH {good_visits(1800)} SELECT {VISIT_COLUMNS} FROM visits")
def ses_rebuilt_days(spark, d):
    """A seventh of the events arrives after the visits of the others were built; only the days they fall on are built again."""
    folder, found = lake.work_folder(spark), good_events(spark, d)
    found.write.parquet(f"{folder}/events")
    events = spark.read.schema(found.schema).parquet(f"{folder}/events")
    late, table = F.col("event_id") % 7 == 3, VersionedTable(spark, f"{folder}/visits")
    refresh_visits(table, events.filter(~late), None, 1, FIRST)
    return shown_visits(refresh_visits(table, events, events.filter(late), 2, SECOND))


# -- streams over written folders -------------------------------------------------------------------------------------
def replay(folder: str, start, *batches: DataFrame) -> None:
    """Each batch written as a folder, of as many files as it has partitions, and taken in by one run of the stream that
    ``start`` makes: a micro-batch for each, all from one checkpoint."""
    for n, rows in enumerate(batches):
        rows.write.parquet(f"{folder}/in/{n}")
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in/*")).awaitTermination()


def finished(operator, folder: str, *batches: DataFrame) -> DataFrame:
    """What an operator over streams has written after all batches."""

    def start(stream: DataFrame):
        out = operator(stream)
        schemas.append(out.schema)
        return out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    schemas: list = []
    replay(folder, start, *batches)
    return batches[0].sparkSession.read.schema(schemas[-1]).parquet(f"{folder}/out")


@query("SELECT DISTINCT event_id FROM {events_raw} WHERE received_at IS NOT NULL")
def str_first_arrivals(spark, d):
    rows, folder = view(spark, d, "events_raw").select("event_id", F.col("received_at").cast("timestamp").alias("received_at")).filter("received_at is not null"), lake.work_folder(spark)
    return finished(lambda s: streaming.first_arrivals(s, delay="3650 days"), folder, rows, rows).select("event_id")


@query("WITH good AS (SELECT * FROM {events_raw} WHERE session_id IS NOT NULL AND event_time IS NOT NULL), " + VISITS.replace("{gap}", "1800") + " SELECT CAST(epoch(date_trunc('second', session_start)) AS BIGINT) AS session_start, count(*) AS visits, CAST(sum(events) AS BIGINT) AS events FROM visits GROUP BY 1")
def str_visits(spark, d):
    """A last event far ahead closes all visits."""
    rows = view(spark, d, "events_raw").filter("session_id is not null and event_time is not null").select("session_id", F.col("event_time").cast("timestamp").alias("event_time"), "customer_id", "event_type")
    end = rows.limit(1).select(F.lit(-1).cast(rows.schema["session_id"].dataType).alias("session_id"), F.lit(datetime(2200, 1, 1)).cast("timestamp").alias("event_time"), "customer_id", "event_type")
    folder = lake.work_folder(spark)
    out = finished(streaming.visits, folder, rows, end, end).filter(F.col("session_start") < F.lit(datetime(2199, 1, 1)).cast("timestamp"))
    return out.groupBy(stamp("session_start")).agg(F.count("*").alias("visits"), F.sum("events").cast("bigint").alias("events"))


@query("SELECT event_id, ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 5 DAY AS late FROM events")
def str_late_rows(spark, d):
    rows, folder = view(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), lake.work_folder(spark)
    start = lambda s: streaming.route_late(s, "ts", 5 * 86400, f"{folder}/good", f"{folder}/late", f"{folder}/state")
    replay(folder, start, rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"))
    read = lambda name, late: spark.read.parquet(f"{folder}/{name}").select("event_id", F.lit(late).alias("late"))
    return read("good", False).unionByName(read("late", True))


@query("SELECT o_orderkey AS order_id, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS total FROM orders")
def str_upserts(spark, d):
    """A second micro-batch changes every tenth order."""
    first = view(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.lit(1).alias("updated_at"))
    changed = first.filter("order_id % 10 = 0").select("order_id", (F.col("total") + 1).alias("total"), F.lit(2).alias("updated_at"))
    folder, spec = lake.work_folder(spark), dataclasses.replace(REGISTRY["orders"], dedup_order=("updated_at",), references={})
    table = KeyedTable(spark, f"{folder}/table", spec, buckets=16)
    replay(folder, lambda s: streaming.upsert_stream(s, table, f"{folder}/state", policy="ordered"), first, changed)
    return table.read().select("order_id", "total")


@query(f"WITH {FILES} SELECT content_hash, bytes FROM files")
def str_landing_once(spark, d):
    """The zone is watched twice; its files are processed once."""
    path, folder = zone(spark, d), lake.work_folder(spark)
    keep = lambda files, n: files.select("content_hash", F.octet_length("content").cast("bigint").alias("bytes")).write.mode("append").parquet(f"{folder}/seen")
    for _ in range(2):
        streaming.landing(spark, f"{path}/*", f"{folder}/state", lambda: None, keep).awaitTermination()
    return spark.read.parquet(f"{folder}/seen")
