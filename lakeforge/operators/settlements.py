"""Multi-record settlement files as one distributed job: header C, details D, trailer P, fields cut by semicolons.

A file is wrong as a whole: any malformed record refuses all of it. Lines of a file are found in one pass; validity and
balance are one aggregation per file; good details are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import amount, comma, day_first_date, name_date, name_sequence, order_reference
from .aggregates import money

BALANCE = 0.005
#: Lines of a file that are numbered together.
CHUNK = 1 << 16


def lines(files: DataFrame, encoding: str = "ISO-8859-1") -> DataFrame:
    """``name, position, record, fields`` of the non-blank lines. Decoding is strict: bytes that the encoding lacks are an
    error, not a replacement."""
    text = F.decode("content", encoding) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    cut = files.select("name", F.posexplode(F.split(text, "\r?\n")).alias("position", "line")).filter(F.trim("line") != "")
    return cut.select("name", "position", F.substring("line", 1, 1).alias("record"), F.split("line", ";").alias("fields"), F.trim("line").alias("line"))


def details(cut: DataFrame) -> DataFrame:
    """Detail records with typed fields and ``bad`` where one cannot be read; the text after the eighth field is optional."""
    f = lambda i: F.get("fields", F.lit(i))
    typed = cut.filter("record = 'D'").select(
        "name", "position", day_first_date(f(1)).alias("operation_date"), order_reference(f(2)).alias("order_id"), F.upper(F.trim(f(3))).alias("kind"),
        amount(f(4)).alias("amount"), amount(f(5)).alias("fee"), F.upper(F.trim(f(6))).alias("currency"), F.upper(F.trim(f(7))).alias("method"), F.trim(f(8)).alias("concept"), F.size("fields").alias("n"),
    )
    return typed.withColumn("bad", (F.col("n") < 8) | F.col("operation_date").isNull() | F.col("amount").isNull() | F.col("fee").isNull()).drop("n")


def verdicts(files: DataFrame, cut: DataFrame) -> DataFrame:
    """One row per file: ``name, provider, settlement_date, sequence, details, amount, fee, outcome, reason``; the first check
    that fails is the reason."""
    f = lambda i: F.get("fields", F.lit(i))
    heads = cut.groupBy("name").agg(
        F.count_if(F.col("record") == "C").alias("headers"), F.count_if(F.col("record") == "P").alias("trailers"), F.count("*").alias("lines"),
        F.max(F.when(F.col("record") == "C", F.struct(F.size("fields").alias("n"), f(2).alias("date"), f(3).alias("sequence"), F.trim(f(4)).alias("provider")))).alias("head"),
        F.max(F.when(F.col("record") == "P", F.struct(F.size("fields").alias("n"), f(1).try_cast("bigint").alias("details"), amount(f(2)).alias("amount"), amount(f(3)).alias("fee")))).alias("tail"),
    )
    sums = details(cut).groupBy("name").agg(F.count("*").alias("details"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.coalesce(F.sum("fee"), F.lit(0)).alias("fee"), F.count_if("bad").alias("bad"))
    all_ = files.select("name").join(heads, "name", "left").join(sums, "name", "left").fillna(0, ["headers", "trailers", "lines", "details", "bad"])
    all_ = all_.withColumns({"amount": F.coalesce("amount", F.lit(0)).cast("decimal(18,2)"), "fee": F.coalesce("fee", F.lit(0)).cast("decimal(18,2)")})
    text = lambda c: F.col(c).cast("string")
    wrong = "pie_descuadrado: "  # fixed value, as are the reasons below
    reason = (
        F.when(F.col("lines") == 0, "fichero_vacio")
        .when(F.col("headers") != 1, "cabecera_ausente_o_repetida")
        .when(F.col("trailers") != 1, "pie_ausente_o_repetido")
        .when(F.col("head.n") < 5, "cabecera_incompleta")
        .when((F.col("tail.n") < 4) | F.col("tail.details").isNull() | F.col("tail.amount").isNull() | F.col("tail.fee").isNull(), "pie_incompleto")
        .when(F.col("bad") > 0, "detalle_invalido")
        .when(F.col("tail.details") != F.col("details"), F.concat(F.lit(wrong + "detalles_declarados="), text("tail.details"), F.lit(" leidos="), text("details")))
        .when(F.abs(F.col("tail.amount") - F.col("amount")) > BALANCE, F.concat(F.lit(wrong + "importe_declarado="), text("tail.amount"), F.lit(" real="), text("amount")))
        .when(F.abs(F.col("tail.fee") - F.col("fee")) > BALANCE, F.concat(F.lit(wrong + "comision_declarada="), text("tail.fee"), F.lit(" real="), text("fee")))
    )
    return all_.select(
        "name", F.col("head.provider").alias("provider"), F.coalesce(F.try_to_date(F.col("head.date"), "yyyyMMdd"), name_date(F.col("name"))).alias("settlement_date"), F.coalesce(F.col("head.sequence").try_cast("int"), name_sequence(F.col("name"))).alias("sequence"),
        "details", "amount", "fee", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("outcome"), reason.alias("reason"),
    )


def numbered(rows: DataFrame, group: str, position: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of each group numbered from 1 by their positions, which are whole and unique in it: inside chunks of positions,
    then with the number of rows in the chunks before, so that a group of any size is spread over its chunks."""
    cut = rows.withColumn("_chunk", F.floor(F.col(position) / chunk))
    inside = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(position))
    sizes = cut.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn(name, inside).join(sizes.select(group, "_chunk", before.alias("_before")), [group, "_chunk"]).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_chunk", "_before")


def flatten(cut: DataFrame, judged: DataFrame) -> DataFrame:
    """Details of the accepted files, numbered from 1 in the order of the file."""
    good = judged.filter("outcome = 'accepted'").select("name", "provider", "settlement_date", "sequence")
    rows = numbered(details(cut).join(good, "name"), "name", "position", "line")
    return rows.select(F.col("name").alias("file"), "provider", "settlement_date", "sequence", "line", "operation_date", "order_id", "kind", "amount", "fee", "currency", "method", "concept")


def extract_lines(orders: DataFrame, provider: str = "PSP_ACME") -> DataFrame:
    """``name, kind, order_id, line``: the records of a file per day from orders (``order_id, order_date, amount``, refunds
    negative), a row each: a header (kind 0), details (1) by order, a trailer (2).

    The fee is 0.25 and 1.9 % of the amount, negative for refunds; numbers of files follow the days. A day of any size is
    never brought together: its count and sums are an aggregate.
    """
    value, size = money("amount"), F.abs(money("amount"))
    fee = (F.round(F.lit(0.25).cast("decimal(18,2)") + size * F.lit("0.019").cast("decimal(5,3)"), 2) * F.when(value < 0, -1).otherwise(1)).cast("decimal(18,2)")
    rows = orders.select(F.col("order_date").cast("date").alias("day"), "order_id", value.alias("amount"), fee.alias("fee"))
    detail = F.concat_ws(
        ";", F.lit("D"), F.date_format("day", "dd/MM/yyyy"), F.concat(F.lit("ORD-"), F.lpad(F.col("order_id").cast("string"), 9, "0")), F.when(F.col("amount") < 0, "DEVOL").otherwise("PAGO"),
        comma(F.col("amount")), comma(F.col("fee")), F.lit("EUR"), F.lit("TARJETA"), F.lit("Operación"),
    )
    days = rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("fee").alias("fee"))
    sequence = F.lpad((F.datediff("day", F.lit("1970-01-01").cast("date")) % 1000).cast("string"), 3, "0")
    head = F.concat_ws(";", F.lit("C"), F.lit("LIQ"), F.date_format("day", "yyyyMMdd"), sequence, F.lit(provider))
    tail = F.concat_ws(";", F.lit("P"), F.col("n").cast("string"), comma(F.col("amount")), comma(F.col("fee")))
    name = F.concat(F.lit("LIQ_"), F.date_format("day", "yyyyMMdd"), F.lit("_"), sequence, F.lit(".txt")).alias("name")
    none = F.lit(None).cast(rows.schema["order_id"].dataType)
    ends = days.select(name, F.inline(F.array(F.struct(F.lit(0).alias("kind"), none.alias("order_id"), head.alias("line")), F.struct(F.lit(2).alias("kind"), none.alias("order_id"), tail.alias("line")))))
    return rows.select(name, F.lit(1).alias("kind"), "order_id", detail.alias("line")).unionByName(ends)


def write_extract(orders: DataFrame, provider: str = "PSP_ACME") -> DataFrame:
    """``name, content``: each file in one row, for files that fit into one; ``write_files`` writes files of any size."""
    whole = extract_lines(orders, provider).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("kind", "order_id", "line"))).alias("l"))
    return whole.select("name", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def write_files(orders: DataFrame, path: str, provider: str = "PSP_ACME") -> None:
    """Each file as a folder ``name=...`` of numbered parts, read one after the other. Lines are dealt out by ranges of file
    and order, so a large day is many parts and small days share a task."""
    order = ["name", "kind", "order_id", "line"]
    extract_lines(orders, provider).repartitionByRange(*order).sortWithinPartitions(*order).select("name", "line").write.mode("overwrite").partitionBy("name").text(path)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The non-blank lines of files in parts as ``lines`` gives them: ``name, position, record, fields, line``.

    Files are read by byte ranges, as Spark splits them; a range has its lines numbered by the task that reads it, and
    starts where the ranges before it in the file end. No file is ever in one row or one task. What comes back reads the
    files each time, so it should be written before it is used twice.
    """
    read = spark.read.schema("line string, name string").options(sep="\u0001", quote="", encoding=encoding).csv(path)
    ranged = read.select("name", "line", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")).filter(F.trim("line") != "")
    ranges = ranged.groupBy("name", "_file", "_start").agg(F.min("_id").alias("_first"), (F.max("_id") - F.min("_id") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("name").orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("name", "_file", "_start", (before - F.col("_first")).alias("_shift"))  # a row for each range of bytes
    cut = ranged.join(offsets, ["name", "_file", "_start"]).select("name", (F.col("_id") + F.col("_shift")).alias("position"), "line")
    return cut.select("name", "position", F.substring("line", 1, 1).alias("record"), F.split("line", ";").alias("fields"), F.trim("line").alias("line"))
