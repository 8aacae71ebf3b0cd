from datetime import datetime

from pyspark.sql import functions as F

from lakeforge.plans import flows, queries
from lakeforge.plans.domain import REGISTRY, view
from lakeforge.sources import landing

from .conftest import DATA

AT = datetime(2026, 3, 15, 12)


def test_ingest_and_refine(spark, tmp_path):
    root = str(tmp_path)
    sources = {"customers": view(spark, DATA, "customers_raw"), "orders": view(spark, DATA, "orders_raw")}
    assert flows.ingest(sources, REGISTRY, root, "b1", AT)["orders"] == 15000
    assert flows.ingest(sources, REGISTRY, root, "b1", AT)["orders"] == 0
    verdict = flows.refine(spark, REGISTRY, root, "b1", AT)
    assert verdict["total"] == 16500 and not verdict["passed"]
    clean, bad = flows.clean_table(spark, root, "orders"), spark.read.parquet(f"{root}/quarantine/orders")
    assert clean.count() + bad.count() == 15000
    again = flows.refine(spark, REGISTRY, root, "b2", AT, full=True)
    assert again["total"] == 16500 and flows.clean_table(spark, root, "orders").count() == clean.count()


def test_publish(spark, tmp_path):
    orders = queries.judged(spark, DATA, "orders")[0]
    lines = queries.lines(spark, DATA)
    _, cut, verdict = queries.judged_files(spark, DATA)
    settled = queries.settlements.flatten(cut, verdict)
    given = queries.judged(spark, DATA, "customers")[0], queries.judged(spark, DATA, "products")[0], orders, lines, queries.good_events(spark, DATA), settled, str(tmp_path)
    summary = flows.publish(*given, "b1", AT)
    people = flows.version(spark, str(tmp_path), "dim_customer", layer="published").count()
    assert summary["days"] > 0 and "passed" in summary
    assert flows.publish(*given, "b1", AT) == summary
    assert flows.publish(*given, "b2", AT) == summary and flows.version(spark, str(tmp_path), "dim_customer", layer="published").count() == people
    assert spark.read.parquet(str(tmp_path / "fct_settlements")).count() == settled.count()
    assert spark.read.parquet(str(tmp_path / "clean/web_sessions")).count() == spark.read.parquet(str(tmp_path / "fct_sessions")).count()
    sold = spark.read.parquet(str(tmp_path / "fct_order_items"))
    assert sold.count() == lines.count()
    assert spark.read.parquet(str(tmp_path / "agg_daily_sales")).agg(F.sum("lines")).first()[0] == sold.count()


def test_settlement_files(spark, tmp_path):
    """Two files in the provider's encoding, one of them without a trailer; both come again, one under another name."""
    zone, root, spec = tmp_path / "zone", str(tmp_path), REGISTRY["settlements"]
    zone.mkdir()
    good = "C;LIQ;20260315;007;PSP_ACME\nD;15/03/2026;ORD-000000042;PAGO;1.234,56;23,71;EUR;TARJETA;Operación\nP;1;1234,56;23,71\n".encode("latin-1")
    (zone / "LIQ_20260315_007.txt").write_bytes(good)
    (zone / "LIQ_20260317_009.txt").write_bytes(good.split(b"\nP;")[0].replace(b"20260315;007", b"20260317;009"))
    assert flows.ingest_files(landing.scan(spark, str(zone)), spec, root, "b1", AT) == {"accepted": 1, "rejected": 1}
    (zone / "LIQ_20260315_007_R.txt").write_bytes(good)
    for _ in range(2):
        assert flows.ingest_files(landing.scan(spark, str(zone)), spec, root, "b2", AT) == {"rejected": 1}
    rows = spark.read.parquet(f"{root}/raw/settlements").collect()
    assert [(r["order_id"], float(r["amount"]), r["concept"], r["provider"], r["line"], r["_batch_id"]) for r in rows] == [(42, 1234.56, "Operación", "PSP_ACME", 1, "b1")]
    assert [r["missing"] for r in flows.missing_files(spark, spec, root).collect()] == [8]
    kept = spark.read.parquet(f"{root}/quarantine/files/settlements").filter("_batch_id = 'b2'").collect()
    assert [(r["name"], r["reason"]) for r in kept] == [("LIQ_20260317_009.txt", "pie_ausente_o_repetido")] and bytes(kept[0]["content"]) == (zone / "LIQ_20260317_009.txt").read_bytes()
    assert flows.refine(spark, REGISTRY, root, "b2", AT)["total"] == 1 and flows.clean_table(spark, root, "settlements").count() == 1


def test_no_files(spark, tmp_path):
    none = spark.createDataFrame([], "name string, content binary, content_hash string")
    assert flows.ingest_files(none, REGISTRY["settlements"], str(tmp_path), "b1", AT) == {}
    assert flows.missing_files(spark, REGISTRY["settlements"], str(tmp_path)).count() == 0


def test_first_version_is_not_made_unique_twice(spark, tmp_path, monkeypatch):
    """The first version of a table is the valid rows, one a key already; they meet no upsert."""
    from lakeforge.sources import lake

    monkeypatch.setattr(flows, "upsert", None)
    raw = view(spark, DATA, "orders_raw")
    lake.append_raw(lake.add_lineage(raw.unionByName(raw), "b1", AT, "shop"), f"{tmp_path}/raw/orders")
    flows.refine(spark, REGISTRY, str(tmp_path), "b1", AT, ["orders"])
    kept, refused = flows.clean_table(spark, str(tmp_path), "orders"), spark.read.parquet(f"{tmp_path}/quarantine/orders")
    assert kept.count() == kept.select("order_id").distinct().count() and kept.count() + refused.count() == 15000


def test_published_from_written_tables(spark, monkeypatch):
    """Neither run of the publication makes its inputs again."""
    from lakeforge.plans import stored

    def only_written(*given):
        assert all("/given/" in f for df in given[:6] for f in df.inputFiles())
        return flows.publish(*given)

    monkeypatch.setattr(stored, "publish", only_written)
    assert queries.QUERIES["flw_publish"](spark, DATA).count() == 9
