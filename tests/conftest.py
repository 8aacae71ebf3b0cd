import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="lakeforge-tests-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(frame):
    """Rows as comparable texts, columns by name; whole numbers alike whatever their type, others to six places."""
    import pandas as pd

    def plain(v):
        if v is None or (not isinstance(v, (list, tuple)) and not hasattr(v, "__len__") and pd.isna(v)):
            return None
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return int(v) if float(v).is_integer() else round(float(v), 6)
        return v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False))
