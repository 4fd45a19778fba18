from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lineitem(spark):
    return spark.read.parquet(f"{DATA}/lineitem.parquet")


@pytest.fixture(scope="session")
def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet")


@pytest.fixture(scope="session")
def sample(spark):
    """A balanced 6 × 5 panel whose columns are exact linear functions of id and time."""
    rows = []
    for i in range(1, 7):
        for t in range(1, 6):
            x1, x2 = 2 * i - t, 1.5 + i + 3 * t
            rows.append((i, t, "north" if i % 2 else "south", 1.75 + 0.8 * x1 - 0.35 * x2, x1, x2, 0.6 * i + t, 2.0 * i - 0.25 * t))
    return spark.createDataFrame(rows, 'id int, time int, `group` string, y double, x1 int, x2 double, endog double, instr double')


def one(df) -> dict:
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by_name(df, key: str = "variable") -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
