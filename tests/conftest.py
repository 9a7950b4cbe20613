"""A Spark session for all tests, and comparison of results with SQL run by DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows in order, columns by name, numbers to nine digits."""

    def value(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
        return str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def oracle(sql: str, data: str | None = DATA, **frames: pd.DataFrame) -> pd.DataFrame:
    """The rows of ``sql`` over a folder of tables, some of them replaced by ``frames``."""
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        elif data:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con.sql(sql).df()


def agree(df, sql: str, data: str | None = DATA, **frames: pd.DataFrame) -> None:
    got, want = df.toPandas(), oracle(sql, data, **frames)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
