"""One Spark session for all tests, the small tables, and comparison with SQL."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = os.environ.get("WAYMARK_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL


def plain(value):
    """A value for comparison: floats to twelve digits, not-a-number as a word."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def as_rows(names: list[str], rows) -> list[tuple]:
    """Rows in a fixed order, columns in order of their names."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    """Column names and rows of DuckDB's answer over the tables of a folder."""
    import duckdb

    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{file}/*.parquet" if file.is_dir() else file
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{source}')")
    found = base.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), as_rows(names, found.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), as_rows(df.columns, df.collect())
