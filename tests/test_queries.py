"""Every core query against its SQL on the smallest test tables."""

import math
import os
from pathlib import Path

import pytest

from speechlytics.plans.catalog import catalog

DATA = Path(os.environ.get("SPEECHLYTICS_TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def canonical(value):
    if hasattr(value, "isoformat"):
        value = value.replace(tzinfo=None).isoformat()
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.9g}" if value else "0"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.runs))
def test_query(spark, duck, name):
    df = catalog.runs[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    if name in catalog.sqls:
        frame = duck.sql(catalog.sqls[name])
        assert sorted(frame.columns) == columns
        at = [frame.columns.index(c) for c in columns]
        assert got == sorted(tuple(canonical(r[k]) for k in at) for r in frame.fetchall())


def test_the_core_does_not_import_the_optional_subpackage():
    root = Path(__file__).resolve().parent.parent / "speechlytics"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "speechlytics.llm" not in path.read_text(), path
