"""Each query against its SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ridgeline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    other = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert rows == other
    assert rows
