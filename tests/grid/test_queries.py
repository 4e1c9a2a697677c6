"""Every query of the grid and content parts against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cellward.plans import contentqueries, gridqueries, modelqueries, shapequeries, webqueries

DATA = Path("/root/testdata/sf0.001")
QUERIES = {**gridqueries.QUERIES, **modelqueries.QUERIES, **shapequeries.QUERIES, **contentqueries.QUERIES, **webqueries.QUERIES}
ORACLES = {**gridqueries.ORACLES, **modelqueries.ORACLES, **shapequeries.ORACLES, **contentqueries.ORACLES, **webqueries.ORACLES}


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    return db


def plain(rows):
    value = lambda v: round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    assert plain(df.select(*columns).collect()) == plain(found.select(*columns).fetchall())
