"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lodestrata.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_duckdb(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [Counter(tuple(map(plain, r)) for r in d[columns].astype(object).values) for d in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
