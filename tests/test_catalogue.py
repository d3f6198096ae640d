"""Every core query with an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from paceline.plans import audits, catalogue, extraction  # noqa: F401  (the others register their queries)
from paceline.session import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return str(int(x)) if x.is_integer() else round(float(x), 6)  # whole numbers beside nulls come as floats
        return str(x)

    return sorted(str([cell(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
