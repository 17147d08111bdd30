"""Each query with an oracle against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quire import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_oracle(spark, duck, name):
    got = plans.queries()[name](spark, DATA)
    found = duck.execute(plans.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    rows = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.oracles()) <= set(__spark_entry__.queries())
