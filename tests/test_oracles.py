"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tracewell.plans.all_queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: None if v is None else float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(([show(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(want.fetchall(), names)
