"""Every registered query against its SQL."""

import math
import os

import duckdb
import pytest

from swathline.plans.file_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) + 0.0 if isinstance(x, float) else x
    out = [tuple(clean(r[i]) for i in order) for r in data]
    return sorted(names), sorted(out, key=lambda r: [(x is None, str(type(x).__name__ in ("str",)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    rel = db.sql(SQL[name])
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for g, w in zip(got[1], want[1], strict=True):
        assert g == pytest.approx(w, abs=2e-6)
