"""Every query of the reference operators against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from dendrospark import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.execute("SELECT " + ", ".join(columns) + " FROM (" + plans.oracle_sql()[name] + ") z").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


def test_spline_test_and_curves(spark):
    tested = plans.queries()["de_spline"](spark, SF).toPandas()
    assert set(tested.status) <= {"OK", "FAIL"} and tested.qval.between(0, 1).all()
    curves = plans.queries()["smooth_curves"](spark, SF).toPandas()
    assert (curves.groupby("gene_id").size() == 20).all()
