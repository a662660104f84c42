"""Every query of the catalogue against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from srclattice.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Paths of 20 calls are too many in the dense graph of the smallest tables.
LARGER = {"call_chains": "/root/testdata/sf0.01"}
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no tables here")


def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted(str(tuple(one(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.CATALOG))
def test_as_in_sql(spark, name):
    folder = LARGER.get(name, SF)
    con = duck(folder)
    df, want = __spark_entry__.queries()[name](spark, folder), con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [list(want.columns).index(c) for c in cols]
    assert plain(df.select(*[f"`{c}`" for c in cols]).collect()) == plain([r[i] for i in at] for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_training_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(catalog.CATALOG)
