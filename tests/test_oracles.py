"""Every registered raster query against its SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pixelweft import registry, registry_io  # noqa: F401

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL whose operators have no golden test of their own.
BARE = ("c11_qef", "f2_weight", "f3_unweight", "f4_cda", "w25_srad")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    keys = [k for k in ("ch", "y", "x", "label", "bin", "i") if k in cols]
    a, b = (d[cols].sort_values(keys).reset_index(drop=True) for d in (a, b))
    for c in cols:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True), c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, db, name):
    _same(registry.QUERIES[name](spark, DATA).toPandas(), db.execute(registry.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", BARE)
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 16000 and set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_window_plans(spark):
    plan = registry.QUERIES["w16_lee"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
