"""Every query with a twin gives the twin's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vasculyze import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_twin(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    for a, b in zip(_plain(got.collect(), got.columns), _plain(rows, columns), strict=True):
        assert a == pytest.approx(b, nan_ok=True) if all(isinstance(x, float) for x in a) else a == b or all(x == y or (isinstance(x, float) and x == pytest.approx(y)) for x, y in zip(a, b))


def test_entry_and_models(spark):
    assert entry.entry(spark).count() > 0
    for name in ("mask_features", "avr_equivalent_width", "logistic_scores", "pca_embedding"):
        assert registry.QUERIES[name](spark, SF).count() > 0
