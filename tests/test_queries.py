"""Every registered query against its SQL; the others for shape and invariants."""

import duckdb
import pytest

from bandloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("embeddings", "lineitem", "labels")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    return sorted([tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert tidy(tuple(r[c] for c in columns) for r in got.collect()) == tidy(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["gpc", "walumi_partition"])
def test_partitions_cover_all_bands(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    for k in (registry.K_CUTS, registry.K):
        own = [r for r in rows if r.k == k]
        assert sorted(r.band for r in own) == list(range(64)) and len({r.subset_id for r in own}) == k


@pytest.mark.parametrize("name", ["mcd", "mcd_subset", "selfrep", "selfrep_subset"])
def test_searches_pick_k_bands(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    for k in {r.k for r in rows}:
        bands = [r.band for r in rows if r.k == k]
        assert len(set(bands)) == len(bands) == k and all(0 <= b < 64 for b in bands)


def test_classifier_results(spark):
    rows = registry.QUERIES["svm_eval"](spark, SF).collect()
    assert len(rows) == 20 and all(0 <= r.test_accuracy <= 1 and r.selected_band_count == registry.K for r in rows)
