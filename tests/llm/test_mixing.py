import random

import pytest

from bandloom.llm import mixing

from .oracle import query_rows, sql_rows


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["b", "b", "b", "a", "é", None]), 1) for i in range(400)]
    rows += [(900, None, "a", 1), (901, "x y", "tiny", 1), (902, "v " * 3000, "b", 1), (7, "again twice", "b", 1), (7, "again twice", "b", 1), (None, "one", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(3)


def test_against_sql(spark, docs, tmp_path):
    got = query_rows("op9_source_mixing", spark, tmp_path, documents=docs)
    assert got == sql_rows("op9_source_mixing", documents=docs)
    assert query_rows("op9_source_mixing", spark, tmp_path / "e", documents=docs.limit(0)) == []


def test_targets_are_met(docs):
    rows = mixing.mix(docs).select("row.source", "size", "target", "taken").collect()
    total = sum(r.size for r in rows)
    assert sum(r.taken for r in rows) <= total
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)
    assert max(r.taken for r in rows if r.source == "tiny") == 6


def test_hand_made_targets(spark):
    # weights 1, 2, 3, 1: e stops at 3 * 10, then c at 3 * 60 takes part by weight
    sizes = spark.createDataFrame([("a", 500), ("c", 60), ("e", 10), (None, 30)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["e"] == 30.0 and got["c"] == 180.0 and got[None] == 90.0 and got["a"] == pytest.approx(300.0)


@pytest.mark.parametrize("range_rows", [1, 10, 1000])
def test_ranges_do_not_matter(docs, range_rows):
    key = lambda df: sorted((str(r.row), r.taken) for r in df.select("row", "taken").collect())
    assert key(mixing.mix(docs, range_rows=range_rows)) == key(mixing.mix(docs))


def test_of_equal_rows_some_are_taken(spark):
    rows = [(5, "a b c", "x", k) for k in range(40)] + [(6, "d e", "y", k) for k in range(7)] + [(None, "n", None, 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    found = mixing.mix(docs).collect()
    total = sum(r.size for r in found)
    assert len(found) == 52 and total - 3 <= sum(r.taken for r in found) <= total
    for source in ("x", "y", None):
        mine = [r for r in found if r.row.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3
        assert max(r.times for r in mine) - min(r.times for r in mine) <= 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((str(r.row), r.times) for r in again) == sorted((str(r.row), r.times) for r in found)


def test_clashing_names_come_back(spark):
    names = ["row", "SIZE", "order", "range", "source_size", "target", "taken", "times", "slot", "pass", "finish", "n", "last0", "key", "_mix", "_order"]
    rows = [(k, "w " * k, "a", *([n] for n in names)) for k in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` array<string>" for n in names))
    assert mixing.mixed(docs).columns == docs.columns
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == rows
