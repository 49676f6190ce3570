import numpy as np
import pytest

from bandloom.llm import vectors

from .oracle import query_rows, sql_rows


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(700)]
    rows += [(i, rows[50][1]) for i in range(1000, 1040)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 40), (2150, [float("inf")] * 40), (2200, [1.0, -2.0]), (2251, []), (None, [1.0])]
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)


def test_against_sql(spark, table, tmp_path, monkeypatch):
    want = sql_rows("op10_exact_topk", embeddings=table)
    assert len(want) == 5 * (14 + 1 + 1)  # 0..650, 1000, 2200
    assert query_rows("op10_exact_topk", spark, tmp_path, embeddings=table) == want
    monkeypatch.setattr(vectors, "BLOCK", 60)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "CELL_BYTES", 60 * 8 * 40)
    monkeypatch.setattr(vectors, "CELL_BLOCKS", 2)
    assert query_rows("op10_exact_topk", spark, tmp_path / "small", embeddings=table) == want
    assert query_rows("op10_exact_topk", spark, tmp_path / "none", embeddings=table.limit(0)) == []


def test_bounds_prune_nothing_that_counts():
    rng = np.random.default_rng(2)
    decay = np.geomspace(300, 1, 64)[:, None]
    q, v = (rng.normal(size=(64, n)) * decay for n in (30, 4000))
    q, v = q.astype(np.int64), v.astype(np.int64)
    cell = vectors._Cell([{"ids": (np.arange(30) - 100).tobytes(), "grid": q.tobytes(), "width": 8, "bars": None}], 5)
    for at in range(0, 4000, 500):
        cell.add(np.arange(at, at + 500), v[:, at : at + 500])
    x, vec, score = cell.queries[0].pairs
    # bars of a first pass keep what counts, ties included
    again = vectors._Cell([cell.held[0] | {"bars": cell.queries[0].bar.tobytes()}], 5)
    again.add(np.arange(4000), v)
    for one, other in zip(cell.queries[0].pairs, again.queries[0].pairs):
        assert one.tolist() == other.tolist()
    whole = q.T @ v
    for k in range(30):
        order = sorted(range(4000), key=lambda j: (-whole[k, j], j))[:5]
        assert vec[x == k].tolist() == order and score[x == k].tolist() == whole[k, order].tolist()


def test_large_values_and_repeats(spark):
    big = [1e12, 1e12]
    rows = [(0, big), (1, big), (2, [-1e12, 1e12]), (0, [1.0, 0.0]), (1, big)]
    got = vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    top = [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0]
    assert (1, 1, 2**63 - 1) in top and len(top) == 6


def test_scores_beyond_double_precision():
    """A bar isn't rounded up: equal scores of later, smaller ids still count."""
    q = np.array([[3], [1]], np.int64)
    v = np.array([[1 << 52] * 6, [1, 1, 1, 1, 1, 1]], np.int64)
    cell = vectors._Cell([{"ids": np.array([50]).tobytes(), "grid": q.tobytes(), "width": 8, "bars": None}], 5)
    cell.add(np.arange(10, 16), v)
    cell.add(np.arange(6), v)
    _, vec, score = cell.queries[0].pairs
    assert vec.tolist() == [0, 1, 2, 3, 4] and set(score.tolist()) == {3 * (1 << 52) + 1}


def test_vectors_of_other_lengths(spark):
    rows = [(0, [1.0]), (50, [0.5, 2.0]), (7, []), (8, [1.0, 1.0, 9.0]), (9, [-1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.search(table).collect()}
    scale = 256 * 256
    assert [got[0, k] for k in range(1, 5)] == [(8, scale), (50, scale // 2), (7, 0), (9, -scale)]
    assert [got[50, k] for k in range(1, 5)] == [(8, 5 * scale // 2), (0, scale // 2), (7, 0), (9, -scale // 2)]
    empty = spark.createDataFrame([(0, []), (1, []), (2, [])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.search(empty).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
