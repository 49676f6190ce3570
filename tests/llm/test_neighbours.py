import math

import numpy as np
import pytest

from bandloom.llm import neighbours

from .oracle import query_rows, sql_rows

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int, id long, v string, links long"


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    rows = [base[k] for k in range(60)]
    rows += [base[k] + rng.normal(size=24) * 0.19 * np.linalg.norm(base[k]) / math.sqrt(24) for k in range(40) for _ in range(2)]  # about the threshold
    rows += [base[0] * (1 + k) for k in range(1, 5)] + [base[1]] * 12 + [base[2] + 1e-4 * rng.normal(size=24) for _ in range(30)]
    out = [[i, [float(np.float32(x)) for x in v], i % 3 if i < 60 else (i - 60) // 2 % 3 if i < 140 else [0, 1, 2, 2][i % 4], "k", 1, 2, "v", 3] for i, v in enumerate(rows)]
    x = out[0][1]
    more = [None, [], [0.0] * 24, [None, *x[1:]], [float("nan"), *x[1:]], [float("inf"), *x[1:]], [*x, 0.0, 0.0], x[:1], [1e30 * v for v in x], [1e-30 * v for v in x]]
    out += [[500 + k, v, 0, None, None, None, None, None] for k, v in enumerate(more)]
    return out + [[600, x, None, "k", 1, 2, "v", 3], [0, x, 0, "k", 1, 2, "v", 3], [None, x, 0, "k", 1, 2, "v", 3], [5, out[7][1], 1, "k", 1, 2, "v", 3]]


def brute(rows, threshold=0.98):
    n = len(rows)
    width = max(len(r[1] or []) for r in rows)
    full = []
    for r in rows:
        v = np.array([np.nan if x is None else x for x in r[1] or []], float)
        ok = r[1] is not None and r[2] is not None and np.isfinite(v).all() and (v != 0).any()
        full.append(np.pad(v / np.abs(v).max(), (0, width - len(v))) if ok else None)
    near = [[j for j in range(n) if j != i and full[i] is not None and full[j] is not None and rows[i][2] == rows[j][2] and full[i] @ full[j] / (np.linalg.norm(full[i]) * np.linalg.norm(full[j])) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((low, rows[i][0] == low, len(near[i]), rows[i][0]))  # columns by name
    return sorted(out, key=repr)


def query(vectors):
    return sorted([(r.component_id, r.kept, r.n_links, r.vec_id) for r in neighbours.near_duplicates(vectors).collect()], key=repr)


def test_against_brute_force(spark):
    assert query(spark.createDataFrame(vectors(), SCHEMA).repartition(3)) == brute(vectors())


def test_against_sql(spark, tmp_path):
    rows = [r for r in vectors() if r[0] not in (508, 509)]  # their squares leave double precision there
    frame = spark.createDataFrame(rows, SCHEMA)
    assert query_rows("op13_embedding_near_dedup", spark, tmp_path, embeddings=frame) == sql_rows("op13_embedding_near_dedup", embeddings=frame)


@pytest.mark.parametrize(("cell_rows", "chunk_rows"), [(1, 2048), (4, 2048), (1 << 20, 8), (8, 4)])
def test_any_cut_finds_all_links(spark, monkeypatch, cell_rows, chunk_rows):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk_rows)
    rows = [r[:3] for r in vectors()]
    assert query(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == brute(vectors())


def test_pairs_meet_once_in_a_block():
    rng = np.random.default_rng(1)
    for vectors in (1, 5_000, 10**6, 10**9):
        plan = neighbours.layout(64, vectors)
        z = rng.normal(size=(300, plan.block)) * 0.125
        z = np.concatenate((z, z + rng.normal(size=z.shape) * math.sqrt(plan.budget / plan.block) * 0.9))
        row, cells, guest = neighbours.reached(z, plan)
        members = {}
        for r, c, g in zip(row.tolist(), cells, guest.tolist()):
            members.setdefault(c.tobytes(), []).append((r, g))
        met = [tuple(sorted((a, b))) for m in members.values() for k, (a, g) in enumerate(m) for b, h in m[:k] if not (g and h)]
        assert len(met) == len(set(met))
        close = {(a, b) for a in range(600) for b in range(a + 1, 600) if ((z[a] - z[b]) ** 2).sum() <= plan.budget}
        assert close <= set(met) and close


def test_rotation_keeps_distances():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 24))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert np.allclose(neighbours.rotated(v, 32) @ neighbours.rotated(v, 32).T, u @ u.T)


def test_empty_and_invalid(spark):
    frame = spark.createDataFrame(vectors(), SCHEMA)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0
    rows = neighbours.near_duplicates(frame.where("vec_id BETWEEN 500 AND 505")).collect()
    assert len(rows) == 6 and all(r.kept and r.n_links == 0 and r.component_id == r.vec_id for r in rows)
