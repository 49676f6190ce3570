import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import evaluate


def tail(t, df, steps=200_001):
    """Two-sided p by integration over the angle, in which the density is a power of the cosine."""
    angle = np.linspace(0, math.pi / 2, steps)
    density = np.cos(angle) ** (df - 1)
    trapezoid = lambda a, d: float(((d[1:] + d[:-1]) / 2 * np.diff(a)).sum())
    part = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, steps)
    return trapezoid(part, np.cos(part) ** (df - 1)) / trapezoid(angle, density)


def test_p_values_of_any_degree(spark):
    cases = [(t, df) for df in [*range(1, 31), 99] for t in (0.0, 0.7, -2.776, 4.5)]
    row = spark.range(1).select(*(evaluate.p_value(F.lit(t), df).alias(f"p{k}") for k, (t, df) in enumerate(cases))).first()
    assert list(row) == pytest.approx([tail(*c) for c in cases], abs=1e-7)
    with pytest.raises(ValueError):
        evaluate.p_value(F.lit(1.0), 0)


def test_even_degrees_in_paired_tests(spark):
    raw = [(r, m, 5, 0.5 + d) for r, e in enumerate([0.01, 0.03, 0.02, 0.05, 0.04]) for m, d in (("a", 0.0), ("b", e))]
    table = spark.createDataFrame(raw, "run_id int, method string, n_selected_bands int, test_accuracy double")
    base = spark.createDataFrame([("b", "a")], "method string, baseline string")
    got = {r.method: r for r in evaluate.paired_tests(table, base, runs=5).collect()}
    d = np.array([0.01, 0.03, 0.02, 0.05, 0.04])
    t = d.mean() / (d.std(ddof=1) / math.sqrt(5))
    assert got["b"].p_value_vs_baseline == pytest.approx(tail(t, 4), abs=1e-6) and got["b"].significance_mark == "*"
    assert {r.p_value_vs_baseline for r in evaluate.paired_tests(table, base, runs=1).collect()} == {None}


def objective(w, z, t):
    return w @ w / 2 + evaluate.COST * (np.maximum(0, 1 - t * (z @ w)) ** 2).sum()


def solved(z, t):
    """Plain gradient steps with halving, a solver of its own."""
    w, step = np.zeros(z.shape[1]), 1.0
    for _ in range(20_000):
        miss = np.maximum(0, 1 - t * (z @ w))
        g = w - 2 * evaluate.COST * z.T @ (t * miss)
        if np.abs(g).max() < 1e-9:
            break
        while objective(w - step * g, z, t) > objective(w, z, t) - step / 2 * g @ g:
            step /= 2
        w, step = w - step * g, step * 1.5
    return w


@pytest.mark.parametrize("seed", range(6))
def test_line_search_reaches_the_optimum(seed):
    rng = np.random.default_rng(seed)
    z = np.concatenate((rng.normal(size=(60, 4)) * 10.0 ** rng.integers(-1, 2, 4), np.ones((60, 1))), axis=1)
    t = np.where(rng.random(60) < 0.3 + 0.4 * (z[:, 0] > 0), 1.0, -1.0)
    model = evaluate._Model(5)
    losses = []
    while not model.done:
        w = model.asked
        near = t * (z @ w) < 1
        miss = z[near] @ w - t[near]
        model.told(objective(w, z, t), w + 2 * evaluate.COST * z[near].T @ miss, np.eye(5) + 2 * evaluate.COST * z[near].T @ z[near])
        losses.append(model.loss)
    assert model.message is None and losses == sorted(losses, reverse=True)
    assert objective(model.w, z, t) == pytest.approx(objective(solved(z, t), z, t), rel=1e-6)


def test_a_failed_selection_leaves_the_others(spark):
    rng = np.random.default_rng(0)
    labels = np.arange(90) % 3 + 1
    x = np.concatenate((np.eye(3)[labels - 1] + rng.normal(0, 0.05, (90, 3)), np.full((90, 1), np.nan)), axis=1)
    pixels = spark.createDataFrame([(k, int(y), [float(v) for v in r]) for k, (y, r) in enumerate(zip(labels, x))], "pixel_id long, label int, spectrum array<double>")
    chosen = spark.createDataFrame([("good", 3, k, k) for k in range(3)] + [("bad", 2, 0, 0), ("bad", 2, 1, 3)], "method string, k int, rank int, band int")
    rows = evaluate.svm_evaluation(pixels, chosen, runs=2)
    got = {(r.method, r.run_id): r for r in rows.collect()}
    assert all(got["good", r].test_accuracy == 1.0 and got["good", r].message is None for r in range(2))
    assert all(got["bad", r].test_accuracy is None and "not finite" in got["bad", r].message for r in range(2))
    base = spark.createDataFrame([], "method string, baseline string")
    assert [r.method for r in evaluate.evaluation(rows, base, runs=2).collect()] == ["good"]


def test_accuracies_by_brute_force(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 4, 160)  # 0 is background
    x = np.eye(4)[labels] @ rng.normal(size=(4, 5)) + rng.normal(0, 0.7, (160, 5))
    pixels = spark.createDataFrame([(k, int(y), [float(v) for v in r]) for k, (y, r) in enumerate(zip(labels, x))], "pixel_id long, label int, spectrum array<double>").repartition(3)
    bands = {"a": [0, 3], "b": [4, 1, 2]}
    chosen = spark.createDataFrame([(m, len(b), n, v) for m, b in bands.items() for n, v in enumerate(b)], "method string, k int, rank int, band int")
    got = {(r.method, r.run_id): r for r in evaluate.svm_evaluation(pixels, chosen, runs=3).collect()}
    assert len(got) == 6
    split = evaluate.stratified_split(pixels.where("label <> 0"), 3).collect()
    for (method, run), row in got.items():
        own = [r for r in split if r.run_id == run]
        learn, test = ([r.pixel_id for r in own if r.test == flag] for flag in (False, True))
        z = np.concatenate((x[:, bands[method]], np.ones((160, 1))), axis=1)
        scores = np.stack([z[test] @ solved(z[learn], np.where(labels[learn] == c, 1.0, -1.0)) for c in (1, 2, 3)], axis=1)
        assert row.test_accuracy == pytest.approx((scores.argmax(axis=1) + 1 == labels[test]).mean())
        assert row.message is None and row.selected_band_idx == bands[method] and row.n_selected_bands == len(bands[method])


def test_models_keep_their_own_state(spark):
    """Of a batch, models that are done wait unchanged for those that need more steps, and one without pixels says so."""
    state = "r int, s int, c int, k int, v double"
    zero = [0.0, 0.0]
    rows = [(0, 0, 0, zero, zero, math.inf, zero, 0.0, 1.0, 0, False, None), (0, 0, 1, [1.0, 2.0], zero, 0.5, zero, 0.0, 1.0, 7, True, None), (1, 0, 0, zero, zero, math.inf, zero, 0.0, 1.0, 0, False, None)]
    models = spark.createDataFrame(rows, evaluate.STATE)
    sums = spark.createDataFrame([(0, 0, 0, k, v) for k, v in enumerate([3.0, -2.0, 4.0, 1.0, 0.0, 0.0, 3.0])], state)
    got = {(m.r, m.c): m for m in evaluate._stepped(models, sums, [1, 2]).collect()}
    first = got[0, 0]
    assert first.rounds == 1 and not first.done and first.loss == 3.0 and first.step == [-1.0, 1.0] and first.asked == [1.0, -1.0]
    assert got[0, 1] == models.where("c = 1").first()
    assert got[1, 0].done and got[1, 0].message == "class 1: no pixel to learn from"
