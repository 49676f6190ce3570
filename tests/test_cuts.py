"""Cuts and peaks by joins and windows against the numeric kernels on one matrix, and against enumeration."""

import itertools

import numpy as np
import pytest

from bandloom.functions import kernels
from bandloom.operators import cuts

RNG = np.random.default_rng(5)


def matrix(n):
    a = RNG.uniform(0, 1, (n, n))
    return (a + a.T) / 2


def table(spark, m):
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, "i int, j int, value double")


def parts_of(frame):
    got = {}
    for r in sorted(frame.collect()):
        got.setdefault(r.k, {}).setdefault(r.subset_id, []).append(r.band)
    return {k: [s[n] for n in sorted(s)] for k, s in got.items()}


def test_best_cuts_by_enumeration(spark):
    m = matrix(8)
    np.fill_diagonal(m, 1.0)
    value = lambda c: sum(m[a:b, a:b].sum() / m[a:b].sum() for a, b in itertools.pairwise(c))
    best = {k: kernels.parts(max(([0, *i, 8] for i in itertools.combinations(range(1, 8), k - 1)), key=value)) for k in (1, 2, 4, 8)}
    assert parts_of(cuts.best_cuts(table(spark, m), [1, 2, 4, 8])) == best


def test_best_cuts_of_equals_take_the_earliest_last_cut(spark):
    m = np.eye(6)  # whatever the cuts, every part scores 1
    assert parts_of(cuts.best_cuts(table(spark, m), [3])) == {3: [[0], [1], [2, 3, 4, 5]]}
    assert parts_of(cuts.best_cuts(table(spark, np.zeros((4, 4))), [2], diagonal=None)) == {2: [[0], [1, 2, 3]]}


@pytest.mark.parametrize("n", [5, 13, 24])
def test_cuts_by_kernels(spark, n):
    m = matrix(n)
    ks = [k for k in (1, 2, 3, 5, 9) if k <= n]
    distance = m * (1 - np.eye(n))
    assert parts_of(cuts.adapted_cuts(table(spark, m), ks)) == {k: kernels.adaptive_cuts(distance, k) for k in ks}
    ones = m * (1 - np.eye(n)) + np.eye(n)
    assert parts_of(cuts.best_cuts(table(spark, m), ks)) == {k: kernels.best_cuts(ones, k) for k in ks}


def test_adapted_cuts_without_distances_stay_or_take_the_first(spark):
    m = np.zeros((12, 12))
    assert parts_of(cuts.adapted_cuts(table(spark, m), [3, 6])) == {k: kernels.adaptive_cuts(m, k) for k in (3, 6)}


def test_peaks_by_kernels(spark):
    m = matrix(14)
    np.fill_diagonal(m, 1.0)
    w = RNG.normal(size=(14, 14))
    w = w + w.T
    scores = kernels.peak_scores(m)
    got = {r.band: r.value for r in cuts.peak_scores(table(spark, m)).collect()}
    assert [got[b] for b in range(14)] == pytest.approx(scores.tolist())
    for k in (1, 2, 4):
        peaks = sorted(sorted(range(14), key=lambda b: (-scores[b], b))[:k])
        found = sorted(cuts.peak_gap_cuts(table(spark, m), table(spark, w), k).collect())
        assert [r.cut for r in found] == kernels.coarse_cuts(np.abs(w), peaks)


def test_peaks_of_bands_all_alike_are_no_numbers(spark):
    m = np.ones((6, 6))
    assert all(np.isnan(r.value) for r in cuts.peak_scores(table(spark, m)).collect())
    assert [r.cut for r in sorted(cuts.peak_gap_cuts(table(spark, m), table(spark, np.zeros((6, 6))), 2).collect())] == [0, 1, 6]


def test_counts_that_do_not_fit(spark):
    m = table(spark, matrix(4))
    for k in (0, 5):
        with pytest.raises(ValueError):
            cuts.best_cuts(m, [k])
        with pytest.raises(ValueError):
            cuts.adapted_cuts(m, [k])
    with pytest.raises(ValueError):
        cuts.best_cuts(m.limit(0), [1])
