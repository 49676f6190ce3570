import itertools

import numpy as np
import pytest

from bandloom.functions import kernels

RNG = np.random.default_rng(11)


def matrix(n, low=0.0):
    a = RNG.uniform(low, 1, (n, n))
    a = (a + a.T) / 2
    np.fill_diagonal(a, 1.0)
    return a


def all_cuts(n, k):
    for inner in itertools.combinations(range(1, n), k - 1):
        yield [0, *inner, n]


def test_uniform_sizes():
    assert kernels.uniform_sizes(64, 10) == [7, 7, 6, 6, 6, 7, 6, 6, 7, 6]
    for k in (0, 65):
        with pytest.raises(ValueError):
            kernels.uniform_parts(64, k)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_best_cuts_by_enumeration(k):
    s = matrix(8)
    value = lambda cuts: sum(s[a:b, a:b].sum() / s[a:b].sum() for a, b in itertools.pairwise(cuts))
    best = max(all_cuts(8, k), key=value)
    assert kernels.best_cuts(s, k) == kernels.parts(best)


def test_adaptive_cuts_follow_a_step():
    v = np.concatenate((np.zeros(5), np.full(7, 9.0))) + RNG.normal(0, 0.01, 12)
    d = np.abs(v[:, None] - v[None, :])
    assert kernels.adaptive_cuts(d, 2) == [list(range(5)), list(range(5, 12))]


def test_ward_finds_groups():
    v = np.array([0, 0.1, 5, 5.1, 0.2, 9.0])
    assert kernels.ward_clusters(np.abs(v[:, None] - v[None, :]), 3) == [[0, 1, 4], [2, 3], [5]]
    with pytest.raises(ValueError):
        kernels.ward_clusters(np.zeros((4, 4)), 4)


def test_peak_cuts_cover():
    s = matrix(12)
    for k in (2, 3, 5):
        assert sorted(sum(kernels.peak_cuts(s, s, k), [])) == list(range(12))


def test_determinant_search_is_a_local_best():
    x = RNG.normal(size=(200, 8)) * np.arange(1, 9)
    cov = np.cov(x.T)
    chosen = kernels.mcd(cov, 3)
    det = lambda c: abs(np.linalg.det(cov[np.ix_(c, c)]))
    for slot, band in itertools.product(range(3), range(8)):
        if band not in chosen:
            assert det(chosen[:slot] + [band] + chosen[slot + 1 :]) <= det(chosen) * (1 + 1e-9)
    assert sorted(chosen) == [5, 6, 7]
    groups = [[0, 1, 2], [3, 4], [5, 6, 7]]
    assert kernels.mcd(cov, 3, groups) == [2, 4, 7]
    with pytest.raises(ValueError):
        kernels.mcd(cov, 3, [[0], [], [1]])


def test_self_representation_by_inverses():
    x = RNG.normal(size=(100, 7)) @ RNG.normal(size=(7, 7))
    g, var = x.T @ x, x.var(axis=0)
    chosen = [int(var.argmax())]
    while len(chosen) < 4:
        error = {j: np.trace(g) - np.trace(g[:, s] @ np.linalg.inv(g[np.ix_(s, s)]) @ g[s]) for j in range(7) if j not in chosen for s in [chosen + [j]]}
        chosen.append(min(error, key=error.get))
    assert kernels.self_representation(g, var, 4) == chosen
    groups = [[0, 1, 2], [3, 4], [5, 6]]
    picked = kernels.self_representation(g, var, 3, groups)
    assert sorted(next(i for i, s in enumerate(groups) if b in s) for b in picked) == [0, 1, 2]


def test_singular_gram_is_an_error():
    x = np.ones((5, 3))
    with pytest.raises(ValueError):
        kernels.self_representation(x.T @ x, np.array([1.0, 1.0, 1.0]), 2)


def test_mic():
    x = np.linspace(0, 1, 300)
    assert kernels.mic(x, x) == pytest.approx(1.0)
    assert kernels.mic(x, np.sin(6 * x)) > 0.9
    assert kernels.mic(x, RNG.permutation(x)) < 0.35
    assert kernels.mic(np.ones(50), x[:50]) < 1e-9


def test_ksg_of_gaussians():
    r = 0.8
    x = RNG.normal(size=1000)
    y = r * x + np.sqrt(1 - r * r) * RNG.normal(size=1000)
    assert kernels.ksg(x, y) == pytest.approx(-0.5 * np.log(1 - r * r), abs=0.08)
    assert kernels.ksg(x, RNG.normal(size=1000)) < 0.08
    assert kernels.digamma(np.array([1, 2, 5])) == pytest.approx([-0.5772156649, 0.4227843351, 1.5061176684])


@pytest.mark.parametrize("a, b, c", [(0.0, 1.0, 1.0), (0.9, 0.5, -0.5), (0.5, 0.0, 2.0)])
def test_conditional_information_of_gaussians(a, b, c):
    """x = b z + e, y = a e + c z + f: given z, only a couples them."""
    z, e, f = np.random.default_rng(4).normal(size=(3, 1000))
    got = kernels.conditional_ksg(b * z + e, a * e + c * z + f, z)
    assert got == pytest.approx(0.5 * np.log(1 + a * a), abs=0.08)


def test_conditional_information_at_the_edges():
    x, y = RNG.normal(size=(2, 400))
    assert kernels.conditional_ksg(x, y, np.zeros(400)) == pytest.approx(kernels.ksg(x, y), abs=0.08)  # nothing is given
    assert kernels.conditional_ksg(x, x + y, x) < 0.08  # all of x is given
    assert kernels.conditional_ksg(x[:3], y[:3], y[:3]) == 0.0
