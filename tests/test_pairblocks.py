import numpy as np
import pytest

from bandloom.operators import pairblocks, pairwise

RNG = np.random.default_rng(8)
X = RNG.integers(0, 12, (700, 9)).astype(float)
UPPER = [(i, j) for i in range(9) for j in range(i + 1, 9)]


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(X)], "pixel_id long, spectrum array<double>").repartition(3)


def test_blocks_hold_every_pair_once():
    for size in (1, 4, 7, 100):
        blocks = pairblocks.blocks_of(UPPER, size)
        assert sorted(p for b in blocks for p in b) == UPPER and max(map(len, blocks)) <= size


@pytest.mark.parametrize(("slab", "counters"), [(1 << 16, 1 << 24), (10, 144 * 4)])
def test_joint_counts_of_slabs_merge(pixels, monkeypatch, slab, counters):
    monkeypatch.setattr(pairblocks, "SLAB_PIXELS", slab)
    monkeypatch.setattr(pairblocks, "COUNTERS", counters)
    weigh = np.arange(144).reshape(12, 12)
    found = pairblocks.joint_values(pixels, lambda x: x, 12, UPPER, lambda n: float((n * weigh).sum() + n.max() * 1e6))
    want = {}
    for i, j in UPPER:
        n = np.zeros((12, 12))
        np.add.at(n, (X[:, i].astype(int), X[:, j].astype(int)), 1)
        want[i, j] = (n * weigh).sum() + n.max() * 1e6
    assert {(r.i, r.j): r.value for r in found.collect()} == want


def test_functions_of_whole_bands(pixels, monkeypatch):
    """A rank correlation, which is no sum over parts of the pixels."""
    ranks = lambda v: np.searchsorted(np.sort(v), v, side="left") + np.searchsorted(np.sort(v), v, side="right")
    kernel = lambda x, y: np.corrcoef(ranks(x), ranks(y))[0, 1]
    for slab in (1 << 16, 64):
        monkeypatch.setattr(pairblocks, "SLAB_PIXELS", slab)
        got = {(r.i, r.j): r.value for r in pairwise.pairwise(pixels, kernel, single=False).collect()}
        assert got == pytest.approx({(i, j): kernel(X[:, i], X[:, j]) for i, j in UPPER})
