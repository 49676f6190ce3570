"""Samples of pairs against a plain sort of all pixels, and what is made of them."""

import hashlib

import numpy as np
import pytest

from bandloom.functions import kernels
from bandloom.operators import dependence, sketches

RNG = np.random.default_rng(9)


def cube(spark, n, bands=4, parts=5):
    x = RNG.normal(size=(n, bands)).cumsum(axis=1)
    rows = [(int(k), [float(v) for v in r]) for k, r in zip(RNG.permutation(10 * n)[:n], x)]
    return dict(rows), spark.createDataFrame(rows, "pixel_id long, spectrum array<double>").repartition(parts)


def chosen(ids, i, j, n):
    a, b, c = (int(hashlib.md5(f"42:{name}:{i}:{j}".encode()).hexdigest()[:7], 16) for name in "abc")
    return sorted(sorted(ids, key=lambda u: ((a * u * u + b * u + c) % sketches.PRIME, u))[:n])


@pytest.mark.parametrize("rows", [1_000_000, 40])  # all pairs in one pass, and a pass for each two
def test_samples_by_sorting(spark, monkeypatch, rows):
    monkeypatch.setattr(sketches, "ROWS", rows)
    spectra, pixels = cube(spark, 150)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 3)], "i int, j int")
    got = sketches.pair_samples(pixels, pairs, 20).collect()
    of = {(i, j): sorted(r.pixel_id for r in got if (r.i, r.j) == (i, j)) for i, j in [(0, 1), (1, 2), (0, 3)]}
    assert of == {p: chosen(spectra, *p, 20) for p in of}
    assert all(r.x == spectra[r.pixel_id][r.i] and r.y == spectra[r.pixel_id][r.j] for r in got)
    assert len(set(of[0, 1]) & set(of[1, 2])) < 12  # 2.7 are expected


def test_fewer_pixels_than_asked_and_none(spark):
    spectra, pixels = cube(spark, 7)
    pairs = spark.createDataFrame([(0, 1)], "i int, j int")
    assert sorted(r.pixel_id for r in sketches.pair_samples(pixels, pairs, 50).collect()) == sorted(spectra)
    assert sketches.pair_samples(pixels.limit(0), pairs, 50).collect() == []
    assert sketches.pair_samples(pixels, pairs.limit(0), 50).collect() == []
    with pytest.raises(ValueError):
        sketches.pair_samples(pixels, pairs, 0)


def test_coefficients_of_own_samples(spark):
    spectra, pixels = cube(spark, 120, 3)
    pairs = spark.createDataFrame([(0, 1, "p"), (1, 2, "q")], "i int, j int, name string")
    got = {r.name: r.value for r in dependence.mic(pixels, pairs, 60, independent=True).collect()}
    for name, i, j in (("p", 0, 1), ("q", 1, 2)):
        x = np.array([spectra[k] for k in chosen(spectra, i, j, 60)])
        assert got[name] == pytest.approx(kernels.mic(x[:, i], x[:, j]))
    assert all(0 <= r.value for r in dependence.nmi(pixels, pairs, 60, independent=True).collect())
