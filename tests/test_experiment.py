import numpy as np
import pytest

from bandloom.plans import experiment, registry
from bandloom.sources import cubes

from .test_evaluate import tail

SF = "/root/testdata/sf0.001"


def test_grid_has_all_methods(spark):
    rows = registry.QUERIES["selection_grid"](spark, SF).collect()
    assert {r.method for r in rows} == set(experiment.METHODS) and len(experiment.METHODS) == 32
    for r in rows:
        if r.error is None:
            assert 0 <= r.band < 64
    for key in {(r.method, r.k) for r in rows if r.error is None}:
        bands = [r.band for r in rows if (r.method, r.k) == key]
        assert len(set(bands)) == key[1]
    assert sum(r.error is not None for r in rows) < 30


def test_grid_has_all_numbers_of_bands(spark):
    rows = registry.QUERIES["selection_grid"](spark, SF).select("method", "k").distinct().collect()
    assert {(r.method, r.k) for r in rows} == {(m, k) for m in experiment.METHODS for k in (5, 10, 15, 20, 25, 30)}


def test_small_run(spark, tmp_path):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 180)
    x = rng.normal(0, 20, (180, 12)).cumsum(axis=1) + 300 + 40 * labels[:, None] * (np.arange(12) == 6)
    rows = [(i, i // 15, i % 15, int(labels[i]), [float(round(v)) for v in x[i]]) for i in range(180)]
    pixels = spark.createDataFrame(rows, "pixel_id long, row int, col int, label int, spectrum array<double>")
    config = experiment.Config(ks=(3,), samples=60, pairs=10, lag_pairs=2, max_lag=5, entropy_bins=8, runs=10)
    summary = experiment.run(pixels, str(tmp_path), config).collect()
    assert len(summary) >= 25 and all(0 <= r.mean_test_accuracy <= 1 for r in summary)
    raw = {}
    for r in spark.read.parquet(f"{tmp_path}/raw").collect():
        raw.setdefault(r.method, {})[r.run_id] = r.test_accuracy
    for r in summary:
        own = np.array([raw[r.method][k] for k in sorted(raw[r.method])])
        assert len(own) == 10 and r.mean_test_accuracy == pytest.approx(own.mean()) and r.std_test_accuracy == pytest.approx(own.std(ddof=1))
        base = raw.get(r.method.partition("_")[0], {}) if r.method not in experiment.BASELINES else {}
        d = own - np.array([base[k] for k in sorted(base)]) if base and "_" in r.method else np.zeros(2)
        if d.std(ddof=1) > 1e-9:
            assert r.p_value_vs_baseline == pytest.approx(tail(d.mean() / (d.std(ddof=1) / 10**0.5), 9), abs=1e-6)
        else:
            assert r.p_value_vs_baseline is None
    again = experiment.run(pixels, str(tmp_path), config).collect()
    assert [r.mean_test_accuracy for r in again] == [r.mean_test_accuracy for r in summary]
    catalog = experiment.Catalog(pixels, f"{tmp_path}/statistics", config)
    assert set(catalog.makers) >= {"ssim", "ssim_win3", "sr_eta", "rbf_kernel", "mic_vs_bandinterval_shuffled", "r2_array_shuffled", "cis_shuffled"}
    index = catalog.index().first()
    assert 0 <= index.smi <= 1 and catalog["entropy"].count() == 12 and catalog["adj_entropy"].count() == 11
    assert cubes.band_count(pixels) == 12
