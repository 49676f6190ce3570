"""The whole experiment over a cube: cached statistics, the grid of selections, and their evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.functions import kernels
from bandloom.operators import bandstats, dependence, evaluate, pairwise, select, spatial
from bandloom.sources import cubes, sinks

FAMILIES = ("mvpca", "eca", "mcd", "sefrep", "simrnk")
STRATEGIES = ("smi", "ocf", "asps", "gpc", "walumi")
BASELINES = ("unisam", "uni_random")
METHODS = tuple(m for f in FAMILIES for m in (f, *(f"{f}_{s}" for s in STRATEGIES))) + BASELINES


@dataclass(frozen=True)
class Config:
    """Parameters of an experiment."""

    ks: tuple[int, ...] = (5, 10, 15, 20, 25, 30)
    samples: int = 1000
    pairs: int = 1000
    lag_pairs: int = 500
    max_lag: int = 50
    entropy_bins: int = 1024
    similarity_threshold: float = 0.8
    level: float = 255.0
    runs: int = 10
    test_share: float = 0.2
    seed: int = 42


def statistics(pixels: DataFrame, config: Config = Config()) -> dict[str, Callable[[], DataFrame]]:
    """How to make each statistic of a cube, by name. Matrices are ``i, j, value``; vectors ``band, value``."""
    long = cubes.cells(pixels)
    standard = lambda: bandstats.standardized(long)

    shuffled = lambda: bandstats.permuted_spectra(pixels, config.seed)
    span = lambda: pixels.agg(F.max(F.array_max("spectrum")) - F.min(F.array_min("spectrum"))).first()[0]
    made: dict[str, Callable[[], DataFrame]] = {
        "ssim": lambda: spatial.mssim(pixels, level=config.level),
        "ssim_win3": lambda: spatial.ssim(pixels, span()),
        "variances": lambda: bandstats.variances(long),
        "entropy": lambda: bandstats.entropies(standard()),
        "distance_matrix": lambda: pairwise.distances(pixels),
        "covariance_matrix": lambda: pairwise.covariance(pixels),
        "correlation_matrix": lambda: pairwise.gram(pixels),
        "corrcoef_matrix": lambda: pairwise.abs_correlation(pixels),
        "mutual_info_distance": lambda: pairwise.information_distance(pixels),
        "adj_entropy": lambda: pairwise.adjacent_conditional_entropy(pixels, config.entropy_bins),
        "r2_array": lambda: pairwise.neighbour_fit(pixels),
        "r2_array_shuffled": lambda: pairwise.neighbour_fit(shuffled()),
    }
    for suffix, source in (("", lambda: pixels), ("_shuffled", shuffled)):
        made |= {
            f"mic_adj{suffix}": lambda s=source: dependence.mic_adjacent(s(), config.samples),
            f"mic_unadj{suffix}": lambda s=source: dependence.mic_nonadjacent(s(), config.pairs, config.samples),
            f"mic_vs_bandinterval{suffix}": lambda s=source: dependence.mic_by_lag(s(), config.max_lag, config.lag_pairs, config.samples),
            f"cis{suffix}": lambda s=source: dependence.conditional_independence(s(), config.samples),
        }
    return made


class Catalog:
    """Statistics of a cube under a path; each is made and written at its first use."""

    def __init__(self, pixels: DataFrame, path: str, config: Config = Config()):
        self.spark, self.path, self.config, self.makers = pixels.sparkSession, path, config, statistics(pixels, config)
        self.makers["rbf_kernel"] = lambda: pairwise.rbf(self["distance_matrix"])
        self.makers["sr_eta"] = lambda: select.similarity_scores(pairwise.mirrored(self["ssim"], 1.0), config.similarity_threshold).select("band", "value")

    def __getitem__(self, name: str) -> DataFrame:
        return sinks.cached(self.spark, f"{self.path}/{name}", self.makers[name])

    def matrix(self, name: str, diagonal: float | None = None) -> np.ndarray:
        return pairwise.to_matrix(self[name], diagonal)

    def vector(self, name: str) -> np.ndarray:
        rows = self[name].select("band", "value").orderBy("band").collect()
        return np.array([r.value for r in rows])

    def index(self, suffix: str = "") -> DataFrame:
        """``acc, cis, smi`` of the cube or, with ``_shuffled``, of its null model."""
        return dependence.spectral_index(dependence.contrast(self[f"mic_adj{suffix}"], self[f"mic_unadj{suffix}"]), self[f"cis{suffix}"])


def selection_grid(catalog: Catalog, ks: tuple[int, ...] | None = None) -> DataFrame:
    """``method, k, rank, band, error`` for every method of METHODS and every k.

    A task works on one method and k with bands x bands matrices, whose size doesn't depend on the pixels. What fails
    gives one row with its message, and the rest goes on.
    """
    spark = catalog.spark
    peaks = select.density_peaks(pairwise.mirrored(catalog["distance_matrix"], 0.0))
    eca = {r.band: r.value for r in peaks.collect()}
    held = spark.sparkContext.broadcast(
        {
            "mvpca": catalog.vector("variances"),
            "eca": np.array([eca[b] for b in sorted(eca)]),
            "simrnk": catalog.vector("sr_eta"),
            "cov": catalog.matrix("covariance_matrix"),
            "gram": catalog.matrix("correlation_matrix"),
            "rbf": catalog.matrix("rbf_kernel", 1.0),
            "distance": catalog.matrix("distance_matrix", 0.0),
            "ssim3": catalog.matrix("ssim_win3", 1.0),
            "information": catalog.matrix("mutual_info_distance", 0.0),
        }
    )
    rows = [(m, k) for m in METHODS for k in ks or catalog.config.ks]
    grid = spark.createDataFrame(rows, "method string, k int").repartition(len(rows), "method", "k")
    spread = {k: [r.band for r in select.uniform_sample(spark, len(held.value["mvpca"]), k).orderBy("rank").collect()] for k in ks or catalog.config.ks}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for method, k in zip(batch.method, batch.k):
                try:
                    bands, error = (spread[k] if method == "unisam" else _selected(held.value, method, int(k))), None
                except (ValueError, np.linalg.LinAlgError) as e:
                    bands, error = [], str(e)
                found = [(method, k, n + 1, b, None) for n, b in enumerate(bands)] or [(method, k, None, None, error)]
                yield pd.DataFrame(found, columns=["method", "k", "rank", "band", "error"]).astype({"rank": "Int32", "band": "Int32"})

    return grid.mapInPandas(of, "method string, k int, rank int, band int, error string")


def _subsets(m: dict[str, np.ndarray], strategy: str, k: int) -> list[list[int]]:
    if strategy == "ocf":
        return kernels.best_cuts(m["rbf"], k)
    if strategy == "asps":
        return kernels.adaptive_cuts(m["distance"], k)
    if strategy == "gpc":
        return kernels.peak_cuts(m["ssim3"], m["gram"], k)
    if strategy == "walumi":
        return kernels.ward_clusters(m["information"], k)
    return kernels.uniform_parts(len(m["cov"]), k)


def _selected(m: dict[str, np.ndarray], method: str, k: int) -> list[int]:
    family, _, strategy = method.partition("_")
    if method == "uni_random":
        return [min(s, key=lambda b: (hashlib.md5(f"42:{b}".encode()).hexdigest(), b)) for s in _subsets(m, "smi", k)]
    subsets = [s for s in _subsets(m, strategy, k) if s] if strategy else None
    if subsets is not None and len(subsets) != k:
        raise ValueError(f"{strategy} gives {len(subsets)} subspaces for {k}")
    if family == "mcd":
        return kernels.mcd(m["cov"], k, subsets)
    if family == "sefrep":
        return kernels.self_representation(m["gram"], m["mvpca"], k, subsets)
    score = m[family]
    if subsets is not None:
        return [min(s, key=lambda b: (-score[b], b)) for s in subsets]
    top = sorted(range(len(score)), key=lambda b: (-score[b], b))[:k]
    return top[::-1] if family == "mvpca" else top  # variances rank upwards


def baselines(spark) -> DataFrame:
    """``method, baseline``: what each method is held against, its family without subspaces."""
    return spark.createDataFrame([(m, m.partition("_")[0]) for m in METHODS if "_" in m and m not in BASELINES], "method string, baseline string")


def run(pixels: DataFrame, path: str, config: Config = Config()) -> DataFrame:
    """Statistics, selections, classification and tests of a cube, all kept under ``path``; returns the summary."""
    catalog = Catalog(pixels, f"{path}/statistics", config)
    chosen = sinks.cached(catalog.spark, f"{path}/selections", lambda: selection_grid(catalog))
    picked = chosen.where("error IS NULL").select("method", "k", "rank", "band")
    spectra = bandstats.standardized_spectra(pixels).select("pixel_id", "label", "spectrum")
    raw = sinks.cached(catalog.spark, f"{path}/raw", lambda: evaluate.svm_evaluation(sinks.temporary(spectra), picked, config.runs, config.test_share, config.seed))
    sinks.write_csv(raw, f"{path}/raw_csv")
    summary = evaluate.evaluation(raw, baselines(catalog.spark), config.runs)
    sinks.write_csv(summary, f"{path}/summary_csv")
    return summary
