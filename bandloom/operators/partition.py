"""Subspaces: contiguous or clustered groups of bands, from bands x bands matrices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions import kernels
from bandloom.operators import cuts
from bandloom.operators.pairwise import matrix_of

SCHEMA = "k int, subset_id int, pos int, band int"


def rows_of(k: int, subsets: list[list[int]]) -> pd.DataFrame:
    rows = [(k, s, p, b) for s, bands in enumerate(subsets) for p, b in enumerate(bands)]
    return pd.DataFrame(rows, columns=["k", "subset_id", "pos", "band"]).astype("int32")


def uniform(spark: SparkSession, bands: int, ks: list[int], seed: int = 42) -> DataFrame:
    """``k, subset_id, pos, band``: contiguous parts of nearly equal size."""
    return spark.createDataFrame(pd.concat([rows_of(k, kernels.uniform_parts(bands, k, seed)) for k in ks]), SCHEMA)


def _for_each(pairs: DataFrame, ks: list[int], diagonal: float | None, cut: Callable[[np.ndarray, int], list[list[int]]]) -> DataFrame:
    """A group for each k, which gets the bands x bands pairs and cuts them."""
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows.k.iloc[0])
        return rows_of(k, cut(matrix_of(rows, diagonal), k))

    grouped = pairs.select("i", "j", "value", F.explode(F.array(*map(F.lit, ks))).alias("k")).groupBy("k")
    return grouped.applyInPandas(of, SCHEMA)


def ocf(pairs: DataFrame, ks: list[int], diagonal: float | None = 1.0) -> DataFrame:
    """Optimal contiguous parts by association within over association to all; the diagonal counts as given."""
    return cuts.best_cuts(pairs, ks, diagonal)


def asps(pairs: DataFrame, ks: list[int]) -> DataFrame:
    """Equal parts with adapted cuts, from distances."""
    return cuts.adapted_cuts(pairs, ks)


def gpc(similarity: DataFrame, weights: DataFrame, ks: list[int]) -> DataFrame:
    """Parts around the best peaks of a similarity; cuts are rated by a second matrix of weights."""
    both = similarity.select("i", "j", "value").withColumn("which", F.lit(0)).unionByName(weights.select("i", "j", "value").withColumn("which", F.lit(1)))

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows.k.iloc[0])
        return rows_of(k, kernels.peak_cuts(matrix_of(rows[rows.which == 0], 1.0), matrix_of(rows[rows.which == 1]), k))

    return both.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("k").applyInPandas(of, SCHEMA)


def coarse_cuts(similarity: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``pos, cut``: the first cuts between the k best peaks, from which ``gpc`` starts; 0 and the number of bands around them."""
    return cuts.peak_gap_cuts(similarity, weights, k)


def walumi(pairs: DataFrame, ks: list[int]) -> DataFrame:
    """Clusters by Ward linkage of an information distance; not contiguous, by their first band."""
    return _for_each(pairs, ks, 0.0, kernels.ward_clusters)
