"""Band selection: rankings by windows over band statistics, searches by kernels over one matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandloom.functions import kernels
from bandloom.operators.bandstats import hash_order
from bandloom.operators.pairwise import matrix_of
from bandloom.sources.sinks import temporary

RANKED = "rank int, band int"


def top_bands(scores: DataFrame, k: int) -> DataFrame:
    """``rank, band, value``: the k greatest values; of equals the first band."""
    place = Window.orderBy(F.col("value").desc(), "band")
    return scores.select(F.row_number().over(place).alias("rank"), "band", "value").where(F.col("rank") <= k)


def best_of_subsets(scores: DataFrame, subsets: DataFrame) -> DataFrame:
    """``k, subset_id, band, value``: the greatest value of each subset; of equals the first band."""
    place = Window.partitionBy("k", "subset_id").orderBy(F.col("value").desc(), "band")
    ranked = subsets.join(scores, "band").withColumn("n", F.row_number().over(place))
    return ranked.where("n = 1").select("k", "subset_id", "band", "value")


def density_peaks(distances: DataFrame, sigma: float | None = None) -> DataFrame:
    """``band, rho, delta, value``: density times distance to the nearest denser band, from distances in both orders and i = i.

    Density is the sum of exp(-d / (2 sigma^2)) over all bands, sigma^2 a thirtieth of the mean distance if not given. The
    densest band takes its greatest distance; others without a denser one take 0. Densities are summed once and written: a
    second sum of the same numbers in another order can differ in its last bit, and a band would be denser than itself.
    """
    if sigma is None:
        sigma2 = distances.agg(F.avg("value")).first()[0] / 30
    else:
        sigma2 = sigma**2
    rho = temporary(distances.groupBy("i").agg(F.sum(F.exp(-F.col("value") / (2 * sigma2))).alias("rho")))
    pairs = distances.join(rho, "i").join(rho.select(F.col("i").alias("j"), F.col("rho").alias("rho_j")), "j")
    near = pairs.groupBy("i", "rho").agg(F.min(F.when(F.col("rho_j") > F.col("rho"), F.col("value"))).alias("near"), F.max("value").alias("far"))
    top = F.row_number().over(Window.orderBy(F.col("rho").desc(), "i")) == 1
    delta = F.when(top, F.col("far")).otherwise(F.coalesce("near", F.lit(0.0)))
    return near.select(F.col("i").alias("band"), "rho", delta.alias("delta"), (F.col("rho") * delta).alias("value"))


def similarity_scores(similarity: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``band, alpha, theta, value``: mean of similarities above a threshold times dissimilarity to bands that rank higher.

    Takes similarities in both orders and i = i, whose 1 counts. The first band by mean takes the least positive
    similarity of the others; both factors are scaled to 0 .. 1.
    """
    alpha = similarity.groupBy("i").agg(F.coalesce(F.avg(F.when(F.col("value") > threshold, F.col("value"))), F.lit(0.0)).alias("alpha"))
    ranked = alpha.withColumn("place", F.row_number().over(Window.orderBy(F.col("alpha").desc(), "i")))
    other = ranked.select(F.col("i").alias("j"), F.col("place").alias("place_j"))
    phi = similarity.join(ranked, "i").join(other, "j").groupBy("i", "alpha", "place").agg(F.max(F.when(F.col("place_j") < F.col("place"), F.col("value"))).alias("phi"))
    every = Window.partitionBy()
    phi = phi.withColumn("phi", F.when(F.col("place") == 1, F.coalesce(F.min(F.when(F.col("phi") > 0, F.col("phi"))).over(every), F.lit(0.0))).otherwise(F.col("phi")))
    theta = phi.withColumn("theta", F.sqrt(F.greatest(1 - F.col("phi") * F.col("phi"), F.lit(0.0))))

    def scaled(c: str):
        low, high = F.min(c).over(every), F.max(c).over(every)
        return (F.col(c) - low) / (high - low + 1e-10)

    return theta.select(F.col("i").alias("band"), "alpha", "theta", (scaled("alpha") * scaled("theta")).alias("value"))


def uniform_sample(spark: SparkSession, bands: int, k: int) -> DataFrame:
    """``rank, band``: k bands at the middle of k equal steps; halves go to the even band."""
    step = bands / k
    ranks = spark.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))
    at = step / 2 + (F.col("rank") - 1) * ((bands - 1 - step) / max(k - 1, 1))
    return ranks.select("rank", F.rint(at).cast("int").alias("band"))


def random_of_subsets(subsets: DataFrame, seed: int = 42) -> DataFrame:
    """``k, subset_id, band``: one band of each subset, the same in each run."""
    place = Window.partitionBy("k", "subset_id").orderBy(hash_order(seed, "band"), "band")
    return subsets.withColumn("n", F.row_number().over(place)).where("n = 1").select("k", "subset_id", "band")


def first_of_subsets(ranking: DataFrame, subsets: DataFrame, n: int | None = None, strict: bool = False) -> DataFrame:
    """``pos, band, subset_id``: the ranking's first band of each subset, until n are found.

    Bands in no subset are passed over, or with ``strict`` are an error.
    """
    if strict and not ranking.join(subsets, "band", "left_anti").isEmpty():
        raise KeyError("a ranked band is in no subset")
    place = Window.partitionBy("subset_id").orderBy("pos")
    first = ranking.join(subsets.select("band", "subset_id"), "band").withColumn("n", F.row_number().over(place)).where("n = 1")
    found = first.withColumn("place", F.row_number().over(Window.orderBy("pos")))
    return (found.where(F.col("place") <= n) if n is not None else found).select("pos", "band", "subset_id")


def max_determinant(covariance: DataFrame, ks: list[int], subsets: DataFrame | None = None) -> DataFrame:
    """``k, rank, band``: bands with the greatest determinant of their covariance, by swaps."""
    return _searched(covariance, ks, subsets, lambda cov, k, groups: kernels.mcd(cov, k, groups))


def self_representation(gram: DataFrame, ks: list[int], subsets: DataFrame | None = None) -> DataFrame:
    """``k, rank, band``: bands that represent all others best, by greedy choice. The Gram matrix's diagonal starts it."""
    return _searched(gram, ks, subsets, lambda g, k, groups: kernels.self_representation(g, np.diag(g), k, groups))


def _searched(pairs: DataFrame, ks: list[int], subsets: DataFrame | None, search) -> DataFrame:
    """One group for each k, with the bands x bands pairs and the k's subsets."""
    rows = pairs.select("i", "j", "value", F.explode(F.array(*map(F.lit, ks))).alias("k")).withColumn("subset_id", F.lit(None).cast("int"))
    if subsets is not None:
        members = subsets.where(F.col("k").isin(ks)).select(F.col("band").alias("i"), F.col("band").alias("j"), F.lit(0.0).alias("value"), "k", "subset_id")
        rows = rows.unionByName(members)

    def of(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group.k.iloc[0])
        own = group[group.subset_id.notna()]
        groups = [sorted(g.i.tolist()) for _, g in own.groupby("subset_id")] if len(own) else None
        bands = search(matrix_of(group[group.subset_id.isna()]), k, groups)
        return pd.DataFrame({"k": k, "rank": range(1, len(bands) + 1), "band": bands}).astype("int32")

    return rows.groupBy("k").applyInPandas(of, "k int, rank int, band int")
