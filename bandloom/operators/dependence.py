"""Nonlinear dependence of band pairs on a bounded sample of pixels, and the index made of it.

The sample (1000 pixels unless said otherwise) is the same for all pairs, or each pair's own where that is asked for. The former is the only thing broadcast, and its size is
fixed by its parameter and the number of bands; pairs are dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.functions import kernels
from bandloom.operators.bandstats import sampled_pairs, sampled_pixels
from bandloom.operators.pairwise import pair_domain
from bandloom.operators.sketches import pair_samples
from bandloom.sources.cubes import band_count
from bandloom.sources.sinks import temporary

SAMPLE = 1000
#: Values that a sample may hold, to be broadcast.
MAX_VALUES = 4_000_000


def _sample(pixels: DataFrame, n: int) -> np.ndarray:
    bands = band_count(pixels)
    if n * bands > MAX_VALUES:
        raise ValueError(f"a sample of {n} pixels with {bands} bands is too large to broadcast")
    rows = sampled_pixels(pixels.select("pixel_id", "spectrum"), n).orderBy("pixel_id").collect()
    return np.array([r.spectrum for r in rows]).reshape(len(rows), -1)


def _for_pairs(pixels: DataFrame, pairs: DataFrame, kernel: Callable[[np.ndarray, int, int], float], n: int) -> DataFrame:
    spark = pixels.sparkSession
    sample = spark.sparkContext.broadcast(_sample(pixels, n))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(value=[kernel(sample.value, i, j) for i, j in zip(rows.i, rows.j)])

    schema = ", ".join(f"{name} {kind}" for name, kind in pairs.dtypes) + ", value double"
    return pairs.repartition(spark.sparkContext.defaultParallelism * 2, "i", "j").mapInPandas(of, schema)


def _for_own_samples(pixels: DataFrame, pairs: DataFrame, kernel: Callable[[np.ndarray, int, int], float], n: int) -> DataFrame:
    """As ``_for_pairs``, with a sample for each pair that doesn't depend on those of the others; a task gets one of n rows."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pixel_id")
        return pd.DataFrame({"i": rows.i.iloc[:1], "j": rows.j.iloc[:1], "value": kernel(rows[["x", "y"]].to_numpy(), 0, 1)})

    found = pair_samples(pixels, pairs, n).groupBy("i", "j").applyInPandas(of, "i int, j int, value double")
    return pairs.join(found, ["i", "j"]).select(*pairs.columns, "value")


def mic(pixels: DataFrame, pairs: DataFrame, n: int = SAMPLE, independent: bool = False) -> DataFrame:
    """The pairs with ``value``, their maximal information coefficient; with ``independent``, each from a sample of its own."""
    of = _for_own_samples if independent else _for_pairs
    return of(pixels, pairs, lambda x, i, j: kernels.mic(x[:, i], x[:, j]), n)


def mic_adjacent(pixels: DataFrame, n: int = SAMPLE) -> DataFrame:
    return mic(pixels, pair_domain(pixels.sparkSession, band_count(pixels), "adjacent"), n)


def mic_nonadjacent(pixels: DataFrame, max_pairs: int = 1000, n: int = SAMPLE) -> DataFrame:
    """A sample of the pairs that are five or more bands apart."""
    pairs = pair_domain(pixels.sparkSession, band_count(pixels), "nonadjacent")
    return mic(pixels, sampled_pairs(pairs, max_pairs), n)


def mic_by_lag(pixels: DataFrame, max_lag: int = 50, max_pairs: int = 500, n: int = SAMPLE) -> DataFrame:
    """``lag, value``: mean coefficient of at most max_pairs pairs for each lag; lags from 1 to bands - 1."""
    bands = band_count(pixels)
    if not 1 <= max_lag <= bands - 1:
        raise ValueError(f"lags go from 1 to {bands - 1}, not to {max_lag}")
    pairs = pair_domain(pixels.sparkSession, bands, "upper").withColumn("lag", F.col("j") - F.col("i")).where(F.col("lag") <= max_lag)
    return mic(pixels, sampled_pairs(pairs, max_pairs, within=["lag"]), n).groupBy("lag").agg(F.avg("value").alias("value"))


def nmi(pixels: DataFrame, pairs: DataFrame, n: int = SAMPLE, independent: bool = False) -> DataFrame:
    """The pairs with ``value``: 2 I(x;y) / (I(x;x) + I(y;y)) by nearest neighbours, 0 if that is undefined.

    With ``independent``, each pair has a sample of its own.
    """

    def kernel(x: np.ndarray, i: int, j: int) -> float:
        own = kernels.ksg(x[:, i], x[:, i]) + kernels.ksg(x[:, j], x[:, j])
        return 2 * kernels.ksg(x[:, i], x[:, j]) / own if own else 0.0

    return (_for_own_samples if independent else _for_pairs)(pixels, pairs, kernel, n)


def conditional_nmi(pixels: DataFrame, pairs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The pairs with ``value``, given the left neighbour z of band i: max(I(x;y) - I(z;y), 0), normalized alike."""
    return _for_pairs(pixels, pairs.where("i > 0"), _conditional, n)


def _conditional(x: np.ndarray, i: int, j: int) -> float:
    z = x[:, i - 1]
    ixy, izx, izy = kernels.ksg(x[:, i], x[:, j]), kernels.ksg(z, x[:, i]), kernels.ksg(z, x[:, j])
    hx, hy = kernels.ksg(x[:, i], x[:, i]), kernels.ksg(x[:, j], x[:, j])
    return 2 * max(ixy - izy, 0.0) / (max(hx - izx, 0.0) + max(hy - izy, 0.0) + 1e-8)


def joint_conditional(pixels: DataFrame, pairs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The pairs with ``value``, the information in nats of bands i and j given the left neighbour of i, estimated in all three
    bands together; ``conditional_nmi`` is made of pairs' information instead. Band 0 has no left neighbour, and a pair whose j is
    that neighbour nothing left to tell: such pairs are left out."""
    return _for_pairs(pixels, pairs.where("i > 0 AND j <> i - 1"), lambda x, i, j: kernels.conditional_ksg(x[:, i], x[:, j], x[:, i - 1]), n)


def conditional_independence(pixels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """``band, value`` of the inner bands: 1 - mean conditional NMI / mean NMI with all bands two or more away, in 0 .. 1.

    Every pair's information is estimated once, in a table of bands^2 rows from which both terms are made.
    """
    bands = band_count(pixels)
    spark = pixels.sparkSession
    pairs = pair_domain(spark, bands, "apart").where((F.col("i") > 0) & (F.col("i") < bands - 1))
    found = _for_pairs(pixels, pair_domain(spark, bands, "every"), lambda x, i, j: kernels.ksg(x[:, i], x[:, j]), n)
    info = temporary(found.select(F.col("i").alias("a"), F.col("j").alias("b"), "value"), "information")
    i, j = F.col("i"), F.col("j")
    for name, a, b in (("xy", i, j), ("xx", i, i), ("yy", j, j), ("zx", i - 1, i), ("zy", i - 1, j)):
        pairs = pairs.withColumns({"a": a, "b": b}).join(info.withColumnRenamed("value", name), ["a", "b"]).drop("a", "b")
    xy, xx, yy, zx, zy = map(F.col, ("xy", "xx", "yy", "zx", "zy"))
    zero = F.lit(0.0)
    both = pairs.select(
        "i",
        (2 * F.greatest(xy - zy, zero) / (F.greatest(xx - zx, zero) + F.greatest(yy - zy, zero) + 1e-8)).alias("given"),
        F.when(xx + yy == 0, 0.0).otherwise(F.try_divide(2 * xy, xx + yy)).alias("value"),
    )
    means = both.groupBy("i").agg(F.avg("given").alias("given"), F.avg("value").alias("free"))
    ratio = F.when(F.col("free") == 0, 1.0).otherwise(F.greatest(F.least(F.try_divide("given", "free"), F.lit(1.0)), F.lit(0.0)))
    return means.select(F.col("i").alias("band"), (1 - ratio).alias("value"))


def contrast(adjacent: DataFrame, apart: DataFrame) -> DataFrame:
    """``value``: 1 - exp(-difference of means^2 / (sum of sample variances + 1e-8)), in 0 .. 1; 0 without pairs apart."""
    a = adjacent.agg(F.avg("value").alias("ma"), F.var_samp("value").alias("va"))
    b = apart.agg(F.avg("value").alias("mb"), F.var_samp("value").alias("vb"))
    gap = F.pow(F.col("ma") - F.col("mb"), 2) / (F.coalesce("va", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0)) + 1e-8)
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")
    return one.select(F.coalesce(F.greatest(F.least(1 - F.exp(-gap), F.lit(1.0)), F.lit(0.0)), F.lit(0.0)).alias("value"))


def spectral_index(acc: DataFrame, cis: DataFrame) -> DataFrame:
    """``acc, cis, smi``: the square root of contrast times mean conditional independence."""
    mean = cis.agg(F.greatest(F.avg("value"), F.lit(0.0)).alias("cis")).withColumn("k", F.lit(1))
    one = acc.select(F.col("value").alias("acc"), F.lit(1).alias("k")).join(mean, "k")
    return one.select("acc", "cis", F.sqrt(F.col("acc") * F.col("cis")).alias("smi"))
