"""Statistics of each band, and what they are used for: scaling, outliers, binning, sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.binning import EPS, entropy, equal_width_bin, quantile_bin
from bandloom.operators.quantiles import quantile_edges
from bandloom.sources.cubes import band_count


def variances(cells: DataFrame) -> DataFrame:
    """``band, value``: population variance."""
    return cells.groupBy("band").agg(F.var_pop("v").alias("value"))


def moments(cells: DataFrame) -> DataFrame:
    """``band, n, mean, std, lo, hi``; std is the population's."""
    return cells.groupBy("band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def standardized(cells: DataFrame) -> DataFrame:
    """Cells with mean 0 and deviation 1 in each band; a constant band is centred only. Statistics are a row for each band, so the join's small side doesn't grow with the pixels."""
    stats = moments(cells).select("band", "mean", "std")
    scale = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return cells.join(stats, "band").withColumn("v", (F.col("v") - F.col("mean")) / scale).select(cells.columns)


def without_outliers(cells: DataFrame, limit: float = 3.0) -> DataFrame:
    """Values of more than ``limit`` deviations from their band's mean become that mean."""
    stats = moments(cells).select("band", "mean", "std")
    far = F.abs(F.col("v") - F.col("mean")) > limit * F.col("std")
    return cells.join(stats, "band").withColumn("v", F.when(far, F.col("mean")).otherwise(F.col("v"))).select(cells.columns)


def _means(pixels: DataFrame) -> tuple[Column, Column]:
    """Means and deviations of the bands, as literal arrays."""
    stats = moments(pixels.select(F.posexplode("spectrum").alias("band", "v"))).orderBy("band").collect()
    mean, std = (F.array(*(F.lit(r[c]) for r in stats)) for c in ("mean", "std"))
    return mean, std


def standardized_spectra(pixels: DataFrame) -> DataFrame:
    """``standardized`` for pixels: each spectrum is changed where it is, without a shuffle of pixels."""
    mean, std = _means(pixels)
    scaled = F.transform("spectrum", lambda v, i: (v - F.get(mean, i)) / F.coalesce(F.nullif(F.get(std, i), F.lit(0.0)), F.lit(1.0)))
    return pixels.withColumn("spectrum", scaled)


def spectra_without_outliers(pixels: DataFrame, limit: float = 3.0) -> DataFrame:
    """``without_outliers`` for pixels: each spectrum is changed where it is, by one row of moments a band on the driver."""
    mean, std = _means(pixels)
    near = F.transform("spectrum", lambda v, i: F.when(F.abs(v - F.get(mean, i)) > limit * F.get(std, i), F.get(mean, i)).otherwise(v))
    return pixels.withColumn("spectrum", near)


def histogram(cells: DataFrame, bins: int = 256) -> DataFrame:
    """``band, bin, n, total`` of equal-width bins over each band's range; only bins with a value."""
    stats = moments(cells).select("band", "lo", "hi", F.col("n").alias("total"))
    binned = cells.join(stats, "band").withColumn("bin", equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins))
    return binned.groupBy("band", "bin", "total").agg(F.count("*").alias("n")).select("band", "bin", "n", "total")


def entropies(cells: DataFrame, bins: int = 256, base2: bool = False) -> DataFrame:
    """``band, value``: entropy of the histogram, in nats (or bits)."""
    return histogram(cells, bins).groupBy("band").agg(entropy(F.col("n"), F.col("total"), base2).alias("value"))


def probabilities(cells: DataFrame, bins: int = 256) -> DataFrame:
    """``band, bin, p`` for all bins, EPS added to each and normalized."""
    found = histogram(cells, bins)
    every = found.select("band", "total").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    p = (F.coalesce(F.col("n"), F.lit(0)).cast("double") / F.col("total") + EPS) / (1 + bins * EPS)
    return every.join(found.select("band", "bin", "n"), ["band", "bin"], "left").select("band", "bin", p.alias("p"))


def binned(cells: DataFrame, bins: int, method: str = "quantile") -> DataFrame:
    """Cells with ``bin`` by quantiles or by equal width; another method is an error."""
    if method == "quantile":
        return cells.join(quantile_edges(cells, bins), "band", "left").withColumn("bin", quantile_bin(F.col("v"), F.col("edges"))).drop("edges")
    if method == "equal":
        stats = moments(cells).select("band", "lo", "hi")
        return cells.join(stats, "band").withColumn("bin", equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins)).drop("lo", "hi")
    raise ValueError(f"unknown bin method {method!r}")


def summary(values: DataFrame) -> DataFrame:
    """Mean, median, population deviation, min and max of ``value`` in one row."""
    v = "value"
    return values.agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def stationarity(values: DataFrame) -> DataFrame:
    """1 - deviation / mean of ``value``; null for a mean of zero."""
    return values.agg((1 - F.try_divide(F.stddev_pop("value"), F.avg("value"))).alias("value"))


def hash_order(seed: int, *cols: str):
    """A column to order by for sampling that every run and engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def sampled_pixels(pixels: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """n pixels without replacement (all, if there are fewer), the same for every band."""
    return pixels.withColumn("_order", hash_order(seed, "pixel_id")).orderBy("_order", "pixel_id").limit(n).drop("_order")


def sampled_pairs(pairs: DataFrame, n: int, seed: int = 42, within: list[str] | None = None) -> DataFrame:
    """At most n pairs ``i, j`` without replacement, for each group of ``within``."""
    place = Window.partitionBy(*(within or [])).orderBy(hash_order(seed, "i", "j"), "i", "j")
    return pairs.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).drop("_n")


def permuted(cells: DataFrame, seed: int = 42) -> DataFrame:
    """Cells with their bands relabelled at random, the null model of adjacency."""
    bands = cells.select("band").distinct()
    place = F.row_number().over(Window.orderBy(hash_order(seed, "band"), "band")) - 1
    return cells.join(bands.withColumn("to", place), "band").withColumn("band", F.col("to")).select(cells.columns)


def permuted_spectra(pixels: DataFrame, seed: int = 42) -> DataFrame:
    """As ``permuted``, with the values of each spectrum put in that order in place, so no cell moves."""
    order = sorted(range(band_count(pixels)), key=lambda b: (hashlib.md5(f"{seed}:{b}".encode()).hexdigest(), b))
    return pixels.withColumn("spectrum", F.transform(F.array(*map(F.lit, order)), lambda b: F.get("spectrum", b)))
