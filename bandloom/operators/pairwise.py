"""Band-pair statistics.

Second-order statistics are sums over pixels. Each task adds up the pairs of its own pixels with numpy, so that what is
shuffled is one bands x bands triangle for each task, whatever the number of pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions.binning import EPS
from bandloom.operators import bandstats, pairblocks
from bandloom.sources.cubes import band_count

#: Pixels that a kernel sees at a time.
BATCH = 4096


def pair_domain(spark: SparkSession, bands: int, shape: str, lag: int = 1) -> DataFrame:
    """``i, j``: upper (i < j), adjacent (j = i + 1), lag (j = i + lag), nonadjacent (j >= i + 5), apart (|j - i| >= 2, both ways) or every."""
    i, j = F.col("i"), F.col("j")
    shapes = {"upper": i < j, "adjacent": j == i + 1, "lag": j == i + lag, "nonadjacent": j >= i + 5, "apart": F.abs(i - j) >= 2, "every": F.lit(True)}
    if shape not in shapes:
        raise ValueError(f"unknown pair domain {shape!r}")
    ones = spark.range(bands).select(F.col("id").cast("int").alias("i"))
    every = ones.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))) if bands else ones.withColumn("j", F.lit(0))
    return every.where(shapes[shape])


def _spectra(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    lists = batch.column(0)
    for at in range(0, len(lists), BATCH):
        part = lists.slice(at, BATCH)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        if len(part):
            yield flat.reshape(len(part), -1)


def pair_sums(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``i, j, s`` for i <= j: the kernel's bands x bands matrix, summed over all pixels."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in _spectra(batch):
                part = kernel(block)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    return pixels.select("spectrum").mapInArrow(of, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def gram(pixels: DataFrame) -> DataFrame:
    """``i, j, value`` (i <= j): sums of products, not centred."""
    return pair_sums(pixels, lambda x: x.T @ x).withColumnRenamed("s", "value")


def _means(pixels: DataFrame) -> tuple[int, np.ndarray]:
    """Pixel count and band means: one row for each band."""
    rows = pixels.select(F.posexplode("spectrum").alias("band", "v")).groupBy("band").agg(F.count("v").alias("n"), F.avg("v").alias("mean")).orderBy("band").collect()
    return (rows[0].n if rows else 0), np.array([r.mean for r in rows])


def centred(pixels: DataFrame) -> DataFrame:
    """``i, j, value``: sums of products of deviations from the mean, in two passes, which keeps small variances exact."""
    _, mean = _means(pixels)
    return pair_sums(pixels, lambda x: (x - mean).T @ (x - mean)).withColumnRenamed("s", "value")


def covariance(pixels: DataFrame) -> DataFrame:
    """``i, j, value``: sample covariance."""
    n = pixels.count()
    return centred(pixels).withColumn("value", F.col("value") / (n - 1 if n > 1 else None))


def abs_correlation(pixels: DataFrame) -> DataFrame:
    """``i, j, value``: absolute correlation; null with a constant band."""
    sums = centred(pixels)
    own = sums.where("i = j")
    joined = sums.join(own.select(F.col("i"), F.col("value").alias("a")), "i").join(own.select(F.col("j"), F.col("value").alias("b")), "j")
    return joined.select("i", "j", F.abs(F.try_divide(F.col("value"), F.sqrt(F.col("a")) * F.sqrt(F.col("b")))).alias("value"))


def distances(pixels: DataFrame) -> DataFrame:
    """``i, j, value``: Euclidean distance between bands, from differences (near bands would cancel in a Gram matrix)."""

    def kernel(x: np.ndarray) -> np.ndarray:
        return np.stack([((x - x[:, [k]]) ** 2).sum(axis=0) for k in range(x.shape[1])])

    return pair_sums(pixels, kernel).select("i", "j", F.sqrt("s").alias("value"))


def rbf(pairs: DataFrame, sigma: float | None = None) -> DataFrame:
    """exp(-d / (2 sigma^2)); sigma is a thirtieth of the mean over all bands x bands distances, if not given."""
    if sigma is None:
        mean = pairs.agg(F.sum(F.when(F.col("i") < F.col("j"), 2.0).otherwise(1.0) * F.col("value")) / F.sum(F.when(F.col("i") < F.col("j"), 2.0).otherwise(1.0))).first()[0]
        sigma = mean / 30
    return pairs.withColumn("value", F.exp(-F.col("value") / (2 * sigma**2)))


def restricted(pairs: DataFrame, bands: DataFrame) -> DataFrame:
    """The pairs of which both bands are among ``bands(band)``: a submatrix. Bands may repeat; an empty table gives no pairs."""
    for side in ("i", "j"):
        pairs = pairs.join(bands.select(F.col("band").alias(side)), side, "left_semi")
    return pairs.select("i", "j", "value")


def mirrored(pairs: DataFrame, diagonal: float | None = None) -> DataFrame:
    """Both orders of each pair; with a diagonal value, that for i = j."""
    upper = pairs.where("i < j").select("i", "j", "value")
    both = upper.unionByName(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    if diagonal is None:
        return both.unionByName(pairs.where("i = j").select("i", "j", "value"))
    bands = upper.select(F.explode(F.array("i", "j")).alias("i")).distinct()
    return both.unionByName(bands.select("i", F.col("i").alias("j"), F.lit(diagonal).alias("value")))


def pairwise(pixels: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], float], single: bool = True) -> DataFrame:
    """``i, j, value`` (i < j) of any function of two whole bands; ``additive_pairwise`` is cheaper for sums over pixels.

    With ``single`` values are rounded to 32 bits, as distance matrices are kept. No pixel gives no pair.
    """
    bands = band_count(pixels)
    found = pairblocks.whole_values(pixels, _upper(bands), kernel)
    return found.withColumn("value", F.col("value").cast("float").cast("double")) if single else found


def _upper(bands: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(bands) for j in range(i + 1, bands)]


def additive_pairwise(pixels: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], float], single: bool = True) -> DataFrame:
    """``i, j, value`` (i < j) of an additive function of two bands' values in a batch, summed over the batches.

    With ``single`` values are rounded to 32 bits, as distance matrices are kept.
    """

    def matrix(x: np.ndarray) -> np.ndarray:
        bands = x.shape[1]
        out = np.zeros((bands, bands))
        for i in range(bands):
            for j in range(i + 1, bands):
                out[i, j] = kernel(x[:, i], x[:, j])
        return out

    value = F.col("s").cast("float").cast("double") if single else F.col("s")
    return pair_sums(pixels, matrix).where("i < j").select("i", "j", value.alias("value"))


def _ranges(pixels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = pixels.select(F.posexplode("spectrum").alias("band", "v")).groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("band").collect()
    return np.array([r.lo for r in rows]), np.array([r.hi for r in rows])


def _equal_bins(lo: np.ndarray, hi: np.ndarray, bins: int) -> Callable[[np.ndarray], np.ndarray]:
    width = np.where(hi > lo, hi - lo, 1e-10)
    return lambda x: np.clip(np.floor((x - lo) / width * bins), 0, bins - 1)


def information_distance(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """``i, j, value``: (1 - sqrt(2 MI / (H1 + H2)))^2 in bits, each histogram cell raised by EPS.

    Marginal counts are sums of the joint ones.
    """
    lo, hi = _ranges(pixels)

    def entropy(n: np.ndarray) -> float:
        p = (n / n.sum() + EPS) / (1 + n.size * EPS)
        return float(-(p * np.log2(p)).sum())

    def distance(n: np.ndarray) -> float:
        hi_, hj, hij = entropy(n.sum(axis=1)), entropy(n.sum(axis=0)), entropy(n)
        return (1 - math.sqrt(max(2 * (hi_ + hj - hij) / (hi_ + hj + EPS), 0.0))) ** 2

    return pairblocks.joint_values(pixels, _equal_bins(lo, hi, bins), bins, _upper(len(lo)), distance)


def symmetric_kl(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """``i, j, value``: KL(p, q) + KL(q, p) in bits over bins of the two bands' joint range; bins empty in both add nothing."""
    lo, hi = _ranges(pixels)
    total = pixels.count()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for x in _spectra(batch):
                for i in range(x.shape[1]):
                    for j in range(i + 1, x.shape[1]):
                        low, high = min(lo[i], lo[j]), max(hi[i], hi[j])
                        width = high - low if high > low else 1e-10
                        place = np.clip(np.floor((x[:, [i, j]] - low) / width * bins), 0, bins - 1).astype(np.int64)
                        part = np.bincount((place + [0, bins]).ravel(), minlength=2 * bins)
                        sums[i, j] = part if (i, j) not in sums else sums[i, j] + part
        for (i, j), n in sums.items():
            used = np.flatnonzero(n[:bins] + n[bins:])
            ones = np.ones(len(used), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i * ones), pa.array(j * ones), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(n[used + bins])], ["i", "j", "bin", "n", "m"])

    counts = pixels.select("spectrum").mapInArrow(of, "i int, j int, bin int, n long, m long").groupBy("i", "j", "bin").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    p, q = ((F.col(c).cast("double") / total + EPS) / (1 + bins * EPS) for c in ("n", "m"))
    return counts.groupBy("i", "j").agg(F.sum((p - q) * (F.log2(p) - F.log2(q))).alias("value"))


def adjacent_conditional_entropy(pixels: DataFrame, bins: int = 1024, method: str = "quantile") -> DataFrame:
    """``band, value``: entropy of band + 1 given band, in nats. A table without pixels is an error."""
    cells = pixels.select(F.posexplode("spectrum").alias("band", "v"))
    if method == "quantile":
        edges = [np.array(r.edges) for r in bandstats.quantile_edges(cells, bins).orderBy("band").collect()]
        of = lambda x: np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
        bands = len(edges)
    elif method == "equal":
        lo, hi = _ranges(pixels)
        of, bands = _equal_bins(lo, hi, bins), len(lo)
    else:
        raise ValueError(f"unknown bin method {method!r}")
    if not bands:
        raise ValueError("no pixels")

    def conditional(n: np.ndarray) -> float:
        return _entropy(n) - _entropy(n.sum(axis=1))

    found = pairblocks.joint_values(pixels, of, bins, [(k, k + 1) for k in range(bands - 1)], conditional)
    return found.select(F.col("i").alias("band"), "value")


def _entropy(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return float(-(p * np.log(p)).sum())


def neighbour_fit(pixels: DataFrame, adjusted: bool = False) -> DataFrame:
    """``band, value``: R^2 of each inner band's fit by its two neighbours and a constant, from 3 x 3 centred moments.

    Fewer than three bands are an error.
    """
    if band_count(pixels) < 3:
        raise ValueError("a fit by neighbours needs three bands")
    n = pixels.count()
    s = centred(pixels).where("j - i <= 2")

    def part(name: str, lower: int, step: int) -> DataFrame:
        return s.where(F.col("j") == F.col("i") + step).select((F.col("i") + lower).alias("band"), F.col("value").alias(name))

    rows = part("yy", 0, 0)
    for name, lower, step in (("s11", 1, 0), ("s22", -1, 0), ("s1y", 1, 1), ("s2y", 0, 1), ("s12", 1, 2)):
        rows = rows.join(part(name, lower, step), "band")
    r2 = F.expr("try_divide(s1y * s1y * s22 - 2 * s1y * s2y * s12 + s2y * s2y * s11, (s11 * s22 - s12 * s12) * yy)")
    return rows.select("band", ((1 - (1 - r2) * (n - 1) / (n - 3)) if adjusted else r2).alias("value"))


def to_matrix(pairs: DataFrame, diagonal: float | None = None) -> np.ndarray:
    """The symmetric matrix of band pairs on the driver: bands x bands numbers, independent of the pixels."""
    rows = pairs.select("i", "j", "value").toPandas()
    return matrix_of(rows, diagonal)


def matrix_of(rows: pd.DataFrame, diagonal: float | None = None) -> np.ndarray:
    size = int(rows[["i", "j"]].to_numpy().max()) + 1 if len(rows) else 0
    out = np.zeros((size, size))
    out[rows.i, rows.j] = rows.value
    out[rows.j, rows.i] = rows.value
    if diagonal is not None:
        np.fill_diagonal(out, diagonal)
    return out
