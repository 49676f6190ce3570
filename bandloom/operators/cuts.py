"""Contiguous subspaces and peaks by joins and windows over tables of band pairs, ``i, j, value``.

All tables here have at most bands^3 rows, whatever the number of pixels, and no task gets a matrix. ``ranges`` sums what is
within each range of bands with two windows; what is best is decided for all ranges at once, layer by layer or step by step.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.kernels import check_count
from bandloom.sources.sinks import temporary

#: A sum below which a range counts as empty.
EMPTY = 1e-12
#: Layers of cuts that one plan makes before they are written.
ROUNDS = 5


def _square(pairs: DataFrame, diagonal: float | None) -> tuple[DataFrame, int]:
    """Both orders of each pair and the diagonal, which counts as given (None: as in the table), and the number of bands."""
    kept = temporary(pairs.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value"))
    last = kept.agg(F.max(F.greatest("i", "j"))).first()[0]
    bands = 0 if last is None else last + 1
    upper = kept.where("i <> j")
    own = kept.where("i = j")
    if diagonal is not None:
        band = F.col("id").cast("int")
        own = pairs.sparkSession.range(bands).select(band.alias("i"), band.alias("j"), F.lit(float(diagonal)).alias("value"))
    return upper.unionByName(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).unionByName(own), bands


def ranges(square: DataFrame) -> DataFrame:
    """``lo, hi, inner, whole`` for bands lo to hi - 1: the sum over pairs within, and of their bands with all bands."""
    whole = F.sum("value").over(Window.partitionBy("i"))
    back = Window.partitionBy("i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("lo").orderBy("hi").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(2 * F.col("value"))).over(back)  # of adding band i to j .. i - 1
    rows = square.withColumn("own", whole).where("j <= i").select(F.col("j").alias("lo"), (F.col("i") + 1).alias("hi"), gain.alias("gain"), "own")
    return rows.select("lo", "hi", F.sum("gain").over(on).alias("inner"), F.sum("own").over(on).alias("whole"))


def _bands_of(edges: DataFrame) -> DataFrame:
    """``k, subset_id, pos, band`` of parts ``k, subset_id, lo, hi``."""
    band = F.posexplode(F.sequence("lo", F.col("hi") - 1)).alias("pos", "band")
    return edges.where("lo < hi").select(*(F.col(c).cast("int").alias(c) for c in ("k", "subset_id", "lo", "hi"))).select("k", "subset_id", band)


def _check(ks: list[int], bands: int) -> None:
    for k in ks:
        check_count(k, 1, bands)


def best_cuts(pairs: DataFrame, ks: list[int], diagonal: float | None = 1.0) -> DataFrame:
    """The k contiguous parts with the greatest sum of similarity within over similarity to all; of equals, the earliest last cut.

    Layer n holds the best n parts of the first bands, for each end, with their cuts; the next one joins it with all ranges
    that begin there and keeps the best for each end. Layers are written every ROUNDS of them, so that plans stay small.
    """
    square, bands = _square(pairs, diagonal)
    _check(ks, bands)
    value = F.when(F.abs("whole") < EMPTY, 0.0).otherwise(F.try_divide("inner", "whole"))
    scores = temporary(ranges(square).select("lo", "hi", value.alias("value")))
    layer = scores.where("lo = 0").select("hi", F.col("value").alias("total"), F.array("lo", "hi").alias("cuts"))
    found = []
    for k in range(1, max(ks) + 1):
        if k > 1:
            total, cut = F.col("total") + F.col("value"), F.array_append("cuts", F.col("hi"))
            ways = layer.withColumnRenamed("hi", "lo").join(scores, "lo").select("hi", F.struct(total.alias("total"), (-F.col("lo")).alias("back"), cut.alias("cuts")).alias("way"))
            layer = ways.groupBy("hi").agg(F.max("way").alias("way")).select("hi", "way.total", "way.cuts")
            layer = temporary(layer) if k % ROUNDS == 0 and k < max(ks) else layer
        if k in ks:
            found.append(layer.where(F.col("hi") == bands).select(F.lit(k).alias("k"), "cuts"))
    every = functools.reduce(DataFrame.unionByName, found)
    parts = every.select("k", F.posexplode(F.slice("cuts", 1, F.col("k"))).alias("subset_id", "lo"), "cuts")
    return _bands_of(parts.withColumn("hi", F.get("cuts", F.col("subset_id") + 1)))


def adapted_cuts(pairs: DataFrame, ks: list[int]) -> DataFrame:
    """Equal parts whose cuts move, from left to right, to where the greatest distance across is largest against the mean within.

    Where a cut goes follows from the cut before it and the unmoved one after it, so it is found for every place of the
    former at once; the walk from cut to cut then only looks up these places, at most k x bands of them in the one row
    of a k. A cut without a choice stays.
    """
    spark = pairs.sparkSession
    square, bands = _square(pairs, 0.0)
    _check(ks, bands)
    starts = {k: [p * (bands // k) + min(p, bands % k) for p in range(k + 1)] for k in ks}
    steps = spark.createDataFrame([(k, p, s[p + 1], s[p + 2]) for k, s in starts.items() for p in range(k - 1)], "k int, p int, own int, hi int")
    inner = ranges(square).select("lo", "hi", "inner")
    of, cut = ["k", "p"], F.col("cut")
    ahead = Window.partitionBy(*of, "lo").orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*of, "cut").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, 0)
    across = square.where("i < j").select(F.col("i").alias("lo"), F.col("j").alias("cut"), "value").join(F.broadcast(steps), cut < F.col("hi"))
    across = across.withColumn("across", F.max("value").over(ahead)).withColumn("across", F.max("across").over(behind))
    left = inner.select("lo", F.col("hi").alias("cut"), F.col("inner").alias("left"))
    right = inner.select(F.col("lo").alias("cut"), "hi", F.col("inner").alias("right"))
    options = across.where("cut >= lo + 2 AND cut <= hi - 2").join(left, ["lo", "cut"]).join(right, ["cut", "hi"])

    def mean(total: str, size: Column) -> Column:
        return F.col(total) / (size * (size - 1))

    within = mean("left", cut - F.col("lo")) + mean("right", F.col("hi") - cut)
    score = F.when(within >= EMPTY, F.try_divide("across", within)).otherwise(F.when(F.col("across") > 0, F.lit(math.inf)).otherwise(0.0))
    best = options.withColumn("score", score).where("NOT isnan(score)").groupBy(*of, "lo").agg((-F.max(F.struct("score", (-cut).alias("at")))["at"]).alias("cut"))
    moves = best.withColumn("at", F.struct("p", "lo")).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("at", "cut"))).alias("moves"))
    counts = spark.createDataFrame(list(starts.items()), "k int, own array<int>").join(moves, "k", "left")

    def step(walked: Column, p: Column) -> Column:
        moved = F.element_at("moves", F.struct(p.alias("p"), F.element_at(walked, -1).alias("lo")))
        return F.array_append(walked, F.coalesce(moved, F.get("own", p + 1)))

    walked = counts.select("k", F.aggregate(F.slice(F.sequence(F.lit(0), F.col("k")), 1, F.col("k") - 1), F.array(F.lit(0)), step).alias("cuts"))
    parts = walked.select("k", F.posexplode("cuts").alias("subset_id", "lo"), "cuts")
    return _bands_of(parts.withColumn("hi", F.coalesce(F.get("cuts", F.col("subset_id") + 1), F.lit(bands))))


def peak_scores(similarity: DataFrame) -> DataFrame:
    """``band, value``: mean of a band's high similarities times its dissimilarity to bands that have a higher mean, both scaled.

    High is what exceeds the mean of the pairs between the twentieth and the tenth part of all, from the top. Where
    no band differs from another, the scores are no numbers.
    """
    square, _ = _square(similarity, 1.0)
    ranked = square.where("i < j").select("value", F.row_number().over(Window.orderBy(F.desc("value"))).alias("n"), F.count("*").over(Window.partitionBy()).alias("m"))
    level = ranked.where("n >= floor(m * 0.05D) AND n <= floor(m * 0.1D) - 1").agg(F.avg("value").alias("level"))
    alpha = square.crossJoin(F.broadcast(level)).groupBy("i").agg(F.coalesce(F.avg(F.when(F.col("value") > F.col("level"), F.col("value"))), F.lit(0.0)).alias("alpha"))
    places = temporary(alpha.withColumn("place", F.row_number().over(Window.orderBy(F.desc("alpha"), "i"))))
    other = places.select(F.col("i").alias("j"), F.col("place").alias("earlier"))
    higher = square.join(places, "i").join(other, "j").groupBy("i", "alpha", "place").agg(F.greatest(F.max(F.when(F.col("earlier") < F.col("place"), F.col("value"))), F.lit(0.0)).alias("phi"))
    every = Window.partitionBy()
    least = F.least(F.coalesce(F.min(F.when(F.col("place") > 1, F.col("phi"))).over(every), F.lit(1.0)), F.lit(1.0))
    theta = higher.withColumn("phi", F.when(F.col("place") == 1, least).otherwise(F.col("phi"))).withColumn("theta", F.sqrt(1 - F.col("phi") * F.col("phi")))

    def scaled(name: str) -> Column:
        low = F.min(name).over(every)
        return F.coalesce(F.try_divide(F.col(name) - low, F.max(name).over(every) - low), F.lit(math.nan))

    return theta.select(F.col("i").alias("band"), (scaled("alpha") * scaled("theta")).alias("value"))


def peak_gap_cuts(similarity: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``pos, cut``: a cut between each two neighbours of the k best peaks; 0 and the number of bands around them.

    In gaps of over three bands the cut has the least weight across over the product of the weights within; of equals it
    is the first, and where no cut has such a number, the middle.
    """
    square, bands = _square(weights, None)
    check_count(k, 1, bands)
    best = peak_scores(similarity).orderBy(F.desc(F.nanvl("value", F.lit(-math.inf))), "band").limit(k)
    in_order = Window.orderBy("band")
    gaps = best.select(F.row_number().over(in_order).alias("pos"), F.col("band").alias("a"), F.lead("band").over(in_order).alias("b")).where("b IS NOT NULL")
    gaps = temporary(gaps)
    wide = gaps.where("b - a > 3").withColumn("t", F.explode(F.sequence(F.col("a") + 2, F.col("b") - 1)))
    triangle = square.where("i <= j").select("i", "j", F.abs("value").alias("w"))
    low, high, at = F.col("j") < F.col("t"), F.col("i") >= F.col("t"), F.broadcast(wide)
    sums = triangle.join(at, (F.col("i") >= F.col("a")) & (F.col("j") <= F.col("b"))).groupBy("pos", "t").agg(
        F.sum(F.when(~low & ~high, F.col("w"))).alias("across"), F.sum(F.when(low, F.col("w"))).alias("left"), F.sum(F.when(high, F.col("w"))).alias("right")
    )
    cost = sums.withColumn("cost", F.try_divide("across", F.col("left") * F.col("right"))).where("cost < double('inf')")
    least = cost.groupBy("pos").agg(F.min(F.struct("cost", "t"))["t"].alias("t"))
    width = F.col("b") - F.col("a")
    cut = F.when(width <= 2, F.col("a") + 1).when(width == 3, F.col("a") + 2).otherwise(F.coalesce("t", F.floor((F.col("a") + F.col("b")) / 2)))
    inner = gaps.join(least, "pos", "left").select("pos", cut.cast("int").alias("cut"))
    return inner.unionByName(weights.sparkSession.createDataFrame([(0, 0), (k, bands)], "pos int, cut int"))
