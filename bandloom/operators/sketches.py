"""Independent samples of pixels for many pairs of bands, in one pass: bottom-n sketches that merge."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders are polynomials of pixel ids over this prime, so products stay within 64 bits.
PRIME = 2**31 - 1
#: Rows that the sketches of a task may keep, 64 MB; more pairs take a pass for each so many.
ROWS = 1_000_000
#: Groups of tasks whose sketches are merged before the last merge.
MERGES = 32


def _coefficient(name: str, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), F.col("i").cast("string"), F.col("j").cast("string"))), 1, 7), 16, 10).cast("long")


def pair_samples(pixels: DataFrame, pairs: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """``i, j, pixel_id, x, y``: for each pair ``i, j`` its own n pixels (all, if there are fewer), with both bands' values.

    A pair orders pixels by a quadratic polynomial of their ids, u = pixel_id mod PRIME, whose coefficients come from a hash of
    seed and pair: any three pixels take places that don't depend on each other, and so do pairs. Equal places go by
    pixel_id. A task keeps the first n of its pixels for each pair; these meet in two merges, so what is shuffled and what a
    group holds follows n and the tasks, not the pixels. Repeated rows of a pixel count as several.
    """
    if n < 1:
        raise ValueError("a sample needs a pixel")
    own = pairs.select("i", "j").distinct().select("i", "j", *(_coefficient(c, seed).alias(c) for c in "abc")).orderBy("i", "j").collect()
    size = max(1, ROWS // n)
    blocks = [own[at : at + size] for at in range(0, max(len(own), 1), size)]
    return functools.reduce(DataFrame.unionByName, [_sampled(pixels, block, n) for block in blocks])


def _sampled(pixels: DataFrame, pairs: list, n: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * len(pairs)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            u = ids % PRIME
            square = u * u % PRIME
            for p, (i, j, a, b, c) in enumerate(pairs):
                place = (a * square % PRIME + b * u % PRIME + c) % PRIME
                own = tuple(map(np.concatenate, zip(kept[p], (place, ids, x[:, i], x[:, j]))))
                first = np.lexsort((own[1], own[0]))[:n] if len(own[0]) > n else slice(None)
                kept[p] = tuple(v[first] for v in own)
        for (i, j, *_), (place, ids, x, y) in zip(pairs, kept):
            of_pair = [pa.array(np.full(len(ids), b, np.int32)) for b in (i, j)]
            yield pa.RecordBatch.from_arrays([*of_pair, pa.array(place), pa.array(ids), pa.array(x), pa.array(y)], ["i", "j", "place", "pixel_id", "x", "y"])

    rows = pixels.select(F.col("pixel_id").cast("long"), F.col("spectrum").cast("array<double>")).mapInArrow(of, "i int, j int, place long, pixel_id long, x double, y double")
    rows = rows.withColumn("part", F.spark_partition_id() % MERGES)
    for keys in (["i", "j", "part"], ["i", "j"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place", "pixel_id"))).where(F.col("rank") <= n).drop("rank")
    return rows.select("i", "j", "pixel_id", "x", "y")
