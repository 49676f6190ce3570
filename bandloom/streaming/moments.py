"""Band statistics of a stream of pixels, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_moments(pixels: DataFrame) -> DataFrame:
    """``band, n, mean, value`` (population variance) of a streaming or static table of spectra.

    The state is three sums for each band, whatever the number of pixels; write it in complete or update mode.
    """
    cells = pixels.select(F.posexplode("spectrum").alias("band", "v"))
    sums = cells.groupBy("band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("value"))
    return sums


def windowed_moments(pixels: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """``window, band, n, mean, value`` by event time; pixels later than the watermark are dropped by Spark."""
    cells = pixels.withWatermark(time, late).select(time, F.posexplode("spectrum").alias("band", "v"))
    return cells.groupBy(F.window(time, window).alias("window"), "band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("value"))
