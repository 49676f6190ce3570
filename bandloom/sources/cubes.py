"""Image cubes as tables: ``pixels(pixel_id, row, col, label, spectrum)`` and ``cells(pixel_id, row, col, label, band, v)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels in a row of the grid that the embeddings table is laid out on.
WIDTH = 25


def from_vectors(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """The embeddings table as a cube: ids run along the rows of a grid, label 0 is background."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(
        F.col("vec_id").alias("pixel_id"),
        F.floor(F.col("vec_id") / width).cast("int").alias("row"),
        F.pmod("vec_id", F.lit(width)).cast("int").alias("col"),
        "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("spectrum"),
    )


def smooth(pixels: DataFrame) -> DataFrame:
    """Spectra as their running sums along the bands."""
    sums = F.transform(F.sequence(F.lit(1), F.size("spectrum")), lambda i: F.aggregate(F.slice("spectrum", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    return pixels.withColumn("spectrum", sums)


def counts_of(pixels: DataFrame, shift: float = 5.0, scale: float = 100.0) -> DataFrame:
    """Spectra as whole numbers floor((v + shift) * scale), as sensors deliver them."""
    return pixels.withColumn("spectrum", F.transform("spectrum", lambda x: F.floor((x + shift) * scale).cast("double")))


def cells(pixels: DataFrame) -> DataFrame:
    """One row for each pixel and band."""
    keep = [c for c in pixels.columns if c != "spectrum"]
    return pixels.select(*keep, F.posexplode("spectrum").alias("band", "v"))


def flattened(cube: DataFrame, width: int) -> DataFrame:
    """``pixel_id`` from row and col, row-major."""
    return cube.withColumn("pixel_id", F.col("row").cast("long") * width + F.col("col"))


def foreground(pixels: DataFrame) -> DataFrame:
    """Pixels whose label isn't 0; the filter reaches the scan."""
    return pixels.where("label <> 0")


def projected(pixels: DataFrame, bands: list[int]) -> DataFrame:
    """Spectra of the given bands only, in the given order. Bands outside the spectrum are left out, as is a null one."""
    inside = F.filter(F.array(*map(F.lit, bands)), lambda b: (b >= 0) & (b < F.size("spectrum")))
    return pixels.withColumn("spectrum", F.transform(inside, lambda b: F.get("spectrum", b)))


def band_count(pixels: DataFrame) -> int:
    """Bands of a cube, from one row."""
    first = pixels.select(F.size("spectrum")).first()
    return first[0] if first else 0
