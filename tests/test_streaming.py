import pytest

from bandloom.operators import bandstats
from bandloom.sources import cubes
from bandloom.streaming import moments

SF = "/root/testdata/sf0.001"


def test_stream_gives_the_batch_result(spark, tmp_path):
    pixels = cubes.from_vectors(spark, SF)
    for part in range(3):
        pixels.where(f"pixel_id % 3 = {part}").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = moments.band_moments(stream).writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    running.awaitTermination(120)
    got = {r.band: r.value for r in spark.table("moments").collect()}
    want = {r.band: r.value for r in bandstats.variances(cubes.cells(pixels)).collect()}
    assert got == pytest.approx(want)


def test_windows(spark):
    rows = [("2024-01-01 00:00:01", [1.0]), ("2024-01-01 00:00:09", [3.0]), ("2024-01-01 00:00:11", [5.0])]
    table = spark.createDataFrame(rows, "t string, spectrum array<double>").selectExpr("cast(t AS timestamp) AS t", "spectrum")
    got = sorted((r.n, r.mean) for r in moments.windowed_moments(table, "t", "10 seconds", "1 minute").collect())
    assert got == [(1, 5.0), (2, 2.0)]
