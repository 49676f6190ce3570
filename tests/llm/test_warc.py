import pytest
from pyspark.sql import functions as F

from bandloom.llm import shared, warc

from .oracle import query_rows, sql_rows


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://host/{i} a\r\nX: y", f"<html>{'é' * (i % 7)} body {i % 40}</html>", 1) for i in range(150)]
    rows += [(500, None, None, 1), (501, "", "", 1), (None, "u", "<html> body 0</html>", 1), (3, "again", rows[3][2], 1), (502, "u", "x" * 3_000_000, 1), (503, "u", warc.EMPTY_FRAME * 3, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").repartition(3)


def test_against_sql(spark, pages, tmp_path):
    assert query_rows("op3_warc_round_trip", spark, tmp_path, pages=pages) == sql_rows("op3_warc_round_trip", pages=pages)
    assert query_rows("op3_warc_round_trip", spark, tmp_path / "none", pages=pages.limit(0)) == []


@pytest.mark.parametrize("n", [0, 1, 3, 2000])
def test_archive_layout(n):
    made = [warc.record(i, f"http://h/{i}", f"<p>{'text ' * (i % 50)}{i}</p>", None) for i in range(n)]
    parts = list(warc.frames(iter(made)))
    assert len(parts) == (n + 1 if n else 0)
    if n:
        content = b"".join(p + warc.EMPTY_FRAME.encode() for p in parts)
        got = [block for _, block in warc.records(content)]
        assert got == [m.partition(b"\r\n\r\n")[2][:-4] for m in made]
    if n == 2000:
        assert len(content) < sum(map(len, made)) / 3


def test_a_changed_payload_is_found(spark, tmp_path):
    bad = warc.record(1, "u", "<p>abc</p>", None).replace(b"abc", b"abd")
    (tmp_path / "part").write_bytes(b"".join(p + warc.EMPTY_FRAME.encode() for p in warc.frames(iter([bad]))))
    with pytest.raises(Exception, match="was changed"):
        warc.read(spark, str(tmp_path)).collect()


def test_archives_follow_the_size(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("same" * 50)).otherwise(F.repeat(F.col("id").cast("string"), 40)).alias("html"))
    path = warc.new_path(spark, "warc")
    warc.write(pages, path, archive_bytes=2000)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).where("length > 0").select("length").collect()]
    assert len(sizes) > 15
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == 400 and all(r.refers_to == (0 if i % 3 == 0 and i else None) for i, r in got.items())


def test_one_payload_on_most_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 50)
    pages = spark.createDataFrame([(i, None, None, "x") for i in range(500)], "page_id long, url string, html string, refers_to string").repartition(4)
    used = warc.planned(pages).groupBy(F.spark_partition_id()).count().collect()
    assert len(used) > 2 and max(r["count"] for r in used) < 350
    got = warc.round_trip(pages).collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == [(0, None)] + [(i, 0) for i in range(1, 500)]

