import struct
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bandloom.operators import bandstats, dependence, evaluate, pairwise, partition, select, spatial
from bandloom.plans import registry
from bandloom.sources import cubes, mat, sinks

RNG = np.random.default_rng(3)


def pixels(spark, values, width=4, labels=None):
    rows = [(i, i // width, i % width, int(labels[i]) if labels is not None else i % 3, [float(x) for x in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pixel_id long, row int, col int, label int, spectrum array<double>")


@pytest.fixture(scope="module")
def ties(spark):
    """Six bands of eight pixels: one constant, two alike."""
    x = RNG.integers(0, 9, (8, 6)).astype(float)
    x[:, 2], x[:, 4] = 5.0, x[:, 3]
    return pixels(spark, x), x


def test_ties_and_constants(ties):
    table, x = ties
    cells = cubes.cells(table)
    assert {r.band: r.value for r in bandstats.entropies(cells).collect()}[2] == 0
    z = bandstats.standardized(cells).where("band = 2").agg(F.max(F.abs("v"))).first()[0]
    assert z == 0
    top = [r.band for r in select.top_bands(bandstats.variances(cells), 6).orderBy("rank").collect()]
    assert top.index(3) < top.index(4) and top[-1] == 2
    corr = pairwise.to_matrix(pairwise.abs_correlation(table).where("i <> 2 and j <> 2"), 1.0)
    assert corr[3, 4] == pytest.approx(1.0)
    assert pairwise.abs_correlation(table).where("i = 0 and j = 2").first().value is None


def test_moments_match_numpy(ties):
    table, x = ties
    assert pairwise.to_matrix(pairwise.covariance(table)) == pytest.approx(np.cov(x.T), abs=1e-12)
    assert pairwise.to_matrix(pairwise.gram(table)) == pytest.approx(x.T @ x)
    assert pairwise.to_matrix(pairwise.distances(table)) == pytest.approx(np.linalg.norm(x[:, :, None] - x[:, None, :], axis=0))


def test_errors(spark, ties):
    table, _ = ties
    with pytest.raises(ValueError):
        bandstats.binned(cubes.cells(table), 4, "other")
    with pytest.raises(ValueError):
        pairwise.neighbour_fit(cubes.projected(table, [0, 1]))
    with pytest.raises(ValueError):
        pairwise.adjacent_conditional_entropy(table.limit(0))
    with pytest.raises(ValueError):
        dependence.mic_by_lag(table, 6)
    with pytest.raises(ValueError):
        partition.uniform(spark, 6, [7])
    with pytest.raises(ValueError):
        pairwise.pair_domain(spark, 6, "round")
    with pytest.raises(ValueError):
        mat.load(spark, "unknown", "a", "b")
    with pytest.raises(ValueError):
        evaluate.evaluation(spark.createDataFrame([], "run_id int, method string, n_selected_bands int, test_accuracy double"), None)
    subsets = spark.createDataFrame([(1, 0, 0, 0)], "k int, subset_id int, pos int, band int")
    ranking = spark.createDataFrame([(1, 0), (2, 5)], "pos long, band int")
    with pytest.raises(KeyError):
        select.first_of_subsets(ranking, subsets, strict=True)
    assert select.first_of_subsets(ranking, subsets).count() == 1


@pytest.mark.parametrize("shape", [(70, 12), (9, 75), (40, 37)])
def test_images_span_tiles(spark, monkeypatch, shape):
    image = RNG.integers(0, 200, (*shape, 3)).astype(float)
    table = pixels(spark, image.reshape(-1, 3), width=shape[1])
    monkeypatch.setattr(spatial, "TILE", 100)
    whole = [pairwise.to_matrix(spatial.mssim(table)), pairwise.to_matrix(spatial.ssim(table, 200.0))]
    monkeypatch.setattr(spatial, "TILE", 16)
    assert pairwise.to_matrix(spatial.mssim(table)) == pytest.approx(whole[0])
    assert pairwise.to_matrix(spatial.ssim(table, 200.0)) == pytest.approx(whole[1])


def test_tiles_of_a_wide_image_are_bounded(spark):
    wide = spark.range(32 * 100_000).select((F.col("id") / 100_000).cast("int").alias("row"), (F.col("id") % 100_000).cast("int").alias("col"))
    tiles = spatial._tiles(wide, 5, 32, 100_000).groupBy("down", "across").agg(F.count("*").alias("n"))
    assert tiles.agg(F.max("n"), F.count("*")).first() == (32 * 74, 1563)


def test_images_without_windows(spark):
    table = pixels(spark, RNG.integers(0, 9, (2, 3)).astype(float), width=1)
    assert [r.value for r in spatial.ssim(table, 9.0).collect()] == [0.0] * 3
    assert spatial.ssim(table.limit(0), 9.0).count() == spatial.mssim(table.limit(0)).count() == 0


def test_summed_area_of_similarity_to_itself(spark):
    table = pixels(spark, np.repeat(RNG.integers(0, 99, (24, 1)), 2, axis=1).astype(float))
    assert pairwise.to_matrix(spatial.ssim(table, 99.0))[0, 1] == pytest.approx(1.0)


@pytest.mark.parametrize("gone", [[], [2049], [0, 7, 8, 400, 401, 402, 426, 1100, 2050], list(range(33, 2056, 10))])
def test_similarity_of_an_image_that_lacks_pixels(spark, tmp_path, gone):
    ids = [n for n in range(2056) if n not in gone]  # the last row is not full
    vectors = RNG.normal(0, 0.2, (len(ids), 3)).astype("float32")
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(vectors), "label": [1] * len(ids)}), tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    db.sql("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    got = {(r.i, r.j): r.value for r in registry.QUERIES["ssim_win3"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(i, j): v for i, j, v in db.sql(registry.ORACLE_SQL["ssim_win3"]).fetchall()}, abs=2e-7) and len(got) == 3


def test_a_band_is_not_denser_than_itself(spark):
    at = np.cumsum(RNG.uniform(0.5, 1.5, 40)) / 20
    d = np.sqrt(abs(at[:, None] - at))
    rows = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(40)], "i int, j int, value double").coalesce(1)
    shuffled = rows.mapInPandas(lambda batches: (b.sample(frac=1) for b in batches), rows.schema)  # in another order each time, as a cluster's rows are
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.band: r.delta for r in select.density_peaks(shuffled, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    rho = np.exp(-d / 0.5).sum(axis=1)
    want = [d[i].max() if i == rho.argmax() else d[i][rho > rho[i]].min() for i in range(40)]
    assert [got[i] for i in range(40)] == pytest.approx(want)


def test_separable_classes(spark):
    labels = np.arange(120) % 4
    x = RNG.normal(0, 0.05, (120, 5))
    x[:, 1] += labels == 1
    x[:, 2] += labels == 2
    x[:, 3] += labels == 3
    chosen = spark.createDataFrame([("m", 3, 1, 1), ("m", 3, 2, 2), ("m", 3, 3, 3), ("m", 3, 4, 99)], "method string, k int, rank int, band int")
    got = evaluate.svm_evaluation(pixels(spark, x, labels=labels), chosen, runs=2).collect()
    assert [(r.test_accuracy, r.selected_band_idx) for r in got] == [(1.0, [1, 2, 3])] * 2


def test_results_and_tests(spark):
    raw = [(r, m, 5, 0.5 + 0.01 * r + d) for r in range(10) for m, d in (("a", 0.0), ("a_x", 0.001 * (r % 3) + 0.02), ("a_same", 0.1))]
    table = spark.createDataFrame(raw, "run_id int, method string, n_selected_bands int, test_accuracy double")
    base = spark.createDataFrame([("a_x", "a"), ("a_same", "a")], "method string, baseline string")
    got = {r.method: r for r in evaluate.evaluation(table, base).collect()}
    assert got["a_x"].significance_mark == "**" and got["a_x"].p_value_vs_baseline < 1e-6
    assert got["a"].p_value_vs_baseline is None and got["a_same"].p_value_vs_baseline is None
    assert got["a"].raw_accuracy_list == pytest.approx([0.5 + 0.01 * r for r in range(10)])
    assert spark.range(1).select(evaluate.p_value(F.lit(2.3), 9)).first()[0] == pytest.approx(0.0469993889)


def test_quantile_edges_match_numpy(spark):
    x = np.concatenate([RNG.integers(0, 5, 3000), RNG.normal(size=997), [7.0] * 2000])
    rows = [(0, float(v)) for v in x] + [(0, None), (1, 4.0), (2, 1.0), (2, 2.0), (3, None)]
    cells = spark.createDataFrame(rows, "band int, v double").repartition(5)
    for bins in (1, 2, 10, 64):
        got = {r.band: r.edges for r in bandstats.quantile_edges(cells, bins).collect()}
        at = np.arange(1, bins) / bins
        assert set(got) == {0, 1, 2}
        assert got[0] == pytest.approx(np.quantile(x, at)) and got[1] == [4.0] * (bins - 1) and got[2] == pytest.approx(1 + at)
    assert bandstats.quantile_edges(cells.limit(0), 4).count() == 0
    assert bandstats.binned(cells, 4).count() == len(rows)


def test_submatrix(spark, ties):
    table, x = ties
    pairs = pairwise.gram(table)
    bands = spark.createDataFrame([(1,), (4,), (4,), (9,)], "band int")
    got = {(r.i, r.j): r.value for r in pairwise.restricted(pairs, bands).collect()}
    assert got == pytest.approx({(i, j): float(x[:, i] @ x[:, j]) for i, j in ((1, 1), (1, 4), (4, 4))})
    assert pairwise.restricted(pairs, bands.limit(0)).count() == 0


def _mat(name, array, pack=True, more=()):
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    flags, dims = element(6, struct.pack("<II", 6, 0)), element(5, np.array(array.shape, "<i4").tobytes())
    body = flags + dims + element(1, name.encode()) + element(4, array.astype("<u2").tobytes(order="F"))
    packed = zlib.compress(element(14, body))
    own = struct.pack("<II", 15, len(packed)) + packed if pack else element(14, body)
    return b" " * 124 + struct.pack("<HH", 0x0100, 0x4D49) + b"".join(m[128:] for m in more) + own


@pytest.mark.parametrize("pack", [True, False])
def test_mat_files(spark, tmp_path, pack):
    cube, labels = RNG.integers(0, 999, (70, 4, 3)), RNG.integers(0, 5, (70, 4))
    others = [_mat("other", RNG.integers(0, 999, (90, 31)), p) for p in (True, False)]
    (tmp_path / "cube.mat").write_bytes(_mat("pavia", cube, pack, others))
    (tmp_path / "gt.mat").write_bytes(_mat("pavia_gt", labels, pack))
    with pytest.raises(ValueError):
        mat.rows_of(str(tmp_path / "cube.mat"), "absent", 0, 1)
    rows = mat.load(spark, "pavia", str(tmp_path / "cube.mat"), str(tmp_path / "gt.mat")).orderBy("pixel_id").collect()
    assert [r.pixel_id for r in rows] == list(range(280))
    assert np.array([r.spectrum for r in rows]).reshape(70, 4, 3).tolist() == cube.tolist()
    assert [r.label for r in rows] == labels.ravel().tolist()


@pytest.mark.parametrize("pack", [True, False])
def test_mat_format_reads_ranges_of_rows(spark, tmp_path, pack):
    cube = RNG.integers(0, 999, (70, 4, 3))
    (tmp_path / "cube.mat").write_bytes(_mat("pavia", cube, pack))
    spark.dataSource.register(mat.MatDataSource)
    rows = spark.read.format("mat").option("path", f"{tmp_path}/cube.mat").option("variable", "pavia").load().orderBy("row", "col").collect()
    assert np.array([r.spectrum for r in rows]).reshape(70, 4, 3).tolist() == cube.tolist()


@pytest.mark.parametrize("pack", [True, False])
def test_mat_images_on_other_file_systems(spark, tmp_path, monkeypatch, pack):
    """A path that Python can't open, several images at once, and pieces far smaller than they."""
    monkeypatch.setattr(mat, "SLAB", 8 * 12 * 5)
    monkeypatch.setattr(mat, "PIECE", 300)
    cubes_ = [RNG.integers(0, 999, shape) for shape in ((13, 4, 3), (7, 3, 4), (1, 1, 1))]
    for n, cube in enumerate(cubes_):
        (tmp_path / f"{n}.mat").write_bytes(_mat("pavia", cube, pack, [_mat("other", RNG.integers(0, 9, (9, 3)), not pack)]))
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.images{pack:d}.link./all", f"file://{tmp_path}")
    found = mat.images(spark, f"viewfs://images{pack:d}/all/*.mat", "pavia").collect()
    for n, cube in enumerate(cubes_):
        rows = sorted((r.row, r.col, r.spectrum) for r in found if r.path.endswith(f"/{n}.mat"))
        assert found[0].path.startswith("viewfs:") and np.array([r[2] for r in rows]).reshape(cube.shape).tolist() == cube.tolist()
    with pytest.raises(Exception, match="no variable absent"):
        mat.images(spark, f"viewfs://images{pack:d}/all/0.mat", "absent").collect()


def test_mat_bytes_are_inflated_once(monkeypatch):
    data = _mat("pavia", RNG.integers(0, 999, (500, 20, 9)))
    out = []
    real = zlib.decompressobj

    class Counted:
        def __init__(self):
            self.own = real()

        def decompress(self, *args):
            out.append(len(got := self.own.decompress(*args)))
            return got

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(mat.zlib, "decompressobj", Counted)
    batch = pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([data])], ["path", "content"])
    size = sum(len(v) for b in mat._pieces("pavia")([batch]) for v in b.column(7).to_pylist())
    assert size == 2 * 500 * 20 * 9 and sum(out) < size + 2 * mat.HEAD


def test_sinks(spark, tmp_path, ties):
    table, _ = ties
    calls = []
    make = lambda: calls.append(1) or bandstats.variances(cubes.cells(table))
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/v", make).count() == 6
    assert len(calls) == 1
    sinks.write_vector(make(), f"{tmp_path}/csv")
    assert len(spark.read.csv(f"{tmp_path}/csv").collect()) == 6
    chosen = spark.createDataFrame([("m", 3, None, 1, 1), ("n", 3, 2, 1, 4)], "method string, k int, run_id int, rank int, band int")
    sinks.write_selections(chosen, f"{tmp_path}/s")
    wanted = spark.createDataFrame([("m", 3), ("other", 9)], "method string, k int")
    assert [r.band for r in sinks.read_selections(spark, f"{tmp_path}/s", wanted).collect()] == [1]
    sinks.write_csv(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), f"{tmp_path}/r")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/r").first().b == "[1,2]"


def test_entry_without_the_corpus_subpackage(tmp_path):
    code = "import sys; sys.modules['bandloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'pipeline' not in e.queries()"
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0


def test_spectra_permuted_in_place(spark):
    rows = [(p, [float(10 * p + b) for b in range(13)]) for p in range(3)]
    pixels = spark.createDataFrame(rows, "pixel_id long, spectrum array<double>")
    cells = pixels.select("pixel_id", F.posexplode("spectrum").alias("band", "v"))
    want = {(r.pixel_id, r.band): r.v for r in bandstats.permuted(cells).collect()}
    got = bandstats.permuted_spectra(pixels).collect()
    assert {(r.pixel_id, b): v for r in got for b, v in enumerate(r.spectrum)} == want
    assert all(sorted(r.spectrum) == dict(rows)[r.pixel_id] for r in got)
