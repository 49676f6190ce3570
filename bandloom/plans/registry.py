"""All queries over the reference tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandloom.operators import bandstats, cuts, dependence, evaluate, pairwise, partition, select, sketches, spatial
from bandloom.plans import experiment, oracle
from bandloom.plans.oracle import BANDS, bin_of, cells, moments
from bandloom.sources import cubes, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Subspaces and bands chosen in the queries that take one number of them.
K = 10
K_CUTS = 5
DIGITS = 8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.from_vectors(spark, sf_dir)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.cells(_raw(spark, sf_dir))


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.smooth(_raw(spark, sf_dir))


def _dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.counts_of(_smooth(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of lineitem as bands of very different scale."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("pixel_id"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("spectrum"))


def _rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns or ("value",)})


def _kept(df: DataFrame) -> DataFrame:
    """A bands x bands table, written once, for plans that use it several times."""
    return sinks.temporary(df)


def _uniform(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return partition.uniform(spark, cubes.band_count(_raw(spark, sf_dir)), [k])


# ---- scans, filters, projections --------------------------------------------------------------------------------------


@query(cells() + " SELECT pixel_id, band, round(v, 8) AS v FROM cells")
def cube_cells(spark, sf_dir):
    return _rounded(_cells(spark, sf_dir).select("pixel_id", "band", "v"), "v")


@query(f"WITH {oracle.PIXELS} SELECT pixel_id, r AS \"row\", c AS col, r * (SELECT max(c) + 1 FROM px) + c AS flat FROM px")
def cube_flatten(spark, sf_dir):
    pixels = _raw(spark, sf_dir)
    width = pixels.agg(F.max("col")).first()[0] + 1
    return cubes.flattened(pixels.drop("pixel_id"), width).select("pixel_id", "row", "col", F.col("pixel_id").alias("flat"))


@query("SELECT vec_id AS pixel_id, round(embedding[8]::DOUBLE, 8) AS b7, round(embedding[4]::DOUBLE, 8) AS b3, round(embedding[64]::DOUBLE, 8) AS b63 FROM embeddings")
def band_projection(spark, sf_dir):
    got = cubes.projected(_raw(spark, sf_dir), [7, 3, -1, 63, 64])
    return got.select("pixel_id", *(F.round(F.get("spectrum", F.lit(n)), DIGITS).alias(name) for n, name in enumerate(("b7", "b3", "b63"))))


@query("SELECT vec_id AS pixel_id, label FROM embeddings WHERE label <> 0")
def background_filter(spark, sf_dir):
    return cubes.foreground(_raw(spark, sf_dir)).select("pixel_id", "label")


@query(moments() + " SELECT pixel_id, band, round((v - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 8) AS v FROM cells JOIN stats USING (band)")
def standardize(spark, sf_dir):
    return _rounded(bandstats.standardized(_cells(spark, sf_dir)).select("pixel_id", "band", "v"), "v")


@query(moments() + " SELECT pixel_id, band, round(CASE WHEN abs(v - mean) > 3 * std THEN mean ELSE v END, 8) AS v FROM cells JOIN stats USING (band)")
def outlier_replace(spark, sf_dir):
    return _rounded(bandstats.without_outliers(_cells(spark, sf_dir)).select("pixel_id", "band", "v"), "v")


@query("SELECT vec_id AS pixel_id FROM embeddings ORDER BY md5('42:' || vec_id::VARCHAR), vec_id LIMIT 100")
def pixel_sample(spark, sf_dir):
    return bandstats.sampled_pixels(_raw(spark, sf_dir), 100).select("pixel_id")


@query(f"""SELECT i::INTEGER AS i, j::INTEGER AS j FROM (SELECT unnest(range({BANDS})) AS i), (SELECT unnest(range({BANDS})) AS j) WHERE j >= i + 5
  ORDER BY md5('42:' || i::VARCHAR || ':' || j::VARCHAR), i, j LIMIT 1000""")
def pair_sample(spark, sf_dir):
    bands = cubes.band_count(_raw(spark, sf_dir))
    return bandstats.sampled_pairs(pairwise.pair_domain(spark, bands, "nonadjacent"), 1000).select("i", "j")


def _coefficient(name: str) -> str:
    return f"('0x' || substr(md5('42:{name}:' || i::VARCHAR || ':' || j::VARCHAR), 1, 7))::BIGINT AS {name}"


@query(cells() + f""", p AS (SELECT i, i + 1 AS j FROM (SELECT unnest(range({BANDS - 1})) AS i)), q AS (SELECT i, j, {", ".join(map(_coefficient, "abc"))} FROM p),
  o AS (SELECT i, j, pixel_id, row_number() OVER (PARTITION BY i, j ORDER BY (a * (u * u % 2147483647) % 2147483647 + b * u % 2147483647 + c) % 2147483647, pixel_id) AS n
    FROM q, (SELECT vec_id AS pixel_id, vec_id::BIGINT % 2147483647 AS u FROM embeddings))
  SELECT i::INTEGER AS i, j::INTEGER AS j, pixel_id, round(x.v, 8) AS x, round(y.v, 8) AS y FROM o JOIN cells x USING (pixel_id) JOIN cells y USING (pixel_id) WHERE n <= 1000 AND x.band = i AND y.band = j""")
def pair_samples(spark, sf_dir):
    """Each adjacent pair's own sample of pixels."""
    pixels = _raw(spark, sf_dir)
    return _rounded(sketches.pair_samples(pixels, pairwise.pair_domain(spark, cubes.band_count(pixels), "adjacent")), "x", "y")


@query(cells() + ", p AS (SELECT band, row_number() OVER (ORDER BY md5('42:' || band::VARCHAR), band) - 1 AS t FROM (SELECT DISTINCT band FROM cells)) SELECT pixel_id, t::INTEGER AS band, round(v, 8) AS v FROM cells JOIN p USING (band)")
def band_permute(spark, sf_dir):
    return _rounded(bandstats.permuted(_cells(spark, sf_dir)).select("pixel_id", "band", "v"), "v")


@query(cells() + " SELECT band, round(var_pop(v), 8) AS value FROM cells GROUP BY band")
def cached_statistic(spark, sf_dir):
    path = sinks.new_path(spark, "variances")
    make = lambda: bandstats.variances(_cells(spark, sf_dir))
    sinks.cached(spark, path, make)
    return _rounded(sinks.cached(spark, path, make))


# ---- bands ------------------------------------------------------------------------------------------------------------


@query(cells() + " SELECT band, round(var_pop(v), 8) AS value FROM cells GROUP BY band")
def band_variance(spark, sf_dir):
    return _rounded(bandstats.variances(_cells(spark, sf_dir)))


ENTROPY = """, h AS (SELECT band, {bin} AS bin, any_value(n) AS n, count(*) AS m FROM cells JOIN stats USING (band) GROUP BY 1, 2)"""


@query(moments() + ENTROPY.format(bin=bin_of()) + " SELECT band, round(-sum(m / n * ln(m / n)), 8) AS value FROM h GROUP BY band")
def band_entropy(spark, sf_dir):
    return _rounded(bandstats.entropies(_cells(spark, sf_dir)))


@query(moments() + ENTROPY.format(bin=bin_of()) + " SELECT band, round(-sum(m / n * log2(m / n)), 8) AS value FROM h GROUP BY band")
def band_entropy_bits(spark, sf_dir):
    return _rounded(bandstats.entropies(_cells(spark, sf_dir), base2=True))


@query(cells() + ", e AS (SELECT band, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM cells GROUP BY band) SELECT pixel_id, band, len(list_filter(e, lambda x: x < v))::INTEGER AS bin FROM cells JOIN e USING (band)")
def quantile_bins(spark, sf_dir):
    return bandstats.binned(_cells(spark, sf_dir), 10).select("pixel_id", "band", "bin")


@query(moments() + f" SELECT pixel_id, band, {bin_of(bins=16)} AS bin FROM cells JOIN stats USING (band)")
def equal_bins(spark, sf_dir):
    return bandstats.binned(_cells(spark, sf_dir), 16, "equal").select("pixel_id", "band", "bin")


@query(moments() + ENTROPY.format(bin=bin_of()) + """, g AS (SELECT band, n, b::INTEGER AS bin FROM (SELECT DISTINCT band, n FROM stats), (SELECT unnest(range(256)) AS b))
  SELECT band, bin, round((coalesce(m, 0) / g.n + 1e-10::DOUBLE) / (1 + 256 * 1e-10::DOUBLE), 8) AS p FROM g LEFT JOIN h USING (band, bin)""")
def histogram_prob(spark, sf_dir):
    return _rounded(bandstats.probabilities(_cells(spark, sf_dir)), "p")


# ---- band pairs -------------------------------------------------------------------------------------------------------


@query(cells() + " " + oracle.pairs("round(sum(a.v * b.v), 8)", "cells"))
def band_gram(spark, sf_dir):
    return _rounded(pairwise.gram(_raw(spark, sf_dir)))


@query(cells() + " " + oracle.pairs("round(covar_samp(a.v, b.v), 8)", "cells"))
def band_cov(spark, sf_dir):
    return _rounded(pairwise.covariance(_raw(spark, sf_dir)))


@query(cells() + f", top AS (SELECT band FROM cells GROUP BY band ORDER BY var_pop(v) DESC, band LIMIT {K}) " + oracle.pairs("round(covar_samp(a.v, b.v), 8)", "cells", "a.band <= b.band AND a.band IN (FROM top) AND b.band IN (FROM top)"))
def band_submatrix(spark, sf_dir):
    """The covariance of the bands that vary most."""
    pixels = _raw(spark, sf_dir)
    return _rounded(pairwise.restricted(pairwise.covariance(pixels), select.top_bands(bandstats.variances(cubes.cells(pixels)), K)))


@query("WITH t AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, l_discount::DOUBLE AS c, l_tax::DOUBLE AS d FROM lineitem) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp({x}, {y}), 2) AS value FROM t" for i, x in enumerate("abcd") for j, y in enumerate("abcd") if i <= j))
def lineitem_cov(spark, sf_dir):
    return _rounded(pairwise.covariance(_lines(spark, sf_dir)), digits=2)


@query(cells() + " " + oracle.pairs("round(abs(corr(a.v, b.v)), 8)", "cells"))
def band_abs_corr(spark, sf_dir):
    return _rounded(pairwise.abs_correlation(_raw(spark, sf_dir)))


@query(cells() + " " + oracle.pairs("round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 8)", "cells"))
def band_distance(spark, sf_dir):
    return _rounded(pairwise.distances(_raw(spark, sf_dir)))


@query(oracle.distance() + " SELECT i, j, round(exp(-value / (2 * g * g)), 8) AS value FROM dist, (SELECT avg(value) / 30 AS g FROM dist) WHERE i <= j")
def band_rbf(spark, sf_dir):
    return _rounded(pairwise.rbf(_kept(pairwise.distances(_smooth(spark, sf_dir)))))


@query(cells() + " " + oracle.pairs("round(sum(abs(a.v - b.v))::FLOAT::DOUBLE, 4)", "cells", "a.band < b.band"))
def pairwise_function(spark, sf_dir):
    return _rounded(pairwise.additive_pairwise(_raw(spark, sf_dir), lambda x, y: abs(x - y).sum()), digits=4)


@query(cells() + " " + oracle.pairs("round(median(abs(a.v - b.v))::FLOAT::DOUBLE, 7)", "cells", "a.band < b.band"))
def pairwise_median(spark, sf_dir):
    return _rounded(pairwise.pairwise(_raw(spark, sf_dir), lambda x, y: np.median(abs(x - y))), digits=7)


@query(oracle.ssim3() + " SELECT i, j, round(value, 7) AS value FROM up")
def ssim_win3(spark, sf_dir):
    pixels = _dn(spark, sf_dir)
    low, high = pixels.agg(F.min(F.array_min("spectrum")), F.max(F.array_max("spectrum"))).first()
    return _rounded(spatial.ssim(pixels, high - low), digits=7)


@query(oracle.mssim() + " SELECT i, j, round(value, 7) AS value FROM up")
def mssim_win11(spark, sf_dir):
    return _rounded(spatial.mssim(_dn(spark, sf_dir)), digits=7)


PAD = "((m / n + 1e-10::DOUBLE) / (1 + {cells} * 1e-10::DOUBLE))"
EMPTY = "(1e-10::DOUBLE / (1 + {cells} * 1e-10::DOUBLE))"


def _padded(cells_: int) -> str:
    p, e = PAD.format(cells=cells_), EMPTY.format(cells=cells_)
    return f"-(sum({p} * log2({p})) + ({cells_} - count(*)) * {e} * log2({e}))"


@query(moments() + f""", b AS (SELECT pixel_id, band, n, {bin_of()} AS bin FROM cells JOIN stats USING (band)),
  h1 AS (SELECT band, {_padded(256)} AS h FROM (SELECT band, bin, any_value(n) AS n, count(*) AS m FROM b GROUP BY 1, 2) GROUP BY band),
  h2 AS (SELECT i, j, {_padded(65536)} AS h FROM (SELECT x.band AS i, y.band AS j, x.bin AS bx, y.bin AS byy, any_value(x.n) AS n, count(*) AS m FROM b x JOIN b y ON x.pixel_id = y.pixel_id AND x.band < y.band GROUP BY 1, 2, 3, 4) GROUP BY i, j)
  SELECT i, j, round(pow(1 - sqrt(greatest(2 * (p.h + q.h - h2.h) / (p.h + q.h + 1e-10::DOUBLE), 0)), 2), 7) AS value FROM h2 JOIN h1 p ON p.band = i JOIN h1 q ON q.band = j""")
def walumi_distance(spark, sf_dir):
    return _rounded(pairwise.information_distance(_raw(spark, sf_dir)), digits=7)


@query(moments() + f""", z AS (SELECT a.band AS i, b.band AS j, a.v AS x, b.v AS y, a.n AS n, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi
    FROM (SELECT * FROM cells JOIN stats USING (band)) a JOIN (SELECT * FROM cells JOIN stats USING (band)) b ON a.pixel_id = b.pixel_id AND a.band < b.band),
  u AS (SELECT i, j, n, {bin_of("x")} AS bin, 1 AS p, 0 AS q FROM z UNION ALL SELECT i, j, n, {bin_of("y")}, 0, 1 FROM z),
  t AS (SELECT i, j, (sum(p) / any_value(n) + 1e-10::DOUBLE) / (1 + 256 * 1e-10::DOUBLE) AS p, (sum(q) / any_value(n) + 1e-10::DOUBLE) / (1 + 256 * 1e-10::DOUBLE) AS q FROM u GROUP BY i, j, bin)
  SELECT i, j, round(sum((p - q) * (log2(p) - log2(q))), 7) AS value FROM t GROUP BY i, j""")
def skl_distance(spark, sf_dir):
    return _rounded(pairwise.symmetric_kl(_raw(spark, sf_dir)), digits=7)


CONDITIONAL = cells() + """, e AS (SELECT band, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM cells GROUP BY band),
  b AS (SELECT pixel_id, band, len(list_filter(e, lambda x: x < v)) AS bin FROM cells JOIN e USING (band)), t AS (SELECT count(DISTINCT pixel_id) AS t FROM cells),
  j2 AS (SELECT x.band, x.bin AS a, y.bin AS b, count(*) AS n FROM b x JOIN b y ON x.pixel_id = y.pixel_id AND y.band = x.band + 1 GROUP BY ALL),
  hj AS (SELECT band, -sum(n / t * ln(n / t)) AS h FROM j2, t GROUP BY band), hi AS (SELECT band, -sum(n / t * ln(n / t)) AS h FROM (SELECT band, a, sum(n) AS n FROM j2 GROUP BY 1, 2), t GROUP BY band),
  ce AS (SELECT band, hj.h - hi.h AS value FROM hj JOIN hi USING (band))"""


@query(CONDITIONAL + " SELECT band, round(value, 8) AS value FROM ce")
def adj_cond_entropy(spark, sf_dir):
    return _rounded(pairwise.adjacent_conditional_entropy(_raw(spark, sf_dir), 10))


@query(CONDITIONAL + " SELECT round(1 - stddev_pop(value) / avg(value), 8) AS value FROM ce")
def stationarity(spark, sf_dir):
    return _rounded(bandstats.stationarity(pairwise.adjacent_conditional_entropy(_raw(spark, sf_dir), 10)))


FIT = moments("smooth") + """, o AS (SELECT pixel_id, band, CASE WHEN abs(v - mean) > 3 * std THEN mean ELSE v END AS v FROM cells JOIN stats USING (band)),
  m AS (SELECT b.band, var_pop(a.v) AS s11, var_pop(c.v) AS s22, var_pop(b.v) AS yy, covar_pop(a.v, b.v) AS s1y, covar_pop(c.v, b.v) AS s2y, covar_pop(a.v, c.v) AS s12
    FROM o b JOIN o a ON a.pixel_id = b.pixel_id AND a.band = b.band - 1 JOIN o c ON c.pixel_id = b.pixel_id AND c.band = b.band + 1 GROUP BY b.band),
  fit AS (SELECT band, (s1y * s1y * s22 - 2 * s1y * s2y * s12 + s2y * s2y * s11) / ((s11 * s22 - s12 * s12) * yy) AS value FROM m)"""


def _fit(spark, sf_dir):
    return pairwise.neighbour_fit(_kept(bandstats.spectra_without_outliers(_smooth(spark, sf_dir))))


@query(FIT + " SELECT band, round(value, 7) AS value FROM fit")
def band_fit_r2(spark, sf_dir):
    return _rounded(_fit(spark, sf_dir), digits=7)


@query(FIT + " SELECT round(avg(value), 7) AS mean, round(quantile_cont(value, 0.5), 7) AS median, round(stddev_pop(value), 7) AS std, round(min(value), 7) AS min, round(max(value), 7) AS max FROM fit")
def r2_summary(spark, sf_dir):
    return _rounded(bandstats.summary(_fit(spark, sf_dir)), "mean", "median", "std", "min", "max", digits=7)


# ---- subspaces --------------------------------------------------------------------------------------------------------


@query(f"WITH {oracle.subsets(K)} SELECT {K} AS k, subset_id, pos, band FROM subsets")
def uniform_partition(spark, sf_dir):
    return _uniform(spark, sf_dir)


@query(oracle.distance() + """, c AS (SELECT i, j, sum(value) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM dist)
  SELECT i, j, round(sum(value) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM c""")
def prefix_sum_2d(spark, sf_dir):
    dist = pairwise.mirrored(_kept(pairwise.distances(_smooth(spark, sf_dir))), 0.0)
    rows = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return _rounded(dist.withColumn("value", F.sum("value").over(rows)).withColumn("value", F.sum("value").over(cols)).select("i", "j", "value"), digits=6)


@query(oracle.ocf(K_CUTS))
def ocf_k5(spark, sf_dir):
    return partition.ocf(pairwise.rbf(_kept(pairwise.distances(_smooth(spark, sf_dir)))), [K_CUTS])


@query(oracle.asps(K_CUTS))
def asps_k5(spark, sf_dir):
    return partition.asps(pairwise.distances(_smooth(spark, sf_dir)), [K_CUTS])


@query(oracle.mssim() + ", sim AS (SELECT i, j, value FROM up UNION ALL SELECT j, i, value FROM up UNION ALL SELECT DISTINCT band, band, 1.0::DOUBLE FROM cells), " + oracle.PEAK_SCORES + " SELECT band, round(value, 6) AS value FROM scores")
def gpc_score(spark, sf_dir):
    return _rounded(cuts.peak_scores(spatial.mssim(_dn(spark, sf_dir))), digits=6)


COARSE = oracle.mssim() + f""", sim AS (SELECT i, j, value FROM up UNION ALL SELECT j, i, value FROM up UNION ALL SELECT DISTINCT band, band, 1.0::DOUBLE FROM cells), {oracle.PEAK_SCORES},
  w0 AS (SELECT a.band AS i, b.band AS j, abs(sum(a.v * b.v)) AS value FROM cells a JOIN cells b ON a.pixel_id = b.pixel_id AND a.band <= b.band GROUP BY 1, 2),
  top AS (SELECT band FROM (SELECT band, row_number() OVER (ORDER BY value DESC, band) AS n FROM scores) WHERE n <= {K_CUTS}),
  gap AS (SELECT band AS a, lead(band) OVER (ORDER BY band) AS b, row_number() OVER (ORDER BY band) AS pos FROM top),
  cost AS (SELECT pos, t, sum(CASE WHEN i < t AND j >= t THEN value END) / (sum(CASE WHEN j < t THEN value END) * sum(CASE WHEN i >= t THEN value END)) AS cost
    FROM gap, (SELECT unnest(range({BANDS})) AS t) JOIN w0 ON true WHERE b - a > 3 AND t >= a + 2 AND t < b AND i >= a AND i <= b AND j >= a AND j <= b GROUP BY pos, t),
  best AS (SELECT pos, t FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY cost, t) AS n FROM cost) WHERE n = 1)
  SELECT pos::INTEGER AS pos, (CASE WHEN b - a <= 2 THEN a + 1 WHEN b - a = 3 THEN a + 2 ELSE t END)::INTEGER AS cut FROM gap LEFT JOIN best USING (pos) WHERE b IS NOT NULL
  UNION ALL SELECT 0, 0 UNION ALL SELECT {K_CUTS}, {BANDS}"""


@query(COARSE)
def gpc_coarse(spark, sf_dir):
    pixels = _kept(_dn(spark, sf_dir))
    return partition.coarse_cuts(spatial.mssim(pixels), pairwise.gram(pixels), K_CUTS)


@query()
def gpc(spark, sf_dir):
    pixels = _kept(_dn(spark, sf_dir))
    low, high = pixels.agg(F.min(F.array_min("spectrum")), F.max(F.array_max("spectrum"))).first()
    return partition.gpc(spatial.ssim(pixels, high - low), pairwise.gram(pixels), [K_CUTS, K])


@query()
def walumi_partition(spark, sf_dir):
    return partition.walumi(pairwise.information_distance(_smooth(spark, sf_dir)), [K_CUTS, K])


# ---- selection --------------------------------------------------------------------------------------------------------

VARIANCE = cells() + ", scores AS (SELECT band, var_pop(v) AS value FROM cells GROUP BY band)"


@query(VARIANCE + " " + oracle.top(K))
def mvpca(spark, sf_dir):
    return _rounded(select.top_bands(bandstats.variances(_cells(spark, sf_dir)), K))


@query(VARIANCE + f", {oracle.subsets(K)} " + oracle.best(K))
def mvpca_subset(spark, sf_dir):
    return _rounded(select.best_of_subsets(bandstats.variances(_cells(spark, sf_dir)), _uniform(spark, sf_dir)))


def _peaks(spark, sf_dir):
    return select.density_peaks(_kept(pairwise.mirrored(_kept(pairwise.distances(_smooth(spark, sf_dir))), 0.0)))


@query(oracle.distance() + f", {oracle.PEAKS} SELECT band, round(rho, 8) AS rho, round(delta, 8) AS delta, round(value, 8) AS value FROM scores")
def eca(spark, sf_dir):
    return _rounded(_peaks(spark, sf_dir), "rho", "delta", "value")


@query(oracle.distance() + f", {oracle.PEAKS}, {oracle.subsets(K)} " + oracle.best(K))
def eca_subset(spark, sf_dir):
    return _rounded(select.best_of_subsets(_peaks(spark, sf_dir).select("band", "value"), _uniform(spark, sf_dir)))


def _similarity(spark, sf_dir):
    return select.similarity_scores(_kept(pairwise.mirrored(_kept(pairwise.abs_correlation(_smooth(spark, sf_dir))), 1.0)))


@query(oracle.correlation() + f", {oracle.RANKING} " + oracle.top(K, 7))
def simrank(spark, sf_dir):
    return _rounded(select.top_bands(_similarity(spark, sf_dir).select("band", "value"), K), digits=7)


@query(oracle.correlation() + f", {oracle.RANKING}, {oracle.subsets(K)} " + oracle.best(K, 7))
def simrank_subset(spark, sf_dir):
    return _rounded(select.best_of_subsets(_similarity(spark, sf_dir).select("band", "value"), _uniform(spark, sf_dir)), digits=7)


@query()
def mcd(spark, sf_dir):
    return select.max_determinant(pairwise.covariance(_dn(spark, sf_dir)), [K_CUTS, K])


@query()
def mcd_subset(spark, sf_dir):
    return select.max_determinant(pairwise.covariance(_dn(spark, sf_dir)), [K], _uniform(spark, sf_dir))


@query()
def selfrep(spark, sf_dir):
    return select.self_representation(pairwise.gram(_smooth(spark, sf_dir)), [K_CUTS, K])


@query()
def selfrep_subset(spark, sf_dir):
    return select.self_representation(pairwise.gram(_smooth(spark, sf_dir)), [K], _uniform(spark, sf_dir))


@query(f"""WITH n AS (SELECT max(len(embedding))::DOUBLE AS l FROM embeddings) SELECT (r + 1)::INTEGER AS rank,
  round_even(l / {K} / 2 + r * ((l - 1 - l / {K}) / {K - 1}), 0)::INTEGER AS band FROM n, (SELECT unnest(range({K})) AS r)""")
def uniform_sample(spark, sf_dir):
    return select.uniform_sample(spark, cubes.band_count(_raw(spark, sf_dir)), K)


@query(f"WITH {oracle.subsets(K)} SELECT {K} AS k, subset_id, band FROM (SELECT *, row_number() OVER (PARTITION BY subset_id ORDER BY md5('42:' || band::VARCHAR), band) AS n FROM subsets) WHERE n = 1")
def random_subset(spark, sf_dir):
    return select.random_of_subsets(_uniform(spark, sf_dir))


@query(VARIANCE + f""", {oracle.subsets(K)}, o AS (SELECT band, row_number() OVER (ORDER BY value DESC, band) AS pos FROM scores),
  f AS (SELECT o.pos, band, subset_id, row_number() OVER (PARTITION BY subset_id ORDER BY o.pos) AS n FROM o JOIN subsets USING (band))
  SELECT pos, band, subset_id FROM f WHERE n = 1 ORDER BY pos LIMIT 6""")
def first_per_subset(spark, sf_dir):
    ranking = select.top_bands(bandstats.variances(_cells(spark, sf_dir)), cubes.band_count(_raw(spark, sf_dir))).select(F.col("rank").cast("long").alias("pos"), "band")
    return select.first_of_subsets(ranking, _uniform(spark, sf_dir), 6)


@query()
def selection_grid(spark, sf_dir):
    """All methods for every number of bands of an experiment."""
    catalog = experiment.Catalog(_kept(_dn(spark, sf_dir)), sinks.new_path(spark, "catalog"))
    return experiment.selection_grid(catalog)


# ---- evaluation -------------------------------------------------------------------------------------------------------


@query(f"WITH {oracle.split(10)} SELECT run_id, pixel_id, label, test FROM split")
def stratified_split(spark, sf_dir):
    return evaluate.stratified_split(cubes.foreground(_raw(spark, sf_dir)))


@query("SELECT toxic AS label, avg((quality = toxic)::INTEGER::DOUBLE) AS test_accuracy FROM labels GROUP BY toxic")
def accuracy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return evaluate.accuracy(rows.select(F.col("toxic").alias("label"), F.col("quality").alias("predicted")), "label")


def _results(spark, sf_dir):
    """Accuracies of ten runs of three methods, made from hashes of the labels table."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL")
    for name, values in (("run_id", list(range(10))), ("method", ["base", "base_smi", "base_same"]), ("n_selected_bands", [5, 10])):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    key = F.substring(F.md5(F.concat_ws(":", F.col("run_id").cast("string"), "method", F.col("n_selected_bands").cast("string"), F.col("doc_id").cast("string"))), 1, 1)
    right = F.when(key < F.when(F.col("method") == "base", "8").otherwise("9"), F.col("quality")).otherwise(1 - F.col("quality"))
    return rows.groupBy("run_id", "method", "n_selected_bands").agg(F.avg(right.cast("double")).alias("test_accuracy"))


@query(f"""WITH {oracle.RAW} SELECT method, n_selected_bands, round(avg(test_accuracy), 8) AS mean_test_accuracy, round(stddev_samp(test_accuracy), 8) AS std_test_accuracy,
  round(var_samp(test_accuracy), 8) AS var_test_accuracy, array_to_string(list_transform(list(test_accuracy ORDER BY run_id), lambda x: round(x * 100000000)::BIGINT), ',') AS raw_accuracy_list FROM raw_eval GROUP BY 1, 2""")
def eval_summary(spark, sf_dir):
    got = _rounded(evaluate.summarized(_results(spark, sf_dir)), "mean_test_accuracy", "std_test_accuracy", "var_test_accuracy")
    return got.withColumn("raw_accuracy_list", F.array_join(F.transform("raw_accuracy_list", lambda x: F.round(x * 100000000).cast("long").cast("string")), ","))


TESTS = f"""WITH {oracle.RAW}, d AS (SELECT a.method, a.n_selected_bands, a.test_accuracy - b.test_accuracy AS d FROM raw_eval a JOIN raw_eval b
    ON b.method = 'base' AND a.method <> 'base' AND a.run_id = b.run_id AND a.n_selected_bands = b.n_selected_bands),
  t AS (SELECT method, n_selected_bands, atan(abs(avg(d) / (stddev_samp(d) / sqrt(10))) / 3) AS a, stddev_samp(d) AS s FROM d GROUP BY 1, 2),
  p AS (SELECT method, n_selected_bands, CASE WHEN s > 1e-12 THEN 1 - 2 / pi() * (a + sin(a) * (cos(a) + 2.0::DOUBLE / 3 * pow(cos(a), 3) + 8.0::DOUBLE / 15 * pow(cos(a), 5) + 16.0::DOUBLE / 35 * pow(cos(a), 7))) END AS p FROM t
    UNION ALL SELECT DISTINCT method, n_selected_bands, NULL::DOUBLE FROM raw_eval WHERE method = 'base')"""


@query(TESTS + " SELECT method, n_selected_bands, round(p, 7) AS p_value_vs_baseline, CASE WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS significance_mark FROM p")
def paired_ttest(spark, sf_dir):
    base = spark.createDataFrame([("base_smi", "base"), ("base_same", "base")], "method string, baseline string")
    return _rounded(evaluate.paired_tests(_kept(_results(spark, sf_dir)), base), "p_value_vs_baseline", digits=7)


@query()
def svm_eval(spark, sf_dir):
    pixels = _kept(_smooth(spark, sf_dir))
    chosen = select.top_bands(bandstats.variances(cubes.cells(pixels)), K).select(F.lit("mvpca").alias("method"), F.lit(K).alias("k"), "rank", "band")
    spread = select.uniform_sample(spark, cubes.band_count(pixels), K).select(F.lit("unisam").alias("method"), F.lit(K).alias("k"), "rank", "band")
    return _rounded(evaluate.svm_evaluation(pixels, chosen.unionByName(spread)), "test_accuracy")


@query()
def experiment_summary(spark, sf_dir):
    """Statistics, all 32 methods, ten runs of classification and paired tests, for the fewest and the most bands."""
    found = experiment.run(_dn(spark, sf_dir), sinks.new_path(spark, "experiment"), experiment.Config(ks=(5, 30)))
    return found.select("method", "n_selected_bands", *(F.round(c, 6).alias(c) for c in ("mean_test_accuracy", "std_test_accuracy", "p_value_vs_baseline")), "significance_mark")


# ---- dependence -------------------------------------------------------------------------------------------------------


@query()
def mic_adj(spark, sf_dir):
    return _rounded(dependence.mic_adjacent(_smooth(spark, sf_dir)))


@query()
def mic_nonadj(spark, sf_dir):
    return _rounded(dependence.mic_nonadjacent(_smooth(spark, sf_dir)))


@query()
def mic_vs_lag(spark, sf_dir):
    return _rounded(dependence.mic_by_lag(_smooth(spark, sf_dir)))


@query()
def nmi(spark, sf_dir):
    pixels = _smooth(spark, sf_dir)
    return _rounded(dependence.nmi(pixels, pairwise.pair_domain(spark, cubes.band_count(pixels), "adjacent")))


@query()
def cnmi(spark, sf_dir):
    pixels = _smooth(spark, sf_dir)
    return _rounded(dependence.conditional_nmi(pixels, pairwise.pair_domain(spark, cubes.band_count(pixels), "lag", 2)))


@query()
def cmi_joint(spark, sf_dir):
    """Information of bands two apart given the left neighbour of the first."""
    pixels = _smooth(spark, sf_dir)
    return _rounded(dependence.joint_conditional(pixels, pairwise.pair_domain(spark, cubes.band_count(pixels), "lag", 2)))


@query()
def cis(spark, sf_dir):
    return _rounded(dependence.conditional_independence(_smooth(spark, sf_dir)))


ACC = oracle.correlation() + """, a AS (SELECT avg(value) AS ma, var_samp(value) AS va FROM up WHERE j = i + 1), b AS (SELECT avg(value) AS mb, var_samp(value) AS vb FROM up WHERE j >= i + 5)"""


def _acc(spark, sf_dir):
    corr = _kept(pairwise.abs_correlation(_smooth(spark, sf_dir)))
    return dependence.contrast(corr.where("j = i + 1"), corr.where("j >= i + 5"))


@query(ACC + " SELECT round(greatest(least(1 - exp(-pow(ma - mb, 2) / (va + vb + 1e-8::DOUBLE)), 1), 0), 8) AS value FROM a, b")
def acc(spark, sf_dir):
    return _rounded(_acc(spark, sf_dir))


@query(FIT + ", up AS (" + oracle.pairs("abs(corr(a.v, b.v))", "cells", "a.band < b.band") + ")" + ACC[ACC.index(", a AS ("):] + """,
  x AS (SELECT greatest(least(1 - exp(-pow(ma - mb, 2) / (va + vb + 1e-8::DOUBLE)), 1), 0) AS acc FROM a, b), y AS (SELECT greatest(avg(1 - value), 0) AS cis FROM fit)
  SELECT round(acc, 7) AS acc, round(cis, 7) AS cis, round(sqrt(acc * cis), 7) AS smi FROM x, y""")
def smi_index(spark, sf_dir):
    """The index with correlation for the coefficient and what neighbours leave unexplained for independence, so that SQL can follow."""
    fit = _fit(spark, sf_dir)
    return _rounded(dependence.spectral_index(_acc(spark, sf_dir), fit.withColumn("value", 1 - F.col("value"))), "acc", "cis", "smi", digits=7)


@query()
def smi_mic(spark, sf_dir):
    """The index as defined: coefficients of adjacent and distant pairs, and conditional independence."""
    pixels = _kept(_smooth(spark, sf_dir))
    contrast = dependence.contrast(dependence.mic_adjacent(pixels), dependence.mic_nonadjacent(pixels))
    return _rounded(dependence.spectral_index(contrast, dependence.conditional_independence(pixels)), "acc", "cis", "smi", digits=7)
