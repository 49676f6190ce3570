"""SQL for the queries of the registry, over the same tables."""

from __future__ import annotations

from bandloom.functions.kernels import uniform_sizes

BANDS = 64

PIXELS = """px AS (
  SELECT vec_id AS pixel_id, (vec_id // 25)::INTEGER AS r, (vec_id % 25)::INTEGER AS c, label, embedding FROM embeddings
), raw AS (
  SELECT pixel_id, r, c, label, unnest(range(len(embedding)))::INTEGER AS band, unnest(embedding)::DOUBLE AS v FROM px
), smooth AS (
  SELECT pixel_id, r, c, label, band,
    sum(v) OVER (PARTITION BY pixel_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM raw
), dn AS (
  SELECT pixel_id, r, c, label, band, floor((v + 5) * 100) AS v FROM smooth
), lines AS (
  SELECT l_orderkey AS pixel_id, unnest(range(4))::INTEGER AS band,
    unnest([l_quantity, l_extendedprice, l_discount, l_tax])::DOUBLE AS v FROM lineitem
)"""


def cells(source: str = "raw") -> str:
    return f"WITH {PIXELS}, cells AS (SELECT * FROM {source})"


def moments(source: str = "raw") -> str:
    return cells(source) + ", stats AS (SELECT band, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM cells GROUP BY band)"


def bin_of(v: str = "v", lo: str = "lo", hi: str = "hi", bins: int = 256) -> str:
    return f"greatest(least(floor(({v} - {lo}) / (CASE WHEN {hi} > {lo} THEN {hi} - {lo} ELSE 1e-10::DOUBLE END) * {bins}), {bins - 1}), 0)::INTEGER"


def pairs(select: str, source: str = "raw", where: str = "a.band <= b.band") -> str:
    return f"SELECT a.band AS i, b.band AS j, {select} AS value FROM {source} a JOIN {source} b ON a.pixel_id = b.pixel_id AND {where} GROUP BY 1, 2"


def subsets(k: int) -> str:
    rows, start = [], 0
    for s, size in enumerate(uniform_sizes(BANDS, k)):
        rows += [f"({s}, {p}, {start + p})" for p in range(size)]
        start += size
    return f"subsets AS (SELECT * FROM (VALUES {', '.join(rows)}) t(subset_id, pos, band))"


def distance(source: str = "smooth") -> str:
    return cells(source).replace("cells AS (", "cells AS MATERIALIZED (") + ", up AS MATERIALIZED (" + pairs("sqrt(sum((a.v - b.v) * (a.v - b.v)))", "cells", "a.band < b.band") + """
), dist AS MATERIALIZED (SELECT i, j, value FROM up UNION ALL SELECT j, i, value FROM up UNION ALL SELECT DISTINCT band, band, 0.0::DOUBLE FROM cells)"""


def correlation(source: str = "smooth") -> str:
    return cells(source) + ", up AS (" + pairs("abs(corr(a.v, b.v))", "cells", "a.band < b.band") + """
), sim AS (SELECT i, j, value FROM up UNION ALL SELECT j, i, value FROM up UNION ALL SELECT DISTINCT band, band, 1.0::DOUBLE FROM cells)"""


TAPS = """taps AS (SELECT o::INTEGER AS o, w / sum(w) OVER () AS w FROM (SELECT unnest(range(-5, 6)) AS o, exp(-(unnest(range(-5, 6)) * unnest(range(-5, 6)))::DOUBLE / 4.5) AS w))"""


def blurred(name: str, source: str, keys: str) -> str:
    """A Gaussian blur of ``source(keys, r, c, v)`` with mirrored edges: along rows, then along columns."""
    mirror = lambda at, size: f"CASE WHEN {at} < 0 THEN -{at} - 1 WHEN {at} >= {size} THEN 2 * {size} - {at} - 1 ELSE {at} END"
    k = keys.split(", ")
    on = " AND ".join(f"s.{x} = t.{x}" for x in k)
    return f"""{name}_grid AS (SELECT DISTINCT {keys}, r, c FROM {source}),
{name}_h AS (SELECT {", ".join("t." + x for x in k)}, t.r, t.c, sum(w * s.v) AS v FROM {name}_grid t, taps, size
  JOIN {source} s ON true WHERE {on} AND s.c = t.c AND s.r = {mirror("(t.r + o)", "h")} GROUP BY ALL),
{name} AS (SELECT {", ".join("t." + x for x in k)}, t.r, t.c, sum(w * s.v) AS v FROM {name}_grid t, taps, size
  JOIN {name}_h s ON true WHERE {on} AND s.r = t.r AND s.c = {mirror("(t.c + o)", "wd")} GROUP BY ALL)"""


def mssim(source: str = "dn", level: float = 255.0) -> str:
    c1, c2 = (0.01 * level) ** 2, (0.03 * level) ** 2
    c3 = c2 / 2
    return f"""{cells(source)}, size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS wd FROM cells), {TAPS},
one AS (SELECT band, r, c, v FROM cells), sq AS (SELECT band, r, c, v * v AS v FROM cells),
two AS (SELECT a.band AS i, b.band AS j, a.r, a.c, a.v * b.v AS v FROM cells a JOIN cells b ON a.pixel_id = b.pixel_id AND a.band < b.band),
{blurred("mu", "one", "band")}, {blurred("ms", "sq", "band")}, {blurred("mp", "two", "i, j")},
st AS (SELECT mu.band, mu.r, mu.c, mu.v AS m, greatest(ms.v - mu.v * mu.v, 0) AS s FROM mu JOIN ms USING (band, r, c)),
up AS (SELECT p.i, p.j, avg((2 * a.m * b.m + {c1}::DOUBLE) / (a.m * a.m + b.m * b.m + {c1}::DOUBLE) * (2 * sqrt(a.s * b.s) + {c2}::DOUBLE)
    / (a.s + b.s + {c2}::DOUBLE) * (p.v - a.m * b.m + {c3}::DOUBLE) / (sqrt(a.s * b.s) + {c3}::DOUBLE)) AS value
  FROM mp p JOIN st a ON a.band = p.i AND a.r = p.r AND a.c = p.c JOIN st b ON b.band = p.j AND b.r = p.r AND b.c = p.c GROUP BY 1, 2)"""


def ssim3(source: str = "dn") -> str:
    return f"""{cells(source)}, span AS (SELECT max(v) - min(v) AS g, max(r) AS h, max(c) AS wd FROM cells),
p AS (SELECT a.band AS i, b.band AS j, a.r, a.c, trunc(a.v) AS x, trunc(b.v) AS y FROM cells a JOIN cells b ON a.pixel_id = b.pixel_id AND a.band < b.band),
q AS (SELECT i, j, r, c, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(x * x) OVER w AS xx, sum(y * y) OVER w AS yy, sum(x * y) OVER w AS xy
  FROM p WINDOW w AS (PARTITION BY i, j, r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
s AS (SELECT i, j, r, c, sum(x) OVER w / 9 AS x, sum(y) OVER w / 9 AS y, sum(xx) OVER w / 9 AS xx, sum(yy) OVER w / 9 AS yy, sum(xy) OVER w / 9 AS xy
  FROM q WINDOW w AS (PARTITION BY i, j, c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
up AS (SELECT i, j, avg((2 * x * y + k1) * (2 * cov + k2) / ((x * x + y * y + k1) * (vx + vy + k2))) AS value
  FROM (SELECT s.*, 9.0::DOUBLE / 8 * (xx - x * x) AS vx, 9.0::DOUBLE / 8 * (yy - y * y) AS vy, 9.0::DOUBLE / 8 * (xy - x * y) AS cov,
    (0.01::DOUBLE * g) * (0.01::DOUBLE * g) AS k1, (0.03::DOUBLE * g) * (0.03::DOUBLE * g) AS k2 FROM s, span WHERE r BETWEEN 1 AND h - 1 AND c BETWEEN 1 AND wd - 1)
  GROUP BY i, j)"""


PEAKS = """rho AS (SELECT i, sum(exp(-value / (2 * s2))) AS rho FROM dist, (SELECT avg(value) / 30 AS s2 FROM dist) GROUP BY i),
near AS (SELECT d.i, a.rho, min(CASE WHEN b.rho > a.rho THEN d.value END) AS near, max(d.value) AS far FROM dist d JOIN rho a ON a.i = d.i JOIN rho b ON b.i = d.j GROUP BY 1, 2),
peaks AS (SELECT i AS band, rho, CASE WHEN row_number() OVER (ORDER BY rho DESC, i) = 1 THEN far ELSE coalesce(near, 0) END AS delta FROM near),
scores AS (SELECT band, rho, delta, rho * delta AS value FROM peaks)"""

RANKING = """alpha AS (SELECT i, coalesce(avg(CASE WHEN value > 0.8 THEN value END), 0) AS alpha FROM sim GROUP BY i),
ranked AS (SELECT *, row_number() OVER (ORDER BY alpha DESC, i) AS place FROM alpha),
phi0 AS (SELECT a.i, a.alpha, a.place, max(CASE WHEN b.place < a.place THEN s.value END) AS phi FROM sim s JOIN ranked a ON a.i = s.i JOIN ranked b ON b.i = s.j GROUP BY ALL),
phi AS (SELECT i, alpha, CASE WHEN place = 1 THEN coalesce(min(CASE WHEN phi > 0 THEN phi END) OVER (), 0) ELSE phi END AS phi FROM phi0),
theta AS (SELECT i, alpha, sqrt(greatest(1 - phi * phi, 0)) AS theta FROM phi),
scores AS (SELECT i AS band, alpha, theta, (alpha - min(alpha) OVER ()) / (max(alpha) OVER () - min(alpha) OVER () + 1e-10::DOUBLE)
  * ((theta - min(theta) OVER ()) / (max(theta) OVER () - min(theta) OVER () + 1e-10::DOUBLE)) AS value FROM theta)"""


def top(k: int, digits: int = 8) -> str:
    return f"SELECT rank::INTEGER AS rank, band, round(value, {digits}) AS value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, band) AS rank FROM scores) WHERE rank <= {k}"


def best(k: int, digits: int = 8) -> str:
    return f"""SELECT {k} AS k, subset_id, band, round(value, {digits}) AS value FROM (SELECT *, row_number() OVER (PARTITION BY subset_id ORDER BY value DESC, band) AS n
  FROM scores JOIN subsets USING (band)) WHERE n = 1"""


def ocf(k: int) -> str:
    """Layers of the best sum over the first bands, with the cuts carried along."""
    layers = ["l1 AS (SELECT hi AS h, value, [hi]::INTEGER[] AS cuts FROM score WHERE lo = 0)"]
    for n in range(2, k + 1):
        layers.append(f"""l{n} AS (SELECT h, value, cuts FROM (SELECT s.hi AS h, p.value + s.value AS value, list_append(p.cuts, s.hi) AS cuts,
  row_number() OVER (PARTITION BY s.hi ORDER BY p.value + s.value DESC, p.h) AS n FROM l{n - 1} p JOIN score s ON s.lo = p.h) WHERE n = 1)""")
    return f"""{distance()}, sigma AS (SELECT avg(value) / 30 AS g FROM dist),
kernel AS (SELECT i, j, CASE WHEN i = j THEN 1 ELSE exp(-value / (2 * g * g)) END AS value FROM dist, sigma),
cum AS (SELECT i, j, sum(value) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM kernel),
area AS (SELECT i + 1 AS i, j + 1 AS j, sum(value) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM cum
  UNION ALL SELECT 0, b, 0 FROM (SELECT unnest(range({BANDS + 1})) AS b) UNION ALL SELECT b, 0, 0 FROM (SELECT unnest(range(1, {BANDS + 1})) AS b)),
score AS (SELECT lo::INTEGER AS lo, hi::INTEGER AS hi, CASE WHEN abs(w.s - z.s) < 1e-12 THEN 0 ELSE (a.s - b.s - c.s + d.s) / (w.s - z.s) END AS value
  FROM (SELECT lo, hi FROM (SELECT unnest(range({BANDS})) AS lo), (SELECT unnest(range(1, {BANDS + 1})) AS hi) WHERE lo < hi)
  JOIN area a ON a.i = hi AND a.j = hi JOIN area b ON b.i = lo AND b.j = hi JOIN area c ON c.i = hi AND c.j = lo JOIN area d ON d.i = lo AND d.j = lo
  JOIN area w ON w.i = hi AND w.j = {BANDS} JOIN area z ON z.i = lo AND z.j = {BANDS}),
{", ".join(layers)}, cut AS (SELECT cuts FROM l{k} WHERE h = {BANDS}), edge AS (SELECT unnest(range(len(cuts))) AS subset_id, unnest(cuts) AS hi FROM cut),
span AS (SELECT subset_id, coalesce(lag(hi) OVER (ORDER BY subset_id), 0) AS lo, hi FROM edge)
SELECT {k} AS k, subset_id::INTEGER AS subset_id, (b - lo)::INTEGER AS pos, b::INTEGER AS band FROM span, (SELECT unnest(range({BANDS})) AS b) WHERE b >= lo AND b < hi"""


def asps(k: int) -> str:
    """Each step moves one cut; the next sees it."""
    start = [BANDS * 0]
    for p in range(k):
        start.append(start[-1] + BANDS // k + (p < BANDS % k))
    steps = [f"c0 AS (SELECT {start}::INTEGER[] AS cuts)"]
    for p in range(k - 1):
        steps.append(f"""t{p} AS (SELECT cuts[{p + 1}] AS lo, cuts[{p + 3}] AS hi, t FROM c{p}, (SELECT unnest(range({BANDS})) AS t) WHERE t >= cuts[{p + 1}] + 2 AND t < cuts[{p + 3}] - 1),
s{p} AS (SELECT t, sum(CASE WHEN i < t AND j < t THEN value ELSE 0 END) / any_value((t - lo) * (t - lo - 1)) + sum(CASE WHEN i >= t AND j >= t THEN value ELSE 0 END) / any_value((hi - t) * (hi - t - 1)) AS within,
  max(CASE WHEN i < t AND j >= t THEN value END) AS across FROM t{p} JOIN dist ON i >= lo AND i < hi AND j >= lo AND j < hi GROUP BY t),
c{p + 1} AS (SELECT list_concat(list_concat(cuts[1:{p + 1}], [coalesce((SELECT t FROM s{p} ORDER BY CASE WHEN within < 1e-12 THEN CASE WHEN across > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE across / within END DESC, t LIMIT 1), cuts[{p + 2}])]), cuts[{p + 3}:]) AS cuts FROM c{p})""")
    return f"""{distance()}, {", ".join(steps)}, edge AS (SELECT unnest(range({k})) AS subset_id, unnest(cuts[1:{k}]) AS lo, unnest(cuts[2:]) AS hi FROM c{k - 1})
SELECT {k} AS k, subset_id::INTEGER AS subset_id, (b - lo)::INTEGER AS pos, b::INTEGER AS band FROM edge, (SELECT unnest(range({BANDS})) AS b) WHERE b >= lo AND b < hi"""


PEAK_SCORES = """upper AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS n, count(*) OVER () AS m FROM up),
level AS (SELECT avg(value) AS level FROM upper WHERE n >= floor(m * 0.05::DOUBLE) AND n <= floor(m * 0.1::DOUBLE) - 1),
alpha AS (SELECT i, coalesce(avg(CASE WHEN value > level THEN value END), 0) AS alpha FROM sim, level GROUP BY i),
ranked AS (SELECT *, row_number() OVER (ORDER BY alpha DESC, i) AS place FROM alpha),
phi0 AS (SELECT a.i, a.alpha, a.place, greatest(max(CASE WHEN b.place < a.place THEN s.value END), 0) AS phi FROM sim s JOIN ranked a ON a.i = s.i JOIN ranked b ON b.i = s.j GROUP BY ALL),
phi AS (SELECT i, alpha, CASE WHEN place = 1 THEN least(min(CASE WHEN place > 1 THEN phi END) OVER (), 1) ELSE phi END AS phi FROM phi0),
theta AS (SELECT i, alpha, sqrt(1 - phi * phi) AS theta FROM phi),
scores AS (SELECT i AS band, (alpha - min(alpha) OVER ()) / (max(alpha) OVER () - min(alpha) OVER ()) * ((theta - min(theta) OVER ()) / (max(theta) OVER () - min(theta) OVER ())) AS value FROM theta)"""


def split(runs: int) -> str:
    return f"""labels_in AS (SELECT vec_id AS pixel_id, label FROM embeddings WHERE label <> 0),
split AS (SELECT run_id, pixel_id, label, n <= floor(0.2::DOUBLE * size + 0.5) AS test FROM (SELECT run_id, pixel_id, label,
  row_number() OVER (PARTITION BY run_id, label ORDER BY md5((run_id + 42)::VARCHAR || ':' || pixel_id::VARCHAR), pixel_id) AS n, count(*) OVER (PARTITION BY run_id, label) AS size
  FROM labels_in, (SELECT unnest(range({runs}))::INTEGER AS run_id)))"""


#: Accuracies by run and method made of hashes of the documents' labels, for the summary and the tests.
RAW = """raw_eval AS (
  SELECT run_id::INTEGER AS run_id, method, k::INTEGER AS n_selected_bands,
    avg(CASE WHEN substr(md5(run_id::VARCHAR || ':' || method || ':' || k::VARCHAR || ':' || doc_id::VARCHAR), 1, 1) < CASE WHEN method = 'base' THEN '8' ELSE '9' END THEN quality ELSE 1 - quality END::DOUBLE) AS test_accuracy
  FROM labels, (SELECT unnest(range(10)) AS run_id), (SELECT unnest(['base', 'base_smi', 'base_same']) AS method), (SELECT unnest([5, 10]) AS k)
  WHERE quality IS NOT NULL GROUP BY 1, 2, 3
), tested AS (SELECT run_id, CASE WHEN method = 'base_same' THEN method ELSE method END AS method, n_selected_bands, test_accuracy FROM raw_eval)"""
