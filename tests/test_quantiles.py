import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import quantiles


def test_keys_follow_the_order_of_doubles():
    v = np.array([-np.inf, -1e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 2.0, np.inf, np.nan])
    keys = quantiles.sort_keys(v)
    assert (keys[1:] > keys[:-1]).all()
    assert quantiles.sort_keys(np.array([-0.0]))[0] == quantiles.sort_keys(np.array([0.0]))[0]


def values():
    rng = np.random.default_rng(3)
    near = 1.0 + np.arange(40) * 2.0**-52  # told apart by their last bits alone
    return {0: rng.normal(size=500), 1: np.repeat([2.0, -3.0], [300, 1]), 2: near, 3: np.array([7.5]), 4: np.concatenate((rng.normal(size=99) * 1e-310, [-0.0, 0.0])), 5: rng.integers(-5, 5, 400).astype(float)}


@pytest.mark.parametrize(("first_bits", "counters"), [(16, 1 << 22), (3, 4096), (40, 1 << 12)])
def test_any_width_of_the_digits(spark, first_bits, counters):
    rows = [(b, float(x)) for b, v in values().items() for x in v] + [(0, None), (9, None)]
    cells = spark.createDataFrame(rows, "band int, v double").repartition(5)
    ranks = F.array(*(F.lit(r) for r in (0, 1, 17, 17, 300, 499, 10_000, -1)))
    got = {(r.band, r.rank): r.v for r in quantiles.at_ranks(cells, ranks, first_bits, counters).collect()}
    assert got == {(b, r): np.sort(v)[r] for b, v in values().items() for r in (0, 1, 17, 300, 499) if r < len(v)}


@pytest.mark.parametrize("bins", [1, 2, 10, 1024])
def test_percentiles(spark, bins):
    rows = [(b, float(x)) for b, v in values().items() for x in v]
    got = {r.band: r.edges for r in quantiles.quantile_edges(spark.createDataFrame(rows, "band int, v double"), bins).collect()}
    for b, v in values().items():
        place = (len(v) - 1) * (np.arange(1, bins) / bins)
        low, high = np.sort(v)[np.floor(place).astype(int)], np.sort(v)[np.ceil(place).astype(int)]
        share = place - np.floor(place)
        assert np.array_equal(got[b], np.where(low == high, low, low * (1 - share) + high * share))


def test_shuffled_counts_do_not_follow_the_cells(spark):
    """Ten times the values: as many ranges."""
    def rows(times):
        cells = spark.range(64 * 50 * times).select((F.col("id") % 4).cast("int").alias("band"), (F.col("id") % 3200).cast("double").alias("v")).coalesce(2)
        counter = quantiles._counter((np.arange(4), np.zeros(4, np.uint64), np.arange(4)), 0, 16)
        return cells.mapInArrow(counter, "slot long, digit long, n long, lo double, hi double").count()

    assert rows(10) == rows(40)


def test_empty(spark):
    cells = spark.createDataFrame([], "band int, v double")
    assert quantiles.quantile_edges(cells, 4).count() == 0
