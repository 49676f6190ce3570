"""The dependence queries take the operators' own sizes; shared estimates give the same index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import kernels
from bandloom.operators import dependence
from bandloom.plans import registry

SF = "/root/testdata/sf0.001"
#: Pairs of 64 bands that each query rates.
PAIRS = {"mic_adj": [63], "mic_nonadj": [1000], "mic_vs_lag": [1925], "nmi": [63], "cnmi": [61], "cmi_joint": [61], "cis": [64 * 64], "smi_mic": [63, 1000, 64 * 64]}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_queries_take_the_whole_sample(spark, monkeypatch, name):
    seen = []

    def counted(pixels, pairs, kernel, n):
        seen.append((pairs.count(), n))
        return pairs.withColumn("value", F.lit(0.5))

    monkeypatch.setattr(dependence, "_for_pairs", counted)
    registry.QUERIES[name](spark, SF)
    assert sorted(seen) == [(p, 1000) for p in PAIRS[name]]


def test_conditional_independence_matches_pairs(spark):
    x = np.random.default_rng(5).normal(size=(80, 6)).cumsum(axis=1)
    x[:, 4] = 1.0
    pixels = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pixel_id long, spectrum array<double>")
    own = [kernels.ksg(x[:, b], x[:, b]) for b in range(6)]
    want = {}
    for i in range(1, 5):
        others = [j for j in range(6) if abs(i - j) >= 2]
        free = np.mean([2 * kernels.ksg(x[:, i], x[:, j]) / (own[i] + own[j]) if own[i] + own[j] else 0.0 for j in others])
        given = np.mean([dependence._conditional(x, i, j) for j in others])
        want[i] = 1 - (min(max(given / free, 0), 1) if free else 1.0)
    got = {r.band: r.value for r in dependence.conditional_independence(pixels).collect()}
    assert got == pytest.approx(want)


def test_joint_conditional_takes_the_left_neighbour(spark):
    x = np.random.default_rng(6).normal(size=(90, 5)).cumsum(axis=1)
    pixels = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pixel_id long, spectrum array<double>")
    pairs = spark.createDataFrame([(0, 3), (1, 0), (1, 3), (2, 4), (4, 1)], "i int, j int")
    got = {(r.i, r.j): r.value for r in dependence.joint_conditional(pixels, pairs).collect()}
    assert got == pytest.approx({(i, j): kernels.conditional_ksg(x[:, i], x[:, j], x[:, i - 1]) for i, j in [(1, 3), (2, 4), (4, 1)]})
