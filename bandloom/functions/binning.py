"""Column expressions for histograms and entropies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to every histogram cell before probabilities are taken.
EPS = 1e-10


def equal_width_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 0 .. bins-1 of equal width; the last one is closed. A range of zero puts all into bin 0."""
    width = F.when(hi > lo, hi - lo).otherwise(F.lit(1e-10))
    return F.greatest(F.least(F.floor((v - lo) / width * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def quantile_bin(v: Column, edges: Column) -> Column:
    """How many edges are below v."""
    return F.size(F.filter(edges, lambda e: e < v)).cast("int")


def entropy(n: Column, total: Column, base2: bool = False) -> Column:
    """Aggregate: entropy of cells with counts n of a total; cells without a count add nothing."""
    p = n.cast("double") / total
    return -F.sum(p * (F.log2(p) if base2 else F.log(p)))
