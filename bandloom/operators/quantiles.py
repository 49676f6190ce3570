"""Exact order statistics of every band by radix narrowing: what is shuffled are counts of ranges of values, not values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
#: Bits of the first ranges: sign, exponent and eight bits of the fraction.
FIRST_BITS = 20
#: Ranges that a task counts at most in a later pass, which gives the bits by which that narrows.
COUNTERS = 1 << 22
#: Counts that a task holds before it adds them up.
HELD = 1 << 20


def sort_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one value, and a NaN is the largest."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    raw = values.view(np.uint64)
    negative = raw >> np.uint64(BITS - 1) == 1
    return np.where(negative, ~raw, raw | np.uint64(1 << (BITS - 1)))


class _Ranges:
    """Counts, smallest and largest values of ranges (slot, next bits), added up as they come."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, code: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if len(code):
            order = np.argsort(code, kind="stable")
            code = code[order]
            at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            self.parts.append((code[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)))
            self.rows += len(at)
            if len(self.parts) > 1 and self.rows > HELD:
                self.merged()

    def merged(self) -> tuple:
        parts, self.parts, self.rows = self.parts, [], 0
        if parts:
            self.add(*(np.concatenate(c) for c in zip(*parts)))
        if self.parts and self.rows > HELD:
            self.rows = 0  # all of them differ
        return self.parts[0] if self.parts else ()


def _counter(slots: tuple[np.ndarray, np.ndarray, np.ndarray], done: int, bits: int):
    """Rows ``slot, digit, n, lo, hi`` of the values in the slots (band, bits of the key so far, slot number, in order)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Ranges()
        bands, prefixes, numbers = slots
        names, firsts = np.unique(bands, return_index=True)
        starts = dict(zip(names.tolist(), zip(firsts.tolist(), [*firsts[1:].tolist(), len(bands)])))
        for batch in batches:
            band, v = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            key = sort_keys(v)
            for b in np.unique(band).tolist():
                if b not in starts:
                    continue
                lo, hi = starts[b]
                own = band == b
                k, x = key[own], v[own] + 0.0
                place = np.searchsorted(prefixes[lo:hi], k >> np.uint64(BITS - done)) if done else np.zeros(len(k), np.int64)
                place = np.minimum(place, hi - lo - 1)
                kept = prefixes[lo:hi][place] == (k >> np.uint64(BITS - done) if done else 0)
                digit = (k[kept] >> np.uint64(BITS - done - bits)) & np.uint64((1 << bits) - 1)
                code = numbers[lo:hi][place[kept]] << bits | digit.astype(np.int64)
                found.add(code, np.ones(len(code), np.int64), x[kept], x[kept])
        if merged := found.merged():
            code, n, lo, hi = merged
            for at in range(0, len(code), HELD):
                s = slice(at, at + HELD)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (code[s] >> bits, code[s] & ((1 << bits) - 1), n[s], lo[s], hi[s])], ["slot", "digit", "n", "lo", "hi"])

    return count


def at_ranks(cells: DataFrame, ranks: Column, first_bits: int = FIRST_BITS, counters: int = COUNTERS) -> DataFrame:
    """``band, total, rank, v``: the values of the given ranks (from 0 on) of each band.

    ``ranks`` is an array that may depend on ``total``, the band's number of values; ranks outside give no row. Nulls take
    no part. A pass over the cells counts them by ranges of the leading bits of their keys, tasks adding up their own
    first; only ranges that hold a wanted rank are told apart further. A range whose values are all alike is done. So a
    shuffle carries at most the number of ranges for each task, however many cells there are, and the ranges kept, at most
    one for each wanted rank of a band, are all that comes to the driver.
    """
    spark = cells.sparkSession
    cells = cells.where("v IS NOT NULL").select(F.col("band").cast("int").alias("band"), F.col("v").cast("double").alias("v"))
    wanted = F.array_distinct(F.filter(ranks.cast("array<bigint>"), lambda r: (r >= 0) & (r < F.col("total"))))
    totals = cells.groupBy("band").agg(F.count("*").alias("total")).select("band", "total", wanted.alias("ranks")).where("size(ranks) > 0")
    rows = totals.collect()
    total = {r.band: r.total for r in rows}
    kept = [(r.band, 0, 0, r.ranks) for r in rows]
    found, done, bits = [], 0, first_bits
    while kept:
        kept.sort(key=lambda r: r[:2])
        bits = min(bits, BITS - done)
        arrays = (np.array([r[0] for r in kept]), np.array([r[1] for r in kept], np.uint64), np.arange(len(kept)))
        counts = cells.mapInArrow(_counter(arrays, done, bits), "slot long, digit long, n long, lo double, hi double")
        counts = counts.groupBy("slot", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        slots = spark.createDataFrame([(k, first, own) for k, (_, _, first, own) in enumerate(kept)], "slot long, first long, ranks array<long>")
        upto = F.sum("n").over(Window.partitionBy("slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        ranged = counts.withColumn("upto", upto).join(F.broadcast(slots), "slot").withColumn("first", F.col("first") + F.col("upto") - F.col("n"))
        inside = F.filter("ranks", lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n")))
        alike = F.col("lo").eqNullSafe(F.col("hi")).alias("alike")
        done, before, kept = done + bits, kept, []
        for r in ranged.select("slot", "digit", "first", "lo", alike, inside.alias("ranks")).where("size(ranks) > 0").collect():
            band, prefix = before[r.slot][:2]
            if r.alike or done == BITS:
                found += [(band, total[band], rank, r.lo) for rank in r.ranks]
            else:
                kept.append((band, prefix << bits | r.digit, r.first, r.ranks))
        bits = max(1, (counters // max(1, len(kept))).bit_length() - 1)
    return spark.createDataFrame(found, "band int, total long, rank long, v double")


def quantile_edges(cells: DataFrame, bins: int) -> DataFrame:
    """``band, edges``: the inner percentiles, linearly interpolated; exact. Nulls take no part."""
    inner = F.sequence(F.lit(1), F.lit(bins - 1)) if bins > 1 else F.array().cast("array<int>")
    place = lambda k: (F.col("total") - 1) * (k / F.lit(bins))
    ranks = F.concat(F.array(F.lit(0)), F.flatten(F.transform(inner, lambda k: F.array(F.floor(place(k)), F.ceil(place(k))))))
    values = at_ranks(cells, ranks).groupBy("band", "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def edge(k: Column) -> Column:
        low, high = (F.element_at("at", f(place(k)).cast("long")) for f in (F.floor, F.ceil))
        share = place(k) - F.floor(place(k))
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    return values.select("band", F.transform(inner, edge).alias("edges"))
