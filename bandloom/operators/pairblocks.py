"""Band pairs in blocks: pixels are dealt, band by band, to tasks that own a block of pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels that are dealt as one row.
SLAB_PIXELS = 1 << 16
#: Slabs of a block of pairs that are counted apart, and how many are merged at a time.
SLABS = 32
FAN_IN = 8
#: Counters of a task: pairs x cells of their joint histogram.
COUNTERS = 1 << 24
#: Pairs of whole bands that a task holds at a time: 4 bands by 4.
WHOLE_PAIRS = 16

Pairs = list[tuple[int, int]]


def blocks_of(pairs: Pairs, size: int) -> list[Pairs]:
    """The pairs in blocks of at most ``size`` which share their bands as far as can be: squares of the pair space."""
    side = max(1, math.isqrt(size))
    squares: dict[tuple[int, int], Pairs] = {}
    for i, j in sorted(pairs):
        squares.setdefault((i // side, j // side), []).append((i, j))
    return [own[k : k + size] for own in squares.values() for k in range(0, len(own), size)]


def dealt(pixels: DataFrame, blocks: list[Pairs], encode: Callable[[np.ndarray], np.ndarray], slabs: int) -> DataFrame:
    """``block, slab, place, n, data``: for every SLAB_PIXELS pixels and every block of pairs the values of its bands, band by band.

    A band goes to each block that has a pair of it: once for each of the squares along a side of the pair space.
    """
    needed = [sorted({b for pair in block for b in pair}) for block in blocks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            values = np.ascontiguousarray(encode(np.concatenate(held)).T)
            for k, bands in enumerate(needed):
                row = [[k], [(part + seen) % slabs], [part << 32 | seen], [values.shape[1]], [values[bands].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["block", "slab", "place", "n", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLAB_PIXELS):
                spectra = batch.column(0).slice(at, SLAB_PIXELS)
                held.append(spectra.flatten().to_numpy(zero_copy_only=False).reshape(len(spectra), -1))
            if sum(map(len, held)) >= SLAB_PIXELS:
                yield from flushed()
                held, seen = [], seen + 1
        if held:
            yield from flushed()

    return pixels.select("spectrum").mapInArrow(deal, "block int, slab int, place long, n long, data binary")


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[dict, bool]]:
    """Rows as dicts, each with whether it is the last one of its group."""
    before = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            if before is not None:
                yield before, any(before[x] != row[x] for x in keys)
            before = row
    if before is not None:
        yield before, True


def joint_values(pixels: DataFrame, bins_of: Callable[[np.ndarray], np.ndarray], bins: int, pairs: Pairs, finish: Callable[[np.ndarray], float]) -> DataFrame:
    """``i, j, value`` of each pair: ``finish`` of its joint histogram, a bins x bins matrix of counts over all pixels.

    ``bins_of`` turns a pixels x bands block into bins under ``bins``. Bins are dealt to (block of pairs, slab), one or two
    bytes each. A task counts a block of pairs over its whole slab in dense counters, which are merged in a tree: what
    leaves it are the occupied cells of each pair, whose number is bounded by pairs, bins and SLABS, not by the pixels.
    """
    kind = np.uint8 if bins <= 256 else np.uint16
    blocks = blocks_of(pairs, max(1, COUNTERS // bins**2))
    slabs = min(SLABS, 1 + pixels.count() // SLAB_PIXELS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for row, last in _grouped(batches, "block", "slab"):
            block = blocks[row["block"]]
            at = {b: k for k, b in enumerate(sorted({b for pair in block for b in pair}))}
            values = np.frombuffer(row["data"], kind).reshape(len(at), -1).astype(np.int32)
            total = np.zeros((len(block), bins * bins), np.int64) if total is None else total
            for k, (i, j) in enumerate(block):
                total[k] += np.bincount(values[at[i]] * bins + values[at[j]], minlength=bins * bins)
            if last:
                for (i, j), counters in zip(block, total):
                    yield _packed(i, j, row["slab"], counters)
                total = None

    schema = "i int, j int, slab int, cell binary, n binary"
    rows = dealt(pixels, blocks, lambda x: bins_of(x).astype(kind), slabs).repartition("block", "slab").sortWithinPartitions("block", "slab")
    counts = rows.mapInArrow(count, schema)
    while slabs > FAN_IN:
        slabs = -(-slabs // FAN_IN)
        up = F.floor(F.col("slab") / FAN_IN).cast("int")
        counts = counts.withColumn("slab", up).groupBy("i", "j", "slab").applyInPandas(lambda rows: _packed(rows.i[0], rows.j[0], rows.slab[0], _merged(rows, bins)).to_pandas(), schema)
    done = lambda rows: pd.DataFrame({"i": rows.i[:1], "j": rows.j[:1], "value": [finish(_merged(rows, bins).reshape(bins, bins))]})
    return counts.groupBy("i", "j").applyInPandas(lambda rows: done(rows), "i int, j int, value double")


def _packed(i: int, j: int, slab: int, counters: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(counters)
    row = [[i], [j], [slab], [used.astype(np.uint32).tobytes()], [counters[used].tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(),) * 3 + (pa.binary(),) * 2)], ["i", "j", "slab", "cell", "n"])


def _merged(rows: pd.DataFrame, bins: int) -> np.ndarray:
    total = np.zeros(bins * bins, np.int64)
    for cell, n in zip(rows.cell, rows.n):
        total[np.frombuffer(cell, np.uint32)] += np.frombuffer(n, np.int64)
    return total


def whole_values(pixels: DataFrame, pairs: Pairs, kernel: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """``i, j, value`` of each pair: ``kernel`` of the two bands' values over all pixels, in the same order for both.

    For functions that are no sums over pixels, such as medians and ranks. A task holds the bands of WHOLE_PAIRS pairs, 8
    of them, as doubles: 64 bytes for each pixel of the cube.
    """
    blocks = blocks_of(pairs, WHOLE_PAIRS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for row, last in _grouped(batches, "block"):
            block = blocks[row["block"]]
            at = {b: k for k, b in enumerate(sorted({b for pair in block for b in pair}))}
            parts.append(np.frombuffer(row["data"], np.float64).reshape(len(at), -1))
            if last:
                bands, parts = np.concatenate(parts, axis=1), []
                found = [(i, j, float(kernel(bands[at[i]], bands[at[j]]))) for i, j in block]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "value"])

    rows = dealt(pixels, blocks, lambda x: x.astype(np.float64), 1).repartition("block").sortWithinPartitions("block", "place")
    return rows.mapInArrow(of, "i int, j int, value double")
