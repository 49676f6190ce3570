"""Near-duplicates among embeddings: a subspace pigeonhole join on cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.llm.shared import components, materialize, with_lookup
from bandloom.llm.simhash import _joined

THRESHOLD = 0.98
SEED = 13
#: Dimensions of the smallest block, and how many blocks there are at least where there are as many dimensions.
BLOCK_DIMS = 8
MIN_BLOCKS = 4
#: Vectors of the largest label that a cell should hold, and rows of a cell from which it is cut into chunks.
CELL_ROWS = 1024
CHUNK_ROWS = 2048
#: Cells whose chunk counts are broadcast at most.
HEAVY_CELLS = 100_000
#: Vectors that are dealt at a time, and numbers that a check of pairs holds at a time.
DEAL_ROWS = 1024
CHECK_NUMBERS = 1 << 22
#: Slack of squared distances, far above rounding; candidates are checked exactly.
SLACK = 1e-9
CELL = ("label", "block", "cell")
UNIT = (*CELL, "x", "y")


class Layout(NamedTuple):
    """How rotated unit vectors are cut: dimensions in all and in a block, gridded dimensions of a block, side of a cell and
    the block's share of the squared distance."""

    dims: int
    block: int
    grid: int
    side: float
    budget: float

    @property
    def blocks(self) -> int:
        return self.dims // self.block


def layout(dims: int, vectors: int, threshold: float = THRESHOLD) -> Layout:
    """The cheapest cut with about CELL_ROWS of ``vectors`` in a cell; any cut finds all pairs.

    Unit vectors of cosine >= threshold are at a squared distance of 2 - 2 threshold at most; of equal blocks, one has no
    more than its share of that. Bits that a gridded dimension tells apart, and the cells that a vector reaches, are
    estimated for vectors spread evenly.
    """
    dims = 1 << max(0, dims - 1).bit_length()
    wanted = max(0.0, math.log2(max(vectors, 1) / CELL_ROWS))
    found = []
    block = min(BLOCK_DIMS, dims)
    while block <= max(dims // MIN_BLOCKS, min(BLOCK_DIMS, dims)):
        budget = (2 - 2 * threshold) * block / dims
        for wide in (2, 4):
            side = wide * math.sqrt(budget)
            bits = max(0.1, math.log2(1 + math.sqrt(2 * math.pi * math.e / dims) / side))
            grid = min(block, math.ceil(wanted / bits))
            near = sum(math.comb(grid, j) * (2 / wide) ** j * math.pi ** (j / 2) / math.gamma(j / 2 + 1) / 2**j for j in range(1, grid + 1))
            missing = max(0.0, wanted - grid * bits)
            found.append((dims / block * (1 + near / 2) * 2**missing, block, grid, side, budget))
        block *= 2
    _, block, grid, side, budget = min(found)
    return Layout(dims, block, grid, side, budget)


def rotated(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Unit vectors under a fixed random rotation: signs and Hadamard matrices, which spread any vector over all dimensions."""
    out = np.zeros((len(vectors), dims))
    out[:, : vectors.shape[1]] = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (2, dims))
    for s in signs:
        out = out * s
        half = 1
        while half < dims:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(out), dims)
            half *= 2
        out /= math.sqrt(dims)
    return out


def reached(coordinates: np.ndarray, plan: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is a guest, for each vector's own cell and the earlier ones that its ball touches.

    Of two vectors in different cells within the budget, that of the later cell so is a guest in the earlier one.
    """
    n = len(coordinates)
    z = coordinates[:, : plan.grid]
    own = np.floor(z / plan.side).astype(np.int32)
    low = z - own * plan.side
    row, cost, cells, guest = np.arange(n), np.zeros(n), np.zeros((n, 0), np.int32), np.zeros(n, bool)
    limit = plan.budget * (1 + SLACK) + SLACK
    for k in range(plan.grid):
        options = []
        for step in (0, -1, 1):
            far = cost + (0 if step == 0 else (low[row, k] if step < 0 else plan.side - low[row, k]) ** 2)
            take = (far <= limit) & (guest | (step <= 0))
            cell = np.concatenate((cells[take], (own[row[take], k] + step)[:, None]), axis=1)
            options.append((row[take], far[take], cell, guest[take] | (step < 0)))
        row, cost, cells, guest = (np.concatenate(c) for c in zip(*options))
    return row, cells, guest


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors as rows of doubles, each scaled by a power of two so that squares neither overflow nor vanish."""
    rows = [np.frombuffer(v, kind) for v in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None]) if out.size else out


def _dealer(plan: Layout, kind: str, whole: bool):
    """Rows ``label, block, cell`` for each cell that a vector reaches, with what a join needs of it if ``whole``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DEAL_ROWS):
                part = batch.slice(at, DEAL_ROWS)
                z = rotated(_matrix(part.column("v"), kind), plan.dims)
                for b in range(plan.blocks):
                    row, cells, guest = reached(z[:, b * plan.block : (b + 1) * plan.block], plan)
                    take = pa.array(row)
                    cell = pa.array([c.tobytes() for c in cells], pa.binary())
                    columns = [part.column("label").take(take), pa.array(np.full(len(row), b, np.int32)), cell]
                    if whole:
                        columns += [pa.array(guest), *(part.column(c).take(take) for c in ("id", "n", "v"))]
                    yield pa.RecordBatch.from_arrays(columns, [*CELL, "guest", "id", "n", "v"][: len(columns)])

    return deal


class _Unit:
    """The rows of a cell, or of two of its chunks, and the links between them that this cell is to count."""

    def __init__(self, batch: pa.RecordBatch, plan: Layout, kind: str, threshold: float):
        self.plan, self.threshold, self.block = plan, threshold, batch.column("block")[0].as_py()
        self.two = batch.column("x")[0].as_py() != batch.column("y")[0].as_py()
        self.second = np.asarray(batch.column("second").to_numpy(zero_copy_only=False), bool)
        self.guest = np.asarray(batch.column("guest").to_numpy(zero_copy_only=False), bool)
        self.id, self.n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("id", "n"))
        self.v = _matrix(batch.column("v"), kind)
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        self.z = rotated(self.v, plan.dims)
        self.links, self.label = np.zeros(len(self.id), np.int64), np.arange(len(self.id))

    def run(self) -> pa.RecordBatch:
        order = np.arange(len(self.id))
        left, right = (order[~self.second], order[self.second]) if self.two else (order, order)
        for i in range(0, len(left), CHUNK_ROWS):
            for j in range(0 if self.two else i, len(right), CHUNK_ROWS):
                self._tile(left[i : i + CHUNK_ROWS], right[j : j + CHUNK_ROWS], not self.two and i == j)
        linked = self.links > 0
        return pa.RecordBatch.from_arrays([pa.array(self.id[linked]), pa.array(self.id[self.label[linked]]), pa.array(self.links[linked])], ["a", "b", "links"])

    def _tile(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        own = slice(self.block * self.plan.block, (self.block + 1) * self.plan.block)
        a, b = self.z[left, own], self.z[right, own]
        near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T) <= self.plan.budget + 2 * SLACK
        near &= ~(self.guest[left][:, None] & self.guest[right])
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        rows = max(1, CHECK_NUMBERS // max(self.plan.dims, self.v.shape[1]))
        for at in range(0, len(i), rows):
            self._check(left[i[at : at + rows]], right[j[at : at + rows]])

    def _check(self, x: np.ndarray, y: np.ndarray) -> None:
        cosine = np.einsum("ij,ij->i", self.v[x], self.v[y]) / (self.norm[x] * self.norm[y])
        x, y = x[cosine >= self.threshold], y[cosine >= self.threshold]
        # a pair may lie near in several blocks; the first of them counts it
        parts = (self.z[x] - self.z[y]).reshape(len(x), self.plan.blocks, self.plan.block)
        within = (parts * parts).sum(axis=2) <= self.plan.budget + SLACK
        mine = within.argmax(axis=1) == self.block
        x, y = x[mine], y[mine]
        np.add.at(self.links, x, self.n[y])
        np.add.at(self.links, y, self.n[x])
        self.label = _joined(self.label, x, y)


def _joiner(plan: Layout, kind: str, threshold: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if rows.num_rows > 1:
                yield _Unit(rows, plan, kind, threshold).run()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in UNIT]
            new = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                new |= pa.compute.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                now = tuple(c[lo].as_py() for c in columns)
                if held and now != key:
                    yield from done()
                    held.clear()
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return join


def links(classes: DataFrame, dims: int, kind: str, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, links``: parts of the sums of links of class ``a``, and edges to ``b`` that span the linked ones.

    ``classes`` has a row ``id, label, n, v`` for each different vector. Vectors are rotated and cut into blocks; a pair
    within the threshold is within the block's share of the squared distance in one block at least. For each block, a
    range join deals vectors to the cells of a grid on its first dimensions, and to the cells before that their ball
    touches. Candidates are checked by their cosine, and the first block that has them counts them: what leaves a task
    are counts and a spanning star, not pairs. A cell of more rows than CHUNK_ROWS (with over HEAVY_CELLS times as many
    rows in all, their share of these) is cut into chunks, and pairs of chunks are units of their own.
    """
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = layout(dims, most, threshold)
    narrow = classes.select("label", "v").mapInArrow(_dealer(plan, kind, False), "label string, block int, cell binary")
    sizes = materialize(narrow.groupBy(*CELL).agg(F.count("*").alias("rows")), "cells")
    bound = max(CHUNK_ROWS, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // HEAVY_CELLS))
    heavy = sizes.where(F.col("rows") > bound).select(*CELL, F.ceil(F.col("rows") / bound).cast("int").alias("chunks"))
    dealt = classes.mapInArrow(_dealer(plan, kind, True), "label string, block int, cell binary, guest boolean, id long, n long, v binary")
    rows = dealt.join(F.broadcast(heavy), list(CELL), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"x": F.least("chunk", "other"), "y": F.greatest("chunk", "other"), "second": F.col("chunk") > F.col("other")})
    units = rows.select(*UNIT, "second", "guest", "id", "n", "v").repartition(*UNIT).sortWithinPartitions(*UNIT)
    return units.mapInArrow(_joiner(plan, kind, threshold), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows of equal labels link if their cosine is ``threshold`` or more (over 0). ``component_id`` is the smallest vec_id
    reachable, and ``kept`` tells whether it is the row's own. Rows whose label or vector is null, or whose vector is zero
    or holds a null or non-finite component, link with nothing. Equal vectors of a label are one class with a count, so
    that copies aren't expanded into pairs. Vectors of unequal length count as padded with zeros. Rows that repeat a vec_id
    count each. A null vec_id links like others and never is the smallest, unless no other is there. Other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    width = "float" if kind == "f4" else "double"
    valid = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vector = F.when(valid & F.col("label").isNotNull(), F.col("embedding").cast(f"array<{width}>"))
    label = F.col("label").cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("v"))
    rows = rows.withColumn("key", F.sha2(F.concat(F.octet_length("label").cast("string"), F.lit(":"), "label", F.col("v").cast("string")), 256))
    known = rows.where("v IS NOT NULL")
    classes = known.groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    dims = classes.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        named = classes.select("key", "n", F.col("n").alias("links"), F.col("low").alias("component_id"))
    else:
        packed = materialize(classes.select("id", "label", "n", "v").mapInArrow(_packer(kind), "id long, label string, n long, v binary"), "vectors")
        found = materialize(links(packed, dims, kind, threshold), "vector-links")
        sums = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
        roots = components(found).select(F.col("node").alias("id"), "root")
        owned = classes.select("id", "key", "low", "n").join(sums, "id", "left").join(roots, "id", "left")
        owned = owned.select("key", "low", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "id").alias("root"))
        owned = materialize(owned, "vector-roots")
        best = materialize(owned.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("classes")), "vector-best")
        named = materialize(with_lookup(owned, best, "root", "classes").select("key", "n", "links", "component_id"), "vector-named")
    joined = with_lookup(rows.where("v IS NOT NULL").select("vec_id", "key"), named, "key", "n").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _packer(kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(v, kind).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "n")), pa.array(packed, pa.binary())], ["id", "label", "n", "v"])

    return pack
