"""Exact top-k inner-product search by columnar branch-and-bound."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.shared import materialize

SCALE = 256
TOP = 5
EVERY = 50
#: Vectors in a block of candidates, and in a block of queries.
BLOCK = 2048
QUERY_BLOCK = 256
#: Bytes of queries that a cell of the grid holds at most, at 8 for each component.
CELL_BYTES = 64 << 20
#: Blocks of candidates that stream past a cell's queries at most, and partitions of cells at most.
CELL_BLOCKS = 512
CELL_PARTS = 20_000
#: Dimensions that are accumulated between two bounds.
STEP = 16
#: Share of surviving pairs from which they are kept as a list instead of a matrix.
SPARSE = 0.2
#: Sums beyond this are not exact in double precision.
EXACT = 1 << 53


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v`` with whole components floor(256 * x); without vectors that are null or hold a null or non-finite one, and without null ids."""
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(ok)
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _blocks(size: int):
    """Packs rows into blocks: ids, and components in vertical layout (dimension by vector), in the least width; and their mean squared norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = part.column(1).to_pylist()
                dims = max(map(len, rows), default=0)
                grid = np.zeros((dims, len(rows)), np.int64)
                for k, row in enumerate(rows):
                    grid[: len(row), k] = row
                most = int(np.abs(grid).max(initial=0))
                power = float((grid.astype(np.float64) ** 2).sum() / max(1, len(rows)))
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column(0)).astype(np.int64).tobytes()]), pa.array([grid.astype(f"i{width}").tobytes()]), pa.array([width]), pa.array([power])], ["ids", "grid", "width", "power"])

    return pack


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every``, its ``top`` best others.

    The score is the integer inner product; ties go to the smaller vec_id. Rows with the query's own vec_id are no
    candidates of it. Rows that repeat a query's vec_id with another vector are queries of their own, equal rows one
    query; candidates that repeat count each. Vectors of unequal length count as padded with zeros, and scores beyond a
    long as its limit. A table without valid vectors gives an empty result; other columns are ignored.

    Both sides are packed into blocks and dealt over a grid. A cell holds queries of CELL_BYTES at most (131 072 queries
    of 64 dimensions) and streams up to CELL_BLOCKS candidate blocks past them, so memory is bounded at any size: a
    candidate is copied once for each 131 072 queries, a query once for each 512 blocks, or less where the tables are too
    small to keep all cores busy. First, the block of candidates with the greatest norms gives each query a bar that its top scores
    must reach, and every cell starts from it. In a cell the inner products grow STEP dimensions at a time; pairs whose
    sum plus the product of the remaining norms is under the query's current ``top``-th score go.
    """
    rows = scaled(vectors)
    spark, schema = rows.sparkSession, "ids binary, grid binary, width long, power double"
    candidates = materialize(rows.mapInArrow(_blocks(BLOCK), schema), "vector-blocks")
    asked = materialize(rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(), "queries")
    count, dims = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cell = max(1, CELL_BYTES // (BLOCK * 8 * max(1, dims)))  # packs of BLOCK queries
    packs = -(-count // BLOCK)
    across = -(-packs // cell)
    packed = asked.repartition(packs).mapInArrow(_blocks(QUERY_BLOCK), schema)
    queries = materialize(packed.withColumn("col", F.floor(F.spark_partition_id() / cell).cast("int")), "query-blocks")
    blocks = candidates.count()
    down = -(-blocks // max(1, min(CELL_BLOCKS, blocks * across // (4 * spark.sparkContext.defaultParallelism))))
    name = F.xxhash64("ids")
    seed = candidates.where(name == candidates.agg(F.max_by(name, "power")).first()[0]).limit(1)
    barred = materialize(_cells(queries.withColumn("bars", F.lit(None).cast("binary")), seed, 1, across, _run(top, _barred), "ids binary, grid binary, width long, bars binary, col int"), "query-bars")
    found = _cells(barred, candidates, down, across, _run(top, _pairs), "query_id long, query long, vec_id long, score long")
    place = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _cells(queries: DataFrame, candidates: DataFrame, down: int, across: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over the cells of a grid: those of a column share queries, those of a row share candidate blocks."""
    left = queries.withColumns({"side": F.lit(0), "row": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
    right = candidates.withColumns({"row": F.pmod(F.xxhash64("ids"), F.lit(down)).cast("int"), "side": F.lit(1), "bars": F.lit(None).cast("binary")})
    right = right.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    names = ["row", "col", "side", "bars", "ids", "grid", "width"]
    cells = left.select(*names).unionByName(right.select(*names)).repartition(min(down * across, CELL_PARTS), "row", "col")
    return cells.sortWithinPartitions("row", "col", "side").mapInArrow(run, schema)


def _run(top: int, result: Callable[[_Cell, int], Iterator[pa.RecordBatch]]):
    """Streams each cell's candidate blocks past its queries; ``result`` makes rows of what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for part in range(b.num_rows) for r in b.slice(part, 1).to_pylist())
        for (_, col), group in itertools.groupby(rows, lambda r: (r["row"], r["col"])):
            held, cell = [], None
            for r in group:
                if r["side"] == 0:
                    held.append(r)
                elif held:
                    cell = cell or _Cell(held, top)
                    cell.add(*_grid(r))
            if cell:
                yield from result(cell, col)

    return run


def _pairs(cell: _Cell, col: int) -> Iterator[pa.RecordBatch]:
    for q in cell.queries:
        x, vec, score = q.pairs
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q.ids[x], q.key[x], vec, score)], ["query_id", "query", "vec_id", "score"])


def _barred(cell: _Cell, col: int) -> Iterator[pa.RecordBatch]:
    for r, q in zip(cell.held, cell.queries):
        columns = [[r["ids"]], [r["grid"]], [r["width"]], [q.bar.tobytes()]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([col], pa.int32())], ["ids", "grid", "width", "bars", "col"])


def _grid(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["grid"], f"i{row['width']}").reshape(-1, len(ids))


class _Cell:
    """Blocks of queries, each with its best candidates so far."""

    def __init__(self, held: list[dict], top: int):
        self.held = held
        grids = [_grid(r)[1] for r in held]
        self.dims = max(map(len, grids))
        energy = sum(np.pad((g.astype(np.float64) ** 2).sum(axis=1), (0, self.dims - len(g))) for g in grids)
        self.order = np.argsort(-energy, kind="stable")  # dimensions that tell most come first
        self.queries = [_Best(r, self.dims, self.order, top) for r in held]
        self.most = max((q.most for q in self.queries), default=0)

    def add(self, ids: np.ndarray, grid: np.ndarray) -> None:
        """A block of candidates; dimensions that no query has add nothing."""
        v = np.pad(grid[: self.dims].astype(np.int64), ((0, max(0, self.dims - len(grid))), (0, 0)))[self.order]
        bound = self.most * int(np.abs(v).max(initial=0)) * max(self.dims, 1)
        v = v.astype(np.float64 if bound < EXACT else object)
        rest = _suffix_norms(v)
        for q in self.queries:
            q.add(ids, v, rest)


class _Best:
    """The best candidates so far of a block of queries."""

    def __init__(self, row: dict, dims: int, order: np.ndarray, top: int):
        self.ids, grid = _grid(row)
        self.top, self.most = top, int(np.abs(grid.astype(np.int64)).max(initial=0))
        # a query is told by its id and content, so that cells agree on it
        self.key = np.array([xxhash.xxh64_intdigest(np.trim_zeros(c, "b").tobytes()) for c in grid.astype(np.int64).T], np.uint64).view(np.int64)
        self.q = np.pad(grid, ((0, dims - len(grid)), (0, 0)))[order]
        self.rest = _suffix_norms(self.q)
        self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.bar = np.full(len(self.ids), -np.inf) if row["bars"] is None else np.frombuffer(row["bars"]).copy()

    def add(self, ids: np.ndarray, v: np.ndarray, rest: np.ndarray) -> None:
        q, dims = self.q.astype(np.int64).astype(v.dtype), len(self.q)
        total = np.zeros((q.shape[1], v.shape[1]), v.dtype)
        x = y = None
        for step, at in enumerate(range(0, dims, STEP), 1):
            cut = slice(at, at + STEP)
            if x is None:
                total += q[cut].T @ v[cut]
                if at + STEP < dims:
                    alive = total + np.outer(self.rest[step], rest[step]) >= self.bar[:, None]
                    if alive.mean() < SPARSE:
                        x, y = np.nonzero(alive)
                        total = total[x, y]
            else:
                total += (q[cut][:, x] * v[cut][:, y]).sum(axis=0)
                alive = total + self.rest[step][x] * rest[step][y] >= self.bar[x]
                x, y, total = x[alive], y[alive], total[alive]
        if x is None:
            total = np.where(self.ids[:, None] == ids[None, :], -np.inf, total)
            n = total.shape[1]
            least = np.partition(total, n - self.top, axis=1)[:, n - self.top] if n > self.top else np.full(len(total), -np.inf)
            x, y = np.nonzero((total >= least[:, None]) & (total >= self.bar[:, None]))
            total = total[x, y]
        other = self.ids[x] != ids[y]
        x, y, total = x[other], y[other], total[other]
        if not len(x):
            return
        whole = np.array([max(-(1 << 63), min((1 << 63) - 1, t)) for t in total.tolist()], np.int64) if v.dtype == object else total.astype(np.int64)
        x, vec, score = (np.concatenate(p) for p in zip(self.pairs, (x, ids[y], whole)))
        order = np.lexsort((vec, ~score, x))
        x, vec, score = x[order], vec[order], score[order]
        first = np.searchsorted(x, np.arange(len(self.ids)))
        place = np.arange(len(x)) - first[x]
        keep = place < self.top
        self.pairs = x[keep], vec[keep], score[keep]
        full = keep & (place == self.top - 1)
        # just under the score, as that may not be exact in double precision
        self.bar[x[full]] = np.maximum(self.bar[x[full]], np.nextafter(score[full].astype(np.float64), -np.inf))


def _suffix_norms(grid: np.ndarray) -> np.ndarray:
    """Row s: an upper bound of each column's norm over the dimensions from s * STEP on."""
    squares = grid.astype(np.float64) ** 2
    parts = [squares[at : at + STEP].sum(axis=0) for at in range(0, len(grid), STEP)]
    sums = np.cumsum([np.zeros(grid.shape[1]), *parts[::-1]], axis=0)[::-1]
    return np.sqrt(sums) * (1 + 1e-9) + 1e-6 * (sums > 0)
