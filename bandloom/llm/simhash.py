"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of binary tries."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.llm.shared import components, materialize, with_lookup

SHINGLE_WORDS = 4
SEED = 42
BUDGET = 4
#: Fingerprints in one side of a unit of work; a trie node that holds more is split into its descendants.
NODE_ROWS = 512
#: Node pairs that one traversal may hold before pruning.
FRONTIER = 1_000_000
#: Levels that a heavy node goes down at once.
SPLIT_BITS = 8
BITS = 64
#: What tells a unit of work: its trie, and the two nodes and their depth.
UNIT = ("trie", "depth", "x", "y")


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of a text: bit set if set in over half of its shingles' XXH64, repeats included.

    A-Z is lower-cased, words are runs without ASCII white space. Fewer words than a shingle make one shingle of them
    all; no word (or null) gives zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE_WORDS - 1 :] if len(words) >= SHINGLE_WORDS else ends[-1:]
    total = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], np.dtype(">u8"))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(last)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every whole text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, fp long")


def forests(count: int) -> list[list[tuple[int, int]]]:
    """Bit orders of the tries, as lists of (offset, length) blocks with the exact ones first, and their number.

    With m blocks, fingerprints that differ in at most BUDGET bits agree on m - BUDGET blocks at least; there is a trie
    for each choice of these, under whose first nodes all pairs are found. More fingerprints take more blocks, so that
    a first node keeps few; every choice of m is exact.
    """
    blocks = BUDGET + 1
    while BITS * (blocks - BUDGET) // blocks < np.log2(max(count, 2)) - 6 and blocks < 2 * BUDGET:
        blocks += 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [(lo, hi - lo) for lo, hi in itertools.pairwise(cuts)]
    return [[*lead, *(s for s in spans if s not in lead)] for lead in map(list, itertools.combinations(spans, blocks - BUDGET))]


def _reordered(fp: Column, order: list[tuple[int, int]]) -> Column:
    out, at = F.lit(0).cast("long"), 0
    for offset, length in order:
        part = F.shiftrightunsigned(fp, BITS - offset - length).bitwiseAND(F.lit((1 << length) - 1).cast("long"))
        out, at = out.bitwiseOR(F.shiftleft(part, BITS - at - length)), at + length
    return out


def _prefix(bits: str, depth: int) -> Column:
    return F.shiftrightunsigned(bits, BITS - depth) if depth < BITS else F.col(bits)


def links(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges ``a, b`` that span every component of the distinct fingerprints ``fp`` under links of at most ``budget`` bits.

    The self-join goes down binary tries from node pairs: pairs of children add a differing bit, and those beyond the
    budget go. Spark's unit of work is a trie node; one that holds more than ``node_rows`` fingerprints is replaced by
    the pairs of its descendants SPLIT_BITS levels below (itself a step of the same traversal), as often as needed, so
    no task gets an unbounded group. Pairs whose ends a unit has already joined are pruned: of a dense group each unit
    returns a spanning star, not all pairs. No link between components is lost.
    """
    fps = fps.where("fp is not null")
    orders = forests(fps.count())
    lead = min(sum(n for _, n in order[: len(order) - BUDGET]) for order in orders)
    tries = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("trie"), _reordered(F.col("fp"), o).alias("bits")) for i, o in enumerate(orders)))).alias("t")).select("fp", "t.*")
    node = _prefix("bits", lead).alias("node")
    heavy = materialize(tries.groupBy("trie", node).count().where(F.col("count") > node_rows), "trie-nodes")
    light, units, depth, pairs = tries, [], lead, None
    if not heavy.isEmpty():
        pairs = heavy.select("trie", F.col("node").alias("x"), F.col("node").alias("y"), F.lit(0).alias("diff"))
        light = tries.withColumn("node", node).join(heavy, ["trie", "node"], "left_anti")
        deep = materialize(tries.withColumn("node", node).join(heavy, ["trie", "node"], "left_semi").drop("node"), "trie-deep")
    while pairs is not None:
        up, depth = depth, min(depth + SPLIT_BITS, BITS)
        sizes = materialize(deep.groupBy("trie", _prefix("bits", up).alias("up"), _prefix("bits", depth).alias("node")).agg(F.count("*").alias("n")), "trie-nodes")
        one = sizes.select("trie", F.col("up").alias("x"), F.col("node").alias("cx"), F.col("n").alias("nx"))
        two = sizes.select("trie", F.col("up").alias("y"), F.col("node").alias("cy"), F.col("n").alias("ny"))
        below = F.lit((1 << (depth - up)) - 1).cast("long")
        differ = F.bit_count(F.col("cx").bitwiseAND(below).bitwiseXOR(F.col("cy").bitwiseAND(below)))
        pairs = pairs.join(one, ["trie", "x"]).join(two, ["trie", "y"]).where((F.col("x") != F.col("y")) | (F.col("cx") <= F.col("cy")))
        pairs = pairs.withColumn("diff", F.col("diff") + differ).where((F.col("diff") <= budget) & ~((F.col("cx") == F.col("cy")) & (F.col("nx") < 2)))
        pairs = materialize(pairs.select("trie", F.col("cx").alias("x"), F.col("cy").alias("y"), "diff", F.greatest("nx", "ny").alias("n")), "trie-pairs")
        small = pairs.where(F.col("n") <= node_rows) if depth < BITS else pairs
        members = deep.select("fp", "trie", "bits", _prefix("bits", depth).alias("node"))
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("node")), F.struct(F.when(F.col("x") != F.col("y"), 1).alias("side"), F.col("y").alias("node")))
        ends = small.select("trie", "x", "y", "diff", F.explode(sides).alias("e")).select("trie", "x", "y", "diff", "e.*").where("side is not null")
        units.append(members.join(ends, ["trie", "node"]).select("trie", F.lit(depth).alias("depth"), "x", "y", "diff", "side", "bits", "fp"))
        pairs = pairs.where(F.col("n") > node_rows).drop("n") if depth < BITS else None
        if pairs is not None and pairs.isEmpty():
            pairs = None
    first = _prefix("bits", lead)
    work = light.select("trie", F.lit(lead).alias("depth"), first.alias("x"), first.alias("y"), F.lit(0).alias("diff"), F.lit(0).alias("side"), "bits", "fp")
    for more in units:
        work = work.unionByName(more)
    work = work.repartition(*UNIT).sortWithinPartitions(*UNIT, "side")
    return work.mapInArrow(_walker(budget), "a long, b long")


def _walker(budget: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns]))
            rows = np.concatenate(held, axis=1) if held else np.zeros((8, 0), np.int64)
            if not rows.shape[1]:
                continue
            new = (np.diff(rows[: len(UNIT)]) != 0).any(axis=0)
            unit, edge = np.concatenate(([0], np.cumsum(new))), np.flatnonzero(new) + 1
            bounds = np.concatenate(([0], edge, [rows.shape[1]] if batch is None else []))
            held = [] if batch is None else [rows[:, int(bounds[-1]) :]]
            first, total = 0, 0
            for k in range(1, len(bounds)):
                total += (bounds[k] - bounds[k - 1]) ** 2
                if total >= FRONTIER or k == len(bounds) - 1:
                    part = slice(int(bounds[first]), int(bounds[k]))
                    a, b = _spanning((unit[part], rows[1, part], *rows[len(UNIT) :, part]), budget)
                    first, total = k, 0
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return walk


def _spanning(rows: tuple[np.ndarray, ...], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links within the given units (unit, depth, diff, side, bits, fp by row)."""
    unit, depth, diff, side, bits, fp = rows
    bits = bits.view(np.uint64)
    order = np.lexsort((bits, side, unit))
    unit, depth, diff, side, bits, fp = unit[order], depth[order], diff[order], side[order], bits[order], fp[order]
    n = len(fp)
    cut = np.flatnonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1])) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
    one = np.flatnonzero(side[lo] == 0)
    two = np.minimum(one + 1, len(lo) - 1)
    two = np.where((side[lo[two]] == 1) & (unit[lo[two]] == unit[lo[one]]), two, one)
    pairs = [lo[one], hi[one], lo[two], hi[two], diff[lo[one]]]
    level = depth[lo[one]]

    near = np.flatnonzero((unit[1:] == unit[:-1]) & (np.bitwise_count(bits[1:] ^ bits[:-1]) <= budget))
    label = _joined(np.arange(n), near, near + 1)
    front = [p[:0] for p in pairs]
    for d in range(int(level.min()), BITS + 1):
        new = level == d
        front = [np.concatenate((f, p[new])) for f, p in zip(front, pairs)]
        alo, ahi, blo, bhi, gap = front
        keep = ~((alo == blo) & (ahi == bhi) & (ahi - alo < 2))
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        keep &= ~((changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (label[alo] == label[blo]))
        leaf = keep & (ahi - alo == 1) & (bhi - blo == 1)
        x, y = alo[leaf], blo[leaf]
        linked = np.bitwise_count(bits[x] ^ bits[y]) <= budget
        if linked.any():
            label = _joined(label, x[linked], y[linked])
        alo, ahi, blo, bhi, gap = (f[keep & ~leaf] for f in front)
        if d == BITS or not (len(alo) or (level > d).any()):
            break
        zero = np.concatenate(([0], np.cumsum((bits >> np.uint64(BITS - 1 - d)) & np.uint64(1) == 0)))
        am, bm = alo + zero[ahi] - zero[alo], blo + zero[bhi] - zero[blo]
        mixed = ~((alo == blo) & (ahi == bhi))
        grown = [
            (alo, am, blo, bm, gap),
            (am, ahi, bm, bhi, gap),
            (alo, am, bm, bhi, gap + 1),
            tuple(p[mixed] for p in (am, ahi, blo, bm, gap + 1)),
        ]
        grown = [tuple(p[(g[1] > g[0]) & (g[3] > g[2]) & (g[4] <= budget)] for p in g) for g in grown]
        front = [np.concatenate(p) for p in zip(*grown)]
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, label, fp)
    root = root[label]
    out = root != fp
    return fp[out], root[out]


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels, which are the smallest row of each set, after joining the sets of x[i] and y[i]."""
    label = label.copy()
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low < high
        if not open_.any():
            return label
        np.minimum.at(label, high[open_], low[open_])
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def near_duplicates(docs: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` per document; component_id is the smallest doc_id reachable over links.

    Texts that are null, empty or blank have fingerprint zero and link like any other. Rows that repeat a doc_id come
    out as often as they come in. A row whose doc_id is null gets the smallest doc_id of its component, which is null
    only if no member has one. An empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs), "simhash")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-fp")
    roots = components(links(first.select("fp"), budget, node_rows))
    owned = first.join(roots, first.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    best = materialize(owned.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("texts")), "simhash-best")
    named = materialize(with_lookup(owned, best, "root", "texts").select("fp", "n", "component_id"), "simhash-named")
    return with_lookup(prints, named, "fp", "n").select("doc_id", "fp", "component_id")
