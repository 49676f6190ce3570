"""Merkle manifest of a data set: a tree for each source, a tree of their roots, and a proof for each document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.shared import materialize, with_lookup

#: Children of a node.
RUN = 3
#: Levels of a superblock, which a task reduces at once: 729 nodes.
LEVELS = 6
NODES = "tree string, pos long, size long, digest string"
#: ``path`` holds the siblings to the left and to the right of each level in turn.
PATHS = "tree string, pos long, path array<string>, root string"
NO_SOURCE, SOURCE = "n", "s"


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(text: Column) -> Column:
    """The digest of a row of documents that has this text: each field as its length in bytes and value, or ``-`` for null."""
    fields = (F.col("doc_id").cast("long").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long").cast("string"), text.cast("string"))
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields)), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in its group by ``order`` from 0 on, and ``size``, the rows of the group.

    Rows are dealt in ranges of (group, order), so that a hot group takes many tasks; counts of the ranges give each its
    first place.
    """
    dealt = materialize(rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(group, "range").agg(F.count("*").alias("n"))
    own = Window.partitionBy(group)
    before = F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = materialize(counts.select(group, "range", before.alias("before"), F.sum("n").over(own).alias("size")), "ranges")
    place = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)) - 1
    placed = dealt.withColumn("place", place).join(starts, [group, "range"])
    return placed.withColumn("pos", F.col("before") + F.col("place")).drop("range", "place", "before")


def _levels(nodes: list[str], size: int, deep: int) -> list[list[str]]:
    """The levels of a superblock of a tree of ``size`` nodes from its nodes up to its root. In a tree of several
    superblocks each has all levels, in which a lone node is hashed too."""
    levels = [nodes]
    while len(levels) <= deep and (size > RUN**deep or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([digest("".join(last[k : k + RUN])) for k in range(0, len(last), RUN)])
    return levels


def _siblings(levels: list[list[str]], at: int) -> list[str]:
    path = []
    for level in levels[:-1]:
        first = at - at % RUN
        path += ["".join(level[first:at]), "".join(level[at + 1 : first + RUN])]
        at //= RUN
    return path


def _reduced(rows: pd.DataFrame, deep: int) -> pd.DataFrame:
    """The root of a superblock."""
    rows = rows.sort_values("pos")
    size = int(rows["size"].iloc[0])
    return pd.DataFrame({"tree": [rows.tree.iloc[0]], "pos": [int(rows.pos.iloc[0]) // RUN**deep], "size": [-(-size // RUN**deep)], "digest": [_levels(rows.digest.tolist(), size, deep)[-1][0]]})


def _block(deep: int) -> list[Column]:
    return [F.col("tree"), F.floor(F.col("pos") / RUN**deep).alias("block")]


def _finished(rows: pd.DataFrame, outer: pd.DataFrame, deep: int) -> Iterator[tuple[int, list[str], object]]:
    """Of each node of a superblock its row, and its path through the superblock and on to the root; with the outer row."""
    if len(outer) != 1:
        raise ValueError(f"a superblock needs one row of outer nodes, not {len(outer)}")
    rest = outer.iloc[0]
    rows.sort_values("pos", inplace=True, ignore_index=True)
    levels = _levels(rows.digest.tolist(), int(rows["size"].iloc[0]), deep)
    for k in range(len(rows)):
        yield k, _siblings(levels, k) + list(rest.path), rest


def _inner_paths(rows: pd.DataFrame, outer: pd.DataFrame, deep: int) -> pd.DataFrame:
    found = [(rows.tree[k], rows.pos[k], path, rest.root) for k, path, rest in _finished(rows, outer, deep)]
    return pd.DataFrame(found, columns=["tree", "pos", "path", "root"])


def _roots(nodes: DataFrame, deep: int) -> DataFrame:
    return materialize(nodes.groupBy(*_block(deep)).applyInPandas(lambda rows: _reduced(rows, deep), NODES), "superblocks")


def _outer(blocks: DataFrame, deep: int) -> DataFrame:
    """PATHS of the roots of superblocks: their way up to the root of their tree."""
    above = blocks.where("size > 1")
    single = blocks.where("size = 1").select("tree", "pos", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    if above.isEmpty():
        return single
    outer = _outer(_roots(above, deep), deep)
    found = above.groupBy(*_block(deep)).cogroup(outer.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(lambda rows, rest: _inner_paths(rows, rest, deep), PATHS)
    return materialize(single.unionByName(found), "outer-nodes")


def _folded(rows: pd.DataFrame, outer: pd.DataFrame, deep: int) -> pd.DataFrame:
    found = []
    for k, path, rest in _finished(rows, outer, deep):
        now = rows.now[k]
        for i in range(0, len(path), 2):
            now = digest(path[i] + now + path[i + 1])
        found.append((rows.doc_id[k], rows.digest[k], rest.subroot, rest.root, digest("".join(path)), now, now == rest.root))
    return pd.DataFrame(found, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).astype({"doc_id": "Int64"})


def manifest(docs: DataFrame, text_now: Column | None = None, deep: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of documents.

    Per source, leaves ascend by doc_id; every RUN consecutive nodes (the last ones: fewer, even one) become one while
    several remain. What remains is the source's subroot; subroots by source (null first, then by bytes) become the root
    in the same way. ``proof_sha256`` is the digest of a leaf's siblings level by level, and ``folded_root`` what they
    give with the leaf of ``text_now`` (the text itself, if not given): the root, unless the text has changed.

    Leaves and the outer nodes that their superblock needs are cogrouped by superblock (RUN^deep leaves), and one call finishes
    its local reduction, joins the proofs and folds them. Outer nodes come from the same reduction of the superblocks'
    roots, which shrink as many times in each round, so no task gets a whole tree, source or list of sources.

    A null source is one of its own, other than the empty string. Null doc_ids come first; rows that repeat a doc_id go by
    leaf, and equal rows are leaves of their own in any order, which gives the same result. Texts of any length are hashed
    whole; a null or empty text is a leaf like any other. Columns besides doc_id, source, lang, n_chars and text are
    ignored, whatever their names. An empty table gives an empty result.
    """
    changed = leaf(F.col("text") if text_now is None else text_now)
    tree = F.coalesce(F.concat(F.lit(SOURCE), F.col("source").cast("string")), F.lit(NO_SOURCE))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), changed.alias("now"), F.monotonically_increasing_id().alias("tie"))
    # equal rows differ by tie, so that they too are dealt over ranges
    leaves = materialize(ranked(materialize(rows, "leaves"), "tree", ["doc_id", "digest", "tie"]).drop("tie"), "leaves")
    blocks = materialize(_outer(_roots(leaves.select("tree", "pos", "size", "digest"), deep), deep), "outer-nodes")
    trees = blocks.groupBy("tree").agg(F.first("root").alias("subroot"), F.count("*").alias("n"))
    tops = materialize(ranked(trees.withColumn("top", F.lit("")), "top", ["tree"]), "subroots")
    nodes = tops.select(F.col("top").alias("tree"), "pos", "size", F.col("subroot").alias("digest"))
    above = nodes.groupBy(*_block(deep)).cogroup(_outer(_roots(nodes, deep), deep).groupBy("tree", F.col("pos").alias("block"))).applyInPandas(lambda r, rest: _inner_paths(r, rest, deep), PATHS)
    tops = tops.join(above.select("pos", F.col("path").alias("top_path"), F.col("root").alias("top_root")), "pos").select("tree", "subroot", "n", "top_path", "top_root")
    outer = with_lookup(blocks, materialize(tops, "subroots"), "tree", "n")
    outer = outer.select("tree", F.col("pos").alias("block"), F.concat("path", "top_path").alias("path"), "subroot", F.col("top_root").alias("root"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.groupBy(*_block(deep)).cogroup(outer.groupBy("tree", "block")).applyInPandas(lambda r, rest: _folded(r, rest, deep), schema)
