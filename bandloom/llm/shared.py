"""Helpers that the operators of this subpackage share: tables in the shared folder, and graph components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.sources.sinks import new_path, temporary

__all__ = ["components", "materialize", "nested", "new_path", "with_lookup"]

materialize = temporary

#: Keys that count as hot at most; a key with fewer rows than this share of all does not fill a task.
HOT_KEYS = 10_000
#: Rows of a key under which it is never hot.
HOT_ROWS = 1_000


def nested(docs: DataFrame, *used: Column, carry: list[str] | None = None) -> DataFrame:
    """``row``, a struct of the columns of ``docs`` (of those in ``carry``, if given), and the columns used: what
    operators add beside ``row`` cannot clash with it, and what it doesn't carry isn't moved."""
    return docs.select(F.struct(*(carry or ["*"])).alias("row"), *used)


def with_lookup(rows: DataFrame, table: DataFrame, key: str, count: str, outer: bool = False, parts: int | None = None) -> DataFrame:
    """Inner (or left outer) join of ``rows`` with ``table``, which has one row for each key and its number of rows in ``count``.

    Keys that hold at least one in HOT_KEYS of the rows counted, which are HOT_KEYS at most, are broadcast, so that the
    rows of a hot key aren't gathered; all other keys meet in a shuffle, of ``parts`` partitions if given.
    """
    bound = max(HOT_ROWS, -(-(table.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS))
    values = F.struct(*(c for c in table.columns if c != key))
    hot = table.where(F.col(count) >= bound).select(key, values.alias("_hot"))
    cold = table.where(F.col(count) < bound).select(key, F.lit(0).cast("long").alias("_lane"), values.alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left")
    # a hot key's rows take lanes of their own, which spreads them and meets nothing
    marked = marked.withColumn("_lane", F.when(F.col("_hot").isNull(), 0).otherwise(F.monotonically_increasing_id() + 1))
    if parts:
        marked, cold = marked.repartition(parts, key, "_lane"), cold.repartition(parts, key, "_lane")
    joined = marked.join(cold, [key, "_lane"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if not outer:
        joined = joined.where("_found is not null")
    return joined.select(*rows.columns, "_found.*")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given by its edges of two long columns.

    Returns ``node, root`` for every node that has an edge to another node; ``root`` is the smallest node of the
    component. Alternates the large-star and small-star steps (Kiveris et al. 2014), which keep the edge count
    bounded by the input's and end after a logarithmic number of rounds. Minima are pre-aggregated before each
    shuffle, and the edges of a hub aren't gathered (``with_lookup``). Edges with a null end and loops are ignored; no
    edges give an empty table.
    """
    now = materialize(_downward(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "cc")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "cc-low")
        large = with_lookup(both.where("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(_downward(large), "cc")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-low")
        small = with_lookup(large, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(_downward(small.unionByName(low.select("u", F.col("m").alias("v")))), "cc")
        if (after := _fingerprint(now)) == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _downward(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _fingerprint(pairs: DataFrame) -> tuple:
    key = F.xxhash64("u", "v")
    row = pairs.agg(F.count("*"), F.sum(key.cast("decimal(20,0)")), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)
