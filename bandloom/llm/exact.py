"""Exact dedup: documents whose texts are equal apart from ASCII white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.llm.shared import materialize, nested, with_lookup

WHITE_SPACE = " \t\n\v\f\r"
#: Salts of a digest in the middle stage, so that a hot group is merged by as many tasks.
SALTS = 32


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _combine(rows: DataFrame, salts: int) -> DataFrame:
    """``digest, norm, best, n`` per distinct normalised text.

    Each stage groups by the full content beside its digest: every map task merges its own rows, then the salted groups
    are merged, then their winners. A hot group so reaches the last stage as one row per salt.
    """
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = salted.groupBy("digest", "salt", "norm").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def _keyed(docs: DataFrame, digest: Callable[[Column], Column], carry: list[str] | None) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    length = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rank = F.struct((-length).alias("shorter"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))
    rows = nested(docs, normalised(F.col("text")).alias("norm"), rank.alias("rank"), carry=carry)
    return rows.withColumn("digest", digest(F.col("norm")))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS, carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, or of those in ``carry``), ``keep_id, group_size, kept, digest`` for every row.

    Of equal texts the row with the most code points stays, then that with the smallest doc_id (null last). A null text
    is an empty one. Rows that repeat both doc_id and length of the winner all count as kept; ``deduplicated`` leaves
    one. Contents that share a digest (none with SHA-256, but tests use weak ones) are told apart by full comparison.
    Whole texts of any length are compared. Other columns, whatever their names, come back in ``row``; an empty table
    gives an empty result. Rows of hot groups aren't gathered by their digest (``with_lookup``).
    """
    rows = _keyed(docs, digest, carry)
    groups = materialize(_combine(rows, salts).drop("norm"), "exact-groups")
    clashes = materialize(groups.groupBy("digest").count().where("count > 1").select("digest"), "exact-clashes")
    clash = not clashes.isEmpty()
    if clash:
        groups = groups.join(clashes, "digest", "left_anti")
    named = with_lookup(rows.select("row", "digest", "rank"), groups, "digest", "n")
    if clash:
        few = rows.join(clashes, "digest", "left_semi")
        named = named.unionByName(few.join(_combine(few, salts), ["digest", "norm"]).select(named.columns))
    return named.select(
        "row",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("rank").eqNullSafe(F.col("best")).alias("kept"),
        F.col("digest").cast("string").alias("digest"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts; columns as they come.

    Where several rows repeat the winner's doc_id and length, that with the smallest text, then the smallest JSON form
    of the whole row, stays.
    """
    kept = exact_duplicates(docs).where("kept").select("row", "digest")
    twins = materialize(kept.groupBy("digest").count().where("count > 1").select("digest"), "exact-twins")
    if twins.isEmpty():
        return kept.select("row.*")
    alone = kept.join(twins, "digest", "left_anti").select("row")
    first = F.min_by("row", F.struct(F.col("row.text"), F.to_json("row"))).alias("row")
    return alone.unionByName(kept.join(twins, "digest", "left_semi").groupBy("digest").agg(first).select("row")).select("row.*")
