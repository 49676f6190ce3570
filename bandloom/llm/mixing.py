"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.shared import materialize, nested, with_lookup

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Times that a document may be taken.
REPEATS = 3
SEED = "mix"
NO_SOURCE = "n"
#: Rows in a range of the shuffled order, or of virtual time, that windows run over (on average over all sources).
RANGE_ROWS = 1 << 14
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``, one row for each source.

    Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of all. A target stops at
    REPEATS times its source's size; the excess goes to the others by weight. With sources ordered by size per weight,
    a source stops if its share of what the ones before it leave is too much for it; so one pass finds all that stop.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.pmod(rank, F.lit(len(WEIGHTS))).cast("long") + 1)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = left.cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    rows = rows.withColumn("full", share * F.col("weight") > (REPEATS * F.col("source_size")).cast("double"))
    left = F.sum(F.col("source_size") - F.when(F.col("full"), REPEATS * F.col("source_size")).otherwise(0)).over(every)
    weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    share = left.cast("double") / F.nullif(weight, F.lit(0)).cast("double")
    target = F.when(F.col("full"), (REPEATS * F.col("source_size")).cast("double")).otherwise(share * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = SEED, range_rows: int = RANGE_ROWS, carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, or of those in ``carry``), ``size, source_size, target, taken, times`` for every row.

    The shuffled order is that of ``md5(seed:doc_id:text)``, so reruns agree. A document's copy in pass p finishes at the
    virtual time (p * source size + cumulative source words) / target. Copies are taken in order of that time while
    their words fit into the total budget, the words of all documents; a source whose target is met gets no more.
    A null text has no words; documents without words are taken zero times. A null source is a source, the last one.
    Rows that repeat doc_id and text count each; of these, those with the smaller JSON form are taken more often. Whole
    texts are counted; other columns, whatever their names, come back in ``row``. An empty table gives an empty result.

    Cumulative words come from sums over ranges of the order plus a window within each range; ranges are as many as the
    rows need, so a source that holds a third of all rows is spread over them. Windows see sizes and keys alone, never
    texts. What a source gets in a pass is a prefix of its order, so each row is told by its source's last key in each
    pass. Only the last copy taken, one row, comes to the driver. Targets need one order over all sources: one task
    sorts a row for each source. The budget needs one over all slots of virtual time: one task sums a row for each, at
    most 32 for every RANGE_ROWS documents.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    rows = nested(docs, _key(F.col("source")).alias("source"), order.alias("order"), word_count(F.col("text")).alias("size"), carry=carry)
    narrow = materialize(rows.select("source", "order", "size"), "mix-sizes")
    every, budget = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = max(1, math.ceil(math.log(max(1, every / range_rows), 16)))
    narrow = narrow.withColumn("range", F.substring("order", 1, digits))
    sums = materialize(narrow.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-ranges")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    named = F.when(F.col("source") != NO_SOURCE, F.expr("substring(source, 2)"))
    goal = targets(sizes.select(named.alias("source"), "source_size")).select(_key(F.col("source")).alias("source"), "target")
    goal = materialize(sizes.join(goal, "source"), "mix-goals")
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    starts = materialize(sums.select("source", "range", ahead.alias("ahead")).join(goal.drop("n"), "source"), "mix-starts")
    place = Window.partitionBy("source", "range").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = narrow.join(starts, ["source", "range"]).withColumn("cum", F.col("ahead") + F.sum("size").over(place))
    slots = 16**digits
    copies = _copies(queued).withColumn("slot", F.least(F.floor(F.col("finish") * slots), F.lit(2 * slots)))
    filled = materialize(copies.groupBy("slot").agg(F.sum("size").alias("words")), "mix-slots")
    filled = filled.select("slot", (F.sum("words").over(Window.orderBy("slot")) - F.col("words")).alias("before"))
    place = Window.partitionBy("slot").orderBy("finish", "order", "source", "pass", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = copies.join(filled, "slot").withColumn("run", F.col("before") + F.sum("size").over(place))
    taken = materialize(running.where(F.col("run") <= budget).select("source", "pass", "order", "size"), "mix-taken")
    last = taken.groupBy("source").agg(*(F.max(F.when(F.col("pass") == p, F.struct("order", "size"))).alias(f"last{p}") for p in range(REPEATS)))
    # written, so that its real size, a row for each source, tells how it is joined
    ends = materialize(goal.join(materialize(last, "mix-last"), "source", "left"), "mix-ends")
    found = with_lookup(rows, ends, "source", "n")
    found = found.withColumn("times", sum((F.when(_upto(p), 1).otherwise(0) for p in range(REPEATS)), F.lit(0)).cast("long"))
    found = found.select("row", "source", "order", "size", "source_size", "target", "times")
    if not (split := _split(narrow, taken, last)).isEmpty():
        same = ["source", "order", "size"]
        nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.to_json("row")))
        less = found.join(split, same).withColumn("times", F.aggregate("shares", F.lit(0).cast("long"), lambda a, m: a + F.when(m >= nth, 1).otherwise(0)))
        found = found.join(split, same, "left_anti").unionByName(less.drop("shares"))
    return found.select("row", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; columns as they come."""
    found = mix(docs).where("times > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def _upto(p: int) -> Column:
    """Whether a row is in its source's prefix of a pass."""
    return (F.col("size") > 0) & (F.struct("order", "size") <= F.col(f"last{p}"))


def _split(narrow: DataFrame, taken: DataFrame, last: DataFrame) -> DataFrame:
    """``source, order, size, shares``: keys of several rows, of which a pass takes only some, and how many each takes."""
    same = ["source", "order", "size"]
    ends = last.select("source", F.explode(F.array(*(f"last{p}" for p in range(REPEATS)))).alias("end")).where("end is not null").select("source", "end.*").distinct()
    all_ = narrow.join(ends, same, "left_semi").groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")
    shares = F.array(*(F.sum(F.when(F.col("pass") == p, 1).otherwise(0)) for p in range(REPEATS)))
    some = taken.join(all_, same).groupBy(*same).agg(shares.alias("shares"), F.max("n").alias("n"))
    return materialize(some.where(F.exists("shares", lambda m: (m > 0) & (m < F.col("n")))).drop("n"), "mix-split")


def _key(source: Column) -> Column:
    """A source as a key that is never null, so that the join and the window share one exchange."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(NO_SOURCE))


def _copies(queued: DataFrame) -> DataFrame:
    """Each row once for each pass that starts before its source's target is met, with its virtual finish time."""
    copies = queued.where("size > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(REPEATS)))))
    end = F.col("pass") * F.col("source_size") + F.col("cum")
    copies = copies.where((end - F.col("size")).cast("double") < F.col("target"))
    return copies.select("source", "order", "size", "pass", (end.cast("double") / F.nullif(F.col("target"), F.lit(0.0))).alias("finish"))
