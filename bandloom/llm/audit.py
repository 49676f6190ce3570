"""Filter interaction audit: what each of five filters removes, alone and in every order."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.llm.shared import HOT_KEYS, HOT_ROWS, materialize

#: The filters; bit k of a combination of failed ones stands for FILTERS[k].
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def text_failures(text: str | None) -> int:
    """The bits of the filters A to D that a text fails; null counts as empty.

    A: under 50 words; B: under 65 % of the words differ; C: over 5 % of the code points are A to Z; D: a symbol of #$%&*|.
    """
    text = text or ""
    data = text.encode()
    words = data.split()  # at ASCII white space
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, UPPER))) > MAX_UPPER_PERCENT * len(text)) << 2
        | (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    )


def _with_failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = pa.array([text_failures(t.as_py()) for t in batch.column("text")], pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "hash")), bits], ["doc_id", "part", "hash", "bits"])


def _read(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.withColumn("hash", F.unhex(F.sha2("text", 256)))


def later_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, part, hash`` of every row whose text is identical to that of a row with a smaller doc_id.

    A left-semi join on hash, exact text and smaller doc_id. One row stands for all equal texts on the right, that with the
    smallest doc_id, since a smaller one exists if that is smaller. Hashes of many rows are salted: the left side is dealt
    over their salts, the right side's one row for a text repeats for each; the others need no second exchange of texts.
    Both sides always move whole texts; a filter by repeated hashes would move less of small tables only.
    """
    rows = _read(docs).where("doc_id IS NOT NULL")
    bound = max(HOT_ROWS, -(-rows.count() // HOT_KEYS))  # at most HOT_KEYS hashes have as many rows
    counts = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= bound)
    hot = materialize(counts.select("hash", F.ceil(F.col("n") / bound).cast("int").alias("salts")), "audit-hot")
    few = rows.join(F.broadcast(hot), "hash", "left_anti")
    found = _with_smaller(few, few.groupBy("hash", "text").agg(F.min("doc_id").alias("first")), ["hash", "text"])
    if hot.isEmpty():
        return found
    many = rows.join(F.broadcast(hot), "hash")
    first = many.groupBy("hash", "salts", "text").agg(F.min("doc_id").alias("first"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = many.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.col("salts")).cast("int"))
    return found.unionByName(_with_smaller(salted, first, ["hash", "salt", "text"]))


def _with_smaller(rows: DataFrame, first: DataFrame, same: list[str]) -> DataFrame:
    on = [F.col(f"d.{c}") == F.col(f"e.{c}") for c in same]
    return rows.alias("d").join(first.alias("e"), [*on, F.col("e.first") < F.col("d.doc_id")], "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, n, good, toxic``: documents of each part by the combination of filters that they fail.

    The ids of later copies are united with the other failure ids; a row's id is its doc_id with part and text hash, so rows
    that repeat a doc_id stay apart. ``labels`` may repeat a doc_id: one row of quality or toxic 1 is enough.
    """
    rows = _read(docs).mapInArrow(_with_failures, "doc_id long, part string, hash binary, bits int")
    copies = later_copies(docs).select("doc_id", "part", "hash", F.lit(1 << FILTERS.index("E")).alias("bits"))
    marks = rows.withColumn("n", F.lit(1)).unionByName(copies.withColumn("n", F.lit(0)))
    failed = marks.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    narrow = materialize(failed.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n")), "audit-bits")
    is_one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("quality"), is_one("toxic").alias("toxic"))
    joined = narrow.where("doc_id IS NOT NULL").join(known, "doc_id", "left")  # without the rows of no id, which would meet in one task
    none = F.lit(None).cast("int")
    joined = joined.unionByName(narrow.where("doc_id IS NULL").withColumns({"quality": none, "toxic": none}))
    labelled = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return joined.groupBy("part", "bits").agg(F.sum("n").alias("n"), labelled("quality").alias("good"), labelled("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row, zeros included, for each part (source; null is the empty string), each of the 120 orders of the five filters,
    and each step of it. Whole texts of any length are read, a null one as empty. Rows that repeat a doc_id or a whole
    row count each; of copies with the same smallest doc_id none is a later one, and a null doc_id is neither later nor
    earlier than others. An empty table of documents gives an empty result, one of labels no good or toxic document.
    Other columns of either table, whatever their names, are ignored.

    What is left of a part is a count for each combination of failed filters, 32 rows at most; each step of an order adds up
    the combinations that it is about.
    """
    cells = F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells")
    parts = materialize(combinations(docs, labels).groupBy("part").agg(cells), "audit-parts")
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    mask = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    own, before = mask(F.substring("filter_order", F.col("step"), F.lit(1))), mask(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    rows = rows.select("part", "filter_order", "step", "cells", own.alias("own"), before.alias("before"))

    def total(what: str, when: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(when(x["bits"]), x[what]).otherwise(0))

    has = lambda bits, c: bits.bitwiseAND(F.col(c)) > 0
    here = lambda bits: has(bits, "own") & ~has(bits, "before")
    shares = [0] + [len(orders) // k for k in range(1, len(FILTERS) + 1)]
    # of all orders, each of the failed filters comes first among them in an equal share
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(has(x["bits"], "own"), x["n"] * F.get(F.lit(shares), F.bit_count(x["bits"]))).otherwise(0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda bits: ~has(bits, "own") & ~has(bits, "before")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda bits: has(bits, "own") & has(bits, "before")).alias("redundant"),
        total("n", lambda bits: bits == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )
