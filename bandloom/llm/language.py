"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from bandloom.llm.shared import materialize, nested

#: Hash buckets of the n-grams, and their lengths.
BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages that are counted, and scored, at a time; their matrix of log-probabilities takes 16 MB.
LANGUAGES = 64
#: Characters that are hashed at a time.
CHUNK = 1 << 18
#: Documents whose n-grams are held at a time.
SCORED_ROWS = 128
UNKNOWN = "und"
#: Posterior below which the pipeline rejects a document.
MIN_SCORE = 0.5

_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def letters(text: str | None) -> str:
    """The text in lower case with each run of other characters than letters as one space; empty if it has none."""
    clean = _OTHER.sub(" ", (text or "").lower()).strip()
    return clean if any(map(str.isalpha, clean)) else ""


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of LENGTHS, and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    padded = f" {text} "
    for at in range(0, len(padded), CHUNK):
        codes = np.frombuffer(padded[at : at + CHUNK + max(LENGTHS) - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        for n in LENGTHS:
            mixed = np.zeros(max(0, min(CHUNK, len(codes) - n + 1)), np.uint64)
            for k in range(n):
                mixed = (mixed ^ codes[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            total += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


def ngram_table(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over every row that may be learned from; bucket BUCKETS holds a language's number of rows.

    Each task sums its own rows before the shuffle, LANGUAGES languages at a time, so memory is bounded however many
    there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                if lang.as_py() not in sums and len(sums) == LANGUAGES:
                    least = min(sums, key=lambda k: sums[k][BUCKETS])  # its rows are few, so what leaves follows the input
                    yield from summed({least: sums.pop(least)})
                own = sums.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += 1
                if clean := letters(text.as_py()):
                    used, times = ngram_counts(clean)
                    own[used] += times
        yield from summed(sums)

    def summed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(own[used])], ["lang", "bucket", "n"])

    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return materialize(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "lang-counts")


def models(counts: DataFrame, block: int = LANGUAGES) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Languages in code point order, ``block`` at a time, with log-probabilities (bucket by language) and log-priors.

    A model comes to the driver and is broadcast; it is ``block`` times BUCKETS numbers at most. No row to learn from
    gives no model.
    """
    total = counts.where(F.col("bucket") == BUCKETS).agg(F.sum("n")).first()[0]
    ahead = counts.select("lang").distinct()
    langs = [r.lang for r in ahead.orderBy("lang").limit(block + 1).collect()]
    while langs:
        here, more = langs[:block], langs[block:]
        table = counts.where(F.col("lang").between(here[0], here[-1])).toPandas()
        matrix = np.zeros((BUCKETS + 1, len(here)))
        at = {lang: k for k, lang in enumerate(here)}
        matrix[table.bucket.to_numpy(), table.lang.map(at).to_numpy()] = table.n.to_numpy()
        smooth = matrix[:BUCKETS] + SMOOTHING
        yield here, np.log(smooth / smooth.sum(axis=0)), np.log(matrix[BUCKETS] / total)
        langs = [r.lang for r in ahead.where(F.col("lang") >= more[0]).orderBy("lang").limit(block + 1).collect()] if more else []


def predict(docs: DataFrame, block: int = LANGUAGES) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``lang_pred`` and ``score``, its posterior (0 to 1), for every row.

    Learns from the rows of ``docs`` that are not held out and have a language, and looks at nothing but the text when
    it predicts. A text that is null or without letters, or a table without a row to learn from, gives ``und`` and 0.
    Ties go to the first language by code point. Rows that repeat are predicted each; whole texts of any length are
    read, and other columns, whatever their names, come back in ``row``. An empty table gives an empty result.

    Up to ``block`` languages are scored in one pass over the rows. More take a pass for each block, which keeps the
    best language so far and the sum of all probabilities; the result is the same.
    """
    rows = nested(docs)
    found = None
    for model in models(ngram_table(docs), block):
        if found is not None:
            found = materialize(found, "lang-scores")
        found = _passed(rows if found is None else found, model)
    if found is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return found.select("row", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(F.exp(F.col("top") - F.col("every")), F.lit(0.0)).alias("score"))


def known(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a known language, of a posterior of ``least`` or more; columns as they come."""
    found = predict(docs)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def _passed(rows: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``row, lang_pred, top, every``: the best language so far, its log-probability, and the log of the sum of all."""
    model = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.schema["row"].dataType.names.index("text")
    again = len(rows.columns) > 1
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("top", DoubleType()), StructField("every", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, prior = model.value
        for batch in (b.slice(k, SCORED_ROWS) for b in batches for k in range(0, b.num_rows, SCORED_ROWS)):
            texts = pc.struct_field(batch.column(0), at)
            found = [ngram_counts(c) if (c := letters(_as_text(t.as_py()))) else None for t in texts]
            best, top, every = _scored([f for f in found if f], matrix, prior)
            where = iter(zip(best.tolist(), top.tolist(), every.tolist()))
            out = [next(where) if f else None for f in found]
            named = [o and (langs[o[0]], o[1], o[2]) for o in out]
            if again:
                named = [n and _better(b, n) for b, n in zip(zip(*(c.to_pylist() for c in batch.columns[1:])), named)]
            columns = zip(*(n or (None, None, None) for n in named)) if named else [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "lang_pred", "top", "every"])

    return rows.mapInArrow(score, schema)


def _better(before: tuple, now: tuple) -> tuple:
    lang, top, _ = before if before[1] >= now[1] else now
    return lang, top, float(np.logaddexp(before[2], now[2]))


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def _scored(rows: list[tuple[np.ndarray, np.ndarray]], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its log-probability, and the log of all languages' sum, for sparse rows of (buckets, counts)."""
    sums = np.empty((len(rows), len(prior)))
    step = 256
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        starts = np.cumsum([0] + [len(b) for b, _ in part[:-1]])
        terms = matrix[np.concatenate([b for b, _ in part])] * np.concatenate([n for _, n in part])[:, None]
        sums[at : at + step] = np.add.reduceat(terms, starts, axis=0) + prior
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    best, top = sums.argmax(axis=1), sums.max(axis=1)
    return best, top, top + np.log(np.exp(sums - top[:, None]).sum(axis=1))
