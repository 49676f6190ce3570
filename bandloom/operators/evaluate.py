"""Evaluation of selections: stratified splits, linear classifiers, accuracy, summaries and paired tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.sources.cubes import foreground
from bandloom.sources.sinks import temporary

COST = 1.0
#: Evaluations of a model at most, each a Newton step or a shorter one; what is not done by then is told.
EVALUATIONS = 200
TOLERANCE = 1e-6
#: Share of the decrease that a gradient promises which a step must reach.
DECREASE = 1e-4
#: Entries of Hessians, 8 bytes each, that a task adds up at a time.
MAX_NUMBERS = 2_000_000
STATE = "r int, s int, c int, w array<double>, asked array<double>, loss double, step array<double>, slope double, share double, rounds int, done boolean, message string"
RESULT = "run_id int, method string, n_selected_bands int, test_accuracy double, selected_band_count int, selected_band_idx array<int>, message string"


def stratified_split(pixels: DataFrame, runs: int = 10, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``run_id, pixel_id, label, test``: in each run and class the same share, rounded, is for testing.

    The order of a run is that of a hash of its seed and the pixel, so reruns agree.
    """
    rows = pixels.select("pixel_id", "label").withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    order = F.md5(F.concat_ws(":", (F.col("run_id") + seed).cast("string"), F.col("pixel_id").cast("string")))
    own = Window.partitionBy("run_id", "label")
    place = F.row_number().over(own.orderBy(order, "pixel_id"))
    rows = rows.withColumns({"n": place, "size": F.count("*").over(own)})
    return rows.select("run_id", "pixel_id", "label", (F.col("n") <= F.round(share * F.col("size"))).alias("test"))


def accuracy(predictions: DataFrame, *keys: str) -> DataFrame:
    """Share of rows whose ``predicted`` is their ``label``, by the keys."""
    return predictions.groupBy(*keys).agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("test_accuracy"))


def svm_evaluation(pixels: DataFrame, selections: DataFrame, runs: int = 10, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``run_id, method, n_selected_bands, test_accuracy, selected_band_count, selected_band_idx, message``.

    One linear classifier against the rest for each class, with squared hinge loss, cost COST and a regularized bias, for
    each run and each (method, k) of ``selections(method, k, rank, band)``. Background pixels take no part. Newton steps
    solve all models together. Models are rows of a table, written after each step: tasks add losses, gradients and Hessians
    of their pixels, which are summed by model, and the task that gets a model's sums takes its step. Only weights come to
    the driver, to be sent to the tasks, at most MAX_NUMBERS of Hessians' entries at a time standing in a task. Selections
    that name no band of the cube are left out. A line search makes every step lower the loss. A run of a selection with a
    model that has values that are not finite, or has not converged, gets no accuracy but a message; the others aren't
    touched by it.
    """
    spark = pixels.sparkSession
    rows = selections.orderBy("method", "k", "rank").toPandas()
    bands = pixels.select(F.size("spectrum")).first()[0]
    rows = rows[(rows.band >= 0) & (rows.band < bands)]
    chosen = [(m, int(k), g.band.astype(int).tolist()) for (m, k), g in rows.groupby(["method", "k"])]
    known = foreground(pixels)
    classes = [r.label for r in known.select("label").distinct().orderBy("label").collect()]
    split = stratified_split(known, runs, share, seed).groupBy("pixel_id").agg(F.map_from_entries(F.collect_list(F.struct("run_id", "test"))).alias("tests"))
    data = known.join(split, "pixel_id").select("spectrum", "label", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.element_at("tests", r)).alias("tests"))
    data = temporary(data)
    signs = classes[1:] if len(classes) == 2 else classes
    found = spark.createDataFrame([], RESULT)
    for part in _batches(chosen, runs * len(signs)):
        models = _fitted(data, part, signs, runs)
        failed = models.where("message IS NOT NULL").groupBy("r", "s").agg(F.min(F.struct("c", "message"))["message"].alias("message"))
        hits = _hits(data, models, part, classes, signs, runs).join(failed, ["r", "s"], "left")
        names = F.broadcast(spark.createDataFrame([(s, m, b) for s, (m, _, b) in enumerate(part)], "s int, method string, selected_band_idx array<int>"))
        size, rate = F.size("selected_band_idx"), F.when(F.col("message").isNull(), F.col("hit") / F.col("n"))
        own = hits.join(names, "s").select(F.col("r").alias("run_id"), "method", size.alias("n_selected_bands"), rate.alias("test_accuracy"), size.alias("selected_band_count"), "selected_band_idx", "message")
        found = found.unionByName(temporary(own))
    return found


def _batches(chosen: list, models: int) -> Iterator[list]:
    """Selections whose models are solved together: at most MAX_NUMBERS in their Hessians, or one selection."""
    part, size = [], 0
    for item in chosen:
        own = models * (len(item[2]) + 1) ** 2
        if part and size + own > MAX_NUMBERS:
            yield part
            part, size = [], 0
        part.append(item)
        size += own
    if part:
        yield part


class _Model:
    """A classifier on its way: Newton steps with a line search, which shortens a step until the loss falls enough."""

    def __init__(self, size: int):
        self.w, self.loss, self.step, self.slope, self.share = np.zeros(size), math.inf, np.zeros(size), 0.0, 1.0
        self.asked = self.w
        self.done, self.message, self.rounds = False, None, 0

    @classmethod
    def resumed(cls, row) -> _Model:
        """The model of a row of STATE."""
        model = cls(len(row.w))
        model.w, model.asked, model.step = np.array(row.w), np.array(row.asked), np.array(row.step)
        model.loss, model.slope, model.share, model.rounds = row.loss, row.slope, row.share, row.rounds
        return model

    def told(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Loss, gradient and Hessian at ``asked``."""
        self.rounds += 1
        if not (math.isfinite(loss) and np.isfinite(gradient).all() and np.isfinite(hessian).all()):
            if not math.isfinite(self.loss):
                return self.ended("its values are not finite")
            loss = math.inf
        if loss <= self.loss - DECREASE * self.share * self.slope or self.share * np.abs(self.step).max() < TOLERANCE and loss <= self.loss:
            self.w, self.loss = self.asked, loss
            try:
                self.step = np.linalg.solve(hessian, gradient)
            except np.linalg.LinAlgError:
                return self.ended("its Hessian is singular")
            self.slope, self.share = float(gradient @ self.step), 1.0
            if np.abs(self.step).max() < TOLERANCE:
                return self.ended(None)
        else:
            self.share /= 2
            if self.share * np.abs(self.step).max() < TOLERANCE * 1e-3:
                return self.ended(None)  # no shorter step changes the weights
        if self.rounds >= EVALUATIONS:
            return self.ended(f"not converged after {EVALUATIONS} evaluations")
        self.asked = self.w - self.share * self.step

    def ended(self, message: str | None) -> None:
        self.done, self.message = True, message


    def row(self) -> list:
        return [self.w, self.asked, self.loss, self.step, self.slope, self.share, self.rounds, self.done, self.message]


def _fitted(data: DataFrame, chosen: list, signs: list, runs: int) -> DataFrame:
    """The models when all of them are done, as STATE says."""
    spark = data.sparkSession
    sizes = spark.createDataFrame([(s, len(b) + 1) for s, (_, _, b) in enumerate(chosen)], "s int, size int")
    zeros = F.array_repeat(F.lit(0.0), F.col("size"))
    models = sizes.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(signs) - 1))))
    models = models.select("r", "s", "c", zeros.alias("w"), zeros.alias("asked"), F.lit(math.inf).alias("loss"), zeros.alias("step"), F.lit(0.0).alias("slope"), F.lit(1.0).alias("share"), F.lit(0).alias("rounds"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("message"))
    while active := {(m.r, m.s, m.c): np.array(m.asked) for m in models.where("NOT done").select("r", "s", "c", "asked").collect()}:
        held = spark.sparkContext.broadcast(active)
        models = temporary(_stepped(models, _derivatives(data, held, chosen, signs), signs))
        held.destroy()
    return models


def _stepped(models: DataFrame, sums: DataFrame, signs: list) -> DataFrame:
    """Each model after it was told its sums, in the task that gets them; those that are done stay as they are."""
    own = sums.groupBy("r", "s", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("sums"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m in batch.itertuples(index=False):
                if m.done:
                    out.append(list(m)[:-1])
                    continue
                model = _Model.resumed(m)
                if m.sums is None:
                    model.ended(f"class {signs[m.c]}: no pixel to learn from")
                else:
                    v, w, d = np.array(m.sums), model.asked, len(model.asked)
                    model.told(v[0] + w @ w / 2, v[1 : d + 1] + w, v[d + 1 :].reshape(d, d) + np.eye(d))
                    if model.message:
                        model.message = f"class {signs[m.c]}: {model.message}"
                out.append([m.r, m.s, m.c, *model.row()])
            yield pd.DataFrame(out, columns=batch.columns[:-1])

    return models.join(own, ["r", "s", "c"], "left").mapInPandas(of, STATE)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            tests = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield x, np.asarray(b.column(1)), tests.astype(bool)


def _derivatives(data: DataFrame, held, chosen: list, signs: list) -> DataFrame:
    """``r, s, c, k, v``: loss, gradient and Hessian of the models at the weights held, flat and summed over all pixels."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for x, y, tests in _blocks(batches):
            for s, (_, _, bands) in enumerate(chosen):
                z = np.concatenate((x[:, bands], np.ones((len(x), 1))), axis=1)
                for (r, of_s, c), w in held.value.items():
                    if of_s != s:
                        continue
                    t = np.where(y == signs[c], 1.0, -1.0)
                    near = ~tests[:, r] & ~(t * (z @ w) >= 1)  # with what is no number, so that it shows
                    zi, ti = z[near], t[near]
                    miss = zi @ w - ti
                    part = np.concatenate(([COST * (miss @ miss)], 2 * COST * (zi.T @ miss), (2 * COST * (zi.T @ zi)).ravel()))
                    sums[r, s, c] = part if (r, s, c) not in sums else sums[r, s, c] + part
        for (r, s, c), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(v), pa.int32()), pa.array([s] * len(v), pa.int32()), pa.array([c] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["r", "s", "c", "k", "v"])

    return data.mapInArrow(of, "r int, s int, c int, k int, v double").groupBy("r", "s", "c", "k").agg(F.sum("v").alias("v"))


def _hits(data: DataFrame, models: DataFrame, chosen: list, classes: list, signs: list, runs: int) -> DataFrame:
    """``r, s, hit, n``: right predictions and all of them, over the pixels for testing."""
    held = data.sparkSession.sparkContext.broadcast({(m.r, m.s, m.c): np.array(m.w) for m in models.select("r", "s", "c", "w").collect()})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, tests in _blocks(batches):
            for s, (_, _, bands) in enumerate(chosen):
                z = np.concatenate((x[:, bands], np.ones((len(x), 1))), axis=1)
                for r in range(runs):
                    scores = z @ np.stack([held.value[r, s, c] for c in range(len(signs))], axis=1)
                    best = (scores[:, 0] > 0).astype(int) if len(classes) == 2 else scores.argmax(axis=1)
                    good = np.array(classes)[best] == y
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([int(good[tests[:, r]].sum())]), pa.array([int(tests[:, r].sum())])], ["r", "s", "hit", "n"])

    counts = data.mapInArrow(of, "r int, s int, hit long, n long").groupBy("r", "s").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).where("n > 0")
    counts = temporary(counts)
    held.destroy()
    return counts


def summarized(raw: DataFrame) -> DataFrame:
    """``method, n_selected_bands``, mean, sample deviation and variance of the accuracy, and all of them by run."""
    v = "test_accuracy"
    by_run = F.transform(F.sort_array(F.collect_list(F.struct("run_id", v))), lambda x: x[v])
    return raw.groupBy("method", "n_selected_bands").agg(F.avg(v).alias("mean_test_accuracy"), F.stddev_samp(v).alias("std_test_accuracy"), F.var_samp(v).alias("var_test_accuracy"), by_run.alias("raw_accuracy_list"))


def p_value(t, df: int):
    """Two-sided p of a t statistic with any whole number of degrees of freedom, in closed form: a finite series in the
    cosine of atan(t / sqrt(df)), one for odd and one for even df."""
    if df < 1:
        raise ValueError("a t test needs a degree of freedom")
    angle = F.atan(F.abs(t) / math.sqrt(df))
    square, series = F.cos(angle) * F.cos(angle), F.lit(1.0)
    for k in range(df - 2, 1, -2):  # from the last term inwards
        series = 1 + series * square * ((k - 1) / k)
    if df % 2 == 0:
        return 1 - F.sin(angle) * series
    return 1 - (2 / math.pi) * (angle + (F.sin(angle) * F.cos(angle) * series if df > 1 else 0))


def paired_tests(raw: DataFrame, baselines: DataFrame, runs: int = 10) -> DataFrame:
    """``method, n_selected_bands, p_value_vs_baseline, significance_mark``.

    ``baselines(method, baseline)`` names what a method is held against; runs are paired by run_id. Without ``runs`` pairs,
    or with differences that are all alike, there is no p. One mark is for p < 0.05, two for p < 0.01.
    """
    base = raw.select(F.col("method").alias("baseline"), "n_selected_bands", "run_id", F.col("test_accuracy").alias("base"))
    pairs = raw.join(baselines, "method").join(base, ["baseline", "n_selected_bands", "run_id"])
    d = F.col("test_accuracy") - F.col("base")
    stats = pairs.groupBy("method", "n_selected_bands").agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.count("*").alias("n"))
    t = F.col("mean") / (F.col("std") / math.sqrt(runs))
    p = F.when((F.col("n") == runs) & (F.col("std") > 1e-12), p_value(t, runs - 1)) if runs > 1 else F.lit(None).cast("double")
    marked = stats.select("method", "n_selected_bands", p.alias("p_value_vs_baseline"))
    every = raw.select("method", "n_selected_bands").distinct().join(marked, ["method", "n_selected_bands"], "left")
    return every.withColumn("significance_mark", mark(F.col("p_value_vs_baseline")))


def mark(p):
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def evaluation(raw: DataFrame, baselines: DataFrame, runs: int = 10) -> DataFrame:
    """The summary with the paired tests, by method and number of bands. Failed rows take no part; no result is an error."""
    raw = raw.where("test_accuracy IS NOT NULL")
    if raw.isEmpty():
        raise ValueError("no results to evaluate")
    return summarized(raw).join(paired_tests(raw, baselines, runs), ["method", "n_selected_bands"]).orderBy("method", "n_selected_bands")
