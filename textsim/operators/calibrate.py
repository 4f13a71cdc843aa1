"""Threshold sweep, weight grid search and final evaluation over scored pairs.

Neither search crosses every pair with every grid point.  A pair predicts 1 at
threshold t exactly when floor(score) (or floor(2 score) on the half-point
sweep) reaches t, so pairs are first counted per (label, bin) -- a table with a
constant number of rows -- and accuracies come from cumulative counts.  The
weight grid is a fixed 64-cell parameter table, broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsim.constants import (FALLBACK_EVAL_WEIGHTS, GRID_THRESHOLDS, SWEEP_HALF_POINTS)

GRID_SIZE = 8  # cosine and jaccard weights: 8 steps each


def _arange(start: float, step: float, i):
    """The i-th value of numpy's arange(start, ..., step): start + i * ((start + step) - start)."""
    return F.lit(start) + i.cast("double") * F.lit((start + step) - start)


def _accuracy_from_bins(bins: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """bins(keys..., label, k, n) + grid(t) -> keys, t, tp, fp, tn, fn, accuracy (pred = k >= t)."""
    tot = bins.groupBy(*keys).agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"),
                                  F.sum("n").alias("total"))
    j = bins.join(F.broadcast(grid), F.col("k") >= F.col("t"))  # bins and grid: constant-size tables
    up = j.groupBy(*keys, "t").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("tp"),
                                   F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("fp"))
    full = tot.join(F.broadcast(grid), how="cross").join(up, [*keys, "t"], "left").fillna(0, ["tp", "fp"])
    return full.select(*keys, "t", "tp", "fp", (F.col("total") - F.col("pos") - F.col("fp")).alias("tn"),
                       (F.col("pos") - F.col("tp")).alias("fn"),
                       ((F.col("tp") + F.col("total") - F.col("pos") - F.col("fp")) / F.col("total")).alias("accuracy"))


def threshold_sweep(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """(t2, threshold = t2 / 2, tp, fp, tn, fn, accuracy) for thresholds 10.0, 10.5, ..., 49.5."""
    lo, hi = SWEEP_HALF_POINTS
    bins = (scored.select("label", F.floor(F.col("overall") * 2).alias("k"))
            .groupBy("label", "k").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0)))
    grid = spark.range(lo, hi).select(F.col("id").alias("t"))
    out = _accuracy_from_bins(bins, grid, ["g"])
    return out.select(F.col("t").alias("t2"), (F.col("t") / 2.0).alias("threshold"), "tp", "fp", "tn", "fn", "accuracy")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest accuracy; ties go to the smallest threshold."""
    return sweep.orderBy(F.desc("accuracy"), "t2").limit(1)


def weight_cells(spark: SparkSession) -> DataFrame:
    """Feasible (cosine, jaccard, ngram) weight cells of the 8 x 8 grid."""
    g = spark.range(GRID_SIZE * GRID_SIZE).select((F.col("id") / GRID_SIZE).cast("int").alias("i"),
                                                  (F.col("id") % GRID_SIZE).cast("int").alias("j"))
    g = g.select("i", "j", _arange(0.2, 0.05, F.col("i")).alias("cw"), _arange(0.1, 0.05, F.col("j")).alias("jw"))
    g = g.withColumn("nw", F.lit(1.0) - F.col("cw") - F.col("jw"))
    return g.filter(~((F.col("nw") < 0.05) | (F.col("nw") > 0.5)))


def weight_grid(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """(i, j, cw, jw, nw, threshold, accuracy) over feasible cells and integer thresholds 10..49."""
    cells = weight_cells(spark)
    score = (F.col("cw") * F.col("cosine") + F.col("jw") * F.col("jaccard") + F.col("nw") * F.col("ngram")) * 100.0
    bins = (scored.select("label", "cosine", "jaccard", "ngram").crossJoin(F.broadcast(cells))  # 50 fixed cells
            .select("i", "j", "cw", "jw", "nw", "label", F.floor(score).alias("k"))
            .groupBy("i", "j", "cw", "jw", "nw", "label", "k").agg(F.count(F.lit(1)).alias("n")))
    lo, hi = GRID_THRESHOLDS
    grid = spark.range(lo, hi).select(F.col("id").alias("t"))
    out = _accuracy_from_bins(bins, grid, ["i", "j", "cw", "jw", "nw"])
    return out.select("i", "j", "cw", "jw", "nw", F.col("t").alias("threshold"), "accuracy")


def best_weights(grid: DataFrame) -> DataFrame:
    """Best accuracy; ties go to the first cell in (cosine, jaccard, threshold) order."""
    return grid.filter(F.col("accuracy") > 0).orderBy(F.desc("accuracy"), "i", "j", "threshold").limit(1)


def final_eval(scored: DataFrame, best_w: DataFrame, best_t: DataFrame) -> DataFrame:
    """Re-score with the chosen weights (fallback 0.40/0.30/0.30 at the sweep threshold)."""
    fw = FALLBACK_EVAL_WEIGHTS
    choice = (best_t.select(F.col("threshold").alias("sweep_t")).join(
        best_w.select("cw", "jw", "nw", F.col("threshold").cast("double").alias("grid_t")), how="left")  # 1 x <=1 row
        .select(F.coalesce("cw", F.lit(fw[0])).alias("cw"), F.coalesce("jw", F.lit(fw[1])).alias("jw"),
                F.coalesce("nw", F.lit(fw[2])).alias("nw"), F.coalesce("grid_t", "sweep_t").alias("thr")))
    s = scored.crossJoin(F.broadcast(choice))  # one row
    score = (F.col("cw") * F.col("cosine") + F.col("jw") * F.col("jaccard") + F.col("nw") * F.col("ngram")) * 100.0
    return s.select("pair_id", "type", "label", score.alias("score"), "thr").select(
        "pair_id", "type", "label", "score", (F.col("score") >= F.col("thr")).cast("int").alias("pred")
    ).withColumn("correct", (F.col("pred") == F.col("label")).cast("int"))


def type_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("type").agg(F.first("label").alias("label"), F.avg("overall").alias("mean_score"),
                                      F.stddev_pop("overall").alias("std_score"), F.min("overall").alias("min_score"),
                                      F.max("overall").alias("max_score"))
