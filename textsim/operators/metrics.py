"""Binary-classification metrics as single-pass conditional aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row: tn, fp, fn, tp (a 2x2 confusion matrix)."""
    l, p = F.col(label), F.col(pred)
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return df.agg(c((l == 0) & (p == 0)).alias("tn"), c((l == 0) & (p == 1)).alias("fp"),
                  c((l == 1) & (p == 0)).alias("fn"), c((l == 1) & (p == 1)).alias("tp"))


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """accuracy, precision, recall, f1 (zero when undefined) plus support."""
    cm = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return cm.select(_div(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"),
                     rec.alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     (tp + tn + fp + fn).alias("support"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class (0, 1) precision / recall / f1 / support, plus macro and weighted averages."""
    cm = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = F.array(
        F.struct(F.lit("0").alias("cls"), _div(tn, tn + fn).alias("precision"), _div(tn, tn + fp).alias("recall"),
                 _div(2 * tn, 2 * tn + fn + fp).alias("f1"), (tn + fp).alias("support")),
        F.struct(F.lit("1").alias("cls"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
                 _div(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")))
    per = cm.select(F.explode(rows).alias("r")).select("r.*")
    tot = F.sum("support")
    avg = per.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                  F.avg("f1").alias("f1"), tot.alias("support"))
    wavg = per.agg(F.lit("weighted avg").alias("cls"), (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                   (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                   (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    return per.unionByName(avg).unionByName(wavg)
