"""Shared column expressions on whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_array(text: Column) -> Column:
    """All words of a text, in order; an empty array without words."""
    return F.array_remove(F.split(text, GAP), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: an expression that a lambda
    refers to would otherwise be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(docs: DataFrame, used: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) while the columns of docs that it does not use bear names that no operator has, so that none can
    clash. Columns that the work adds follow; one of a caller's column's name takes its place."""
    names = [c if c in used else f"passed through {i}" for i, c in enumerate(docs.columns)]
    done = work(docs.toDF(*names))
    added = [c for c in done.columns if c not in names]
    kept = [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns) if n in done.columns and c not in added]
    return done.select(*kept, *added)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lets Arrow batches hold at most ``rows`` rows from now on, since a batch of ten
    thousand long texts would not fit a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
