"""Labelled texts as CSV (S5): a header with ``text`` and ``generated``, quoted values of any number of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsim.constants import TRAIN_MIN_CHARS
from textsim.functions.style import STRIP

_BAD = "_malformed"


def read_labelled_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects): texts (text, label) stripped and longer than 30 characters; rejects (text, generated, reason).

    A row is rejected when it does not parse or its label is no whole number; shorter texts are dropped without a reject.
    A quoted value may hold line ends, so a file is read by one task: write many files rather than one.
    """
    raw = (spark.read.schema(f"text string, generated string, {_BAD} string")
           .option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).option("emptyValue", "").option("enforceSchema", "true")
           .csv(path))
    label = F.when(F.col("generated").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim("generated").cast("int"))
    rows = raw.select(F.regexp_replace(F.coalesce("text", F.lit("")), STRIP, "").alias("text"), "generated", label.alias("label"),
                      F.when(F.col(_BAD).isNotNull(), "malformed row").when(label.isNull(), "label is no whole number").alias("reason"))
    texts = rows.where(F.col("reason").isNull() & (F.char_length("text") > TRAIN_MIN_CHARS)).select("text", "label")
    return texts, rows.where(F.col("reason").isNotNull()).select("text", "generated", "reason")


def write_labelled_csv(rows: DataFrame, path: str) -> None:
    """Writes (text, label) so that ``read_labelled_csv`` gets the same texts back."""
    (rows.select("text", F.col("label").cast("string").alias("generated")).write.mode("overwrite").option("header", "true")
     .option("quoteAll", "true").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
