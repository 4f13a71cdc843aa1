"""The calibrated configuration: weights of both modes, threshold and the two accuracies, one JSON row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsim.constants import DEFAULT_WEIGHTS, DEFAULT_WEIGHTS_WITH_SEMANTIC, PLAGIARISM_THRESHOLD

MEASURES = ("cosine", "jaccard", "ngram", "semantic")
_WEIGHTS = "struct<" + ", ".join(f"{m}: double" for m in MEASURES) + ">"
SCHEMA = (f"similarity_weights {_WEIGHTS}, similarity_weights_with_semantic {_WEIGHTS}, plagiarism_threshold double, "
          "ai_detector_accuracy double, plagiarism_detector_accuracy double")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def weights_struct(cosine, jaccard, ngram, semantic):
    as_column = lambda x: F.lit(float(x)) if isinstance(x, (int, float)) else x
    return F.struct(*[as_column(x).alias(m) for m, x in zip(MEASURES, (cosine, jaccard, ngram, semantic))])


def write_config(config: DataFrame, path: str) -> None:
    """Writes the one row of ``config`` (columns of ``SCHEMA``) as JSON."""
    config.select(*[f.name for f in spark_schema()]).coalesce(1).write.mode("overwrite").json(path)  # one row


def spark_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA)


def load_config(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row (columns of ``SCHEMA``): what the file says, and defaults for whatever it does not say.

    A missing path, an empty folder or no path gives the defaults; accuracies that are not stated stay null. With several
    rows the last one in order of the threshold counts, so that the result is always one row.
    """
    default = lambda w: F.struct(*[F.lit(w[m]).alias(m) for m in MEASURES])
    if path is not None and path_exists(spark, path):
        stated = spark.read.schema(SCHEMA).option("multiLine", "true").json(path).orderBy(F.desc_nulls_last("plagiarism_threshold")).limit(1)
    else:
        stated = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark_schema()])
    filled = lambda name, w: F.struct(*[F.coalesce(F.col(f"{name}.{m}"), F.lit(w[m])).alias(m) for m in MEASURES]).alias(name)
    return spark.range(1).join(stated, how="left").select(
        filled("similarity_weights", DEFAULT_WEIGHTS), filled("similarity_weights_with_semantic", DEFAULT_WEIGHTS_WITH_SEMANTIC),
        F.coalesce("plagiarism_threshold", F.lit(PLAGIARISM_THRESHOLD)).alias("plagiarism_threshold"), "ai_detector_accuracy",
        "plagiarism_detector_accuracy")


def score_with_config(components: DataFrame, config: DataFrame, include_semantic: bool = False) -> DataFrame:
    """Adds overall_score and flagged (at or above the threshold) under the row of ``config``; with ``include_semantic`` by the
    four weights and the column ``semantic``, else by the lexical ones."""
    from textsim.functions.scores import classification

    name = "similarity_weights_with_semantic" if include_semantic else "similarity_weights"
    semantic = F.col("semantic") if include_semantic else F.lit(0.0)
    one = config.select(F.col(name).alias("_weights"), F.col("plagiarism_threshold").alias("_threshold"))
    w = lambda m: F.col(f"_weights.{m}")
    total = (F.col("cosine") * w("cosine") + F.col("jaccard") * w("jaccard") + F.col("ngram") * w("ngram") + semantic * w("semantic"))
    return (components.crossJoin(F.broadcast(one))  # one row
            .withColumn("overall_score", F.round(total * 100, 2))
            .withColumn("flagged", F.col("overall_score") >= F.col("_threshold"))
            .withColumn("classification", classification(F.col("overall_score"))).drop("_weights", "_threshold"))
