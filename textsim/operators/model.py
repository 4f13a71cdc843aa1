"""Style classifier on Spark ML: assemble 15 features, standardise, boosted trees; a store of fitted models; exact folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textsim.constants import CV_FOLDS, GBT_PARAMS, STYLE_FEATURES
from textsim.session import ensure_checkpoint_dir
from textsim.sources.config import path_exists


def detector_pipeline(max_iter: int | None = None, label_col: str = "label") -> Pipeline:
    params = dict(GBT_PARAMS)
    if max_iter is not None:
        params["maxIter"] = max_iter
    return Pipeline(stages=[
        VectorAssembler(inputCols=STYLE_FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        GBTClassifier(featuresCol="features", labelCol=label_col, **params),
    ])


def train_detector(train: DataFrame, max_iter: int | None = None, label_col: str = "label") -> PipelineModel:
    return detector_pipeline(max_iter, label_col).fit(train)


def save_model(model: PipelineModel, path: str) -> None:
    """Assembler, scaler and trees in one folder; it takes its name only when it is whole."""
    import uuid

    spark = SparkSession.getActiveSession()
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    part = f"{path}-{uuid.uuid4().hex}"
    model.write().overwrite().save(part)
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(to(path)):
        fs.rename(to(part), to(path))


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved model; None where there is none (``predict`` then gives the 'unknown' verdict)."""
    return PipelineModel.load(path) if path_exists(spark, path) else None


def content_key(train: DataFrame, label_col: str = "label", **params) -> str:
    """Names a fit: order-free hashes of the training rows and the parameters. Rows are one aggregate."""
    import hashlib

    h = F.xxhash64(*STYLE_FEATURES, label_col)
    row = train.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_000_007)))).first()
    return hashlib.md5(repr((tuple(row), sorted({**GBT_PARAMS, **params}.items()))).encode()).hexdigest()


def stored_detector(train: DataFrame, max_iter: int | None = None, label_col: str = "label") -> PipelineModel:
    """The detector fitted on these rows: read from the shared folder if it was fitted before, else fitted and saved."""
    spark = train.sparkSession
    key = content_key(train, label_col, **({} if max_iter is None else {"maxIter": max_iter}))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/textsim-model-{key}"
    model = load_model(spark, path)
    if model is None:
        model = train_detector(train, max_iter, label_col)
        save_model(model, path)
    return model


def predict(model: PipelineModel | None, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Verdict columns: label text, is_ai, confidence = max(p), both probabilities.

    Without a model every row gets the 'unknown' verdict with zero confidence.
    """
    if model is None:
        return df.select(id_col, F.lit("unknown").alias("verdict"), F.lit(None).cast("boolean").alias("is_ai"),
                         F.lit(0.0).alias("confidence"), F.lit(None).cast("double").alias("ai_probability"),
                         F.lit(None).cast("double").alias("human_probability"))
    out = model.transform(df).withColumn("p", vector_to_array("probability"))
    return out.select(
        id_col,
        F.when(F.col("prediction") == 1.0, "AI-Generated").otherwise("Human-Written").alias("verdict"),
        (F.col("prediction") == 1.0).alias("is_ai"),
        F.greatest(F.col("p")[0], F.col("p")[1]).alias("confidence"),
        F.col("p")[1].alias("ai_probability"),
        F.col("p")[0].alias("human_probability"),
    )


def label_ranks(rows: DataFrame, id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """Adds ``_rank`` (from 1) and ``_size``: the place of a row in its label by md5 of the id, and the label's rows.

    Rows are counted by (label, first four hex digits); running counts give the rows before those digits, and only rows with
    the same digits are numbered together. No label is sorted as a whole.
    """
    marked = rows.withColumn("_md5", F.md5(F.col(id_col).cast("string"))).withColumn("_digits", F.substring("_md5", 1, 4))
    counts = marked.groupBy(label_col, "_digits").agg(F.count(F.lit(1)).alias("_n"))
    by_label = Window.partitionBy(label_col)
    before = counts.select(label_col, "_digits", (F.sum("_n").over(by_label.orderBy("_digits")) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(by_label).alias("_size"))
    inside = Window.partitionBy(label_col, "_digits").orderBy("_md5", id_col)
    placed = marked.withColumn("_place", F.row_number().over(inside)).join(before, [label_col, "_digits"])
    return placed.withColumn("_rank", F.col("_before") + F.col("_place")).select(*rows.columns, "_rank", "_size")


def with_folds(rows: DataFrame, folds: int = CV_FOLDS, id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """Adds ``fold``: the rows of each label are dealt in turn, so that a label's folds differ by one row at most."""
    fold = F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")
    return label_ranks(rows, id_col, label_col).withColumn("fold", fold).drop("_rank", "_size")


def cross_validate(spark, data: DataFrame, max_iter: int | None = None, folds: int = CV_FOLDS,
                   id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """Per-fold accuracy: fold k is held out, the model is fitted on the rest.

    The loop runs ``folds`` model fits; each fit and evaluation is a Spark job.
    """
    data = with_folds(data, folds, id_col, label_col).cache()
    rows = []
    for k in range(folds):
        model = stored_detector(data.filter(F.col("fold") != k), max_iter, label_col)
        acc = (model.transform(data.filter(F.col("fold") == k))
               .agg(F.avg((F.col("prediction") == F.col(label_col)).cast("double")).alias("a")).first()["a"])
        rows.append((k, float(acc) if acc is not None else 0.0))
    data.unpersist()
    return spark.createDataFrame(rows, "fold int, accuracy double")


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(STYLE_FEATURES, imp)), "feature string, importance double")
