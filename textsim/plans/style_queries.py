"""Style features, labelled texts, split, scaling and the boosted-tree detector."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textsim.constants import CV_FOLDS, STYLE_FEATURES, TRAIN_MIN_CHARS
from textsim.functions.style import STRIP, _sql_re, style_features, style_features_sql
from textsim.operators import metrics as M
from textsim.operators import model as ML
from textsim.plans.registry import query
from textsim.session import ensure_checkpoint_dir, materialize
from textsim.sources.labelled_csv import read_labelled_csv, write_labelled_csv
from textsim.sources.tables import load, spread

CV_TREES = 20             # trees of the five fits of the registered cross-validation; everything else has the 200 of the library
TEST_SHARE = 0.2


def _docs(spark, sf):
    return spread(load(spark, sf, "documents", "doc_id", "text"))


@query("style_features", style_features_sql())
def q_style_features(spark, sf):
    out = style_features(_docs(spark, sf))
    return out.select("doc_id", *[F.round(k, 6).alias(k) for k in STYLE_FEATURES])


def labelled_texts(spark, sf):
    """Labelled texts: stripped text longer than 30 characters, label = quality."""
    d = load(spark, sf, "documents", "doc_id", "text").withColumn("text", F.regexp_replace("text", STRIP, ""))
    lab = load(spark, sf, "labels", "doc_id", "quality")
    return (d.join(lab, "doc_id").filter(F.char_length("text") > TRAIN_MIN_CHARS)
            .select("doc_id", "text", F.col("quality").alias("label")))


_LABELLED_SQL = f"""SELECT d.doc_id, regexp_replace(d.text, {_sql_re(STRIP)}, '', 'g') AS text, l.quality AS label
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
WHERE length(regexp_replace(d.text, {_sql_re(STRIP)}, '', 'g')) > {TRAIN_MIN_CHARS}"""


@query("labelled_texts", f"SELECT doc_id, label, length(text) AS n_chars FROM ({_LABELLED_SQL})")
def q_labelled_texts(spark, sf):
    return labelled_texts(spark, sf).select("doc_id", "label", F.char_length("text").alias("n_chars"))


def with_split(rows, id_col: str = "doc_id"):
    """Adds ``split``: of each label the fifth with the smallest md5 of the id is the test part."""
    test = F.floor(F.col("_size") * TEST_SHARE + 0.5)
    return ML.label_ranks(rows, id_col).withColumn("split", F.when(F.col("_rank") <= test, "test").otherwise("train")).drop("_rank", "_size")


_SPLIT_SQL = f"""SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id)
  <= floor(count(*) OVER (PARTITION BY label) * {TEST_SHARE} + 0.5) THEN 'test' ELSE 'train' END AS split FROM ({_LABELLED_SQL})"""


@query("stratified_split", f"SELECT label, split, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY ALL")
def q_stratified_split(spark, sf):
    return with_split(labelled_texts(spark, sf).select("doc_id", "label")).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("label_counts", f"SELECT label, count(*) AS n FROM ({_LABELLED_SQL}) GROUP BY label")
def q_label_counts(spark, sf):
    """How many texts the detector is trained from, by label."""
    return labelled_texts(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("fold_counts", f"""SELECT label, fold, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM (SELECT doc_id, label,
  ((row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % {CV_FOLDS})::INTEGER AS fold
  FROM ({_SPLIT_SQL}) WHERE split = 'train') GROUP BY label, fold""")
def q_fold_counts(spark, sf):
    """The stratified folds of the training part."""
    train = with_split(labelled_texts(spark, sf).select("doc_id", "label")).where("split = 'train'")
    return ML.with_folds(train).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@query("labelled_csv", f"SELECT md5(text) AS text_md5, label, count(*) AS n FROM ({_LABELLED_SQL}) GROUP BY ALL")
def q_labelled_csv(spark, sf):
    """The labelled texts written as CSV and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/textsim-csv-{uuid.uuid4().hex}"
    write_labelled_csv(labelled_texts(spark, sf), path)
    texts, _ = read_labelled_csv(spark, path)
    return texts.groupBy(F.md5("text").alias("text_md5"), "label").agg(F.count(F.lit(1)).alias("n"))


def labelled_features(spark, sf):
    lt = labelled_texts(spark, sf)
    feats = style_features(lt.select("doc_id", "text"))
    return with_split(lt.select("doc_id", "label")).join(feats, "doc_id")


@query("style_scaled", f"""WITH f AS ({style_features_sql(f'({_LABELLED_SQL})')}),
sp AS ({_SPLIT_SQL}),
l AS (SELECT f.*, sp.split FROM f JOIN sp ON sp.doc_id = f.doc_id),
st AS (SELECT {', '.join(f'avg({k}) AS m_{k}, stddev_pop({k}) AS s_{k}' for k in STYLE_FEATURES)} FROM l WHERE split = 'train')
SELECT doc_id, split, {', '.join(f'round(({k} - m_{k}) / CASE WHEN s_{k} = 0 THEN 1.0 ELSE s_{k} END, 4) AS {k}' for k in STYLE_FEATURES)}
FROM l, st""")
def q_style_scaled(spark, sf):
    """Standardised features (train-split mean and population std; zero std -> 1)."""
    lf = labelled_features(spark, sf).select("doc_id", "split", *[F.round(k, 6).alias(k) for k in STYLE_FEATURES])
    stats = lf.filter(F.col("split") == "train").agg(
        *[x for k in STYLE_FEATURES for x in (F.avg(k).alias(f"m_{k}"), F.stddev_pop(k).alias(f"s_{k}"))])
    scaled = [F.round((F.col(k) - F.col(f"m_{k}")) / F.when(F.col(f"s_{k}") == 0, 1.0).otherwise(F.col(f"s_{k}")), 4).alias(k)
              for k in STYLE_FEATURES]
    return lf.crossJoin(F.broadcast(stats)).select("doc_id", "split", *scaled)  # stats: one row


def _fit(spark, sf):
    lf = materialize(labelled_features(spark, sf), "features")
    model = ML.stored_detector(lf.filter(F.col("split") == "train"))
    return lf, model


@query("ai_predictions")
def q_ai_predictions(spark, sf):
    lf, model = _fit(spark, sf)
    test = lf.filter(F.col("split") == "test")
    return ML.predict(model, test).join(test.select("doc_id", "label"), "doc_id")


def detector_test_metrics(spark, sf):
    lf, model = _fit(spark, sf)
    test = lf.filter(F.col("split") == "test")
    pred = ML.predict(model, test).join(test.select("doc_id", "label"), "doc_id")
    return M.binary_metrics(pred.withColumn("pred", F.col("is_ai").cast("int")))


@query("detector_metrics")
def q_detector_metrics(spark, sf):
    return detector_test_metrics(spark, sf)


@query("cv_metrics")
def q_cv_metrics(spark, sf):
    lf = materialize(labelled_features(spark, sf).filter(F.col("split") == "train"), "features")
    folds = ML.cross_validate(spark, lf, max_iter=CV_TREES)
    summary = folds.agg(F.avg("accuracy").alias("cv_accuracy_mean"), F.stddev_pop("accuracy").alias("cv_accuracy_std"))
    return folds.crossJoin(summary)  # summary: one row


@query("feature_importance")
def q_feature_importance(spark, sf):
    _, model = _fit(spark, sf)
    return ML.feature_importance(model, spark).orderBy(F.desc("importance"), "feature")
