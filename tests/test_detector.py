"""Configuration file, labelled CSV, model store, stratified folds."""

import json

from pyspark.sql import functions as F

from textsim.constants import DEFAULT_WEIGHTS, DEFAULT_WEIGHTS_WITH_SEMANTIC, PLAGIARISM_THRESHOLD, STYLE_FEATURES
from textsim.operators import model as ML
from textsim.sources import config as CFG
from textsim.sources.labelled_csv import read_labelled_csv, write_labelled_csv


def test_config_defaults_and_partial_file(spark, tmp_path):
    none = CFG.load_config(spark, str(tmp_path / "missing")).collect()
    assert len(none) == 1 and none[0].similarity_weights.asDict() == DEFAULT_WEIGHTS
    assert none[0].plagiarism_threshold == PLAGIARISM_THRESHOLD and none[0].ai_detector_accuracy is None
    (tmp_path / "config.json").write_text(json.dumps({"plagiarism_threshold": 42.0, "similarity_weights": {"cosine": 0.6}}, indent=2))
    row = CFG.load_config(spark, str(tmp_path / "config.json")).first()
    assert row.plagiarism_threshold == 42.0 and row.similarity_weights.asDict() == {**DEFAULT_WEIGHTS, "cosine": 0.6}
    assert row.similarity_weights_with_semantic.asDict() == DEFAULT_WEIGHTS_WITH_SEMANTIC


def test_scores_follow_the_written_config(spark, tmp_path):
    parts = spark.createDataFrame([(1, 1.0, 0.5, 0.0, 0.2), (2, 0.1, 0.1, 0.1, 0.9)], "id int, cosine double, jaccard double, ngram double, semantic double")
    row = lambda w, t: spark.range(1).select(
        CFG.weights_struct(*w).alias("similarity_weights"), CFG.weights_struct(0.25, 0.15, 0.15, 0.45).alias("similarity_weights_with_semantic"),
        F.lit(t).alias("plagiarism_threshold"), F.lit(0.9).alias("ai_detector_accuracy"), F.lit(0.8).alias("plagiarism_detector_accuracy"))
    seen = {}
    for name, w, t in (("a", (1.0, 0.0, 0.0, 0.0), 50.0), ("b", (0.0, 1.0, 0.0, 0.0), 60.0)):
        path = str(tmp_path / name)
        CFG.write_config(row(w, t), path)
        cfg = CFG.load_config(spark, path)
        assert (cfg.first().ai_detector_accuracy, cfg.first().plagiarism_detector_accuracy) == (0.9, 0.8)
        seen[name] = {r.id: (r.overall_score, r.flagged) for r in CFG.score_with_config(parts, cfg).collect()}
    assert seen == {"a": {1: (100.0, True), 2: (10.0, False)}, "b": {1: (50.0, False), 2: (10.0, False)}}
    semantic = {r.id: r.overall_score for r in CFG.score_with_config(parts, CFG.load_config(spark), include_semantic=True).collect()}
    assert semantic == {1: 41.5, 2: 46.0}


def test_csv_round_trip_and_rejects(spark, tmp_path):
    body = "long enough to be kept, with \"quotes\", commas\nand lines\n\nof text"
    rows = spark.createDataFrame([(body, 1), ("  " + body + " \n", 0), ("short", 1), (body + " \\ backslash \\\" end", 0)], "text string, label int")
    write_labelled_csv(rows, str(tmp_path / "csv"))
    texts, rejects = read_labelled_csv(spark, str(tmp_path / "csv"))
    assert sorted((r.text, r.label) for r in texts.collect()) == sorted([(body, 1), (body, 0), (body + " \\ backslash \\\" end", 0)])
    assert rejects.count() == 0
    (tmp_path / "bad.csv").write_text('text,generated\n"a text that is certainly longer than thirty characters",maybe\n'
                                      '"another text, also longer than thirty characters",1\n"this one has no label, but thirty characters"\n')
    texts, rejects = read_labelled_csv(spark, str(tmp_path / "bad.csv"))
    assert [r.label for r in texts.collect()] == [1]
    assert sorted(r.reason for r in rejects.collect()) == ["label is no whole number", "malformed row"]


def _features(spark, n=60):
    columns = [((F.xxhash64("id", F.lit(k)) % 1000) / 1000.0 + (F.col("id") % 2) * (3.0 if k == "avg_sent_len" else 0.0)).alias(k) for k in STYLE_FEATURES]
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"), *columns)


def test_model_store_finds_the_same_fit_again(spark, tmp_path, monkeypatch):
    data = _features(spark)
    first = ML.stored_detector(data, max_iter=2)
    monkeypatch.setattr(ML, "train_detector", lambda *a, **k: (_ for _ in ()).throw(AssertionError("fitted again")))
    again = ML.stored_detector(data.repartition(3), max_iter=2)
    of = lambda m: sorted((r.doc_id, r.verdict, r.ai_probability) for r in ML.predict(m, data).collect())
    assert of(first) == of(again)
    assert ML.content_key(data) != ML.content_key(data.where("doc_id > 0")) != ML.content_key(data, maxIter=3)
    assert ML.load_model(spark, str(tmp_path / "none")) is None
    assert {r.verdict for r in ML.predict(None, data).collect()} == {"unknown"}


def test_folds_are_stratified(spark):
    rows = spark.range(103).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    counts = {}
    for r in ML.with_folds(rows).collect():
        counts[r.label, r.fold] = counts.get((r.label, r.fold), 0) + 1
    for label in (0, 1):
        sizes = [counts[label, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert sum(counts.values()) == 103
