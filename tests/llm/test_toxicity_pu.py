import math

import numpy as np
from pyspark.sql import functions as F

from textsim.llm import toxicity_pu as T


def test_training_separates_and_holds_the_risk_above_zero():
    rng = np.random.default_rng(1)
    pos = rng.random((200, 10)) + np.array([2.0] + [0.0] * 9)
    unl = np.vstack([rng.random((900, 10)), rng.random((100, 10)) + np.array([2.0] + [0.0] * 9)])
    w = T.train(pos, unl, 0.1)
    z = lambda x: np.mean(np.hstack([x, np.ones((len(x), 1))]) @ w.T, axis=1)
    assert (z(pos) > 0).mean() > 0.95 and (z(unl[:900]) < 0).mean() > 0.95


def test_held_out_accuracy(spark):
    from textsim.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    found = [r.predicted for r in held if toxic[r.doc_id] == 1]
    wrong = [r.predicted for r in held if toxic[r.doc_id] == 0]
    assert sum(found) >= 0.7 * len(found) and sum(wrong) <= 0.03 * len(wrong)


def test_edges(spark):
    texts = [(i, "calm words here and there " * 4 + ("vile " if i % 5 == 0 else ""), "x") for i in range(200)]
    texts += [(500, None, "x"), (501, "", None), (None, "vile vile", "y"), (0, texts[0][1], "x"), (502, "vile " * 30000, "z"), (503, "v" * 100000, "z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    rows = T.toxicity(docs, labels).collect()
    got = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(texts) and all(0 <= s <= 1 and not math.isnan(s) for s in got.values())
    assert got[195] > 0.7 > got[196] and got[502] > 0.7 and got[500] == got[501] < 0.5
    assert T.toxicity(docs, labels.limit(0)).agg({"score": "max"}).first()[0] < 0.5
    assert T.toxicity(docs.limit(0), labels).count() == 0


def test_unspaced_runs_are_read_to_their_end(spark):
    run = lambda i, bad: "".join(chr(0x4E00 + (i * 7919 + k * 104729) % 3000) for k in range(150)) + ("毒恶辱骂" * bad) + "好" * (i % 7)
    docs = spark.createDataFrame([(i, run(i, i % 5 == 0)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels, F.col("doc_id") < 200).collect()}
    assert all((got[i] >= T.TOXIC_AT) == (i % 5 == 0) for i in range(200, 400))


def test_every_marked_word_is_learned(spark):
    """Forty toxic words, each frequent enough to pass, make far more than 256 n-grams."""
    import hashlib

    marks = ["".join(chr(97 + b % 26) for b in hashlib.md5(b"%d" % k).digest()[:9]) for k in range(40)]
    calm = "calm words here and there for a while " * 4
    docs = spark.createDataFrame([(i, calm + (marks[i // 16 % 40] if i % 16 == 0 else "")) for i in range(6400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 16 == 0)) for i in range(3200)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels, F.col("doc_id") < 3200).collect()}
    assert all((got[i] >= T.TOXIC_AT) == (i % 16 == 0) for i in range(3200, 6400))


def test_one_long_unlabelled_text_hides_no_mark(spark):
    """An unlabelled text that repeats the toxic texts many times is one text."""
    calm = "calm words here and there for a while " * 4
    rows = [(i, calm + f"w{i} " + ("vile brute " if i % 8 == 0 else "")) for i in range(1600)]
    rows.append((5000, " ".join(t for i, t in rows if i % 8 == 0) * 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(800)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels, F.col("doc_id") < 800).collect()}
    assert all((got[i] >= T.TOXIC_AT) == (i % 8 == 0) for i in range(800, 1600))
