import re

import pytest

from textsim.llm import secret_forest as S

HEX = "49b0203a9cc466e6ee3fd1b2"
TEXTS = [
    ('a = 1\ntoken = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" end', ["b44e15e09fd311c3cf3163b66d5a9875b883d8ce"]),
    (f"üü password={HEX} and sha256: {HEX}{HEX}", [HEX]),
    ("card 4981021525375367 and order 123456789012", []),
    ("uuid 49b0203a-9cc4-66e6-ee3f-d1b249b0203a", []),
    ('api_key = "your-api-key-1234"', []),
    ("just thononing words heitschaft and lyntsterhaedonth", []),
    (None, []), ("", []), ("   ", []), ("a1" * 50000, None), ("x1234567890123 " * 3000, None),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string, secrets string")
    return {r.doc_id: r for r in S.find_secrets(df).collect()}


def test_findings(found):
    for i, (text, want) in enumerate(TEXTS):
        if want is not None:
            assert [text[s.start:s.end] for s in found[i].secrets] == want, (text, found[i].secrets)
        assert found[i].n_candidates == len(re.findall(S.CANDIDATE, text or ""))


def test_forest_is_accurate_on_findings_it_has_not_seen(spark):
    rows = S.example_findings(spark, 6000)
    forest = S.train(rows.limit(4000))
    from pyspark.sql import functions as F

    unseen = rows.exceptAll(rows.limit(4000))
    judged = unseen.select("label", S.vote(S.features(F.col("value"), F.col("before"), F.col("after")), forest).alias("s")).collect()
    right = sum((r.s >= S.SECRET_AT) == (r.label == 1) for r in judged)
    assert right >= 0.97 * len(judged)


def test_redact_and_empty(spark):
    df = spark.createDataFrame([(1, f"x password={HEX} y", "en"), (2, None, "de")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in S.redact(df).orderBy("doc_id").collect()] == [(1, "x password=<secret> y", "en"), (2, None, "de")]
    assert S.redact(df.limit(0)).count() == 0


def test_documents(spark):
    from textsim.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op5_secrets"](spark, sf).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        planted = re.findall(r'token = "([0-9a-f]{40})"', t, re.I)
        got = [t[a:b] for a, b in (map(int, s.split(":")) for s in rows[i].spans.split(",") if s)]
        assert set(planted) <= set(got), (i, planted, got)


def test_context_reaches_past_the_candidate_before(spark):
    text = f'client_secret_v2 = "{HEX}" end'
    got = S.find_secrets(spark.createDataFrame([(text,)], "text string")).first()
    assert got.n_candidates == 2 and [text[s.start:s.end] for s in got.secrets] == [HEX]
