"""Columns of the caller that bear the operators' own names pass through every operator and stage unchanged."""

import corpus_pipeline as P
from textsim.llm import mixing, ngram_join, pii, quality_llr, secret_forest, topk_search
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ["score", "passes", "_size", "size", "_row", "_pass", "_once", "_was", "_text", "_h", "_sec_text", "_sec_hits", "_pii_text",
         "_k0", "_trusted", "secrets", "n_candidates", "finish", "id", "tokens", "bucket", "spans", "a b", "dotted.name", "TARGET"]
TEXTS = ["one text of some words that all stay", "one text of some words that all stay", "mail me at a@b.org please, it is me", "", None,
         "password = a8F3kd93jfK20dkfJ3kd in this text", "  \n"]


def _docs(spark):
    rows = [(i, t, "web" if i % 2 else None, "en", len(t or "")) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


def _extras_kept(rows, names=NAMES):
    for r in rows:
        for n in names:
            assert r[n] == f"{n}/{r['doc_id']}"


def test_pipeline_stages(spark):
    docs = _docs(spark)
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows
        _extras_kept(rows)
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_operators(spark):
    docs = _docs(spark)
    assert [r["doc_id"] for r in ngram_join.one_of_each(docs).orderBy("doc_id").collect()] == [0, 2, 3, 4, 5, 6]
    mix = mixing.mixed(docs).collect()
    assert {r["text"] for r in mix} <= set(TEXTS) - {"", None, "  \n"}
    _extras_kept(mix)
    found = pii.find_pii(docs).collect()
    assert {r["doc_id"]: len(r["spans"]) for r in found}[2] == 1
    _extras_kept(found, [n for n in NAMES if n != "spans"])
    _extras_kept(pii.redact(docs).collect())
    judged = quality_llr.quality(docs, docs.select("doc_id").limit(2)).collect()
    assert {r["doc_id"]: r["n_words"] for r in judged} == {i: len((t or "").split()) for i, t in enumerate(TEXTS)}
    _extras_kept(judged, [n for n in NAMES if n != "score"])
    secrets = secret_forest.find_secrets(docs)
    assert secrets.schema["secrets"].dataType.typeName() == "array"
    _extras_kept(secrets.collect(), [n for n in NAMES if n not in ("secrets", "n_candidates")])


def test_huge_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -4.0]), (2, [0.5, 0.5]), (20, [1e200, 1.0]), (3, [-1e200, 0.0]), (4, [1e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == [(0, 1, 2, 64 * 32 + 128 * 32), (0, 2, 1, 64 * 192 - 128 * 256)]
