"""Semantic operators on ``embeddings``: document = ``label``, sentence = ``vec_id``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textsim.constants import MAX_SEMANTIC_MATCHES, SEMANTIC_MATCH_THRESHOLD
from textsim.functions.scores import match_band, sql_match_band
from textsim.operators import semantic as SEM
from textsim.plans.registry import query
from textsim.sources.tables import load


def _vectors(spark, sf):
    return SEM.normalized_vectors(load(spark, sf, "embeddings", "vec_id", "embedding", "label"), "label", "vec_id", "embedding")


_SIMS = f"""WITH e AS (SELECT label AS doc, vec_id AS sent, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT doc, sent, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
s AS (SELECT x.doc AS a, y.doc AS b, x.sent AS i, y.sent AS j, list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) AS sim
      FROM n x JOIN n y ON x.doc < y.doc)"""


@query("semantic_score", f"""{_SIMS},
c AS (SELECT doc, count(*) AS n FROM e GROUP BY doc),
best AS (SELECT a, b, i, max(sim) AS best_sim FROM s GROUP BY ALL)
SELECT a AS doc1, b AS doc2, round(least(avg(best_sim), 1.0), 6) AS semantic_score,
       any_value(ca.n) AS total_sentences_doc1, any_value(cb.n) AS total_sentences_doc2
FROM best JOIN c ca ON ca.doc = a JOIN c cb ON cb.doc = b GROUP BY a, b""")
def q_semantic_score(spark, sf):
    v = _vectors(spark, sf)
    out = SEM.semantic_scores(v, SEM.all_doc_pairs(v))
    return out.select(F.col("a").alias("doc1"), F.col("b").alias("doc2"), F.round("semantic_score", 6).alias("semantic_score"),
                      "total_sentences_doc1", "total_sentences_doc2")


@query("semantic_matches", f"""{_SIMS}
SELECT a AS doc1, b AS doc2, i AS source_sentence, j AS matched_sentence, round(sim, 6) AS similarity
FROM s WHERE sim > {SEMANTIC_MATCH_THRESHOLD!r}""")
def q_semantic_matches(spark, sf):
    v = _vectors(spark, sf)
    _, m = SEM.sentence_best(v, SEM.all_doc_pairs(v))
    return m.select(F.col("a").alias("doc1"), F.col("b").alias("doc2"), F.col("i").alias("source_sentence"),
                    F.col("j").alias("matched_sentence"), F.round("similarity", 6).alias("similarity"))


@query("semantic_top_matches", f"""{_SIMS},
m AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY sim DESC, i, j) AS rank FROM s WHERE sim > {SEMANTIC_MATCH_THRESHOLD!r})
SELECT a AS doc1, b AS doc2, rank, i AS source_sentence, j AS matched_sentence, round(sim, 6) AS similarity,
       {sql_match_band('sim')} AS band
FROM m WHERE rank <= {MAX_SEMANTIC_MATCHES}""")
def q_semantic_top_matches(spark, sf):
    v = _vectors(spark, sf)
    _, m = SEM.sentence_best(v, SEM.all_doc_pairs(v))
    t = SEM.top_matches(m)
    return t.select(F.col("a").alias("doc1"), F.col("b").alias("doc2"), "rank", F.col("i").alias("source_sentence"),
                    F.col("j").alias("matched_sentence"), F.round("similarity", 6).alias("similarity"),
                    match_band(F.col("similarity")).alias("band"))


@query("match_bands", f"""{_SIMS}
SELECT a AS doc1, b AS doc2, {sql_match_band('sim')} AS band, count(*) AS n_matches
FROM s WHERE sim > {SEMANTIC_MATCH_THRESHOLD!r} GROUP BY ALL""")
def q_match_bands(spark, sf):
    v = _vectors(spark, sf)
    _, m = SEM.sentence_best(v, SEM.all_doc_pairs(v))
    return (m.groupBy(F.col("a").alias("doc1"), F.col("b").alias("doc2"), match_band(F.col("similarity")).alias("band"))
            .agg(F.count(F.lit(1)).alias("n_matches")))
