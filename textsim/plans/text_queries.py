"""Single-document text operators over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textsim.functions import text as T
from textsim.operators import profiles as P
from textsim.plans.oracle import stemmed_cte
from textsim.plans.registry import query
from textsim.sources.tables import load, spread


def _docs(spark, sf):
    return spread(load(spark, sf, "documents", "doc_id", "text"))


_CLEAN = T.sql_clean_text("text")
_TOKS = T.sql_word_tokens("c")
_CT = T.sql_content_tokens(_TOKS)


@query("clean_text", f"SELECT doc_id, {_CLEAN} AS clean_text FROM documents")
def q_clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text")).alias("clean_text"))


@query("word_tokens", f"""SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
FROM (SELECT doc_id, {_TOKS} AS tk FROM (SELECT doc_id, {_CLEAN} AS c FROM documents))""")
def q_word_tokens(spark, sf):
    tk = T.word_tokens(T.clean_text(F.col("text")))
    return (_docs(spark, sf).select("doc_id", tk.alias("tk"))
            .select("doc_id", F.size("tk").alias("n_tokens"), F.md5(F.array_join("tk", " ")).alias("tokens_md5")))


@query("content_tokens", f"""SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
FROM (SELECT doc_id, {_CT} AS tk FROM (SELECT doc_id, {_CLEAN} AS c FROM documents))""")
def q_content_tokens(spark, sf):
    tk = P.preprocess(F.col("text"), use_stemming=False)
    return (_docs(spark, sf).select("doc_id", tk.alias("tk"))
            .select("doc_id", F.size("tk").alias("n_tokens"), F.md5(F.array_join("tk", " ")).alias("tokens_md5")))


@query("stemmed_tokens", f"""SELECT doc_id, len(ct) AS n_tokens, md5(array_to_string(ct, ' ')) AS tokens_md5
FROM ({stemmed_cte('documents', 'doc_id')})""")
def q_stemmed_tokens(spark, sf):
    tk = P.preprocess(F.col("text"), use_stemming=True)
    return (_docs(spark, sf).select("doc_id", tk.alias("tk"))
            .select("doc_id", F.size("tk").alias("n_tokens"), F.md5(F.array_join("tk", " ")).alias("tokens_md5")))


@query("sentences", f"""SELECT doc_id, CAST(generate_subscripts(se, 1) - 1 AS INTEGER) AS sent_idx, unnest(se) AS sentence
FROM (SELECT doc_id, {T.sql_sentences('text')} AS se FROM documents)""")
def q_sentences(spark, sf):
    return (_docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence")))


@query("ngrams", f"""SELECT doc_id, len(g) AS n_ngrams, len(list_distinct(g)) AS n_distinct,
       md5(array_to_string(g, '|')) AS ngrams_md5
FROM (SELECT doc_id, {T.sql_ngrams('tk')} AS g FROM (SELECT doc_id, {_CT} AS tk FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)))""")
def q_ngrams(spark, sf):
    g = T.ngrams(P.preprocess(F.col("text"), use_stemming=False))
    return (_docs(spark, sf).select("doc_id", g.alias("g"))
            .select("doc_id", F.size("g").alias("n_ngrams"), F.size(F.array_distinct("g")).alias("n_distinct"),
                    F.md5(F.array_join("g", "|")).alias("ngrams_md5")))


@query("term_frequencies", f"""SELECT doc_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest({T.sql_terms('text')}) AS term FROM documents) GROUP BY ALL""")
def q_term_frequencies(spark, sf):
    return (_docs(spark, sf).select("doc_id", F.explode(T.term_counts(T.terms(F.col("text")))).alias("e"))
            .select("doc_id", F.col("e.k").alias("term"), F.col("e.tf").alias("tf")))
