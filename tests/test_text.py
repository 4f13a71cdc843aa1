"""Text operators: hand-made edge rows, Spark vs DuckDB twins, stemmer."""

from pyspark.sql import functions as F

from textsim.functions import porter
from textsim.functions import text as T
from textsim.operators import profiles as P

EDGE = [
    (1, ""),
    (2, "   "),
    (3, "!!! ... ---"),
    (4, "word"),
    (5, "two words"),
    (6, "Visit https://example.com/x?y=1 or www.test.org now, mail john.doe@mail.example.com."),
    (7, "Don't stop -- it's well-known... Is it? Yes! Pi is 3.14, and 1,000 items: done."),
    (8, "Café naïve résumé — ÉCOLE   déjà vu."),
    (9, "First para.\n\nSecond para here. Third one!"),
    (10, "I cannot go, gonna wanna stay."),
]


def _rows(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string")


def test_clean_text_edges(spark):
    out = {r.doc_id: r.c for r in _rows(spark).select("doc_id", T.clean_text(F.col("text")).alias("c")).collect()}
    assert out[1] == "" and out[2] == ""
    assert out[3] == "!!! ... ---"
    assert out[6] == "Visit or now, mail"
    assert out[7] == "Dont stop -- its well-known... Is it? Yes! Pi is 3.14, and 1,000 items: done."
    assert out[8] == "Café naïve résumé ÉCOLE déjà vu."


def test_word_tokens_treebank_rules(spark):
    df = _rows(spark).select("doc_id", T.word_tokens(T.clean_text(F.col("text"))).alias("t"))
    out = {r.doc_id: r.t for r in df.collect()}
    assert out[7] == ["dont", "stop", "--", "its", "well-known", "...", "is", "it", "?", "yes", "!", "pi", "is",
                      "3.14", ",", "and", "1,000", "items", ":", "done", "."]
    assert out[10] == ["i", "can", "not", "go", ",", "gon", "na", "wan", "na", "stay", "."]
    assert out[1] == []


def test_content_tokens_drop_stopwords_and_punct_substrings(spark):
    df = _rows(spark).select("doc_id", P.preprocess(F.col("text"), use_stemming=False).alias("t"))
    out = {r.doc_id: r.t for r in df.collect()}
    # "--" and "..." are not substrings of the punctuation string; "?" "!" "," ":" "." are
    assert out[7] == ["dont", "stop", "--", "well-known", "...", "yes", "pi", "3.14", "1,000", "items", "done"]
    assert out[3] == ["...", "--"]  # "!!!" pads to three "!", "---" splits into "--" and "-"


def test_sentences_and_ngrams(spark):
    df = _rows(spark).select("doc_id", T.sentences(F.col("text")).alias("s"),
                             T.ngrams(P.preprocess(F.col("text"), use_stemming=False)).alias("g"))
    out = {r.doc_id: (r.s, r.g) for r in df.collect()}
    assert out[9][0] == ["First para.", "Second para here.", "Third one!"]
    assert out[4][1] == [] and out[5][1] == []
    assert out[9][1] == ["first para second", "para second para", "second para third", "para third one"]


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "the cat and the hat, THE end. a b")], "doc_id long, text string")
    r = df.select(T.term_counts(T.terms(F.col("text"))).alias("c"), T.sum_sq(T.term_counts(T.terms(F.col("text")))).alias("s")).first()
    assert [(x.k, x.tf) for x in r.c] == [("and", 1), ("cat", 1), ("end", 1), ("hat", 1), ("the", 3)]
    assert r.s == 1 + 1 + 1 + 1 + 9


def test_spark_and_duckdb_agree_on_edges(spark, duck):
    import pandas as pd

    pdf = pd.DataFrame(EDGE, columns=["doc_id", "text"])
    duck.register("edge_docs", pdf)
    sql = (f"SELECT doc_id, {T.sql_clean_text('text')} AS c, "
           f"{T.sql_content_tokens(T.sql_word_tokens(T.sql_clean_text('text')))} AS t, "
           f"{T.sql_sentences('text')} AS s FROM edge_docs ORDER BY doc_id")
    d = duck.sql(sql).fetchall()
    s = (_rows(spark).select("doc_id", T.clean_text(F.col("text")).alias("c"),
                             P.preprocess(F.col("text"), use_stemming=False).alias("t"),
                             T.sentences(F.col("text")).alias("s")).orderBy("doc_id").collect())
    assert [(r.doc_id, r.c, list(r.t), list(r.s)) for r in s] == [(a, b, list(c), list(e)) for a, b, c, e in d]


def test_porter_examples():
    cases = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi",
             "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "is": "is"}
    assert {w: porter.stem(w) for w in cases} == cases


def test_stem_udf_matches_python(spark):
    df = _rows(spark).select("doc_id", P.preprocess(F.col("text"), use_stemming=False).alias("u"),
                             P.preprocess(F.col("text"), use_stemming=True).alias("s"))
    for r in df.collect():
        assert list(r.s) == [porter.stem(t) for t in r.u]
