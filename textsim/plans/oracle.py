"""DuckDB SQL twins of the registered queries (brute force where Spark prunes).

The SQL states each result the direct way -- e.g. pair scores by joining every
pair of texts on every shared key -- so it checks both the semantics and the
losslessness of the pruned Spark plans.
"""

from __future__ import annotations

from textsim.constants import (IDF_UNSHARED_SQ, MAX_MATCHING_NGRAMS, PLAGIARISM_THRESHOLD, WEIGHTS)
from textsim.functions import text as T
from textsim.functions.scores import sql_classification, sql_weighted_score
from textsim.plans.stem_sql import stems_sql


def texts_cte(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    return f"SELECT min({id_col}) AS text_id, {text_col} AS text, count(*) AS n_copies FROM {table} GROUP BY {text_col}"


def stemmed_cte(texts: str = "t", id_col: str = "text_id", rest: str = "") -> str:
    """(id, rest, ct) of texts: the stems of the content tokens, in order; each distinct word is stemmed once."""
    ct = T.sql_content_tokens(T.sql_word_tokens(T.sql_clean_text("text")))
    return f"""WITH raw AS MATERIALIZED (SELECT {id_col} AS id{rest}, {ct} AS ct FROM {texts}),
  one AS MATERIALIZED (SELECT id, unnest(ct) AS word, generate_subscripts(ct, 1) AS pos FROM raw),
  vocabulary AS MATERIALIZED ({stems_sql('(SELECT DISTINCT word FROM one)')}),
  stemmed AS (SELECT id, list(stem ORDER BY pos) AS ct FROM one JOIN vocabulary USING (word) GROUP BY id)
  SELECT raw.* EXCLUDE (id, ct), raw.id AS {id_col}, coalesce(stemmed.ct, []) AS ct FROM raw LEFT JOIN stemmed USING (id)"""


def profiles_cte(texts: str = "t", stem: bool = False) -> str:
    ct = T.sql_content_tokens(T.sql_word_tokens(T.sql_clean_text("text")))
    if stem:
        return (f"SELECT text_id, te, list_distinct(ct) AS toks, list_distinct({T.sql_ngrams('ct')}) AS grams "
                f"FROM ({stemmed_cte(texts, rest=f', {T.sql_terms('text')} AS te')})")
    return (f"SELECT text_id, te, list_distinct(ct) AS toks, list_distinct({T.sql_ngrams('ct')}) AS grams "
            f"FROM (SELECT text_id, {T.sql_terms('text')} AS te, {ct} AS ct FROM {texts})")


def pair_components_sql(texts_sql: str, with_matches: bool = False, stem: bool = False) -> str:
    """CTE chain ending in ``comp(a, b, cosine, jaccard, ngram, common_count, ...)`` for all overlapping pairs."""
    m = (f", list_slice(list_sort(list_intersect(pa.grams, pb.grams)), 1, {MAX_MATCHING_NGRAMS}) AS matching_ngrams"
         if with_matches else "")
    k2 = repr(IDF_UNSHARED_SQ)
    return f"""
t AS ({texts_sql}),
prof AS ({profiles_cte('t', stem)}),
tf AS (SELECT text_id, term, count(*)::DOUBLE AS tf FROM (SELECT text_id, unnest(te) AS term FROM prof) GROUP BY ALL),
tsq AS (SELECT text_id, sum(tf * tf) AS t_sq FROM tf GROUP BY text_id),
cs AS (SELECT x.text_id AS a, y.text_id AS b, sum(x.tf * y.tf) AS dot, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb
       FROM tf x JOIN tf y ON x.term = y.term AND x.text_id < y.text_id GROUP BY 1, 2),
tok AS (SELECT text_id, unnest(toks) AS k FROM prof),
js AS (SELECT x.text_id AS a, y.text_id AS b, count(*) AS inter FROM tok x JOIN tok y ON x.k = y.k AND x.text_id < y.text_id GROUP BY 1, 2),
gr AS (SELECT text_id, unnest(grams) AS k FROM prof),
gs AS (SELECT x.text_id AS a, y.text_id AS b, count(*) AS inter FROM gr x JOIN gr y ON x.k = y.k AND x.text_id < y.text_id GROUP BY 1, 2),
pr AS (SELECT a, b FROM cs UNION SELECT a, b FROM js UNION SELECT a, b FROM gs),
comp AS (
  SELECT pr.a, pr.b,
    CASE WHEN coalesce(ta.t_sq, 0) = 0 OR coalesce(tb.t_sq, 0) = 0 THEN 0.0
         ELSE coalesce(cs.dot, 0) / sqrt((coalesce(cs.sa, 0) + {k2} * (ta.t_sq - coalesce(cs.sa, 0)))
                                        * (coalesce(cs.sb, 0) + {k2} * (tb.t_sq - coalesce(cs.sb, 0)))) END AS cosine,
    CASE WHEN len(pa.toks) + len(pb.toks) = 0 THEN 0.0
         ELSE coalesce(js.inter, 0) / (len(pa.toks) + len(pb.toks) - coalesce(js.inter, 0)) END AS jaccard,
    CASE WHEN len(pa.grams) + len(pb.grams) = 0 THEN 0.0
         ELSE coalesce(gs.inter, 0) / (len(pa.grams) + len(pb.grams) - coalesce(gs.inter, 0)) END AS ngram,
    coalesce(gs.inter, 0) AS common_count, len(pa.grams) AS total_ngrams_doc1, len(pb.grams) AS total_ngrams_doc2{m}
  FROM pr
  JOIN prof pa ON pa.text_id = pr.a JOIN prof pb ON pb.text_id = pr.b
  LEFT JOIN tsq ta ON ta.text_id = pr.a LEFT JOIN tsq tb ON tb.text_id = pr.b
  LEFT JOIN cs ON cs.a = pr.a AND cs.b = pr.b
  LEFT JOIN js ON js.a = pr.a AND js.b = pr.b
  LEFT JOIN gs ON gs.a = pr.a AND gs.b = pr.b)"""


COPIES_CTE = """copies AS (SELECT t.text_id AS a, d.doc_id AS b, CASE WHEN coalesce(ta.t_sq, 0) > 0 THEN 1.0 ELSE 0.0 END AS cosine,
    CASE WHEN len(pa.toks) > 0 THEN 1.0 ELSE 0.0 END AS jaccard, CASE WHEN len(pa.grams) > 0 THEN 1.0 ELSE 0.0 END AS ngram
  FROM documents d JOIN t ON d.text = t.text AND d.doc_id <> t.text_id JOIN prof pa ON pa.text_id = t.text_id
  LEFT JOIN tsq ta ON ta.text_id = t.text_id)"""


def pair_scores_sql(threshold: float = PLAGIARISM_THRESHOLD, weights: dict = WEIGHTS,
                    texts_sql: str | None = None, copies: bool = False, stem: bool = False) -> str:
    """All scored pairs of distinct texts; with ``copies`` also (first copy, further copy) of equal documents."""
    texts_sql = texts_sql or texts_cte()
    s = sql_weighted_score("cosine", "jaccard", "ngram", "0.0", weights)
    both = "SELECT a, b, cosine, jaccard, ngram FROM comp" + (" UNION ALL SELECT a, b, cosine, jaccard, ngram FROM copies" if copies else "")
    return f"""WITH {pair_components_sql(texts_sql, stem=stem)}{"," + chr(10) + COPIES_CTE if copies else ""},
sc AS (SELECT *, {s} AS overall_score FROM ({both}))
SELECT a AS doc1, b AS doc2, overall_score, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard,
       round(ngram, 6) AS ngram, {sql_classification('overall_score')} AS classification
FROM sc WHERE overall_score >= {threshold!r}"""


def all_pairs_sql() -> str:
    """overall_score and classification of every pair of documents, written out one by one."""
    s = sql_weighted_score("cosine", "jaccard", "ngram")
    return f"""WITH {pair_components_sql(texts_cte())},
{COPIES_CTE},
ids AS (SELECT d.doc_id, t.text_id FROM documents d JOIN t ON d.text = t.text),
own AS (SELECT DISTINCT a AS text_id, cosine, jaccard, ngram FROM copies),
every AS (SELECT CASE WHEN x.text_id = y.text_id THEN own.cosine ELSE coalesce(c.cosine, 0.0) END AS cosine,
    CASE WHEN x.text_id = y.text_id THEN own.jaccard ELSE coalesce(c.jaccard, 0.0) END AS jaccard,
    CASE WHEN x.text_id = y.text_id THEN own.ngram ELSE coalesce(c.ngram, 0.0) END AS ngram
  FROM ids x JOIN ids y ON x.doc_id < y.doc_id
  LEFT JOIN comp c ON c.a = least(x.text_id, y.text_id) AND c.b = greatest(x.text_id, y.text_id)
  LEFT JOIN own ON own.text_id = x.text_id),
scored AS (SELECT {s} AS overall_score FROM every)
SELECT overall_score, {sql_classification('overall_score')} AS classification FROM scored"""


def given_pairs_sql(pairs_sql: str) -> str:
    """Scores of the given pairs (doc_id, item_id) of a document and a benchmark passage, each from its own two texts.
    ``pairs_sql`` may read the profiles ``pd`` and ``pb``."""
    k2, s = repr(IDF_UNSHARED_SQ), sql_weighted_score("cosine", "jaccard", "ngram")
    return f"""WITH d AS (SELECT doc_id AS text_id, text FROM documents), b AS (SELECT item_id AS text_id, text FROM benchmark),
pd AS ({profiles_cte('d')}), pb AS ({profiles_cte('b')}), given AS ({pairs_sql}),
td AS (SELECT text_id, term, count(*)::DOUBLE AS tf FROM (SELECT text_id, unnest(te) AS term FROM pd) GROUP BY ALL),
tb AS (SELECT text_id, term, count(*)::DOUBLE AS tf FROM (SELECT text_id, unnest(te) AS term FROM pb) GROUP BY ALL),
sd AS (SELECT text_id, sum(tf * tf) AS t_sq FROM td GROUP BY 1), sb AS (SELECT text_id, sum(tf * tf) AS t_sq FROM tb GROUP BY 1),
cs AS (SELECT doc_id, item_id, sum(td.tf * tb.tf) AS dot, sum(td.tf * td.tf) AS sa, sum(tb.tf * tb.tf) AS sb
  FROM given JOIN td ON td.text_id = doc_id JOIN tb ON tb.text_id = item_id AND tb.term = td.term GROUP BY 1, 2),
comp AS (SELECT doc_id, item_id,
    CASE WHEN coalesce(sd.t_sq, 0) = 0 OR coalesce(sb.t_sq, 0) = 0 THEN 0.0
         ELSE coalesce(cs.dot, 0) / sqrt((coalesce(cs.sa, 0) + {k2} * (sd.t_sq - coalesce(cs.sa, 0)))
                                        * (coalesce(cs.sb, 0) + {k2} * (sb.t_sq - coalesce(cs.sb, 0)))) END AS cosine,
    CASE WHEN len(pd.toks) + len(pb.toks) = 0 THEN 0.0 ELSE len(list_intersect(pd.toks, pb.toks))
         / (len(pd.toks) + len(pb.toks) - len(list_intersect(pd.toks, pb.toks))) END AS jaccard,
    CASE WHEN len(pd.grams) + len(pb.grams) = 0 THEN 0.0 ELSE len(list_intersect(pd.grams, pb.grams))
         / (len(pd.grams) + len(pb.grams) - len(list_intersect(pd.grams, pb.grams))) END AS ngram
  FROM given JOIN pd ON pd.text_id = doc_id JOIN pb ON pb.text_id = item_id
  LEFT JOIN sd ON sd.text_id = doc_id LEFT JOIN sb ON sb.text_id = item_id LEFT JOIN cs USING (doc_id, item_id)),
sc AS (SELECT *, {s} AS overall_score FROM comp)
SELECT doc_id, item_id, overall_score, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, round(ngram, 6) AS ngram,
       {sql_classification('overall_score')} AS classification FROM sc"""


def measure_join_sql(measure: str, floor: float, with_matches: bool = False) -> str:
    m = ", array_to_string(matching_ngrams, '|') AS matching_ngrams" if with_matches else ""
    return f"""WITH {pair_components_sql(texts_cte(), with_matches)}
SELECT a AS doc1, b AS doc2, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, round(ngram, 6) AS ngram,
       common_count, total_ngrams_doc1, total_ngrams_doc2{m}
FROM comp WHERE {measure} >= {floor!r}"""
