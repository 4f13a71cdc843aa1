"""The fifteen stylometric features, as native per-row expressions (+ DuckDB twin).

All work is array expressions on the document row, in staged projections so
no intermediate array is computed twice; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsim.constants import CONJUNCTIONS, FUNCTION_WORDS, STYLE_FEATURES
from textsim.functions.text import WORD, WS, let, sql_str, term_counts

WORD_RUN = f"[{WORD}]+"
STYLE_PUNCT_CLASS = r"""[.,;:!?\-()\[\]{}"']"""
STRIP = f"^[{WS}]+|[{WS}]+$"
MIN_CHARS = 20


def _strip(c):
    return F.regexp_replace(c, STRIP, "")


def _ascii_words(c, lower: bool):
    """``\\b[a-zA-Z]+\\b`` matches: word-character runs made of ASCII letters only."""
    runs = F.regexp_extract_all(F.lower(c) if lower else c, F.lit(WORD_RUN), 0)
    return F.filter(runs, lambda w: w.rlike("^[a-zA-Z]+$"))


def _mean(arr):
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)


def _std_pop(arr):
    return let(_mean(arr), lambda m: F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
                                            / F.size(arr)))


def style_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, avg_sent_len, ..., log_length): 15 DOUBLE columns; all zero for guarded texts."""
    s1 = df.select(F.col(id_col), _strip(F.col(text_col)).alias("t"))
    s2 = s1.select(
        id_col, "t",
        F.coalesce(F.char_length("t"), F.lit(0)).alias("n_chars"),
        _ascii_words(F.col("t"), lower=True).alias("words"),
        F.filter(F.transform(F.split("t", "[.!?]+"), lambda s: _strip(s)),
                 lambda s: (s != F.lit("")) & (F.size(F.split(s, f"[{WS}]+")) > 2)).alias("sents"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", ",", ""))).alias("commas"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", STYLE_PUNCT_CLASS, ""))).alias("puncts"),
        F.transform(F.filter(F.transform(F.split("t", "\n\n"), lambda p: _strip(p)), lambda p: p != F.lit("")),
                    lambda p: F.size(F.split(p, f"[{WS}]+"))).alias("paras"),
    )
    s3 = s2.select(
        id_col, "n_chars", "words", "sents", "commas", "puncts", "paras",
        F.size("words").alias("n"),
        F.transform("sents", lambda s: _ascii_words(s, lower=False)).alias("sent_words"),
        term_counts(F.col("words")).alias("wcounts"),
        term_counts(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))),
                                lambda i: F.concat(F.try_element_at("words", i), F.lit(" "),
                                                   F.try_element_at("words", i + 1)))).alias("bcounts"),
    )
    func = list(FUNCTION_WORDS)
    conj = list(CONJUNCTIONS)
    s4 = s3.select(
        id_col, "n_chars", "n", "commas", "puncts", "paras", "wcounts", "bcounts",
        F.size("sents").alias("n_sents"),
        F.transform("sent_words", lambda a: F.size(a).cast("double")).alias("sl"),
        F.transform("words", lambda w: F.char_length(w).cast("double")).alias("wl"),
        F.transform(F.filter("sent_words", lambda a: F.size(a) > 0), lambda a: F.lower(F.element_at(a, 1))).alias("starters"),
        F.size(F.filter("words", lambda w: w.isin(func))).alias("n_func"),
        F.size(F.filter("words", lambda w: w.isin(conj))).alias("n_conj"),
    )
    n = F.col("n").cast("double")
    func_ratio = F.col("n_func") / n
    feats = {
        "avg_sent_len": _mean(F.col("sl")),
        "sent_len_std": F.when(F.size("sl") > 1, _std_pop(F.col("sl"))).otherwise(F.lit(0.0)),
        "type_token_ratio": F.size("wcounts") / n,
        "avg_word_len": _mean(F.col("wl")),
        "word_len_std": _std_pop(F.col("wl")),
        "hapax_ratio": F.size(F.filter("wcounts", lambda c: c["tf"] == 1)) / n,
        "func_word_ratio": func_ratio,
        "punct_density": F.col("puncts") / F.col("n_chars"),
        "comma_per_sent": F.col("commas") / F.col("n_sents"),
        "conj_density": F.col("n_conj") / n,
        # bigrams exist only for n >= 2; the sequence above yields one dummy for n < 2
        "bigram_rep_ratio": F.when(F.col("n") >= 2, F.size(F.filter("bcounts", lambda c: c["tf"] > 1))).otherwise(0)
        / F.greatest(n - 1, F.lit(1.0)),
        "starter_diversity": F.size(F.array_distinct("starters")) / F.greatest(F.size("starters"), F.lit(1)),
        "avg_para_len": F.when(F.size("paras") > 0, _mean(F.transform("paras", lambda x: x.cast("double")))).otherwise(n),
        "lexical_density": F.lit(1.0) - func_ratio,
        "log_length": F.log(n + 1.0),
    }
    ok = (F.col("n_chars") >= MIN_CHARS) & (F.col("n") > 0) & (F.col("n_sents") > 0)
    return s4.select(id_col, *[F.when(ok, feats[k].cast("double")).otherwise(F.lit(0.0)).alias(k)
                               for k in STYLE_FEATURES])


# --------------------------------------------------------------- DuckDB side
def _sql_re(p: str) -> str:
    return sql_str(p.replace(r"\x85", r"\x{85}"))


def style_features_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                       where: str = "") -> str:
    strip = lambda e: f"regexp_replace({e}, {_sql_re(STRIP)}, '', 'g')"
    words = lambda e: (f"list_filter(regexp_extract_all({e}, {_sql_re(WORD_RUN)}), "
                       f"lambda w: regexp_full_match(w, '[a-zA-Z]+'))")
    ws = _sql_re(f"[{WS}]+")
    func = ", ".join(sql_str(w) for w in FUNCTION_WORDS)
    conj = ", ".join(sql_str(w) for w in CONJUNCTIONS)
    std = lambda e: f"coalesce(list_stddev_pop({e}), 0.0)"
    return f"""WITH s1 AS (SELECT {id_col} AS id, {strip(text_col)} AS t FROM {table} {where}),
s2 AS (SELECT id, t, coalesce(length(t), 0) AS n_chars, {words('lower(t)')} AS words,
  list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda s: {strip('s')}),
              lambda s: s <> '' AND len(regexp_split_to_array(s, {ws})) > 2) AS sents,
  length(t) - length(replace(t, ',', '')) AS commas,
  length(t) - length(regexp_replace(t, {_sql_re(STYLE_PUNCT_CLASS)}, '', 'g')) AS puncts,
  list_transform(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {strip('p')}),
                 lambda p: p <> ''), lambda p: len(regexp_split_to_array(p, {ws}))) AS paras
  FROM s1),
s3 AS (SELECT *, len(words) AS n, len(sents) AS n_sents,
  list_transform(sents, lambda s: len({words('s')})::DOUBLE) AS sl,
  list_transform(words, lambda w: length(w)::DOUBLE) AS wl,
  list_transform(list_filter(list_transform(sents, lambda s: {words('s')}), lambda a: len(a) > 0),
                 lambda a: lower(a[1])) AS starters,
  len(list_filter(words, lambda w: w IN ({func}))) AS n_func,
  len(list_filter(words, lambda w: w IN ({conj}))) AS n_conj
  FROM s2),
wc AS (SELECT id, count(*) AS n_types, count(*) FILTER (WHERE c = 1) AS n_hapax
  FROM (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(words) AS w FROM s3) GROUP BY ALL) GROUP BY id),
bc AS (SELECT id, count(*) FILTER (WHERE c > 1) AS n_rep
  FROM (SELECT id, b, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len(words)),
        lambda i: words[i] || ' ' || words[i + 1])) AS b FROM s3) GROUP BY ALL) GROUP BY id),
f AS (SELECT s3.id, s3.n_chars >= {MIN_CHARS} AND s3.n > 0 AND s3.n_sents > 0 AS ok,
  list_avg(sl) AS avg_sent_len,
  CASE WHEN len(sl) > 1 THEN {std('sl')} ELSE 0.0 END AS sent_len_std,
  wc.n_types / n AS type_token_ratio,
  list_avg(wl) AS avg_word_len,
  {std('wl')} AS word_len_std,
  wc.n_hapax / n AS hapax_ratio,
  n_func / n AS func_word_ratio,
  puncts / n_chars AS punct_density,
  commas / n_sents AS comma_per_sent,
  n_conj / n AS conj_density,
  coalesce(bc.n_rep, 0) / greatest(n - 1, 1) AS bigram_rep_ratio,
  len(list_distinct(starters)) / greatest(len(starters), 1) AS starter_diversity,
  CASE WHEN len(paras) > 0 THEN list_avg(paras) ELSE n END AS avg_para_len,
  1.0 - n_func / n AS lexical_density,
  ln(n + 1.0) AS log_length
  FROM s3 LEFT JOIN wc ON wc.id = s3.id LEFT JOIN bc ON bc.id = s3.id)
SELECT id AS {id_col}, {', '.join(f'CASE WHEN ok THEN round({k}::DOUBLE, 6) ELSE 0.0 END AS {k}' for k in STYLE_FEATURES)}
FROM f"""
