"""Text column functions: cleaning, word tokens, sentences, terms, n-grams.

Every rule is written once, in Java-regex form, and rendered either as Spark
``Column`` expressions (JVM side, inside whole-stage codegen) or as DuckDB SQL
for the oracle queries.  Only constructs both engines interpret identically
are used (no look-around, explicit Unicode classes instead of ``\\w``/``\\s``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsim.constants import CONTRACTIONS, NGRAM_N, PUNCTUATION, STOPWORDS_EN

# Python's Unicode ``\s`` and ``\w`` as explicit classes (class bodies).
WS = r"\t-\r\x1c-\x1f\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
NWS = f"[^{WS}]"

# clean_text: URLs, e-mails, characters outside word/space/.,!?;:- , whitespace runs, ends.
CLEAN_RULES = [
    (rf"https?://{NWS}+|www\.{NWS}+", ""),
    (rf"{NWS}+@{NWS}+\.{NWS}+", ""),
    (rf"[^{WORD}{WS}.,!?;:\-]", ""),
    (rf"[{WS}]+", " "),
    (r"^ | $", ""),
]

# Word tokenizer rules on lower-cased clean text (single spaces only).
TOKEN_RULES = [
    (r"([^.])\.( |$)", "$1 .$2"),          # sentence-final period
    (r"([:,])([^\p{Nd}])", " $1 $2"),      # , and : unless a digit follows
    (r"([:,])$", " $1 "),
    (r"\.{2,}", " $0 "),                   # ellipsis
    (r";", " ; "),
    (r"([?!])", " $1 "),
    (r"--", " -- "),
]

# Sentence boundary: [.!?] followed by whitespace (clean text has single spaces).
SENT_MARK = "\ue000"  # private-use character, absent from text
SENTENCE_RULE = (r"([.!?]) ", "$1" + SENT_MARK)

# TF-IDF term stream: runs of two or more word characters of the lower-cased raw text.
TERM_PATTERN = rf"[{WORD}]{{2,}}"


# ---------------------------------------------------------------- Spark side
def _apply(col: Column, rules) -> Column:
    for pat, rep in rules:
        col = F.regexp_replace(col, pat, rep)
    return col


def clean_text(text: Column) -> Column:
    """URLs, e-mails and special characters removed, whitespace collapsed."""
    return _apply(text, CLEAN_RULES)


def word_tokens(clean: Column) -> Column:
    """Lower-cased word tokens of clean text, in order (ARRAY<STRING>)."""
    s = _apply(F.lower(clean), TOKEN_RULES)
    arr = F.filter(F.split(s, " "), lambda t: t != F.lit(""))

    def expand(t):
        out = None
        for word, a, b in CONTRACTIONS:
            cond = t == F.lit(word)
            pair = F.array(F.lit(a), F.lit(b))
            out = F.when(cond, pair) if out is None else out.when(cond, pair)
        return out.otherwise(F.array(t))

    return F.flatten(F.transform(arr, expand))


def content_tokens(tokens: Column, stopwords=STOPWORDS_EN) -> Column:
    """Drop stopwords and tokens that are a substring of ASCII punctuation."""
    return F.filter(
        tokens,
        lambda t: (~t.isin(list(stopwords))) & (F.instr(F.lit(PUNCTUATION), t) == 0),
    )


def sentences(text: Column) -> Column:
    """Sentences of the clean text (ARRAY<STRING>, blanks dropped)."""
    marked = F.regexp_replace(clean_text(text), *SENTENCE_RULE)
    return F.filter(F.split(marked, SENT_MARK), lambda s: s != F.lit(""))


def terms(text: Column) -> Column:
    """TF-IDF term stream of raw text (ARRAY<STRING>, duplicates kept)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), 0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Column expressions referenced inside a higher-order-function lambda are
    re-evaluated per element; binding them through a one-element ``transform``
    keeps array work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(tokens: Column, n: int = NGRAM_N) -> Column:
    """Contiguous n-grams joined by a space; empty when fewer than n tokens."""
    return let(tokens, lambda tk: F.when(
        F.size(tk) >= n,
        F.transform(F.sequence(F.lit(0), F.size(tk) - n),
                    lambda i: F.array_join(F.slice(tk, i + 1, n), " ")),
    ).otherwise(F.array().cast("array<string>")))


def term_counts(term_arr: Column) -> Column:
    """Sorted run-length encoding of a term array: ARRAY<STRUCT<k, tf>>.

    Sorting plus a boundary scan, all native array expressions: no shuffle and
    no per-term Python.
    """
    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                          lambda i: (n > 0) & ((i == 1) | (F.try_element_at(s, i) != F.try_element_at(s, F.greatest(i - 1, F.lit(1))))))
        return let(starts, lambda st_arr: F.transform(
            st_arr,
            lambda st, j: F.struct(
                F.element_at(s, st).alias("k"),
                (F.when(j + 1 < F.size(st_arr), F.try_element_at(st_arr, j + 2)).otherwise(n + 1) - st)
                .cast("long").alias("tf"),
            )))

    return let(F.array_sort(term_arr), runs)


def sum_sq(counts: Column) -> Column:
    """Sum of squared term frequencies of a ``term_counts`` array."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x["tf"] * x["tf"])


# --------------------------------------------------------------- DuckDB side
def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pat: str) -> str:
    return pat.replace(r"\x85", r"\x{85}")


def _re2_rep(rep: str) -> str:
    return rep.replace("$0", r"\0").replace("$1", r"\1").replace("$2", r"\2")


def _sql_apply(expr: str, rules) -> str:
    for pat, rep in rules:
        expr = f"regexp_replace({expr}, {sql_str(_re2(pat))}, {sql_str(_re2_rep(rep))}, 'g')"
    return expr


def sql_clean_text(expr: str) -> str:
    return _sql_apply(expr, CLEAN_RULES)


def sql_word_tokens(clean_expr: str) -> str:
    s = _sql_apply(f"lower({clean_expr})", TOKEN_RULES)
    cases = " ".join(f"WHEN {sql_str(w)} THEN [{sql_str(a)}, {sql_str(b)}]" for w, a, b in CONTRACTIONS)
    return (f"flatten(list_transform(list_filter(string_split({s}, ' '), lambda t: t <> ''), "
            f"lambda t: CASE t {cases} ELSE [t] END))")


def sql_content_tokens(tokens_expr: str, stopwords=STOPWORDS_EN) -> str:
    stop = ", ".join(sql_str(w) for w in stopwords)
    return (f"list_filter({tokens_expr}, lambda t: t NOT IN ({stop}) "
            f"AND instr({sql_str(PUNCTUATION)}, t) = 0)")


def sql_sentences(text_expr: str) -> str:
    marked = _sql_apply(sql_clean_text(text_expr), [SENTENCE_RULE])
    return f"list_filter(string_split({marked}, chr({ord(SENT_MARK)})), lambda s: s <> '')"


def sql_terms(text_expr: str) -> str:
    return f"regexp_extract_all(lower({text_expr}), {sql_str(TERM_PATTERN)})"


def sql_ngrams(tokens_expr: str, n: int = NGRAM_N) -> str:
    return (f"CASE WHEN len({tokens_expr}) >= {n} THEN list_transform(range(1, len({tokens_expr}) - {n - 2}), "
            f"lambda i: array_to_string({tokens_expr}[i:i + {n - 1}], ' ')) ELSE [] END")
