"""Per-text profiles: everything a pair score needs, built row by row.

A profile row holds, for one distinct text, its TF-IDF term counts (sorted
run-length array), the sum of squared counts, the set of preprocessed tokens
and the set of n-grams.  All of it is computed with native array expressions
on the document row itself, so building profiles needs no shuffle; only the
optional Porter stemming leaves the JVM (a vectorised Arrow UDF).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textsim.constants import NGRAM_N
from textsim.functions import porter
from textsim.functions import text as T


@F.arrow_udf(ArrayType(StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Porter stems of token arrays, Arrow in and out.

    Each Arrow batch is dictionary-encoded, so a word is stemmed once per batch
    (and through a memo of bounded size once for most batches); the list offsets are reused as they are.
    """
    flat = tokens.flatten()
    enc = pc.dictionary_encode(flat)
    words = enc.dictionary.to_pylist()
    memo = _STEM_MEMO
    stems = []
    for w in words:
        s = memo.get(w)
        if s is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            s = memo[w] = porter.stem(w)
        stems.append(s)
    values = pa.array(stems, type=pa.string()).take(enc.indices)
    offsets = pc.subtract(tokens.offsets, tokens.offsets[0])
    return pa.ListArray.from_arrays(offsets, values)


_STEM_MEMO: dict = {}
MEMO_WORDS = 200_000


def preprocess(text: Column, use_stemming: bool = True) -> Column:
    """clean -> tokenize -> stopwords -> stem (ordered ARRAY<STRING>)."""
    toks = T.content_tokens(T.word_tokens(T.clean_text(text)))
    return stem_tokens(toks) if use_stemming else toks


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Collapse exact copies: one row per distinct text.

    ``text_id`` is the smallest id among the copies and ``n_copies`` their count.
    One aggregate keyed by a SHA-256 digest of the text: copies in a task are
    combined map-side (all copies carry the same text, so any one of them is
    kept), so a copy group holding a third of the corpus shuffles one row per
    task.  The shuffle also spreads the texts for the tokenising that follows.
    """
    return (docs.groupBy(F.sha2(F.col(text_col), 256).alias("text_key"))
            .agg(F.min(id_col).alias("text_id"), F.count(F.lit(1)).alias("n_copies"), F.first(text_col).alias("text"))
            .select("text_id", "n_copies", "text"))


def copy_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_id, n): the copies of every distinct text, without the texts."""
    return docs.groupBy(F.sha2(F.col(text_col), 256).alias("text_key")).agg(F.min(id_col).alias("text_id"), F.count(F.lit(1)).alias("n")).select("text_id", "n")


def copy_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_id) for every document: which distinct text it is a copy of."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.col(text_col), 256).alias("text_key"))
    reps = keyed.groupBy("text_key").agg(F.min("doc_id").alias("text_id"))
    return keyed.join(reps, "text_key").select("doc_id", "text_id")


def build_profiles(texts: DataFrame, use_stemming: bool = True, n: int = NGRAM_N,
                   id_col: str = "text_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """One profile row per text (no shuffle); columns of ``keep`` stay."""
    toks = preprocess(F.col(text_col), use_stemming)
    return (texts.select(*keep, F.col(id_col).alias("text_id"),
                         T.term_counts(T.terms(F.col(text_col))).alias("terms"),
                         toks.alias("_toks"))
            .select(*keep, "text_id", "terms", T.sum_sq(F.col("terms")).alias("t_sq"),
                    F.array_distinct("_toks").alias("toks"),
                    F.array_distinct(T.ngrams(F.col("_toks"), n)).alias("grams")))
