"""Exact pair scores for a list of text pairs.

* cosine: TF-IDF fitted on the two texts alone has idf 1 for shared terms and
  k = 1 + ln 1.5 for the others, so
  ``cos = dot / sqrt((S_a + k^2 (T_a - S_a)) (S_b + k^2 (T_b - S_b)))`` with
  ``dot`` and ``S_x`` summed over shared terms and ``T_x`` over all terms.
  The shared terms come from one sort-merge of the two sorted term arrays
  (TimSort on two runs, linear), computed in a codegen'd ``aggregate``.
* Jaccard / n-gram: hash-based ``array_intersect`` of the two sets.

Pairs are joined to the profile table twice (once per side); each join is keyed
by a unique text id, so no key is skewed except a text that is a candidate of
very many others, which AQE's skew-join split handles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from textsim.constants import IDF_UNSHARED_SQ, MAX_MATCHING_NGRAMS, WEIGHTS
from textsim.functions.scores import classification, weighted_score
from textsim.functions.text import let
from textsim.operators.blocks import COUNTED, sizes


def _shared_term_sums(ta: Column, tb: Column) -> Column:
    tag = lambda arr, side: F.transform(arr, lambda x: F.struct(x["k"].alias("k"), F.lit(side).alias("s"),
                                                                x["tf"].alias("tf")))
    merged = F.array_sort(F.concat(tag(ta, 0), tag(tb, 1)))
    zero = F.lit(0).cast("long")
    init = F.struct(F.lit("").alias("pk"), zero.alias("ptf"), zero.alias("dot"), zero.alias("sa"), zero.alias("sb"))

    def step(acc, x):
        hit = x["k"] == acc["pk"]
        return F.struct(x["k"].alias("pk"), x["tf"].alias("ptf"),
                        (acc["dot"] + F.when(hit, acc["ptf"] * x["tf"]).otherwise(0)).alias("dot"),
                        (acc["sa"] + F.when(hit, acc["ptf"] * acc["ptf"]).otherwise(0)).alias("sa"),
                        (acc["sb"] + F.when(hit, x["tf"] * x["tf"]).otherwise(0)).alias("sb"))

    return F.aggregate(merged, init, step)


def cosine_expr(sums: Column, ta_sq: Column, tb_sq: Column) -> Column:
    na = sums["sa"] + F.lit(IDF_UNSHARED_SQ) * (ta_sq - sums["sa"])
    nb = sums["sb"] + F.lit(IDF_UNSHARED_SQ) * (tb_sq - sums["sb"])
    return F.when((ta_sq == 0) | (tb_sq == 0), F.lit(0.0)).otherwise(sums["dot"] / F.sqrt(na * nb))


def set_jaccard(inter: Column, na: Column, nb: Column) -> Column:
    return F.when(na + nb == 0, F.lit(0.0)).otherwise(inter / (na + nb - inter))


def packed_grams(profiles: DataFrame) -> DataFrame:
    """(text_id, grams): the n-grams of a text as one compressed value (their number, lengths and bytes); they repeat its words."""
    def pack(strings):
        raw = [s.encode() for s in strings]
        return zlib.compress(np.array([len(raw), *map(len, raw)], np.uint32).tobytes() + b"".join(raw))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x is None else pack(x) for x in batch["grams"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["text_id"], pa.array(packed, pa.binary())], names=["text_id", "grams"])

    return profiles.select("text_id", "grams").mapInArrow(rows, StructType([profiles.schema["text_id"], StructField("grams", BinaryType())]))


def _unpacked(packed: bytes) -> set:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)
    return {raw[i:j] for i, j in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist())}


@F.arrow_udf(ArrayType(StringType()))
def first_shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of two packed arrays the first ``MAX_MATCHING_NGRAMS`` strings of both, by code point; null if one is null."""
    out, last = [], (None, None)
    for i in range(len(a)):
        x, y = a[i].as_py(), b[i].as_py()
        if x is None or y is None:
            out.append(None)
            continue
        if last[0] != y:
            last = y, _unpacked(y)
        out.append([s.decode() for s in sorted(_unpacked(x) & last[1])[:MAX_MATCHING_NGRAMS]])
    return pa.array(out, pa.list_(pa.string()))


def _side(profiles: DataFrame, s: str) -> DataFrame:
    return profiles.select(*[F.col(c).alias(f"{c}_{s}") for c in profiles.columns])


def pair_components(pairs: DataFrame, profiles: DataFrame, with_matches: bool = False,
                    min_score: float | None = None, weights: dict = WEIGHTS, other: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine, jaccard, ngram, common_count, total_ngrams_doc1/2[, matching_ngrams]).

    Two stages: the set measures first (token and n-gram sets joined to the
    pair list), then the term arrays for the cosine.  With ``min_score`` a pair
    is dropped between the stages when even a cosine of 1 could not lift it to
    the floor, so the term arrays travel only with pairs that can qualify.
    ``other`` holds the profiles of side b when they are a collection of their own.
    Pairs that were counted in blocks carry their measures; only matching n-grams are then looked up, in the packed n-grams of either text.
    """
    if "copies" in pairs.columns:
        return _counted(pairs, profiles, with_matches, min_score, weights)
    other = profiles if other is None else other
    sets = profiles.select("text_id", "toks", "grams")
    j = (pairs.join(_side(sets, "a"), F.col("a") == F.col("text_id_a"))
         .join(_side(other.select("text_id", "toks", "grams"), "b"), F.col("b") == F.col("text_id_b")))
    gi = F.array_intersect("grams_a", "grams_b")
    stage1 = j.select(
        "a", "b",
        set_jaccard(F.size(F.array_intersect("toks_a", "toks_b")), F.size("toks_a"), F.size("toks_b")).alias("jaccard"),
        set_jaccard(F.size(gi), F.size("grams_a"), F.size("grams_b")).alias("ngram"),
        F.size(gi).alias("common_count"),
        F.size("grams_a").alias("total_ngrams_doc1"),
        F.size("grams_b").alias("total_ngrams_doc2"),
        *([F.slice(F.array_sort(gi), 1, MAX_MATCHING_NGRAMS).alias("matching_ngrams")] if with_matches else []))
    if min_score is not None:
        bound = (F.lit(weights["cosine"]) + F.lit(weights["jaccard"]) * F.col("jaccard")
                 + F.lit(weights["ngram"]) * F.col("ngram") + F.lit(weights["semantic"])) * F.lit(100.0)
        stage1 = stage1.filter(bound >= F.lit(min_score - 0.005 - 1e-9))
    tv = profiles.select("text_id", "terms", "t_sq")
    k = (stage1.join(_side(tv, "a"), F.col("a") == F.col("text_id_a"))
         .join(_side(other.select("text_id", "terms", "t_sq"), "b"), F.col("b") == F.col("text_id_b")))
    cos = let(_shared_term_sums(F.col("terms_a"), F.col("terms_b")),
              lambda sums: cosine_expr(sums, F.col("t_sq_a"), F.col("t_sq_b")))
    rest = [c for c in stage1.columns if c not in ("a", "b", "jaccard", "ngram")]
    return k.select("a", "b", cos.alias("cosine"), "jaccard", "ngram", *rest)


def _counted(pairs: DataFrame, profiles: DataFrame, with_matches: bool, min_score: float | None, weights: dict) -> DataFrame:
    if min_score is not None:
        bound = sum(F.lit(weights[c]) * F.col(c) for c in ("cosine", "jaccard", "ngram")) * F.lit(100.0) + F.lit(100.0 * weights["semantic"])
        pairs = pairs.filter(bound >= F.lit(min_score - 0.005 - 1e-9))
    if with_matches:
        grams = packed_grams(profiles)
        pairs = (pairs.join(_side(grams, "a"), F.col("a") == F.col("text_id_a")).join(_side(grams, "b"), F.col("b") == F.col("text_id_b"))
                 .withColumn("matching_ngrams", first_shared("grams_a", "grams_b")))
    return pairs.select("a", "b", "cosine", "jaccard", "ngram", *COUNTED, *(["matching_ngrams"] if with_matches else []))


def self_components(profiles: DataFrame) -> DataFrame:
    """(text_id, cosine, jaccard, ngram) of each text compared with a copy of itself: 1, or 0 where it has nothing to compare."""
    if "toks_keys" in profiles.columns:
        profiles = sizes(profiles)
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    size = lambda c: F.col(f"n_{c}") if f"n_{c}" in profiles.columns else F.size(c)
    return profiles.select("text_id", one(F.col("t_sq") > 0).alias("cosine"), one(size("toks") > 0).alias("jaccard"),
                           one(size("grams") > 0).alias("ngram"))


def score(components: DataFrame, weights: dict = WEIGHTS, semantic: Column | None = None) -> DataFrame:
    """Adds ``overall_score`` (percent, 2 dp) and ``classification``."""
    sem = semantic if semantic is not None else F.lit(0.0)
    s = weighted_score(F.col("cosine"), F.col("jaccard"), F.col("ngram"), sem, weights)
    return components.withColumn("overall_score", s).withColumn("classification", classification(F.col("overall_score")))
