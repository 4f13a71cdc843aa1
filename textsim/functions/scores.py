"""Score arithmetic and banding as column expressions (+ DuckDB twins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsim.constants import (CLASS_CUTS, CLASS_TOP, MATCH_BAND_CUTS, SEVERITY_CUTS, WEIGHTS)


def weighted_score(cos: Column, jac: Column, ngram: Column, sem: Column, weights: dict = WEIGHTS) -> Column:
    """round(100 * (w_c cos + w_j J + w_n N + w_s S), 2), summed in that order."""
    total = (F.lit(weights["cosine"]) * cos + F.lit(weights["jaccard"]) * jac
             + F.lit(weights["ngram"]) * ngram + F.lit(weights["semantic"]) * sem)
    return F.round(total * F.lit(100.0), 2)


def classification(score: Column) -> Column:
    out = None
    for cut, name in CLASS_CUTS:
        out = F.when(score < cut, F.lit(name)) if out is None else out.when(score < cut, F.lit(name))
    return out.otherwise(F.lit(CLASS_TOP))


def severity_band(score: Column) -> Column:
    """Report / results page: < 30 green, < 50 amber, else red."""
    lo, hi = SEVERITY_CUTS
    return F.when(score < lo, "green").when(score < hi, "amber").otherwise("red")


def severity_band_batch(score: Column) -> Column:
    """Batch page: > 50 red, > 30 amber, else green (differs at exactly 30 and 50)."""
    lo, hi = SEVERITY_CUTS
    return F.when(score > hi, "red").when(score > lo, "amber").otherwise("green")


def match_band(sim: Column) -> Column:
    high, medium = MATCH_BAND_CUTS
    return F.when(sim > high, "High").when(sim > medium, "Medium").otherwise("Low")


# --------------------------------------------------------------- DuckDB side
def sql_weighted_score(cos: str, jac: str, ngram: str, sem: str = "0.0", weights: dict = WEIGHTS) -> str:
    return (f"round(({weights['cosine']!r} * {cos} + {weights['jaccard']!r} * {jac} + "
            f"{weights['ngram']!r} * {ngram} + {weights['semantic']!r} * {sem}) * 100.0, 2)")


def sql_classification(score: str) -> str:
    whens = " ".join(f"WHEN {score} < {cut!r} THEN '{name}'" for cut, name in CLASS_CUTS)
    return f"CASE {whens} ELSE '{CLASS_TOP}' END"


def sql_severity_band(score: str) -> str:
    lo, hi = SEVERITY_CUTS
    return f"CASE WHEN {score} < {lo!r} THEN 'green' WHEN {score} < {hi!r} THEN 'amber' ELSE 'red' END"


def sql_severity_band_batch(score: str) -> str:
    lo, hi = SEVERITY_CUTS
    return f"CASE WHEN {score} > {hi!r} THEN 'red' WHEN {score} > {lo!r} THEN 'amber' ELSE 'green' END"


def sql_match_band(sim: str) -> str:
    high, medium = MATCH_BAND_CUTS
    return f"CASE WHEN {sim} > {high!r} THEN 'High' WHEN {sim} > {medium!r} THEN 'Medium' ELSE 'Low' END"
