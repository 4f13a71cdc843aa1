"""Exact top-k search by inner product: distributed histogram selection.

Every query is scored against every candidate, in blocks (a block of queries
and a block of candidates meet in one task, as a matrix product). The k-th score
of each query is located by refining histograms: a pass counts the scores in
``BINS`` bins of the query's interval, the bin that holds the k-th score becomes
the next interval, until a bin is one score wide. A last pass keeps what lies
above that score, and of the ties at it the smallest ids.

A block reports only its highest ``need`` scores to a histogram: a bin above
the k-th score's is then complete, and the bin itself reaches ``need`` if any
block cut it short. So a vector that a third of all rows share costs k rows a
block. Scores are integers and exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsim.session import materialize

K = 20
SCALE = 64
BINS = 1024
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (floor(scale * x) of each component x as a double). Rows
    without an id, and vectors that are null or hold a null or non-finite
    component, take no part; of rows with the same id the largest vector counts."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(whole)
    vectors = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("vector"))
    return vectors.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def _scores(queries, candidates):
    """Matrix of scores of two Arrow tables, the candidates' ids, and a mask of pairs that count."""
    import numpy as np

    def matrix(t):
        v = t.column("vector").combine_chunks()
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    q, c = matrix(queries), matrix(candidates)
    exact = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 1 << 53
    s = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if exact else q.astype(np.int64) @ c.astype(np.int64).T
    ids = candidates.column("vec_id").to_numpy()
    return s, ids, queries.column("vec_id").to_numpy()[:, None] != ids[None, :]


def _count(width: int, upto: int, k: int):
    """Histogram of a block pair: query_id, bin, n; bins are ``width`` wide inside [lo, lo + upto)."""
    def run(queries, candidates):
        import numpy as np
        import pyarrow as pa

        if not len(queries) or not len(candidates):
            return _HISTOGRAM.empty_table()
        s, _, counts = _scores(queries, candidates)
        lo = queries.column("lo").to_numpy()[:, None]
        need = queries.column("need").to_numpy()
        low = np.iinfo(np.int64).min
        s = np.where(counts & (s >= lo) & (s < lo + upto), s, low)
        top = min(k, s.shape[1])
        s = -np.sort(-np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top:], axis=1) if s.shape[1] else s
        keep = (s > low) & (np.arange(s.shape[1])[None, :] < need[:, None])
        row, _ = np.nonzero(keep)
        bins = ((s - lo) // width)[keep]
        pairs, n = np.unique(np.stack([row, bins]), axis=1, return_counts=True)
        ids = queries.column("vec_id").to_numpy()
        return pa.table([pa.array(ids[pairs[0]]), pa.array(pairs[1]), pa.array(n)], schema=_HISTOGRAM)
    return run


def _select(k: int):
    """The rows of a block pair above each query's k-th score, and its smallest ids at that score."""
    def run(queries, candidates):
        import numpy as np
        import pyarrow as pa

        if not len(queries) or not len(candidates):
            return _FOUND.empty_table()
        s, ids, counts = _scores(queries, candidates)
        lo, need = queries.column("lo").to_numpy(), queries.column("need").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        s, ids, counts = s[:, by_id], ids[by_id], counts[:, by_id]
        tie = counts & (s == lo[:, None])
        keep = (counts & (s > lo[:, None])) | (tie & (np.cumsum(tie, axis=1) <= need[:, None]))
        row, col = np.nonzero(keep)
        return pa.table([pa.array(queries.column("vec_id").to_numpy()[row]), pa.array(ids[col]), pa.array(s[row, col])], schema=_FOUND)
    return run


def _schemas():
    import pyarrow as pa

    whole = pa.int64()
    return (pa.schema([("query_id", whole), ("bin", whole), ("n", whole)]),
            pa.schema([("query_id", whole), ("vec_id", whole), ("score", whole)]))


_HISTOGRAM, _FOUND = _schemas()


def top_k(table: DataFrame, is_query, k: int = K, scale: int = SCALE, bins: int = BINS,
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` highest inner products of
    each query with the other rows of ``table`` (vec_id, embedding); ties go to the
    smaller vec_id. ``is_query`` is a condition on vec_id.

    Edge cases: see ``integer_vectors`` for rows that take no part; vectors of
    different lengths are not compared; where a score could pass 64 bits, vectors with a component
    beyond the root of 2^62 / dimension take no part; a query with fewer than ``k`` partners
    returns all of them; scores must fit 64 bits; an empty table or no queries
    give no rows; other columns are ignored.
    """
    vectors = materialize(integer_vectors(table, scale).withColumns({
        "dim": F.size("vector"), "is_query": F.coalesce(is_query, F.lit(False))}), "topk-vectors")
    most = F.greatest(F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double")))

    def extent():
        n, nq, largest, dim = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1)), F.max(most), F.max("dim")).first()
        return n, nq, int(largest or 0), dim or 0
    n, nq, largest, dim = extent()
    if largest ** 2 * dim + 1 >= 1 << 62:
        vectors = vectors.where((F.col("dim") == 0) | (most <= math.isqrt(((1 << 62) - 2) // dim)))
        n, nq, largest, dim = extent()
    bound = largest ** 2 * dim + 1
    kind = "array<int>" if largest < 1 << 31 else "array<bigint>"
    nqb, ncb = max(1, -(-nq // query_block)), max(1, -(-n // candidate_block))
    blocked = vectors.select("vec_id", F.col("vector").cast(kind).alias("vector"), "dim", "is_query",
                             F.pmod(F.xxhash64("vec_id"), F.lit(nqb)).alias("qb"),
                             F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(ncb)).alias("cb"))
    candidates = blocked.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1)).cast("array<bigint>"))).drop("is_query")
    candidates = candidates.toDF(*candidates.columns)  # attributes of its own, since both sides are one table
    queries = blocked.where("is_query").withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(ncb - 1)).cast("array<bigint>"))).drop("is_query")
    block = ["dim", "qb", "cb"]

    def meet(state, run, schema):
        asked = queries.join(state, "vec_id").select("vec_id", "vector", "lo", "need", *block)
        return asked.groupBy(*block).cogroup(candidates.groupBy(*block)).applyInArrow(run, schema)

    state = vectors.where("is_query").select("vec_id", F.lit(-bound).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    upto = 2 * bound + 1
    while upto > 1:
        width = -(-upto // bins)
        counted = meet(state, _count(width, upto, k), "query_id long, bin long, n long")
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        summed = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        reached = summed.withColumnRenamed("query_id", "vec_id").join(state, "vec_id").where("upto >= need").groupBy("vec_id").agg(
            F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("hit"))
        state = materialize(state.join(reached, "vec_id", "left").select(
            "vec_id", (F.col("lo") + F.coalesce(F.col("hit.bin"), F.lit(0)) * width).alias("lo"),
            (F.col("need") - F.coalesce(F.col("hit.above"), F.lit(0))).alias("need")), "topk-state")
        upto = width
    found = meet(state, _select(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
