import math

from pyspark.sql import functions as F

from textsim.llm import topk_search


def brute(rows, k, is_query):
    vec = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        vec[i] = max(w, vec[i]) if i in vec else w
    out = set()
    for q, v in vec.items():
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in vec.items() if c != q and len(w) == len(v))
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best[:k])}
    return out


def test_against_brute_force(spark):
    rows = [(i, [math.sin(i * j * 0.37) * (1 + i % 5) for j in range(1, 7)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(300, 500)]      # one common vector
    rows += [(500, None), (520, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(600, [1.0, 2.0]), (601, [3.0, 4.0]), (620, []), (100, [9.0] * 6), (100, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    for bins, qb, cb in ((1024, 16, 64), (7, 4, 1000)):
        got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=5, bins=bins, query_block=qb, candidate_block=cb)
        assert {tuple(r) for r in got.collect()} == brute(rows, 5, lambda q: q % 20 == 0)


def test_empty_and_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk_search.top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    assert topk_search.top_k(df, F.col("vec_id") == 1).count() == 0
