"""Pairs counted inside block pairs: the same measures as pair by pair, and no joined row a shared key."""

import pytest
from pyspark.sql import functions as F

from textsim.constants import WEIGHTS
from textsim.operators import blocks as B
from textsim.operators import candidates as C
from textsim.operators import pairs_job as PJ
from textsim.operators import similarity as S

MEASURES = ("cosine", "jaccard", "ngram")


@pytest.fixture(scope="module")
def docs(spark):
    """Near copies of one text, texts of common words only, a copy, texts without words and a null, over several partitions."""
    base = [f"word{i % 23} thing{i} common place" for i in range(30)]
    rows = [(k, " ".join(base[k % 5:30 - k % 7]) + f" own{k}") for k in range(40)]
    rows += [(100 + k, "common place the a of and " * (k + 1) + f"rare{k} rare{k + 1}") for k in range(20)]
    rows += [(200, rows[3][1]), (201, ""), (202, "! ?"), (203, None), (204, "common " * 3000 + "place")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def scored(spark, docs):
    prof = PJ.corpus_profiles(docs, use_stemming=False, checkpoint=True)
    ids = prof.select("text_id")
    pairs = ids.select(F.col("text_id").alias("a")).join(ids.select(F.col("text_id").alias("b")), F.col("a") < F.col("b"))
    return prof, {(r.a, r.b): r for r in S.score(S.pair_components(pairs, prof)).where("jaccard is not null").collect()}


def _key(r):
    return (r.a, r.b, r.cosine, r.jaccard, r.ngram, r.common_count, r.total_ngrams_doc1, r.total_ngrams_doc2)


@pytest.mark.parametrize("block,dense,pairwise", [(2048, 768, 250), (3, 1, 1), (7, 10**9, 10**9)])
@pytest.mark.parametrize("measure,floor", [("cosine", 0.3), ("jaccard", 0.5), ("ngram", 0.2), ("score", 31.0), ("score", 15.0)])
def test_block_pairs_equal_pair_by_pair(scored, monkeypatch, block, dense, pairwise, measure, floor):
    for name, value in (("BLOCK", block), ("_DENSE", dense), ("_PAIRWISE", pairwise), ("_STEP", 64 if block == 7 else 1 << 22)):
        monkeypatch.setattr(B, name, value)
    prof, exact = scored
    blocks = B.pack(prof).collect()
    rows = [{c: _values(r, c) for c in r.asDict() if c != "block"} for r in blocks]
    got = []
    held = [B._Block(r) for r in rows]
    for i, x in enumerate(held):
        for y in held[i:]:
            f = B._found(x, y, measure, floor, WEIGHTS)
            for k in range(len(f["i"]) if f else 0):
                a, b = x.ids[f["i"][k]], y.ids[f["j"][k]]
                n1, n2 = f["total_ngrams_doc1"][k], f["total_ngrams_doc2"][k]
                got.append((*((a, b) if a < b else (b, a)), *(f[c][k] for c in MEASURES), f["common_count"][k], *((n1, n2) if a < b else (n2, n1))))
    near = (lambda r: 100 * sum(WEIGHTS[c] * r[c] for c in MEASURES) >= floor - 0.005 - 1e-9) if measure == "score" else lambda r: r[measure] >= floor
    assert sorted(got) == sorted(_key(r) for r in exact.values() if near(r)) and got


def _values(row, c):
    return list(row[c]) if c == "ids" else bytes(row[c])


def test_query_path(spark, scored, docs):
    _, exact = scored
    got = S.pair_components(C.score_candidates(PJ.corpus_blocks(docs, use_stemming=False), 31.0, WEIGHTS), None, min_score=31.0)
    assert {_key(r) for r in S.score(got).where("overall_score >= 31").collect()} == {_key(r) for r in exact.values() if r.overall_score >= 31}


def test_no_row_a_shared_key(docs):
    """A join on keys shuffled a row for every key that two texts share."""
    blocks = PJ.corpus_blocks(docs, use_stemming=False)
    for found in (C.score_candidates(blocks, 31.0, WEIGHTS), C.candidate_pairs(blocks, "terms", 0.5, cos_floor=0.8), C.candidate_pairs(blocks, "toks", 0.5, 0.5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_copies_count(docs):
    counts = {r.classification: r.n_pairs for r in PJ.class_counts(docs).collect()}
    n = docs.count()
    assert sum(counts.values()) == n * (n - 1) // 2


def test_a_task_holds_two_small_blocks_and_one_tile(spark, scored, monkeypatch):
    """All pairs of two blocks were counted in one matrix, and Arrow batches of 64 MB held many block pairs."""
    monkeypatch.setattr(B, "CELLS", 50)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    prof, _ = scored
    rows = B.pack(prof.coalesce(1)).collect()
    x = B._Block({c: _values(rows[0], c) for c in rows[0].asDict() if c != "block"})
    whole, sizes, counted = B._found(x, x, "score", 15.0, WEIGHTS), [], B._Meeting.all
    monkeypatch.setattr(B._Meeting, "all", lambda self, fam, lo, hi, *w: sizes.append((hi - lo) * self.y.n) or counted(self, fam, lo, hi, *w))
    parts = list(B._tiles(x, x, "score", 15.0, WEIGHTS))
    assert max(sizes) <= max(50, x.n) and len(parts) > 1
    assert sorted((a, b) for p in parts for a, b in zip(p["i"], p["j"])) == sorted(zip(whole["i"], whole["j"]))
    C.score_candidates(B.packed(prof), 31.0, WEIGHTS)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
