"""Weighted fair queueing against its DuckDB twin and its laws on ties, repeated rows, null sources and null ids."""

import random
from collections import defaultdict

import duckdb
import pytest

from textsim.llm import mixing
from textsim.llm.queries import ORACLES


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choices(["web", "books", "code", "é", None], [60, 20, 10, 9, 1])[0]
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 5, 5, 80])), source))
    rows += [(5000 + i, "same size here", "tied") for i in range(50)]
    rows += [(7, "a row that is there three times", "web")] * 3 + [(None, "no id at all", "web")] * 4 + [(None, "no id", None), (9000, None, "code")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_twin_and_laws(spark, seed, tmp_path):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.fair_queue(df).select("doc_id", "size", "source_size", "target", "taken", "source", "passes").collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.passes * r["size"]
    total = sum(size.values())
    assert abs(sum(target.values()) - min(1.5 * total, 2 * total)) < 1e-6 * total
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 2 * 80 + 1
    again = mixing.fair_queue(df.repartition(2)).select("doc_id", "size", "source", "taken").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, again)) == sorted(key((r.doc_id, r["size"], r.source, r.taken)) for r in got)
    path = str(tmp_path / "documents")
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    sql = con.execute(ORACLES["op9_mixing"])
    at = {d[0]: i for i, d in enumerate(sql.description)}
    want = [(r[at["doc_id"]], r[at["size"]], r[at["source_size"]], round(r[at["target"]], 6), r[at["taken"]]) for r in sql.fetchall()]
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken)) for r in got)


def test_copies_of_a_row_are_taken_one_by_one(spark):
    df = spark.createDataFrame(_rows(3), "doc_id long, text string, source string")
    queue = mixing.fair_queue(df)
    taken = sum(r.taken for r in queue.collect())
    mix = mixing.mixed(df).collect()
    assert sum(len((r.text or "").split()) for r in mix) == taken
    assert mixing.mixed(df.limit(0)).count() == 0
