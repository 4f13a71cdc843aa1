import re
from collections import Counter

import pytest

import corpus_pipeline as P
from textsim.llm import mixing, packing, toxicity_pu

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_and_toxicity(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in steps[1:5]:
        assert rows[0].__fields__ == docs.columns
    scores = {r.doc_id: r.score for r in toxicity_pu.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in steps[1]} == {i for i, s in scores.items() if s < 0.7}


def test_one_of_each_group(steps):
    sets = {r.doc_id: shingles(r.text) for r in steps[1]}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    assert sorted(r.doc_id for r in steps[2]) == [i for i in ids if root(i) == i]


def test_secrets_mixing_and_packing(spark, steps):
    before = {r.doc_id: r.text for r in steps[2]}
    after = {r.doc_id: r for r in steps[3]}
    assert set(before) == set(after)
    for i, text in before.items():
        hidden = re.sub(r'(?<=token = ")[0-9a-fA-F]{40}', "<secret>", text, flags=re.I) if after[i].text != text else text
        assert after[i].text == hidden and after[i].n_chars == len(hidden)
    df = spark.createDataFrame(steps[3])
    passes = {r.doc_id: r.passes for r in mixing.fair_queue(df).collect()}
    assert Counter(r.doc_id for r in steps[4]) == Counter({i: n for i, n in passes.items() if n})
    assert all(after[r.doc_id] == r for r in steps[4])
    words = packing.WordIds(packing.tokenizer_path())
    got = Counter()
    for r in steps[5]:
        ids = words.of(after[r.doc_id].text) + b"\1\0\0\0"
        assert bytes(r.ids) == ids[4 * r.start:4 * (r.start + r.length)]
        got[r.doc_id] += r.length
    assert got == Counter({i: n * (len(words.of(after[i].text)) // 4 + 1) for i, n in passes.items() if n})


def test_edge_rows_in_every_stage(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, "en", "a", None), (3, "same text of some words here", "en", "a", 28),
            (3, "same text of some words here", "en", "a", 28), (4, "same text of some words here", "de", "b", 28), (5, "x " * 20000, "fr", "b", 40000),
            (None, "no id here", "fr", "b", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        step = docs.limit(0) if empty else docs
        for name, stage in P.STAGES:
            path = str(tmp_path / f"{name}-{empty}")
            stage(spark, step, SF).write.parquet(path)
            step = spark.read.parquet(path)
            if name == "ngram_jaccard" and not empty:
                assert sorted((str(r.doc_id) for r in step.collect())) == ["1", "2", "3", "5", "None", "None"]
        assert step.count() == 0 if empty else step.count() > 0


def test_run(spark, steps):
    assert P.run(spark, SF).count() == len(steps[-1])
