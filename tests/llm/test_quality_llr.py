import re
from collections import Counter

import pytest

from textsim.llm import quality_llr as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n)


A = " ".join(f"w{i}" for i in range(30))
CASES = [None, "", " \t\n\x0b\f\r", "a b", A, A + " " + A, A + "\n" + A + "\n\n" + A, "x " * 7, "x " * 8, "x " * 9, "x " * 500,
         "l\nl\n l\nl ", "# * $ % & | < > é 日本   ", "a b   c", A + " tail " + A[:40], " ".join(f"w{i % 9}" for i in range(60)),
         "lang " * 20000 + A, "\n".join(["same line"] * 1000)]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(CASES)], "doc_id long, text string, kept string")
    trusted = spark.createDataFrame([(4,), (None,)], "doc_id long")
    for r in Q.quality(df, trusted).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(CASES[r.doc_id]), (r.doc_id, CASES[r.doc_id] and CASES[r.doc_id][:50])
        assert (r.score is None) == (r.n_words == 0) and not (r.kept and r.base_failed)


def test_documents(spark):
    from textsim.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.score >= Q.KEEP_AT)
    passed = [r for r in rows if not r.base_failed and r.doc_id in quality]
    good = [r.kept for r in passed if quality[r.doc_id] == 1]
    bad = [r.kept for r in passed if quality[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_ratio_is_counted_on_all_rows(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words"), (3, None), (1, "good words here")], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(1,)], "doc_id long"))
    assert len(model) == Q.BUCKETS
    scores = {r.doc_id: r.score for r in Q.quality(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert scores[1] > scores[2] and scores[3] is None


@pytest.mark.parametrize("trusted", [[], [(None,)]])
def test_empty(spark, trusted):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality(docs, spark.createDataFrame(trusted, "doc_id long")).count() == 0
