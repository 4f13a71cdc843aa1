import random
import re
from collections import Counter

import numpy as np
import pytest

from textsim.llm import phrase_mining as P

SCHEMA = "doc_id long, text string, lang string, n string"


def brute(rows, least, top=2000, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, " ".join(w[i:i + k])] += 1
    out = []
    for lang in n:
        mine = {p: a for (g, p), a in f.items() if g == lang and " " in p and a >= least}
        inside = Counter()
        for p, a in mine.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i:i + k])
                    inside[q] = max(inside[q], a)
        scored = []
        for p, a in mine.items():
            w = p.split(" ")
            cuts = [(1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if inside[p] < a:
                scored.append((-score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed=4):
    rng = random.Random(seed)
    zipf = [f"w{i}" for i in range(60) for _ in range(60 // (i + 1))]
    rows = []
    for i in range(160):
        words = [rng.choice(zipf) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, len(words)):0] = ["In", "the", "long", "run", "it"][:rng.randint(2, 5)]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  "]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"]), "clash"))
    rows += [(500, "only here twice " * 300, "en", None), (501, None, "en", None), (502, "", "de", None), (503, "É É é ß\x00 x", "fr", None),
             (504, "glued words\x1fhere", "fr", None)]
    rows += [rows[3]] * 20 + [(None, "no id, no id, no id", None, None)] * 5
    return rows


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in P.collocations(df, **more).collect())


@pytest.mark.parametrize("least, sample_of", [(8, 4), (12, 1)])
def test_against_brute_force(spark, least, sample_of):
    rows = corpus()
    assert got(spark, rows, least=least, sample_of=sample_of) == brute(rows, least)


def test_border_failures_are_expanded(spark):
    """A sample that sees nothing proposes nothing: all comes from failures of the border."""
    rows = corpus(5)
    assert got(spark, rows, least=10, sample_of=10 ** 9) == brute(rows, 10)
    df = spark.createDataFrame(rows, SCHEMA)
    first = P.count_phrases(df, range(1, 6), {}).where("n >= 10 and instr(phrase, ' ') > 0")
    assert first.isEmpty()                                # without expansion there would be no collocation


def test_top_and_ties(spark):
    rows = [(i, "a b. c d. e f", "en", None) for i in range(5)]
    assert [(r[1], r[2]) for r in got(spark, rows, least=5, top=2)] == [(1, "a b"), (2, "c d")]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 40)
    data = b"a b\xffc d" * 50
    parts = list(P._parts(data))
    assert b"".join(parts) == data and len(parts) > 5 and all(p[:1] in (b"a", b"\xff") for p in parts)


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("x y", 9 * 10 ** 12, 10 ** 15, 10 ** 13, 9 * 10 ** 12)], "phrase string, a long, n long, l long, r long")
    wide = "cast({} as decimal(20,0))".format
    score = found.selectExpr(f"(cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) as s").first()["s"]
    assert score == 1000 * 9 * 10 ** 12 * 10 ** 15 // (10 ** 13 * 9 * 10 ** 12)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, None)]) == []


def test_tables_join():
    a = {1: (19, np.packbits(np.arange(1 << 19) % 7 == 0, bitorder="little"))}
    b = {1: (20, np.packbits(np.arange(1 << 20) % 11 == 0, bitorder="little")), 2: a[1]}
    h = np.arange(0, 1 << 20, 3, dtype=np.uint64) << np.uint64(44)
    both = P._joined(a, b)
    assert (P._has(both[1], h) == (P._has(a[1], h) | P._has(b[1], h))).all() and both[2][1] is a[1][1]
