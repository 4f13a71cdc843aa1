import random
import re
from collections import defaultdict

import numpy as np

from textsim.llm import circulant_minhash as M
from textsim.llm.ngram_join import shingle_hashes


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i:i + 3]) for i in range(len(w) - 2)])


def brute(rows, percent=85):
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    keys = [k for k in sets if k]
    parent = list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for k, s in enumerate(keys):
        for o in range(k):
            both = len(s & keys[o])
            if 100 * both >= percent * (len(s) + len(keys[o]) - both):
                parent[root(k)] = root(o)
    least = {}
    for k, s in enumerate(keys):
        least[root(k)] = min([least.get(root(k), 1 << 60), *(i for i in sets[s] if i is not None)])
    number = {s: least[root(k)] if least[root(k)] < 1 << 60 else None for k, s in enumerate(keys)}
    return sorted(((i, len(shingles(t)), number.get(shingles(t), i)) for i, t in rows), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = " ".join(prose(60)), []
    for _ in range(40):                                   # near copies at many distances
        base = prose(rng.randint(8, 120))
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rows += [f"{passage} {' '.join(prose(rng.randint(5, 30)))}" for _ in range(60)]   # alike, but few linked
    base = prose(200)
    for _ in range(80):                                   # one large group of near copies
        w = list(base)
        w[rng.randrange(200)] = rng.choice(vocabulary)
        w[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += ["copy of one text here"] * 30 + ["A b C", "a B c", "a  b\tc\n", "a b", "", "  \t", None, "İ ß É x y", "İ ß é x y"] + ["z " * 5000, "z " * 4000]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n int").repartition(3)
    return sorted((tuple(r) for r in M.near_duplicates(df, **more).collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_blocks_find_what_the_smallest_set_of_a_bucket_misses(spark, monkeypatch):
    """Blocks of four sets, and none of the links found through the heads of the buckets."""
    rows = corpus(8)
    monkeypatch.setattr(M, "BLOCK", 4)
    assert got(spark, rows) == brute(rows)
    sound = M._agreeing
    monkeypatch.setattr(M, "_agreeing", lambda pairs, signs, percent: sound(pairs, signs, percent).limit(0))
    assert got(spark, rows) == brute(rows)


def test_candidates_are_verified_until_components_join():
    agree, component = np.array([100, 90, 110, 95]), np.array([1, 1, 2, 3])
    pairs = [(0, 2), (1, 2), (2, 3), (0, 3)]
    assert list(M._joining(pairs, agree, component, lambda x, y: True)) == [(2, 3), (0, 2)]
    asked = []
    assert list(M._joining(pairs, agree, component, lambda x, y: asked.append((x, y)) or (x, y) == (1, 2))) == [(1, 2)]
    assert asked == [(2, 3), (0, 2), (0, 3), (1, 2)]


def test_signature_is_circulant():
    """Coordinate k is the first permutation's set, ranked by the second one moved k steps around the circle."""
    h = shingle_hashes("a b c d e f g h", 3)
    at = M._scatter((h >> np.uint64(32)).astype(np.uint32))
    sign = M.signature(h)
    for k in (0, 1, 7, 119):
        shift = np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
        assert sign[k] == M._rank((at + shift).copy()).min()
    every = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(M._rank(every.copy()))) == len(np.unique(M._scatter(every))) == 1 << 16


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.9):
        found = []
        for _ in range(60):
            x = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
            both = int(2 * share / (1 + share) * 1000)
            y = np.concatenate([x[:both], rng.integers(0, 1 << 64, 1000 - both, dtype=np.uint64)])
            found.append((M.signature(x) == M.signature(y)).mean())
        assert abs(np.mean(found) - share) < 0.02


def test_edges(spark):
    assert got(spark, []) == []
    rows = [(None, "one two three four"), (7, "one two three four"), (7, "one two three four"), (None, None), (None, "alone here too"), (9, "")]
    assert got(spark, rows) == brute(rows)
