import random
import re
from collections import defaultdict

import numpy as np

from textsim.llm import ngram_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i:i + 4]) for i in range(len(w) - 3)])


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    keys = [k for k in sets if k]
    index = defaultdict(set)
    for k, s in enumerate(keys):
        for g in s:
            index[g].add(k)
    parent = list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for k, s in enumerate(keys):
        for o in {o for g in s for o in index[g] if o < k}:
            both = len(s & keys[o])
            if 100 * both >= percent * (len(s) + len(keys[o]) - both):
                parent[root(k)] = root(o)
    least = {}
    for k, s in enumerate(keys):
        least[root(k)] = min(least.get(root(k), 1 << 60), *sets[s])
    number = {s: least[root(k)] for k, s in enumerate(keys)}
    return sorted((i, len(shingles(t)), number.get(shingles(t), i)) for i, t in rows)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = " ".join(prose(40)), []
    for _ in range(40):                                   # near copies at many distances, some at the border
        base = prose(rng.randint(8, 120))
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rows += [f"{passage} {' '.join(prose(rng.randint(5, 60)))}" for _ in range(60)]   # a passage in many documents
    base = prose(200)
    for _ in range(80):                                   # one large group of near copies
        w = list(base)
        w[rng.randrange(200)] = rng.choice(vocabulary)
        w[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += ["copy of one text here"] * 30 + ["A b C", "a B c", "a  b\tc\n", "a b", "", "  \t", None, "İ ß É x y", "İ ß é x y"] + ["z " * 5000, "z " * 4000]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string").repartition(3)
    for hot_max, least in ((J.HOT_MAX, J.HOT_LEAST), (0, 1 << 30)):
        J.HOT_LEAST = least
        got = sorted(tuple(r) for r in J.jaccard_components(df, hot_max=hot_max).collect())
        assert got == brute(rows)
    J.HOT_LEAST = 16


def test_links_depend_on_the_walk(spark, monkeypatch):
    """Sets of single words of one small vocabulary: every bucket is large and holds many components."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(0, 200, 2):
        own = rng.sample(words, 40)
        other = own[:38] + rng.sample([w for w in words if w not in own], 2)
        rows += [(i, " ".join(own)), (i + 1, " ".join(other))]
    parent = {i: i for i, _ in rows}
    sets = [(i, set(t.split())) for i, t in rows]
    for i, a in sets:
        for k, b in sets[:i]:
            if 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((parent[i], parent[k]))
                parent = {x: low if p == high else p for x, p in parent.items()}
    want = [(i, 40, parent[i]) for i, _ in rows]
    assert sum(a != c for a, _, c in want) >= 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in J.jaccard_components(df, words=1, hot_max=0).collect()) == want
    walk = J._tree_candidates
    monkeypatch.setattr(J, "_tree_candidates", lambda *a: walk(*a).where("false"))
    assert sorted(tuple(r) for r in J.jaccard_components(df, words=1, hot_max=0).collect()) != want


def test_tree_walk_loses_no_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rng.choice(1 << 40, rng.integers(5, 300), replace=False)
        for _ in range(3):
            keep = rng.random(len(base)) > rng.choice([0.02, 0.08, 0.3])
            sets.append(np.unique(np.append(base[keep], rng.choice(1 << 40, rng.integers(1, 10)))))
    want = set()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                want.add((b, a))
    got = {tuple(sorted(p)) for p in J.tree_pairs(np.array([len(s) for s in sets]), [J.bitmap(s) for s in sets], list(range(len(sets))))}
    assert want and want <= got and len(got) < 4 * len(want)


def test_documents_and_edges(spark):
    from textsim.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op1_ngram_jaccard"](spark, sf).collect()) == brute(rows)
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, None), (7, "q")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in J.jaccard_components(df).collect())))
    assert got == sorted(map(str, [(None, 2, 5), (5, 2, 5), (None, 0, None), (7, 1, 7)]))
    assert J.jaccard_components(df.limit(0)).count() == 0
