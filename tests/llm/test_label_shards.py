import zlib
from collections import Counter, defaultdict

from textsim.llm import label_shards


def laws(rows, texts, shards):
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts)
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def spread(rows, key):
    shards, sizes = defaultdict(set), Counter()
    for r in rows:
        shards[key(r)].add(r.shard)
        sizes[key(r)] += 1
    return {k: (sizes[k], len(v)) for k, v in shards.items() if sizes[k] > 1}


def test_laws_groups_and_hot_group(spark):
    texts = [(i, f"text {i}") for i in range(700)] + [(1000 + i, "hot") for i in range(500)]
    texts += [(3000 + i, f"pair {i // 3}") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = label_shards.balanced_shards(df, shards=12).collect()
    laws(rows, texts, 12)
    groups = spread(rows, lambda r: r.link)
    hot = max(groups.values())
    assert hot[0] == 500 and hot[1] <= 6                    # 125 rows a shard: four at least
    assert sum(n == 1 for size, n in groups.values() if size == 3) >= 95
    again = label_shards.balanced_shards(df, shards=12).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_edges(spark):
    data = [(None, None, 1), (None, None, 1), (5, "", 2), (6, "", 2), (5, "é", 3), (5, "é", 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, shard int")
    rows = label_shards.balanced_shards(df).collect()
    laws(rows, [d[:2] for d in data], 24)
    by = {(r.doc_id, r.size) for r in rows}
    assert by == {(None, 8), (5, 8), (6, 8), (5, 10)}
    assert {r.text_crc32 for r in rows if r.size == 10} == {zlib.crc32("é".encode())}
    assert label_shards.balanced_shards(df.limit(0)).count() == 0


def test_query(spark):
    from textsim.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op6_sharding"](spark, sf).collect()
    laws(rows, texts, 24)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    by_text = dict(texts)
    assert all(n <= 2 for size, n in spread(rows, lambda r: by_text[r.doc_id]).values() if size < 6)
