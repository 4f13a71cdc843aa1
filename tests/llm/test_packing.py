import array
import zlib
from collections import defaultdict

import numpy as np
import pytest

from textsim.llm import packing


WHOLE = packing.WordIds(packing.tokenizer_path()).tokenizer


def tokens(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


TEXTS = ["", "<|endoftext|> a<|startoftext|>b", "it's I'LL don't 'S", "ÀÉ Straße ΣΑΣ İstanbul ǅ", "a\x1cb \x85 c\xa0d e", "é ô̂x",
         "...hi!?? ,,a,b- `~ x_y 12a3", "日本語 テスト 한국어", "a" * 5000, "ªº²½ ١٢", "word " * 6000, "zero​width 're're'"]


@pytest.mark.parametrize("text", TEXTS)
def test_word_ids_equal_whole_text(text):
    got = packing.WordIds(packing.tokenizer_path()).of(text)
    assert list(array.array("I", got)) == tokens(text)


def check(rows, want, limits=(2048, 256, 2048)):
    """Each id in one piece, sequences gapless and within the limits."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for doc, ids in want.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert bytes(r.ids) == np.array(ids[at:at + r.length], dtype="<u4").tobytes()
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits[0] and len(pieces) <= limits[1] and sum(r.loss_tokens for r in pieces) <= limits[2]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return padding, len(seqs)


def test_round_trip_and_edges(spark):
    data = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, length string").repartition(2)
    rows = packing.pack(df).collect()
    padding, _ = check(rows, {i: tokens(t or "") + [1] for i, t, _ in data})
    assert padding == 0
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, max_tokens=1000)


def test_three_limits(spark):
    df = spark.createDataFrame([(i, "ask " * (i % 7), "answer it " * (i % 11)) for i in range(400)], "doc_id long, q string, text string")
    rows = packing.pack(df, max_tokens=64, max_segments=5, max_loss=40, prompt="q", waiting=32).collect()
    want = {i: tokens("ask " * (i % 7)) + tokens("answer it " * (i % 11)) + [1] for i in range(400)}
    check(rows, want, (64, 5, 40))
    for r in rows:
        prompt = len(tokens("ask " * (r.doc_id % 7)))
        assert r.loss_tokens == max(0, r.start + r.length - max(prompt, r.start))


def test_query(spark):
    from textsim.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: tokens(r.text) + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_packing"](spark, sf).collect():
        ids = np.array(texts[r.doc_id][r.start:r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(ids) and r.doc_tokens == len(texts[r.doc_id])
