"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles. One permutation scatters the shingles
over 32-bit positions; a second one, shifted around the circle of positions by k, ranks them,
and coordinate k of the signature is the smallest rank. So two permutations make all coordinates.
``BANDS`` bands of ``ROWS`` coordinates are the buckets in which equal sets, and sets that are
alike, meet; at a similarity of 0.85 a pair meets nowhere with a chance of 8e-7, at 0.8 with 8e-5.

Equal sets are one set. In each bucket every set meets the bucket's smallest one first, so that a
group of near copies costs pairs in proportion to its size. What a bucket still holds of
different components then meets in blocks of bounded size, as a matrix of signatures a
block pair: components large enough have blocks of their own, and two blocks of one component never meet.
Signatures that agree in ``agreement`` coordinates (80 of 120 for 0.85, which gives 102 on
average; the chance of fewer is below 1e-7) make a candidate, and a block pair hands on a spanning forest of the components that
its candidates would join. So components gather in clusters, without a row a pair; the full sets of a cluster, made anew for those documents only, meet in
blocks again and every candidate that would join two components is verified there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsim.llm.components import components
from textsim.llm.ngram_join import _pack, _unpack, shingle_hashes
from textsim.llm.words import small_batches, text_of
from textsim.session import materialize

WORDS = 3
PERCENT = 85
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
BLOCK = 256              # sets of a block
FILTER_BITS = 27         # of the table of wanted documents, at most


def _scatter(x):
    """The first permutation of the 32-bit positions."""
    import numpy as np

    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _rank(x):
    """The second permutation, in place: every step is one to one on 32 bits."""
    import numpy as np

    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes):
    """All coordinates of a set of 64-bit shingle hashes."""
    import numpy as np

    at = _scatter((hashes >> np.uint64(32)).astype(np.uint32))
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    shifts = (np.arange(COORDINATES, dtype=np.uint64) * 0x9E3779B1 & 0xFFFFFFFF).astype(np.uint32)[:, None]
    for a in range(0, len(at), 256):
        np.minimum(out, _rank(at[None, a:a + 256] + shifts).min(axis=1), out=out)
    return out


def agreement(percent: int) -> int:
    """Coordinates in which two sets at the threshold agree but for a chance below 1e-7: 5.6 deviations under the mean."""
    p = percent / 100
    return int(COORDINATES * p - 5.6 * (COORDINATES * p * (1 - p)) ** 0.5)


def band_keys(sign):
    """One 64-bit bucket a band."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(sign[b * ROWS:(b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def signed_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (shingles), id (hash of the set; null when empty), keys (buckets), sign (the low byte of each
    coordinate). Of the equal sets of a task only the first ones carry keys and signature."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, words)
                if not len(h):
                    out.append((0, None, None, None))
                    continue
                key = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
                if key in seen:
                    out.append((len(h), key, None, None))
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(key)
                sign = signature(h)
                out.append((len(h), key, band_keys(sign), sign.astype(np.uint8).tobytes()))
            n, key, keys, sign = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                                              pa.array(sign, pa.binary())], names=["doc_id", "n", "id", "keys", "sign"])
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n long, id long, keys array<bigint>, sign binary")


def _agreeing(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""
    least = agreement(percent)
    one = signs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sign").alias("sign_a"))
    two = signs.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    near = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (batch.column(2), batch.column(3)))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))
    return near.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def _wanted(docs: DataFrame, ids: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(id, tokens) of the sets ``ids``, made anew from one document each. Documents are picked by a bit table of
    their ids before any text moves; it grows with their number up to 16 MB, and where it is full more
    sets are made and the result is the same."""
    import numpy as np

    owner = sets.where("id is not null").groupBy("id").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id"))
    owners = materialize(ids.distinct().join(owner, "id").select("id", "doc_id"), "cmh-owners")
    bits = min(FILTER_BITS, max(16, (16 * owners.count()).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    chunk = 1 << 16
    mask = np.zeros(1 << bits, bool)

    def pack(table):
        import pyarrow as pa

        s = table.column("slot").to_numpy()
        cells = np.zeros(chunk, np.uint8)
        cells[s & (chunk - 1)] = 1
        return pa.table({"chunk": pa.array([int(s[0]) // chunk], pa.int64()), "cells": pa.array([np.packbits(cells).tobytes()], pa.binary())})
    slots = owners.select(slot.alias("slot")).distinct()
    for r in slots.groupBy((F.col("slot") / chunk).cast("long").alias("chunk")).applyInArrow(pack, "chunk long, cells binary").collect():
        mask[r["chunk"] * chunk:(r["chunk"] + 1) * chunk] = np.unpackbits(np.frombuffer(r["cells"], np.uint8)).astype(bool)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(mask, bitorder="little"))

    def run(batches):
        import pyarrow as pa
        import xxhash

        table = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            picked = batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            out = []
            for text in picked.column(1).to_pylist():
                h = shingle_hashes(text, words)
                if len(h):
                    out.append((xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63), _pack(np.unique((h >> np.uint64(16)).astype(np.int64)))))
            if out:
                key, tokens = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(tokens, pa.binary())], names=["id", "tokens"])
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id")
    placed = docs.select(own, text_of().alias("text")).select(slot.alias("slot"), "text")
    return placed.mapInArrow(run, "id long, tokens binary")


def _made(docs: DataFrame, ids: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """The full sets (id, tokens) of ``ids``, once each."""
    made = _wanted(docs, ids, sets, words)
    return materialize(made.join(ids.distinct(), "id", "left_semi").dropDuplicates(["id"]), "cmh-sets")


def _similar(x, y, percent: int) -> bool:
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = [_similar(_unpack(x), _unpack(y), percent) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    one = made.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a"))
    two = made.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b"))
    # the larger ids, of which a group's pairs have as many as it has sets, meet first: the shared smallest set moves last
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "tokens_a", "tokens_b")
    return materialize(both.mapInArrow(run, "a long, b long"), "cmh-links")


def _joining(pairs, agree, component, sound):
    """Of the pairs (x, y) those that are ``sound`` and join components not joined so far, the highest ``agree`` first."""
    import numpy as np

    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c
    for k in np.argsort(-agree, kind="stable").tolist():
        x, y = pairs[k]
        a, b = find(int(component[x])), find(int(component[y]))
        if a != b and sound(x, y):
            root[a] = b
            yield x, y


def _met(groups: DataFrame, known: DataFrame, carried: DataFrame, percent: int) -> DataFrame:
    """What meets in groups (key, id) and whose sizes and signatures allow the threshold, a spanning forest a block pair: pairs (a, b) of
    components or, where ``carried`` brings tokens beside (id, n, sign), pairs of sets whose full sets reach the threshold."""
    least = agreement(percent)
    exact = "tokens" in carried.columns
    of = groups.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    shares = of.groupBy("key", "component").agg(F.count(F.lit(1)).alias("share"))
    mixed = shares.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                      F.sum(F.when(F.col("share") < BLOCK, F.col("share")).otherwise(0)).alias("small")).where("low <> high")
    mixed = materialize(mixed.select("key", "small"), "cmh-mixed")
    # a component of BLOCK sets and more has blocks of its own, the others share blocks
    salt = lambda n: F.pmod(F.xxhash64("id", "key"), F.ceil(n / F.lit(BLOCK))).cast("int")
    placed = of.join(mixed, "key").join(shares.where(F.col("share") >= BLOCK), ["key", "component"], "left")
    placed = materialize(placed.select("key", "id", "component", F.when(F.col("share").isNotNull(), F.col("component")).alias("own"),
                                       salt(F.coalesce("share", F.greatest("small", F.lit(1)))).alias("block")), "cmh-placed")
    blocks = placed.select("key", "own", "block").distinct()
    name = F.xxhash64("own", "block")
    left, right = blocks.select("key", F.col("own").alias("own_i"), name.alias("i")), blocks.select("key", F.col("own").alias("own_j"), name.alias("j"))
    meets = left.join(right, "key").where("i <= j and (own_i is null or not own_i <=> own_j)").select("key", "i", "j")
    side = lambda end: meets.join(placed.withColumn(end, name), ["key", end]).select("key", "i", "j", "id", "component", F.lit(end == "i").alias("first"))
    rows = side("i").unionByName(side("j").where("i <> j")).join(carried, "id")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select(
        "key", "i", "j", "id", "component", "n", "first", "sign", *(["tokens"] if exact else []))

    def pairs_of(block):
        import numpy as np

        n, component, first = (np.array([r[k] for r in block]) for k in (2, 1, 3))
        sign = np.frombuffer(b"".join(r[4] for r in block), np.uint8).reshape(-1, COORDINATES)
        alone = bool(first.all())
        pairs, agree = [], []
        for x in range(len(block)):
            fits = (component != component[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent)
            fits[:x + 1] = False
            fits &= alone | (first != first[x])
            at = np.flatnonzero(fits)
            same = (sign[at] == sign[x]).sum(axis=1)
            at, same = at[same >= least], same[same >= least]
            pairs += [(x, y) for y in at.tolist()]
            agree.append(same)
        if not pairs:
            return
        if exact:
            order, sound = np.concatenate(agree), lambda x, y: _similar(_unpack(block[x][5]), _unpack(block[y][5]), percent)
        else:                                  # smallest components first, so that other blocks find the same pairs
            order, sound = -np.array([min(component[x], component[y]) for x, y in pairs], float), lambda x, y: True
        for x, y in _joining(pairs, order, component, sound):
            a, b = (block[x][0], block[y][0]) if exact else (block[x][1], block[y][1])
            yield min(a, b), max(a, b)

    def run(batches):
        import pyarrow as pa

        now, block = None, []

        def flush(found):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])
        for batch in batches:
            found = []
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != now:
                    found += pairs_of(block) if len(block) > 1 else []
                    now, block = (key, i, j), []
                block.append(row)
            if found:
                yield flush(found)
        if len(block) > 1:
            yield flush(list(pairs_of(block)))
    return materialize(rows.mapInArrow(run, "a long, b long").distinct(), "cmh-met")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links of at
    least ``percent`` / 100 lead to, itself included).

    Words are runs without ASCII white space, A-Z lower-cased.

    Edge cases: a text with fewer words than a shingle is one shingle; a null, empty or blank text has none, links
    with nothing and keeps its own id; rows with the same doc_id, null too, are kept one by one; a null doc_id is
    a component's id only where no other is there; an empty table gives no rows; other columns are ignored. Sets are
    verified by 48-bit hashes of their shingles and known by a hash of 64 bits.
    """
    small_batches(docs.sparkSession)
    sets = materialize(signed_sets(docs, words), "cmh-signed")
    signs = sets.where("sign is not null").select("id", "n", "sign").dropDuplicates(["id"])
    postings = sets.where("keys is not null").select(F.explode("keys").alias("key"), "id")
    heads = postings.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head <> tail").select("key", "head")
    shared = materialize(postings.join(heads, "key"), "cmh-shared")

    first = shared.where("head <> id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    close = materialize(_agreeing(first, signs, percent), "cmh-pairs")
    both = lambda pairs: pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    found = _links(close, _made(docs, both(close), sets, words), percent)

    known = components(found)
    members = shared.select("key", "id").distinct()
    clusters = components(_met(members, known, signs, percent)).select(F.col("id").alias("component"), F.col("component").alias("key"))
    of = members.select("id").distinct().join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    clusters = materialize(of.join(clusters, "component").select("key", "id"), "cmh-clusters")
    full = signs.join(_made(docs, clusters.select("id"), sets, words), "id")
    found = found.unionByName(_met(clusters, known, full, percent))

    classes = sets.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    classes = classes.join(components(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = classes.join(smallest, "component").select(F.col("id").alias("set_id"), "component_id")
    rows = sets.select("doc_id", "n", "id")
    return rows.join(of_class, rows["id"] == of_class["set_id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
