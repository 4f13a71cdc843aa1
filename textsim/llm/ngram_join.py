"""N-gram Jaccard join with signature trees.

Every document becomes the set of its distinct word shingles (48-bit hashes).
Equal sets are one set from then on. Two sets at or above the threshold share a
token among the first ``n - ceil(t n) + 1`` tokens of each, in any common order of
tokens; the order here is by hash, with the most frequent shingles of the whole corpus
last, so that a passage found in a third of all documents makes no bucket.

Round 1 verifies, in each bucket of a shared token, every set against the bucket's
smallest one: near copies by the thousand fall into components with a number
of pairs that is linear in their number. Round 2 puts the sets of a bucket that
still holds several components in a random order and verifies neighbours of different
components. The last round walks what is left. A large bucket becomes a signature tree: leaves
are bitmaps of the sets, inner nodes the OR of their children with ranges of set
size; two trees are walked together, and a pair of nodes is dropped when the
largest overlap that bitmaps and sizes allow is too small. A pair is passed on by the first bucket that
its sets share, and verified on the sets themselves. Nothing is capped or sampled: the result
is the components of all links. Pairs inside a component are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsim.llm.components import components
from textsim.llm.words import apart, small_batches, text_of
from textsim.session import materialize

WORDS = 4
PERCENT = 85
HOT_MAX = 1 << 17        # most frequent shingles that go last in the order; only a matter of speed
HOT_LEAST = 16
SMALL_BUCKET = 8         # sets of a bucket whose pairs are written out by a join
BLOCK = 256              # leaves of one signature tree
FANOUT = 8
FILTER_BITS = 1 << 22

_MIX = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, words: int = WORDS):
    """Sorted distinct 64-bit hashes of a text's shingles; of all its words when it has fewer."""
    import numpy as np
    import xxhash

    h = xxhash.xxh3_64_intdigest
    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        return np.array([h(b" ".join(tokens), seed=len(tokens))], np.uint64)
    w = np.array([h(t) for t in tokens], np.uint64)
    n = len(w) - words + 1
    acc = w[:n].copy()
    for k in range(1, words):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(_MIX) + w[k:k + n]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(_MIX)
    return np.unique(acc ^ (acc >> np.uint64(29)))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _unpack(blob: bytes):
    """The sorted 48-bit tokens of a stored set."""
    import numpy as np

    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.int64) | (np.frombuffer(blob, "<u2", n, 4 * n).astype(np.int64) << 32)


def _pack(tokens) -> bytes:
    import numpy as np

    return (tokens & np.int64(0xFFFFFFFF)).astype("<u4").tobytes() + (tokens >> np.int64(32)).astype("<u2").tobytes()


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (shingles), id (hash of the set; null when empty), tokens. Of the
    equal sets that a batch of rows holds only the first carries its tokens."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = []
                for text in part.column(1).to_pylist():
                    h = shingle_hashes(text, words)
                    if not len(h):
                        out.append((0, None, None))
                        continue
                    key = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)
                    fresh = key not in seen
                    if fresh:
                        if len(seen) >= 1 << 20:
                            seen.clear()
                        seen.add(key)
                    out.append((len(h), key, _pack(np.unique((h >> np.uint64(16)).astype(np.int64))) if fresh else None))
                n, key, blob = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()),
                                                  pa.array(blob, pa.binary())], names=["doc_id", "n", "id", "tokens"])
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n long, id long, tokens binary")


def hot_tokens(sets: DataFrame, hot_max: int, least: int):
    """The most frequent 32-bit token prefixes and their counts, at most ``hot_max``.

    Tasks exchange sorted runs cut into key ranges, two bytes a token; the number
    of ranges follows the number of tokens, so that one range is about a million.
    """
    import numpy as np

    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = min(16, max(5, (total >> 20).bit_length()))

    def send(batches):
        import pyarrow as pa

        def flush(keys):
            k = np.sort(np.concatenate(keys))
            edges = np.searchsorted(k, np.arange((1 << bits) + 1, dtype=np.int64) << (32 - bits))
            rows = [(r, (k[a:b] & 0xFFFF).astype("<u2").tobytes(),
                     np.bincount((k[a:b] >> 16) - (r << (16 - bits)), minlength=1 << (16 - bits)).astype("<u4").tobytes())
                    for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                              names=["range", "low", "high"])
        keys, held = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys.append(_unpack(blob) >> 16)
                held += len(keys[-1])
                if held > 1_000_000:
                    yield flush(keys)
                    keys, held = [], 0
        if held:
            yield flush(keys)

    def count(table):
        import pyarrow as pa

        r = table.column("range")[0].as_py()
        runs = []
        for low, high in zip(table.column("low").to_pylist(), table.column("high").to_pylist()):
            runs.append(np.repeat(np.arange(1 << (16 - bits), dtype=np.int64) + (r << (16 - bits)), np.frombuffer(high, "<u4")) << 16
                        | np.frombuffer(low, "<u2").astype(np.int64))
        k, n = np.unique(np.concatenate(runs), return_counts=True)
        keep = n >= least
        return pa.table({"key": pa.array(k[keep]), "n": pa.array(n[keep])})
    runs = sets.where("tokens is not null").select("tokens").mapInArrow(send, "range int, low binary, high binary")
    counted = materialize(runs.groupBy("range").applyInArrow(count, "key long, n long"), "join-counts")
    steps = {r["e"]: r["c"] for r in counted.groupBy(F.floor(F.log2("n") * 4).alias("e")).agg(F.count(F.lit(1)).alias("c")).collect()}
    cut, upto = None, 0
    for e in sorted(steps, reverse=True):
        upto += steps[e]
        if upto > hot_max:
            break
        cut = e
    if cut is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counted.where(F.floor(F.log2("n") * 4) >= cut).orderBy("key").collect()
    return np.array([r["key"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def prefix(tokens, hot, percent: int = PERCENT):
    """The first tokens of a set in the common order: by corpus count among the hot, by hash."""
    import numpy as np

    keys, counts = hot
    p = _prefix_length(len(tokens), percent)
    if not len(keys):
        return tokens[:p]
    at = np.minimum(np.searchsorted(keys, tokens >> 16), len(keys) - 1)
    n = np.where(keys[at] == tokens >> 16, counts[at], 0)
    cold = tokens[n == 0]
    return cold[:p] if len(cold) >= p else tokens[np.lexsort((tokens, n))][:p]


def bitmap(tokens):
    """A set's signature: one bit a token, the width (a power of two) twice the set's size or more."""
    import numpy as np

    width = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[tokens & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def fold(words, to: int):
    """A bitmap of ``to`` 64-bit words from a wider one."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def may_link(n_a: int, bits_a, n_b: int, bits_b, percent: int = PERCENT) -> bool:
    """Whether sizes and bitmaps allow the threshold: a token of one set whose bit the other lacks is not shared."""
    import numpy as np

    if min(n_a, n_b) * 100 < percent * max(n_a, n_b):
        return False
    width = min(len(bits_a), len(bits_b))
    a, b = fold(bits_a, width), fold(bits_b, width)
    most = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return most * (100 + percent) >= percent * (n_a + n_b)


def tree_pairs(sizes, bitmaps, groups, sides=None, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Pairs of leaves of different groups (and different sides, if given) that a walk of the signature tree cannot rule out."""
    import numpy as np

    order = np.argsort(sizes, kind="stable")
    width = min(len(b) for b in bitmaps)
    leaves = np.stack([fold(bitmaps[i], width) for i in order])
    n = np.asarray(sizes)[order]
    level = (leaves, n, n, n - np.bitwise_count(leaves).sum(axis=1).astype(np.int64))  # bits, least, most, largest excess over bits
    levels = [level]
    while len(level[0]) > 1:
        cut = np.arange(0, len(level[0]), FANOUT)
        level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut),
                 np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
        levels.append(level)
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        bits, least, most, excess = levels[depth]
        ok = (least[np.maximum(i, j)] * percent <= 100 * most[np.minimum(i, j)])
        i, j = i[ok], j[ok]
        shared = np.concatenate([np.bitwise_count(bits[i[k:k + 65536]] & bits[j[k:k + 65536]]).sum(axis=1).astype(np.int64)
                                 for k in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        bound = np.minimum(np.minimum(excess[i], excess[j]) + shared, np.minimum(most[i], most[j]))
        ok = bound * (100 + percent) >= percent * (least[i] + least[j])
        i, j = i[ok], j[ok]
        if depth:
            size = len(levels[depth - 1][0])
            step = np.arange(FANOUT)
            ii = np.repeat((i[:, None] * FANOUT + step), FANOUT, axis=1).ravel()
            jj = np.tile(j[:, None] * FANOUT + step, (1, FANOUT)).ravel()
            ok = (ii < size) & (jj < size) & (ii <= jj)
            i, j = ii[ok], jj[ok]
    for a, b in zip(order[i].tolist(), order[j].tolist()):
        if groups[a] != groups[b] and (sides is None or sides[a] != sides[b]) and \
                may_link(int(sizes[a]), bitmaps[a], int(sizes[b]), bitmaps[b], percent):
            yield a, b


def _postings(sets: DataFrame, hot, percent: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [prefix(_unpack(b), hot, percent) for b in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(found)), pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in found]))],
                    names=["token", "id"])
    return sets.where("tokens is not null").select("id", "tokens").mapInArrow(run, "token long, id long")


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens) of the wanted ids and of few others: a filter of ``FILTER_BITS`` bits, read before any
    shuffle. Its size is fixed; where it is full, more sets travel and the result is the same."""
    import numpy as np

    slot = F.pmod(F.col("id"), F.lit(FILTER_BITS))
    words = ids.select((slot / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)).cast("int")).alias("b"))
    mask = np.zeros(FILTER_BITS // 32, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        mask[r["w"]] = r["b"]
    mask = mask.astype(np.uint32)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = batch.column(0).to_numpy() % FILTER_BITS
            yield batch.filter(pa.array((mask[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1))
    return sets.where("tokens is not null").select("id", "tokens").mapInArrow(run, "id long, tokens binary")


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of either: a, b, one, two. Equal sets of several tasks give equal rows."""
    one = table.select(F.col("id").alias("a"), F.col(column).alias("one"))
    two = table.select(F.col("id").alias("b"), F.col(column).alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")


def links(pairs: DataFrame, sets: DataFrame, signatures: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ids that reach the threshold: first by signature, then on the sets."""
    def possible(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [may_link(x["n"], np.frombuffer(x["bits"], "<u8"), y["n"], np.frombuffer(y["bits"], "<u8"), percent)
                    for x, y in zip(one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, keep = batch.slice(at, 256), []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = _unpack(x), _unpack(y)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    left = materialize(_both(pairs, signatures, "sign").mapInArrow(possible, "a long, b long"), "join-possible")
    ids = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id")))
    wanted = materialize(_only(sets, ids).dropDuplicates(["id"]), "join-wanted")
    return materialize(_both(left, wanted, "tokens").mapInArrow(verified, "a long, b long"), "join-links")


def _signatures(sets: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("n", pa.int64()), ("bits", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = [_unpack(b) for b in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                    [{"n": len(t), "bits": bitmap(t).tobytes()} for t in tokens], kind)], names=["id", "sign"])
    return sets.where("tokens is not null").select("id", "tokens").mapInArrow(
        run, "id long, sign struct<n:bigint,bits:binary>").dropDuplicates(["id"])


def _mixed(shared: DataFrame, known: DataFrame) -> DataFrame:
    """token, id, component, size of the buckets that hold several components."""
    bucket = Window.partitionBy("token")
    grouped = shared.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return materialize(grouped.withColumns({
        "low": F.min("component").over(bucket), "high": F.max("component").over(bucket), "size": F.count(F.lit(1)).over(bucket)})
        .where("low <> high").select("token", "id", "component", "size"), "join-mixed")


def _neighbours(mixed: DataFrame) -> DataFrame:
    """Pairs of sets of different components that follow each other in a bucket, put in a random order."""
    order = Window.partitionBy("token").orderBy(F.xxhash64("id", "token"), "id")
    follows = mixed.withColumn("next", F.lead(F.struct("id", "component")).over(order)).where("next.component <> component")
    return follows.select(F.least("id", "next.id").alias("a"), F.greatest("id", "next.id").alias("b")).distinct()


def _tree_candidates(mixed: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of the large buckets: blocks of about ``BLOCK`` sets meet two by two. A pair
    is passed on only by the smallest token that both sets have in mixed buckets."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    placed = mixed.where(F.col("size") > SMALL_BUCKET).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component")
    of_id = mixed.groupBy("id").agg(F.collect_list("token").alias("tokens"))  # no longer than a set's prefix
    leaves = placed.join(materialize(signatures.join(of_id, "id"), "join-leaves"), "id").select(
        "token", "i", "j", "own", "id", "component", "sign", "tokens")

    def run(table):
        import numpy as np
        import pyarrow as pa

        rows = table.to_pylist()
        pairs = []
        if len(rows) > 1:
            token, has = rows[0]["token"], [set(r["tokens"]) for r in rows]
            sides = [r["own"] for r in rows] if rows[0]["i"] != rows[0]["j"] else None
            walk = tree_pairs(np.array([r["sign"]["n"] for r in rows]), [np.frombuffer(r["sign"]["bits"], "<u8") for r in rows],
                              [r["component"] for r in rows], sides, percent)
            pairs = [(rows[a]["id"], rows[b]["id"]) for a, b in walk if min(has[a] & has[b]) == token]
        return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})
    return leaves.groupBy("token", "i", "j").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot_max: int = HOT_MAX) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, the
    smallest doc_id that links of at least ``percent`` / 100 lead to, itself included.

    Words are runs without ASCII white space, A-Z lower-cased.

    Edge cases: a text with fewer words than a shingle is one shingle; a null, empty or blank text has
    none, links with nothing and keeps its own id; rows with the same doc_id, null too, are
    kept one by one; equal sets link; a null doc_id is never a component's id unless no
    other is there; an empty table gives no rows; other columns are ignored. Hash collisions
    (48 bits within a pair, 64 bits between sets) are the only inexactness.
    """
    small_batches(docs.sparkSession)
    sets = materialize(shingle_sets(docs, words), "join-sets")
    signatures = materialize(_signatures(sets), "join-signatures")
    hot = hot_tokens(sets, hot_max, HOT_LEAST)
    bucket = Window.partitionBy("token")
    shared = materialize(_postings(sets, hot, percent).withColumns({  # the rows of a token are in one place: no second shuffle
        "pivot": F.min("id").over(bucket), "last": F.max("id").over(bucket)}).where("pivot <> last").drop("last")
        .dropDuplicates(["token", "id"]), "join-shared")

    first = shared.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    found = links(first, sets, signatures, percent)
    members = shared.select("token", "id")
    mixed = _mixed(members, components(found))
    found = found.unionByName(links(_neighbours(mixed), sets, signatures, percent))
    mixed = _mixed(mixed.select("token", "id"), components(found))

    small = mixed.where(F.col("size") <= SMALL_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    written = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
                     ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    rest = links(written.unionByName(_tree_candidates(mixed, signatures, percent)).distinct(), sets, signatures, percent)

    final = components(found.unionByName(rest))
    classes = sets.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"))
    classes = classes.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = classes.join(smallest, "component").select(F.col("id").alias("set_id"), "component_id")
    rows = sets.select("doc_id", "n", "id")
    return rows.join(of_class, rows["id"] == of_class["set_id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id.

    Rows that share a doc_id stay or go together, but equal rows become one; rows
    without a doc_id have no place in that order and stay. Other columns pass through, whatever their names.
    """
    return apart(docs, ("doc_id", "text"), lambda d: _one_of_each(d, words, percent))


def _one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    found = jaccard_components(docs, words, percent)
    stays = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(stays, "doc_id", "left_semi")
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    kept = kept.withColumn("_once", F.row_number().over(once)).where("_once = 1").drop("_once")
    return kept.unionByName(docs.where("doc_id is null")).select(*(f"`{c}`" for c in docs.columns))
