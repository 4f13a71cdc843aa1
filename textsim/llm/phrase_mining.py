"""Collocations by Toivonen mining of phrases.

A phrase is a run of words inside a piece of text (no punctuation in between), and a
phrase can be frequent only if the phrase without its first and the one without its last word
are. A sample of the documents proposes: level by level, the phrases that reach a lowered
threshold in it. The full pass then counts, exactly and at once for all lengths, every phrase
both of whose parts were proposed: the proposed phrases themselves and the
negative border. A frequent phrase that was not proposed is a failure of the border. Its extensions
are counted by an expansion pass, in which a phrase not counted so far stands for
itself as possibly frequent, so that extensions of extensions are counted in the same
pass; passes follow until no failure is left. Only the time depends on the sample, never the result.

Proposed phrases reach the tasks as one bit table a length, whose size follows their
number up to ``TABLE_BITS`` (16 MB); where a table is full, more phrases are counted and the result is the
same. Counts are sums of partial sums keyed by language and phrase, so a word or a
phrase that makes up a third of the corpus costs one row a block of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsim.llm.words import small_batches, text_of
from textsim.session import materialize

LEAST = 100              # occurrences that make a phrase a candidate
LONGEST = 5              # words
SAMPLE_OF = 8            # one document in so many proposes
TOP = 2000               # collocations reported of a language
TABLE_BITS = 27          # of a bit table, at most
BLOCK_WORDS = 1 << 20    # words that a task counts at once
PART_BYTES = 1 << 21     # of a long text taken at once, up to the next end of a piece
VOCABULARY = 250_000     # words a task knows by number before it starts anew
CHUNK_BITS = 19

_MIX = 0x9E3779B97F4A7C15
#: A-Z lower-cased; the ends of a piece become a byte that UTF-8 never uses.
_TO = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"\xff"


def _extend(h, word):
    """The hash of a phrase and one more word, on numpy arrays."""
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX) + word
    return h ^ (h >> np.uint64(29))


def phrase_hash(lang: str, words: list[bytes]):
    import numpy as np
    import xxhash

    seed = xxhash.xxh32_intdigest(lang)
    with np.errstate(over="ignore"):
        h = np.uint64(xxhash.xxh3_64_intdigest(words[0], seed))
        for w in words[1:]:
            h = _extend(h, np.uint64(xxhash.xxh3_64_intdigest(w, seed)))
    return h


def _has(table, h):
    """Which hashes have their bit in the table; None has none."""
    import numpy as np

    if table is None:
        return np.zeros(len(h), bool)
    bits, cells = table
    slot = h >> np.uint64(64 - bits)
    return (cells[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_tables(phrases: DataFrame, longest: int = LONGEST) -> dict:
    """{words: (bits, cells)} of the phrases (lang, phrase) shorter than ``longest``."""
    phrases = phrases.withColumn("words", F.size(F.split("phrase", " "))).where(F.col("words") < longest)
    sizes = {r["words"]: min(TABLE_BITS, max(CHUNK_BITS, (16 * r["count"]).bit_length()))
             for r in phrases.groupBy("words").count().collect()}

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            words = batch.column(2).to_pylist()
            h = [int(phrase_hash(lang, p.encode().split(b" "))) for lang, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array([x >> (64 - sizes[k]) for x, k in zip(h, words)], pa.int64())],
                                             names=["words", "slot"])

    marked = phrases.select("lang", "phrase", "words").mapInArrow(slots, "words int, slot long").distinct()
    return _packed(marked, sizes)


def _packed(slots: DataFrame, sizes: dict) -> dict:
    """Bit tables of distinct (words, slot), ``sizes[words]`` bits wide, put together from chunks of 64 KB."""
    import numpy as np

    def pack(table):
        import pyarrow as pa

        slot = table.column("slot").to_numpy()
        cells = np.zeros(1 << CHUNK_BITS, np.uint8)
        cells[slot & ((1 << CHUNK_BITS) - 1)] = 1
        return pa.table({"words": table.column("words")[:1], "chunk": pa.array([int(slot[0]) >> CHUNK_BITS], pa.int64()),
                         "cells": pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())})
    chunks = slots.groupBy("words", F.expr(f"shiftright(slot, {CHUNK_BITS})").alias("chunk")).applyInArrow(pack, "words int, chunk long, cells binary")
    tables = {k: (bits, np.zeros(1 << (bits - 3), np.uint8)) for k, bits in sizes.items()}
    width = 1 << (CHUNK_BITS - 3)
    for r in chunks.collect():
        tables[r["words"]][1][r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(r["cells"], np.uint8)
    return tables


def _joined(old: dict, new: dict) -> dict:
    """Tables with the bits of both; a smaller table is spread out to the size of the other."""
    import numpy as np

    out = dict(old)
    for k, (bits, cells) in new.items():
        if k in out:
            have_bits, have = out[k]
            if have_bits < bits:
                have_bits, have, bits, cells = bits, cells, have_bits, have
            wide = np.repeat(np.unpackbits(cells, bitorder="little"), 1 << (have_bits - bits))
            bits, cells = have_bits, have | np.packbits(wide, bitorder="little")
        out[k] = (bits, cells)
    return out


def _parts(data: bytes):
    """A long text in parts that end where a piece ends."""
    a = 0
    while len(data) - a > PART_BYTES:
        b = data.find(_END, a + PART_BYTES)
        if b < 0:
            break
        yield data[a:b]
        a = b
    yield data[a:]


def _block_counts(ids, hashes, members, sizes, tables, old):
    """Counts within one block of word numbers (0 ends a piece): yields (words, matrix of word numbers, counts, hashes).

    ``members`` are, by word number, those taken as frequent and those taken so when
    ``old`` was counted. With ``old`` only what was not counted then is yielded.
    """
    import numpy as np

    if 1 in sizes:
        n = np.bincount(ids)
        n[0] = 0
        seen = np.flatnonzero(n)
        yield 1, seen[:, None], n[seen], hashes[seen]
    taken, was = members[0][ids], members[1][ids] if old is not None else None
    dense, of_hash = ids, hashes
    for k in range(2, max(sizes) + 1):
        at = np.flatnonzero(taken[:-1] & taken[1:])
        at = at[at + k - 1 < len(ids)]
        if not len(at):
            return
        code = (dense[at].astype(np.int64) << 32) | ids[at + k - 1]
        code, first, inverse, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        inverse = inverse.astype(np.int32)
        head = at[first]
        of_hash = _extend(of_hash[dense[head]], hashes[ids[head + k - 1]])
        known = was[head] & was[head + 1] if old is not None else np.zeros(len(head), bool)
        if k in sizes:
            rows = np.flatnonzero(~known)
            yield k, ids[head[rows, None] + np.arange(k)], count[rows], of_hash[rows]
        if k == max(sizes):
            return
        take = _has(tables.get(k), of_hash)
        if old is not None:
            before = known & _has(old.get(k), of_hash)
            was = np.zeros(len(ids), bool)
            was[at] = before[inverse]
            take |= ~known
        taken = np.zeros(len(ids), bool)
        taken[at] = take[inverse]
        dense = np.zeros(len(ids), np.int32)
        dense[at] = inverse


def _blocks(batches):
    """Blocks of about ``BLOCK_WORDS`` words of rows (lang, text): (ids, hashes, words, languages by number, names of
    languages); ids are word numbers, 0 after each document and at the end of each piece."""
    import numpy as np
    import xxhash

    numbers, words, langs, h, blocks, held = {}, [], [], [], [], 0
    lang_of, names = {}, []

    def start():
        words[:], langs[:], h[:] = [_END], [0], [0]
        numbers.clear()
    start()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in lang_of:
                lang_of[lang] = (len(names), xxhash.xxh32_intdigest(lang))
                names.append(lang)
            number, seed = lang_of[lang]
            for part in _parts(text.encode("utf-8", "surrogatepass").translate(_TO)):
                tokens = part.replace(_END, b" \xff ").split()
                mine = numbers.setdefault(lang, {_END: 0})
                for w in set(tokens).difference(mine):
                    mine[w] = len(words)
                    words.append(w)
                    langs.append(number)
                    h.append(xxhash.xxh3_64_intdigest(w, seed))
                blocks.append(np.fromiter(map(mine.__getitem__, tokens), np.int32, len(tokens)))
                blocks.append(np.zeros(1, np.int32))
                held += len(tokens) + 1
                if held >= BLOCK_WORDS:
                    yield np.concatenate(blocks), np.array(h, np.uint64), words, np.array(langs, np.int32), names
                    blocks.clear()
                    held = 0
                    if len(words) > VOCABULARY:
                        start()
    if blocks:
        yield np.concatenate(blocks), np.array(h, np.uint64), words, np.array(langs, np.int32), names


def _members(hashes, tables, old):
    """Which words are taken as frequent, now and when ``old`` was counted; the end of a piece never is."""
    out = [None if t is None else _has(t.get(1), hashes) for t in (tables, old)]
    for m in out:
        if m is not None:
            m[0] = False
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))


def bounded(docs: DataFrame, longest: int, tables: dict, least: int, words: int):
    """A bit table of the hash buckets in which phrases of 1 to ``longest`` words whose parts are in ``tables`` occur
    ``least`` times or more together: no phrase outside it is frequent.

    ``words`` is about the number of words in docs; the number of buckets follows it (a key range
    of 2^24 buckets for each million words). Tasks exchange sorted buckets, a row a block of words and key range.
    """
    import numpy as np

    spark = docs.sparkSession
    range_bits = min(24, max(4, (words >> 20).bit_length()))
    shared = spark.sparkContext.broadcast(tables)

    def run(batches):
        import pyarrow as pa

        tables = shared.value
        sizes = range(1, longest + 1)
        for ids, hashes, *_ in _blocks(batches):
            found = [(h >> np.uint64(40 - range_bits), n) for _, _, n, h in _block_counts(ids, hashes, _members(hashes, tables, None), sizes, tables, None)]
            key, n = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key)
            key, n = key[order], n[order]
            times = (n + 254) // 255                       # a count of more than a byte holds takes several places
            key = np.repeat(key, times)
            last = np.cumsum(times) - 1
            place = np.full(len(key), 255, np.uint8)
            place[last] = n - 255 * (times - 1)
            edges = np.flatnonzero(np.diff(key >> np.uint64(24), prepend=np.uint64(1 << 40)))
            ends = np.append(edges[1:], len(key))
            low, high = (key & np.uint64(0xFFFF)).astype("<u2"), (key >> np.uint64(16)).astype(np.uint8)
            for a in range(0, len(edges), 4096):
                part = list(zip(edges[a:a + 4096].tolist(), ends[a:a + 4096].tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(key[x]) >> 24 for x, _ in part], pa.int32()), pa.array([low[x:y].tobytes() for x, y in part], pa.binary()),
                    pa.array([high[x:y].tobytes() for x, y in part], pa.binary()), pa.array([place[x:y].tobytes() for x, y in part], pa.binary())],
                    names=["range", "low", "high", "n"])

    def add(table):
        import pyarrow as pa

        columns = [table.column(c).to_pylist() for c in ("low", "high", "n")]
        low, high, n = (np.frombuffer(b"".join(c), t) for c, t in zip(columns, ("<u2", np.uint8, np.uint8)))
        key, at = np.unique(low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16), return_inverse=True)
        key = key[np.bincount(at, n) >= least].astype(np.int64)
        return pa.table({"bucket": pa.array(key | (table.column("range")[0].as_py() << 24))})
    runs = _texts(docs).mapInArrow(run, "range int, low binary, high binary, n binary")
    buckets = materialize(runs.groupBy("range").applyInArrow(add, "bucket long"), "phrases-buckets")
    bits = min(TABLE_BITS, range_bits + 24, max(CHUNK_BITS, (32 * buckets.count()).bit_length()))
    slots = buckets.select(F.lit(0).alias("words"), F.expr(f"shiftright(bucket, {range_bits + 24 - bits})").alias("slot")).distinct()
    return _packed(slots, {0: bits}).get(0)


def count_phrases(docs: DataFrame, sizes: range, tables: dict, old: dict | None = None, among=None) -> DataFrame:
    """lang, phrase, n of the phrases of ``sizes`` words whose two parts are in ``tables`` (and which are in the table
    ``among``, if given); of all words for size 1, with one more row a language, phrase '', that counts its words."""
    shared = docs.sparkSession.sparkContext.broadcast((tables, old, among))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tables, old, among = shared.value
        for ids, hashes, words, of_lang, lang_list in _blocks(batches):
            text, names = pa.array(words, pa.binary()), pa.array(lang_list, pa.string())
            if 1 in sizes:
                n = np.bincount(of_lang[ids[ids > 0]], minlength=len(lang_list))
                yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(lang_list), pa.string()), pa.array(n, pa.int64())],
                                                 names=["lang", "phrase", "n"])
            for k, rows, n, h in _block_counts(ids, hashes, _members(hashes, tables, old), sizes, tables, old):
                if among is not None:
                    may = _has(among, h)
                    rows, n = rows[may], n[may]
                for a in range(0, len(rows), 1 << 14):
                    part = rows[a:a + (1 << 14)]
                    columns = [text.take(pa.array(part[:, j])) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*columns, b" ") if k > 1 else columns[0]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of_lang[part[:, 0]])), phrase.cast(pa.string()),
                                                      pa.array(n[a:a + (1 << 14)], pa.int64())], names=["lang", "phrase", "n"])
    found = _texts(docs).mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample_of: int = SAMPLE_OF) -> DataFrame:
    """All phrases of 1 to ``longest`` words with ``least`` occurrences or more in a language of docs (doc_id,
    text, lang): lang, phrase, n. The row with phrase '' counts the language's words, frequent or not."""
    docs = docs.select("doc_id", "lang", "text")
    low = max(1, least // (2 * sample_of))
    sample = materialize(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample_of)) == 0), "phrases-sample")
    tables: dict = {}
    words = 0
    for k in range(1, longest):
        proposed = materialize(count_phrases(sample, range(k, k + 1), tables).where((F.col("n") >= low) | (F.col("phrase") == "")), "phrases-proposed")
        if k == 1:
            words = sample_of * (proposed.where("phrase = ''").agg(F.sum("n")).first()[0] or 0)
        tables.update(bit_tables(proposed.where("phrase <> ''"), longest))
        if k not in tables:
            break

    frequent = (F.col("n") >= least) | (F.col("phrase") == "")
    among = bounded(docs, longest, tables, least, words)
    counted = materialize(count_phrases(docs, range(1, longest + 1), tables, among=among).where(frequent), "phrases-counted")
    found, old = counted, tables
    while True:
        failed = _absent(counted, old, longest)
        extra = bit_tables(failed, longest)
        if not extra:
            return found
        new = _joined(old, extra)
        counted = materialize(count_phrases(docs, range(2, longest + 1), new, old).where(frequent), "phrases-expanded")
        found = found.unionByName(counted)
        # each phrase counted just now stood for itself, so what it extends to is counted too
        old, counted = _joined(new, bit_tables(counted, longest)), counted.limit(0)


def _absent(phrases: DataFrame, tables: dict, longest: int) -> DataFrame:
    """The phrases shorter than ``longest`` that were not taken as frequent: failures of the border."""
    shared = phrases.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tables, keep = shared.value, []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = phrase.encode().split(b" ")
                keep.append(len(w) < longest and not _has(tables.get(len(w)), np.array([phrase_hash(lang, w)], np.uint64))[0])
            yield batch.filter(pa.array(keep, pa.bool_()))
    return phrases.where("phrase <> ''").select("lang", "phrase").mapInArrow(run, "lang string, phrase string")


def _words(phrase: str) -> Column:
    return F.split(phrase, " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, sample_of: int = SAMPLE_OF) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 to
    ``longest`` words by score, then a (both descending), then phrase in the order of its bytes.

    Text is lower-cased (A-Z) and cut at ``.,;:!?`` and line ends; words are what
    stands between spaces and tabs. a counts the phrase, n the language's words; the score is
    floor(1000 a n / (l r)) for the cut into two parts (l and r occurrences) that makes it smallest, the first
    such cut. A phrase contained in a longer candidate that occurs as often is left out.

    Edge cases: a null text has no words, a null language is ``und``; repeated rows count each time; an empty table
    gives no rows; extra columns are ignored; a text of any length is read whole.
    """
    small_batches(docs.sparkSession)
    found = mine(docs, least, longest, sample_of)
    phrases = found.where("phrase <> ''")
    per_lang = found.where("phrase = ''").select("lang", F.col("n").alias("n_words"))
    several = phrases.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), _words("phrase").alias("w"))

    cuts = several.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(per_lang, "lang").withColumns({
        "above": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n_words"), "below": wide("l") * wide("r")})
    least_cut = scored.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a", "n_words").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    parts = several.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(
        F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"), F.expr("array_join(slice(w, 2, size(w) - 1), ' ')"))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least_cut.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("n_words").alias("n"), F.col("cut.score").alias("score"))
