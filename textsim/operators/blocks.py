"""Shared keys of all pairs of texts, counted inside pairs of blocks.

A common key makes a joined row for every pair of its texts, so a join on keys writes rows that grow with the square
of the corpus. Here texts are packed, where they lie, into blocks of about ``BLOCK`` texts: per block the sorted 48-bit
hashes of its keys and, for every key, the texts that hold it. Every block meets every block in a Cartesian product
that reads the one packed table (no shuffle, no copy of it on disk; packed parts are compressed and reach Python a few blocks
at a time, see ``small_batches``), and a task counts a block pair at once: keys that
many texts of both blocks hold as a matrix product, the others one entry a common key and pair of texts. Only pairs
above the floor become rows. The arithmetic is that of all pairs; memory is that of two blocks of at most ``ENTRIES`` keys and
of one tile of ``CELLS`` pairs, whatever the corpus.

The counts are exact but for two keys with one hash (48 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, ArrayType, StructField, StructType

from textsim.constants import IDF_UNSHARED_SQ
from textsim.session import materialize, small_batches

BLOCK = 2048            # texts of a block
ENTRIES = 1 << 19       # keys of all texts of a block: long texts make smaller blocks
CELLS = 1 << 19         # pairs of texts counted at once: so many texts of one block against all of the other
FAMILIES = ("toks", "grams", "terms")
_STEP = 1 << 20         # joined entries counted at once
_DENSE = 768            # a key is multiplied when its entries pass 1 / _DENSE of all pairs
_EPS = 1e-9
COUNTED = ("common_count", "total_ngrams_doc1", "total_ngrams_doc2", "copies")
_PAIRWISE = 250         # listed pairs are counted one by one when they are fewer than 1 / _PAIRWISE of all


def _hash(c):
    return F.xxhash64(c).bitwiseAND(F.lit((1 << 48) - 1))


def hashed(profiles: DataFrame) -> DataFrame:
    """(block, text_id, copies, t_sq, toks, grams, terms, tf) with hashes instead of keys; no shuffle."""
    none = F.array().cast("array<bigint>")
    keys = lambda c, of: F.coalesce(F.transform(c, of), none)
    n = F.col("n_copies").cast("long") if "n_copies" in profiles.columns else F.lit(1).cast("long")
    return profiles.where("text_id is not null").select(
        F.monotonically_increasing_id().alias("block"), "text_id", n.alias("copies"), F.coalesce("t_sq", F.lit(0).cast("long")).alias("t_sq"), keys("toks", _hash).alias("toks"), keys("grams", _hash).alias("grams"),
        keys("terms", lambda x: _hash(x["k"])).alias("terms"), keys("terms", lambda x: x["tf"]).alias("tf"))


def _bytes(values: np.ndarray) -> bytes:
    """Little-endian values by byte places, compressed, after their length."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _values(packed: bytes, kind) -> np.ndarray:
    width, size = np.dtype(kind).itemsize, int.from_bytes(packed[:8], "little")
    raw = pa.decompress(memoryview(packed)[8:], size, "zstd") if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).reshape(-1).view(kind)


def _packed(rows: pa.Table) -> dict:
    """One block: ids, t_sq, and per family the keys, how many texts hold each, those texts, and for terms how often."""
    out = {"ids": rows["text_id"].combine_chunks(), "copies": rows["copies"].to_numpy(), "t_sq": rows["t_sq"].to_numpy()}
    for fam in FAMILIES:
        lists = rows[fam].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        keys, docs = lists.flatten().to_numpy(), np.repeat(np.arange(len(rows), dtype=np.uint16), sizes)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        out |= {f"{fam}_n": sizes.astype(np.int32), f"{fam}_keys": np.diff(keys[first], prepend=0).astype(np.int64),
                f"{fam}_held": np.diff(np.append(first, len(keys))).astype(np.uint16), f"{fam}_docs": docs[order]}
        if fam == "terms":
            out["tf"] = rows["tf"].combine_chunks().flatten().to_numpy()[order].astype(np.uint32)
    return out


_PARTS = {"copies": np.int64, "t_sq": np.int64, "tf": np.uint32, **{f"{fam}_{part}": kind for fam in FAMILIES for part, kind in
                                              (("n", np.int32), ("keys", np.int64), ("held", np.uint16), ("docs", np.uint16))}}


def pack(profiles: DataFrame) -> DataFrame:
    """(block, ids, one binary column a part): blocks of the texts of each partition, packed where they lie."""
    id_type = profiles.schema["text_id"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, entries = [], 0, 0

        def row():
            b = _packed(pa.Table.from_batches(held))
            cols = {"block": held[0]["block"].slice(0, 1), "ids": pa.array([b["ids"].to_pylist()], pa.list_(b["ids"].type))}
            return pa.RecordBatch.from_pydict(cols | {c: pa.array([_bytes(b[c])], pa.binary()) for c in _PARTS})

        for batch in batches:
            sizes = sum(batch[c].value_lengths().to_numpy() for c in FAMILIES)
            at = 0
            for i, size in enumerate(sizes):
                if texts and (texts == BLOCK or entries + size > ENTRIES):
                    held.append(batch.slice(at, i - at))
                    yield row()
                    held, texts, entries, at = [], 0, 0, i
                texts, entries = texts + 1, entries + size
            held.append(batch.slice(at))
        if texts:
            yield row()

    return hashed(profiles).mapInArrow(blocks, StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)),
                                                           *(StructField(c, BinaryType()) for c in _PARTS)]))


def packed(profiles: DataFrame) -> DataFrame:
    """The table of blocks of ``profiles``, which may be that table."""
    small_batches(profiles.sparkSession)
    return profiles if "toks_keys" in profiles.columns else materialize(pack(profiles), "blocks", compression="uncompressed", **{"parquet.block.size": 1 << 23})


def sizes(blocks: DataFrame) -> DataFrame:
    """(text_id, t_sq, n_toks, n_grams) of the packed texts."""
    id_type = blocks.schema["ids"].dataType.elementType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c: pa.array(_values(batch[c][i].as_py(), _PARTS[c]))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, of("t_sq"), of("toks_n"), of("grams_n")],
                                                 names=["text_id", "t_sq", "n_toks", "n_grams"])

    return blocks.select("ids", "t_sq", "toks_n", "grams_n").mapInArrow(rows, StructType([
        StructField("text_id", id_type), StructField("t_sq", LongType()), StructField("n_toks", IntegerType()), StructField("n_grams", IntegerType())]))


class _Block:
    """A packed block as arrays."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.n, self.sorted = len(self.ids), {}
        self.part = {c: _values(row[c], kind) for c, kind in _PARTS.items()}
        for fam in FAMILIES:
            self.part[f"{fam}_keys"] = np.cumsum(self.part[f"{fam}_keys"])
            self.part[f"{fam}_held"] = self.part[f"{fam}_held"].astype(np.int64)
            self.part[f"{fam}_at"] = np.cumsum(self.part[f"{fam}_held"]) - self.part[f"{fam}_held"]

    def texts(self, fam: str) -> tuple:
        """(where each text's entries begin, how many, number of the key, times), by text and key; sorted once a block."""
        if fam not in self.sorted:
            docs = self.part[f"{fam}_docs"]
            order = np.argsort(docs, kind="stable")
            count = np.bincount(docs, minlength=self.n)
            key = np.searchsorted(self.part[f"{fam}_at"], order, "right") - 1
            self.sorted[fam] = np.cumsum(count) - count, count, key.astype(np.int32), self.part["tf"][order] if fam == "terms" else None
        return self.sorted[fam]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, then the same of the next."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


class _Meeting:
    """Two blocks: their shared keys, for all pairs of a tile (texts lo to hi of x, all of y) or for listed ones."""

    def __init__(self, x: _Block, y: _Block):
        self.x, self.y, self.common = x, y, {}

    def keys(self, fam: str) -> tuple:
        """Places of the common keys in either block; of x's entries with one their place, number of the key and text."""
        if fam not in self.common:
            mine, theirs = self.x.part[f"{fam}_keys"], self.y.part[f"{fam}_keys"]
            at = np.searchsorted(theirs, mine)
            hit = np.flatnonzero(at < len(theirs))
            hit = hit[theirs[at[hit]] == mine[hit]]
            held = self.x.part[f"{fam}_held"][hit]
            entries = _ranges(self.x.part[f"{fam}_at"][hit], held)
            self.common[fam] = hit, at[hit], entries, np.repeat(np.arange(len(hit)), held), self.x.part[f"{fam}_docs"][entries]
        return self.common[fam]

    def all(self, fam: str, lo: int, hi: int, wx=None, wy=None) -> np.ndarray:
        """For every pair of the tile the sum over its shared keys of wx * wy (entries' weights, 1 if none)."""
        y, n = self.y, hi - lo
        _, ky, ex, key, docs = self.keys(fam)
        mine = (docs >= lo) & (docs < hi)
        ex, key, docs = ex[mine], key[mine], docs[mine].astype(np.int64) - lo
        cx, cy = np.bincount(key, minlength=len(ky)), y.part[f"{fam}_held"][ky]
        out = np.zeros(n * y.n)
        often = cx * cy * _DENSE > n * y.n
        if often.any():
            kind = np.float32 if wx is None and wy is None else np.float64   # counts are small, products of counts may not be
            rank, many = np.cumsum(often) - 1, often[key]
            rows, ed, dd, kd = rank[key[many]], ex[many], docs[many], ky[often]
            step = max(1, CELLS // max(n, y.n))
            for k in range(0, len(kd), step):
                s = slice(*np.searchsorted(rows, (k, k + step)))
                ask = kd[k:k + step]
                held = y.part[f"{fam}_held"][ask]
                ey = _ranges(y.part[f"{fam}_at"][ask], held)
                mx = self._matrix(rows[s] - k, dd[s], n, len(ask), None if wx is None else wx[ed[s]], kind)
                my = self._matrix(np.repeat(np.arange(len(ask)), held), y.part[f"{fam}_docs"][ey], y.n, len(ask), None if wy is None else wy[ey], kind)
                out += (mx.T @ my).reshape(-1)
            ex, key, docs = ex[~many], key[~many], docs[~many]
        times = cy[key]                                                    # entries of x, each against all of its key in y
        ends = np.cumsum(times)
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, "right")))
            s = slice(at, to)
            ey = _ranges(y.part[f"{fam}_at"][ky[key[s]]], times[s])
            cell = np.repeat(docs[s] * y.n, times[s])
            cell += y.part[f"{fam}_docs"][ey]
            w = None if wx is None and wy is None else (1.0 if wx is None else np.repeat(wx[ex[s]], times[s])) * (1.0 if wy is None else wy[ey])
            out += np.bincount(cell, w, len(out))
            at = to
        return out

    @staticmethod
    def _matrix(row: np.ndarray, docs: np.ndarray, n: int, keys: int, w, kind) -> np.ndarray:
        # a text may hold two keys of one hash: added, not set
        return np.bincount(row * n + docs, w, keys * n).astype(kind).reshape(keys, n)

    def listed(self, fam: str, i: np.ndarray, j: np.ndarray) -> list:
        """Of pairs (i, j): the number of shared keys, or for terms dot, sx and sy."""
        kx, ky = self.keys(fam)[:2]
        there = np.full(len(self.x.part[f"{fam}_keys"]), -1)
        there[kx] = ky
        out = [np.zeros(len(i)) for _ in range(3 if fam == "terms" else 1)]
        (sx, nx, keyx, tx), (sy, ny, keyy, ty) = self.x.texts(fam), self.y.texts(fam)
        total = np.cumsum(nx[i] + ny[j])
        n, at = len(self.y.part[f"{fam}_keys"]), 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _STEP, "right")))
            p, q = i[at:to], j[at:to]
            ex, ey = _ranges(sx[p], nx[p]), _ranges(sy[q], ny[q])
            px, py = np.repeat(np.arange(to - at), nx[p]), np.repeat(np.arange(to - at), ny[q])
            known = there[keyx[ex]] >= 0
            ex, px = ex[known], px[known]
            code, other = px * n + there[keyx[ex]], py * n + keyy[ey]
            order = np.argsort(code, kind="stable")
            code, ex, px = code[order], ex[order], px[order]
            lo, hi = np.searchsorted(other, code, "left"), np.searchsorted(other, code, "right")
            mine, theirs, px = np.repeat(ex, hi - lo), ey[_ranges(lo, hi - lo)], np.repeat(px, hi - lo)
            if fam == "terms":
                u, v = tx[mine].astype(float), ty[theirs].astype(float)
                sums = (u * v, u * u, v * v)
            else:
                sums = (None,)
            for o, w in zip(out, sums):
                o[at:to] = np.bincount(px, w, to - at)
            at = to
        return out

    def of(self, fam: str, lo: int, hi: int, i: np.ndarray, j: np.ndarray) -> list:
        """``listed`` for few pairs, else all pairs of the tile and of them the listed."""
        if len(i) * _PAIRWISE <= (hi - lo) * self.y.n:
            return self.listed(fam, i, j)
        at = (i - lo) * self.y.n + j
        if fam != "terms":
            return [self.all(fam, lo, hi)[at]]
        tx, ty = self.x.part["tf"].astype(float), self.y.part["tf"].astype(float)
        return [self.all(fam, lo, hi, tx, ty)[at], self.all(fam, lo, hi, tx * tx, None)[at], self.all(fam, lo, hi, None, ty * ty)[at]]


def _ratio(shared, nx, ny):
    return shared / np.maximum(nx + ny - shared, 1)   # 0 / 1 for two empty sets


def _found(x: _Block, y: _Block, measure: str, floor: float, weights: dict, lo: int = 0, hi: int | None = None, met: _Meeting | None = None) -> dict | None:
    """Columns of the pairs of two blocks (of one, each pair once) that reach the floor, for scores before rounding; of x the texts lo to hi."""
    m, hi = met or _Meeting(x, y), x.n if hi is None else hi
    size = lambda b, fam: b.part[f"{fam}_n"].astype(np.int64)
    ti = gi = None
    grid = lambda fam: (size(x, fam)[lo:hi, None], size(y, fam)[None, :])
    every = lambda fam, *w: m.all(fam, lo, hi, *w).reshape(hi - lo, y.n)
    if measure == "cosine":
        dot = every("terms", x.part["tf"].astype(float), y.part["tf"].astype(float))
        long = np.sqrt(x.part["t_sq"][lo:hi].astype(float))[:, None] * np.sqrt(y.part["t_sq"].astype(float))[None, :]
        near = (dot > 0) & (dot >= (floor - _EPS) * long)   # a term that is not shared weighs more than 1, so this is an upper bound
        del dot, long
    elif measure in ("jaccard", "ngram"):
        fam = "toks" if measure == "jaccard" else "grams"
        shared = every(fam)
        near = (shared > 0) & (_ratio(shared, *grid(fam)) >= floor)
        ti, gi = (shared, None) if fam == "toks" else (None, shared)
    else:
        ti, gi = every("toks"), every("grams")
        part = weights["jaccard"] * _ratio(ti, *grid("toks")) + weights["ngram"] * _ratio(gi, *grid("grams"))
        near = 100 * (weights["cosine"] + part) >= floor - 0.005 - _EPS
        if floor <= 0:
            near &= (ti > 0) | (gi > 0) | (every("terms") > 0)
    if x is y:
        near &= np.tri(hi - lo, y.n, lo - 1, dtype=bool)
    i, j = np.nonzero(near)
    if not len(i):
        return None
    i += lo
    pick = lambda of, fam: of[i - lo, j] if of is not None else m.of(fam, lo, hi, i, j)[0]
    ti, gi = pick(ti, "toks"), pick(gi, "grams")
    dot, sx, sy = m.of("terms", lo, hi, i, j)
    tx, ty = x.part["t_sq"][i], y.part["t_sq"][j]
    length = np.sqrt((sx + IDF_UNSHARED_SQ * (tx - sx)) * (sy + IDF_UNSHARED_SQ * (ty - sy)))
    out = {"cosine": np.where((tx == 0) | (ty == 0), 0.0, dot / np.where(length > 0, length, 1.0)),
           "jaccard": _ratio(ti, size(x, "toks")[i], size(y, "toks")[j]), "ngram": _ratio(gi, size(x, "grams")[i], size(y, "grams")[j])}
    keep = out[measure] >= floor if measure != "score" else 100 * sum(weights[c] * v for c, v in out.items()) >= floor - 0.005 - _EPS
    out |= {"i": i, "j": j, "common_count": gi.astype(np.int32), "total_ngrams_doc1": x.part["grams_n"][i], "total_ngrams_doc2": y.part["grams_n"][j],
            "copies": x.part["copies"][i] * y.part["copies"][j]}
    return {c: v[keep] for c, v in out.items()}


def _tiles(x: _Block, y: _Block, measure: str, floor: float, weights: dict) -> Iterator[dict]:
    """``_found`` of the texts of x, so many at once that they make at most ``CELLS`` pairs with y; at most 65,536 pairs each."""
    met, step = _Meeting(x, y), max(1, CELLS // max(y.n, 1))
    for lo in range(0, x.n, step):
        got = _found(x, y, measure, floor, weights, lo, min(lo + step, x.n), met)
        for at in range(0, len(got["i"]) if got else 0, 1 << 16):
            yield {k: v[at:at + (1 << 16)] for k, v in got.items()}


def block_pairs(blocks: DataFrame, measure: str, floor: float, weights: dict | None = None) -> DataFrame:
    """(a, b, cosine, jaccard, ngram, common_count, total_ngrams_doc1/2, copies) of all pairs a < b of the packed texts
    with ``measure`` (cosine, jaccard, ngram) at or above ``floor``, or with measure ``score`` of all whose weighted score
    can round to ``floor`` (in percent). ``copies`` is the product of both texts' numbers of copies."""
    id_type = blocks.schema["ids"].dataType.elementType
    own = blocks.columns
    names = ["a", "b", "cosine", "jaccard", "ngram", *COUNTED]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (None, None)
        for batch in batches:
            for r in range(batch.num_rows):
                first, other = batch["block"][r].as_py(), batch["y_block"][r].as_py()
                read = lambda p: _Block({c: batch[p + c][r].values if c == "ids" else batch[p + c][r].as_py() for c in own if c != "block"})  # noqa: B023, E731
                if kept[0] != first:
                    kept = first, read("")
                x = kept[1]
                y = x if other == first else read("y_")
                for part in _tiles(x, y, measure, floor, weights):
                    a, b = x.ids.take(pa.array(part.pop("i"))), y.ids.take(pa.array(part.pop("j")))
                    na, nb = part.pop("total_ngrams_doc1"), part.pop("total_ngrams_doc2")
                    less, more = pc.less(a, b), pc.greater(a, b)
                    turned = more.to_numpy(zero_copy_only=False)
                    out = pa.RecordBatch.from_pydict({
                        "a": pc.if_else(less, a, b), "b": pc.if_else(less, b, a), **{k: pa.array(v) for k, v in part.items()},
                        "total_ngrams_doc1": pa.array(np.where(turned, nb, na)), "total_ngrams_doc2": pa.array(np.where(turned, na, nb))})
                    yield out.filter(pc.or_(less, more)).select(names)

    small_batches(blocks.sparkSession)
    other = blocks.select(*(F.col(c).alias(f"y_{c}") for c in own))
    met = blocks.hint("shuffle_replicate_nl").join(other, F.col("block") <= F.col("y_block"))
    return met.mapInArrow(pairs, StructType([
        StructField("a", id_type), StructField("b", id_type), *(StructField(c, DoubleType()) for c in ("cosine", "jaccard", "ngram")),
        *(StructField(c, IntegerType()) for c in ("common_count", "total_ngrams_doc1", "total_ngrams_doc2")), StructField("copies", LongType())]))
