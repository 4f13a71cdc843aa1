"""Vector bin packing of token sequences.

A piece asks for three things at once: tokens, one segment, and loss-bearing
tokens. A sequence offers so much of each. The dot-product heuristic fills one
sequence at a time: of the waiting pieces that fit it takes the one whose demand,
each part as a share of the capacity, has the largest dot product with what the
sequence has left. When none fits, the best one is cut to what is left.

Each task tokenizes and packs the documents of its own partition; nothing is
shuffled and no piece waits longer than until the end of the partition. Open
pieces are bounded by ``waiting``. The tokenizer's vocabulary file is a parameter.
"""

from __future__ import annotations

import array
import re
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsim.llm.words import small_batches, text_of

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
MAX_LOSS = 2048
END_ID = 1
WAITING = 512            # pieces a task holds while it packs
CACHED_WORDS = 300_000   # words whose ids a worker remembers, and as many parts of words

_LITTLE = sys.byteorder == "little" and array.array("I").itemsize == 4

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Words without white space and their ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokenizer drops white space and never crosses it, so a
    text's ids are those of its words in turn. Words of Latin letters with
    punctuation behind them go to the merge table directly; all others through
    the whole tokenizer.
    """

    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@[-`{-~]*)")
    ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        a = array.array("I", ids)
        return a.tobytes() if _LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)

    def _part(self, part: str) -> bytes:
        """Ids of a run of lower-case letters or of punctuation."""
        got = self.parts.get(part)
        if got is None:
            shown = part if part.isascii() else "".join([self.alphabet[b] for b in part.encode()])
            got = self._pack([t.id for t in self.model.tokenize(shown)])
            if len(part) <= 64:
                if len(self.parts) >= CACHED_WORDS:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def __missing__(self, word: str) -> bytes:
        m = self.SIMPLE.fullmatch(word) if "<|" not in word else None
        if m:
            letters, marks = m.groups()
            out = (self._part(letters.lower()) if letters else b"") + (self._part(marks) if marks else b"")
        else:
            out = self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out

    def of(self, text: str) -> bytes:
        if self.ODD_SPACE.search(text):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.split()))


class Packer:
    """Fills one sequence after the other from waiting pieces."""

    def __init__(self, limits: tuple[int, int, int], waiting: int, first_id: int):
        import numpy as np

        self.limits, self.waiting, self.next_id = np.array(limits, dtype=np.float64), waiting, first_id
        self.demand = np.zeros((2 * waiting + 2, 3))
        self.pieces: list[tuple | None] = []  # doc_id, ids, prompt tokens, start, end

    def _ask(self, piece: tuple) -> tuple[int, int, int]:
        _, _, prompt, start, end = piece
        return end - start, 1, end - max(start, min(prompt, end))

    def add(self, piece: tuple) -> Iterator[tuple]:
        tokens, _, loss = (int(x) for x in self.limits)
        while piece[4] - piece[3] >= tokens and self._ask((*piece[:4], piece[3] + tokens))[2] <= loss:
            doc, ids, prompt, start, end = piece
            yield from self._emit([(doc, ids, prompt, start, start + tokens)])
            piece = (doc, ids, prompt, start + tokens, end)
        if piece[4] > piece[3]:
            self._put(piece)
        while len(self.pieces) > self.waiting:
            yield from self._fill()

    def _put(self, piece: tuple) -> None:
        self.demand[len(self.pieces)] = self._ask(piece)
        self.pieces.append(piece)

    def _take(self, i: int) -> tuple:
        piece, last = self.pieces[i], self.pieces.pop()
        if i < len(self.pieces):
            self.pieces[i] = last
            self.demand[i] = self.demand[len(self.pieces)]
        return piece

    def _fill(self) -> Iterator[tuple]:
        left, chosen = self.limits.copy(), []
        while self.pieces and left[0] > 0 and left[1] > 0:
            asked = self.demand[:len(self.pieces)]
            value = asked @ (left / self.limits ** 2)
            fits = (asked <= left).all(axis=1)
            if fits.any():
                piece = self._take(int((value * fits).argmax()))
            else:
                piece = self._take(int(value.argmax()))
                doc, ids, prompt, start, end = piece
                most = int(min(left[0], left[2] + max(0, prompt - start)))
                if most <= 0:
                    self._put(piece)
                    break
                self._put((doc, ids, prompt, start + most, end))
                piece = (doc, ids, prompt, start, start + most)
            chosen.append(piece)
            left -= self._ask(piece)
        yield from self._emit(chosen)

    def _emit(self, chosen: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in chosen:
            doc, ids, _, start, end = piece
            yield doc, start, end - start, ids[4 * start:4 * end], len(ids) // 4, self._ask(piece)[2], self.next_id, offset
            offset += end - start
        self.next_id += 1

    def finish(self) -> Iterator[tuple]:
        """What is left goes into sequences of the usual length, then into ever
        shorter ones whose lengths are powers of two, which need no padding."""
        while self.pieces and self.demand[:len(self.pieces), 0].sum() >= self.limits[0]:
            yield from self._fill()
        whole = self.limits.copy()
        while self.pieces:
            rest = int(self.demand[:len(self.pieces), 0].sum())
            self.limits[0] = min(whole[0], 1 << (rest.bit_length() - 1))
            yield from self._fill()
        self.limits = whole


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
         max_loss: int = MAX_LOSS, end_id: int | None = END_ID, waiting: int = WAITING, prompt: str | None = None) -> DataFrame:
    """Packs docs (doc_id, text) into sequences; one row per piece: doc_id, start,
    length, ids (unsigned 32-bit little endian), doc_tokens, loss_tokens,
    sequence_id, offset.

    ``prompt`` names a column of text that stands before the document's own and
    bears no loss. ``max_tokens`` must be a power of two. Sequence ids are
    unique, not gapless: the partition's number times 2^40 and a count.

    Edge cases: a null or empty text is the end id alone (no piece where
    ``end_id`` is None); rows with the same doc_id, null ids too, are packed one
    by one; a document longer than a sequence is cut; an empty table gives no
    rows; other columns are ignored.
    """
    if max_tokens & (max_tokens - 1) or min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("max_tokens must be a power of two and all limits positive")
    path = path or tokenizer_path()
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        words = _WORDS.get(path) or _WORDS.setdefault(path, WordIds(path))
        packer = Packer((max_tokens, max_segments, max_loss), waiting, TaskContext.get().partitionId() << 40)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        rows, held = [], 0

        def table(rows):
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def pieces():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc, before, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                        asked = words.of(before) if before else b""
                        ids = asked + words.of(text) + end
                        yield from packer.add((doc, ids, len(asked) // 4, 0, len(ids) // 4))
            yield from packer.finish()
        for row in pieces():
            rows.append(row)
            held += row[2]
            if held > 1_000_000:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    asked = docs.select("doc_id", text_of(prompt).alias("prompt") if prompt else F.lit("").alias("prompt"), text_of().alias("text"))
    return asked.mapInArrow(run, SCHEMA)


_WORDS: dict[str, WordIds] = {}
