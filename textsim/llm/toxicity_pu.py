"""Toxicity: non-negative positive-unlabelled learning on character n-grams of words.

Only confirmed toxic examples and unlabelled text are used. The features of a
document are rates: how often words with a certain character n-gram occur,
per word. An n-gram is used when its rate in the positives is clearly above that
in unlabelled text; every such n-gram is used. Several linear classifiers (numpy) minimise the
class-prior-corrected risk

    prior * E_pos[loss(z)] + max(0, E_unl[loss(-z)] - prior * E_pos[loss(-z)])

each on its own half of the features; the score is the mean of their outputs.

A run without white space is read to its end. One of more than ``STRETCH``
characters (scripts without spaces, words glued by signs) counts as a word for
each stretch, so that its rates compare with those of spaced text.

Scale: the model is fitted on a bounded sample of rows (``MAX_POSITIVE``,
``MAX_UNLABELLED``, those with the smallest hashes), whose distinct rows of hits
the driver holds sparsely; every document is scored where it lies, without a
shuffle, and what a task holds is one batch and a bounded memory of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsim.llm.words import small_batches, text_of

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 9_000
BIN_BITS = 18
BINS = 1 << BIN_BITS
GRAMS = (3, 4, 5, 6)
STRETCH = 42             # n-grams that start in one stretch of a word count once
MARKS = ".,;:!?#*$%&|\"'()[]<>"
MIN_LIFT, MIN_Z, MIN_COUNT = 3.0, 6.0, 4
MEMBERS, STEPS, RATE, DECAY = 5, 300, 0.05, 1e-5
TOXIC_AT = 0.7
WINDOW = 6_000 * STRETCH  # characters whose n-grams are hashed at once
RATE_SCALE, RATE_PAD = 40.0, 4.0


def marked(words: Iterable[str]) -> str:
    """The words, bare of marks, their ends shown, with one space after each."""
    return "".join([f"^{w.strip(MARKS)}$ " for w in words])


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Stretches:
    """The code points of marked words; where words and their stretches lie."""

    def __init__(self, line: str):
        import numpy as np

        self.codes = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        self.ends = np.flatnonzero(self.codes == 32)
        self.starts = np.append(0, self.ends + 1)[:-1]
        self.counts = -(-(self.ends - self.starts) // STRETCH)
        self.firsts = np.append(0, np.cumsum(self.counts))

    def bins(self, least: int, most: int):
        """(n, bins) for each n of ``GRAMS``: the bins of the n-grams that start from least to most."""
        import numpy as np

        codes = self.codes[least:most + GRAMS[-1] - 1]
        h = codes.copy()
        for n in range(2, GRAMS[-1] + 1):
            if len(codes) < n:
                return
            h = h[:len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1:]
            if n in GRAMS:
                of = h[:most - least]
                yield n, (((of ^ (of >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BIN_BITS))

    def inside(self, at, n):
        """Which of the n-grams at these places lie in one word, and the words."""
        import numpy as np

        word = np.searchsorted(self.ends, at)
        return at + n <= self.ends[word], word

    def stretch(self, at, word):
        return self.firsts[word] + (at - self.starts[word]) // STRETCH


def chunks(words: list[str], times: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    """Words and their numbers, in groups of at most ``WINDOW`` characters or one word."""
    first = size = 0
    for i, w in enumerate(words):
        if i > first and size + len(w) + 3 > WINDOW:
            yield words[first:i], times[first:i]
            first, size = i, 0
        size += len(w) + 3
    if words:
        yield words[first:], times[first:]


def count_grams(words: list[str], times: list[int], into) -> None:
    """Adds to ``into``, by bin, how often words hold an n-gram, once a stretch; the last cell counts the stretches."""
    import numpy as np

    for some, n_times in chunks(words, times):
        line, weight = Stretches(marked(some)), np.array(n_times, dtype=np.int64)
        into[BINS] += int(line.counts @ weight)
        for least in range(0, len(line.codes), WINDOW):  # cuts only a word that is alone, between stretches
            keys = []
            for n, bins in line.bins(least, min(least + WINDOW, len(line.codes))):
                at = np.arange(least, least + len(bins))
                ok, word = line.inside(at, n)
                keys.append(line.stretch(at[ok], word[ok]) * BINS + bins[ok])
            if keys:
                seen = np.unique(np.concatenate(keys))
                word = np.searchsorted(line.firsts, seen // BINS, side="right") - 1
                into[:BINS] += np.bincount(seen % BINS, weight[word], BINS).astype(np.int64)


class Rates:
    """Features of documents: hits of each selected bin per word."""

    def __init__(self, selected: Iterable[int]):
        import numpy as np

        selected = np.array(list(selected), dtype=np.int64)
        self.place = np.full(BINS, -1, dtype=np.int32)
        self.place[selected] = np.arange(len(selected))
        self.width = max(len(selected), 1)

    def of(self, texts: list[str]):
        """(document, place, rate) of all features that are not 0, as arrays in order."""
        import numpy as np

        done, first, size = [], 0, 0
        for i, t in enumerate(texts):
            if i > first and size + len(t) > WINDOW:
                done.append((first, self._of(texts[first:i])))
                first, size = i, 0
            size += len(t)
        if first < len(texts):
            done.append((first, self._of(texts[first:])))
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return (np.concatenate([x[0] + at for at, x in done]), np.concatenate([x[1] for _, x in done]),
                np.concatenate([x[2] for _, x in done]))

    def _of(self, texts: list[str]):
        import numpy as np

        words = [words_of(t) for t in texts]
        text_of_word = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        line = Stretches("".join(map(marked, words)))
        keys = [np.zeros(0, np.int64)]
        for least in range(0, len(line.codes), WINDOW):
            for n, bins in line.bins(least, min(least + WINDOW, len(line.codes))):
                place = self.place[bins]
                hit = np.flatnonzero(place >= 0)
                ok, word = line.inside(least + hit, n)
                hit, word = hit[ok], word[ok]
                keys.append(line.stretch(least + hit, word) * self.width + place[hit])
        seen = np.unique(np.concatenate(keys))
        word = np.searchsorted(line.firsts, seen // self.width, side="right") - 1
        hits, count = np.unique(text_of_word[word] * self.width + seen % self.width, return_counts=True)
        # a word of signs alone counts as one word
        n = np.bincount(text_of_word, np.maximum(line.counts, 1), len(texts))
        text, place = hits // self.width, hits % self.width
        return text, place, np.minimum(count * (RATE_SCALE / (n[text] + RATE_PAD)), 4.0)


class Rows:
    """Sparse rows with their numbers of occurrences; the last column, all ones, is the offset."""

    def __init__(self, lengths, places, values, n, width: int):
        import numpy as np

        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.place, self.value, self.size, self.width = places, values, len(lengths), width
        self.share = n / n.sum()

    def __matmul__(self, w):
        import numpy as np

        return np.bincount(self.row, self.value * w[self.place], self.size) + w[-1]

    def back(self, v):
        """v @ the rows."""
        import numpy as np

        return np.append(np.bincount(self.place, self.value * v[self.row], self.width), v.sum())

    @classmethod
    def dense(cls, x) -> Rows:
        import numpy as np

        rows, n = np.unique(np.asarray(x, float), axis=0, return_counts=True)
        at, place = np.nonzero(rows)
        return cls(np.bincount(at, minlength=len(rows)), place, rows[at, place], n, rows.shape[1])


def train(x_pos, x_unl, prior: float, seed: int = 7):
    """Weights (members x (features + 1), the last the offset) by full-batch Adam on the
    non-negative risk with the logistic loss; both inputs are ``Rows`` or dense matrices."""
    import numpy as np

    rng, out = np.random.default_rng(seed), []
    p, u = (x if isinstance(x, Rows) else Rows.dense(x) for x in (x_pos, x_unl))
    of_p, of_u, width = p.share, u.share, p.width + 1
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    for _ in range(MEMBERS):
        used = np.append(rng.random(width - 1) < 0.5, True)
        if used.sum() < min(8, len(used)):
            used[:] = True
        w, m, v = np.zeros(width), 0.0, 0.0
        w[-1] = -1.0
        for step in range(1, STEPS + 1):
            zp, zu = p @ w, u @ w
            negative = of_u @ np.logaddexp(0, zu) - prior * (of_p @ np.logaddexp(0, zp))
            of_negative = u.back(of_u * sigmoid(zu)) - prior * p.back(of_p * sigmoid(zp))
            of_positive = -prior * p.back(of_p * sigmoid(-zp))
            g = of_positive + of_negative if negative >= 0 else -of_negative
            g = (g + DECAY * np.append(w[:-1], 0.0)) * used
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        out.append(w)
    return np.array(out)


def _sample(docs: DataFrame, positive: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample; ids are broadcast, at most MAX_POSITIVE + MAX_UNLABELLED."""
    def smallest(rows: DataFrame, n: int, flag: int) -> DataFrame:
        return rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(
            "doc_id", F.lit(flag).alias("toxic"))
    wanted = smallest(positive, MAX_POSITIVE, 1).unionByName(smallest(docs, MAX_UNLABELLED, 0))
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(wanted), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, positive: DataFrame, prior: float) -> tuple[list[int], list[list[float]]]:
    """Selected bins and the members' weights, from docs (doc_id, text; unlabelled)
    and positive (doc_id; confirmed toxic). ``prior``: share of toxic documents."""
    sample = _sample(docs, positive).repartition(16, F.xxhash64("text"))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        words = {0: Counter(), 1: Counter()}
        totals = {toxic: np.zeros(BINS + 1, dtype=np.int64) for toxic in words}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # a word counts once a text: one long text that repeats a mark says no more than one text
                own = {w.strip(MARKS) for w in words_of(text)}
                words[toxic].update(w for w in own if len(w) <= 64)
                long = sorted(w for w in own if len(w) > 64)
                count_grams(long, [1] * len(long), totals[toxic])
        for toxic, n in totals.items():
            count_grams(list(words[toxic]), list(words[toxic].values()), n)
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(at), pa.int32()), pa.array(at), pa.array(n[at])],
                                             names=["toxic", "bin", "n"])
    counted = sample.mapInArrow(count, "toxic int, bin long, n long").groupBy("bin").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("u"))
    whole = counted.where(F.col("bin") == BINS).first()
    n_p, n_u = (whole["p"], whole["u"]) if whole else (0, 0)
    if not n_p or not n_u:
        return [], [[-4.0]]
    rate = (F.col("u") + 1) / float(n_u)
    expected = rate * n_p
    chosen = (counted.where((F.col("bin") < BINS) & (F.col("p") >= MIN_COUNT))
              .withColumn("z", (F.col("p") - expected) / F.sqrt(expected))
              .where((F.col("z") >= MIN_Z) & (F.col("p") >= MIN_LIFT * expected))
              .select("bin"))
    selected = sorted(r["bin"] for r in chosen.collect())

    def features(batches):
        import numpy as np
        import pyarrow as pa

        rates = Rates(selected)
        for batch in batches:
            text, place, rate = rates.of(batch.column(0).to_pylist())
            ends = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=batch.num_rows))), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(rate, pa.float64()))], names=["toxic", "places", "rates"])

    rows = sample.mapInArrow(features, "toxic int, places array<int>, rates array<double>").groupBy("toxic", "places", "rates").count(
        ).orderBy("toxic", F.xxhash64("places", "rates"), "places", "rates").toArrow().combine_chunks()

    def of(toxic: int) -> Rows:
        import pyarrow.compute as pc

        mine = rows.filter(pc.equal(rows["toxic"], toxic))
        lengths = pc.list_value_length(mine["places"]).to_numpy()
        return Rows(lengths, pc.list_flatten(mine["places"]).to_numpy(), pc.list_flatten(mine["rates"]).to_numpy(),
                    mine["count"].to_numpy(), len(selected))
    return selected, train(of(1), of(0), prior).tolist()


def score(docs: DataFrame, model: tuple[list[int], list[list[float]]]) -> DataFrame:
    """Adds ``score`` (0 to 1) to docs, from the column ``text`` alone."""
    selected, weights = model
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name != "score"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rates, w = Rates(selected), np.array(weights)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            text, place, rate = rates.of(texts)
            z = [m[-1] + np.bincount(text, rate * m[place], len(texts)) for m in w] if texts else np.zeros((len(w), 0))
            done = np.mean(0.5 * (1 + np.tanh(np.array(z) / 2)), axis=0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in kinds), pa.array(done, pa.float64())],
                                             names=[*(n for n, _ in kinds), "score"])
    return docs.select(*(F.col(f"`{n}`") for n, _ in kinds)).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds) + ", score double")


def toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None) -> DataFrame:
    """Adds ``score`` to docs (doc_id, text), which is learned from labels (doc_id,
    toxic) and texts of rows where ``may_learn`` (a condition on doc_id) holds.
    The class prior is the share of 1 among those labels.

    Edge cases: a null text is scored as empty; empty texts get the classifiers'
    offset, a low score; rows with a null label or doc_id are not learned from;
    repeated rows are scored alike; without a positive every score is
    low; an empty table stays empty; other columns pass through, ``score`` is replaced.
    """
    small_batches(docs.sparkSession)
    may_learn = F.lit(True) if may_learn is None else may_learn
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn)
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    model = fit(docs.where(may_learn), known.where("toxic = 1"), prior)
    return score(docs, model)
