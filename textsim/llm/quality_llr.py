"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``BUCKETS`` buckets. Two multinomials are
counted over them, one on trusted documents and one on the whole raw corpus; a
document's score is the mean, over its n-grams, of log p(trusted) - log p(raw). A
document is kept when it passes the base rules and its score reaches ``KEEP_AT``.

Native expressions throughout: one pass counts (partial aggregation into a
fixed number of buckets), one pass scores. The model is two numbers a bucket, so
it goes to the plan as one constant of fixed size. Nothing else is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsim.llm.words import apart, let, text_of, word_array

BUCKETS = 1 << 14
TRUSTED = 20_000      # trusted documents that the target model is counted on, those with the smallest hashes
KEEP_AT = -0.10       # least mean log ratio of a kept document
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"


def _words(docs: DataFrame) -> DataFrame:
    """Adds ``_text`` and ``_h``, the hashes of the words in order."""
    return docs.withColumn("_text", text_of()).withColumn(
        "_h", F.transform(word_array(F.col("_text")), lambda w: F.xxhash64(w)))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pairs(h: Column, body) -> Column:
    """body(pair hash) for each pair of neighbouring words."""
    return F.when(F.size(h) > 1, F.transform(F.sequence(F.lit(1), F.size(h) - 1),
                                             lambda i: body(F.xxhash64(F.get(h, i - 1), F.get(h, i)))))


def repeated_words(h: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, the first
    occurrence included; ``h`` has the words' hashes. O(n log n) in a text."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(h) - window),
                         lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(hh: Column) -> Column:
        placed = F.array_sort(F.transform(hh, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, o: F.coalesce(F.get(s, o)["h"] == e["h"], F.lit(False))
            hit = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.array_sort(F.filter(hit, lambda p: p.isNotNull()))
        union = F.aggregate(let(placed, twice), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                            lambda a, p: F.struct((p + window).alias("end"),
                                                  (a["n"] + p + window - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hh)) == F.size(hh), F.lit(0)).otherwise(union)
    return F.when(F.size(h) > window, let(hashed, covered)).otherwise(F.lit(0))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.translate(s, SPACE, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def fit(docs: DataFrame, trusted: DataFrame, n_trusted: int = TRUSTED) -> list[float]:
    """The log ratio of each bucket. ``docs`` (doc_id, text) are the raw corpus, all of
    it; ``trusted`` (doc_id) names trusted documents, of which at most ``n_trusted``
    are counted as the target (a bounded set of ids, so it is broadcast)."""
    ids = trusted.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_trusted)
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("_trusted", F.lit(1))), "doc_id", "left")
    grams = _words(marked).select(
        "_trusted", F.explode(F.concat(F.transform("_h", _bucket), F.coalesce(_pairs(F.col("_h"), _bucket), F.array().cast("array<int>")))
                              ).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [math.log((t + 1) / n_target) - math.log((r + 1) / n_raw) for t, r in zip(target, raw)]


def log_ratio(h: Column, model: list[float]) -> Column:
    """Mean log ratio over the words and word pairs; null without words."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # one constant
    of = lambda x: F.get(table, _bucket(x))
    words = F.aggregate(h, F.lit(0.0), lambda a, x: a + of(x))
    pairs = F.when(F.size(h) > 1, F.aggregate(F.sequence(F.lit(1), F.size(h) - 1), F.lit(0.0),
                                              lambda a, i: a + of(F.xxhash64(F.get(h, i - 1), F.get(h, i))))).otherwise(F.lit(0.0))
    return F.when(F.size(h) > 0, (words + pairs) / (2 * F.size(h) - 1))


def quality(docs: DataFrame, trusted: DataFrame, n_trusted: int = TRUSTED, keep_at: float = KEEP_AT) -> DataFrame:
    """Adds to docs (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score (mean log ratio), kept.

    Edge cases: a null text counts as empty; a text without words fails the base
    rules and has a null score; a null doc_id is never trusted; repeated rows are
    judged alike; without trusted documents every ratio compares the raw corpus
    with the uniform distribution; an empty table stays empty; columns of the
    names above are replaced, others pass through, whatever their names.
    """
    return apart(docs, ("doc_id", "text"), lambda d: _quality(d, trusted, n_trusted, keep_at))


def _quality(docs: DataFrame, trusted: DataFrame, n_trusted: int, keep_at: float) -> DataFrame:
    model = fit(docs, trusted, n_trusted)
    text, h = F.col("_text"), F.col("_h")
    counted = _words(docs).withColumns({
        "n_words": F.size(h).cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.when(F.contains(text, F.lit("\n")), repeated_lines(text)).otherwise(F.lit(0)).cast("long"),
        "n_repeat_words": repeated_words(h).cast("long"),
        "score": log_ratio(h, model),
    }).drop("_text", "_h")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= keep_at, F.lit(False)))
