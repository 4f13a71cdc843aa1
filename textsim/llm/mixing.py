"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put into a pseudo-random but fixed order (md5 of
its id). Passing over the source again and again in that order, a copy of a
document finishes at the virtual time

    (words of the source up to and including this copy) / target of the source

so that all sources run out of their targets at the same virtual time 1. The
mix is the globally earliest part of this order, cut at the total budget.

Scale: the running word counts come from two levels. A source is cut into
hash buckets of about ``ROWS_PER_BUCKET`` rows (the number of buckets follows
the row count), bucket sums give each bucket's offset, and a window runs inside
one bucket only, so a source that holds a third of all rows is spread like the
rest. The global cut works the same way on bins of the finish time: bin sums
find the bin where the budget ends, and only that bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsim.llm.words import apart, text_of, word_count
from textsim.session import materialize

WEIGHTS = (5, 2, 1)      # dealt to the sources in code-point order, repeating
BUDGET_SHARE = 1.5       # the mix, as a share of all words
MAX_PASSES = 2           # a source gives at most this many times its words
ROWS_PER_BUCKET = 2_048


def source_targets(sized: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, source_size, n_docs, weight, target.

    The budget is shared by weight; a target stops at ``max_passes`` times the
    source's words and the excess is shared again by weight until none is above
    (water filling: the sources are taken by rising cap / weight, and the first
    one whose share fits sets the level of all that follow). The windows run
    over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (per
              .withColumn("rank", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
              .withColumn("cap", F.col("source_size") * max_passes)
              .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
              .withColumn("all_weight", F.sum("weight").over(everything)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = (ranked
              .withColumn("place", F.row_number().over(rising))
              .withColumn("cap_before", F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
              .withColumn("weight_left", F.col("all_weight") + F.col("weight")
                          - F.sum("weight").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
              .withColumn("fits", F.col("cap") >= F.col("level") * F.col("weight")))
    first = F.struct(F.col("place"), F.col("level"))
    return (filled
            .withColumn("fit", F.min(F.when(F.col("fits"), first)).over(everything))
            .withColumn("target", F.when(F.col("fit").isNull() | (F.col("place") < F.col("fit.place")), F.col("cap").cast("double"))
                        .otherwise(F.col("fit.level") * F.col("weight")))
            .select("source", "source_size", "n_docs", "weight", "target"))


def fair_queue(docs: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE,
               max_passes: int = MAX_PASSES, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size,
    source_size, target, finish (array: virtual finish time of each pass),
    passes (copies that the mix takes) and taken (= passes * size).

    Edge cases: a null source is a source of its own, last in order; a null,
    empty or blank text has size 0 and is taken 0 times; rows with the same
    doc_id are taken one by one; copies that finish at the same time are taken
    together or not at all; an empty table gives an empty result; columns other
    than the three are ignored.
    """
    sized = materialize(docs.select(
        "doc_id", "source", word_count(text_of()).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffle_key")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, budget_share, max_passes), "mix-targets")
    total, largest, rows = targets.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("n_docs"), F.lit(0)),
        F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    buckets = max(1, -(-largest // rows_per_bucket))

    bucketed = sized.withColumn(
        "bucket", F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / 2.0 ** 32 * buckets).cast("int"))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = sums.select(
        "source", "bucket", (F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))
                             - F.col("bucket_size")).alias("before"))
    before = before.join(targets.drop("n_docs", "weight"), before["source"].eqNullSafe(targets["source"])).select(
        before["source"].alias("b_source"), F.col("bucket").alias("b_bucket"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = bucketed.withColumn("inside", F.sum("size").over(inside))
    queued = placed.join(before, placed["source"].eqNullSafe(before["b_source"]) & (placed["bucket"] == before["b_bucket"]))
    reached = [(F.col("before") + F.col("inside") + F.col("source_size") * p) / F.col("target") for p in range(max_passes)]
    queued = materialize(queued.select("doc_id", "source", "size", "source_size", "target",
                                       F.when(F.col("size") > 0, F.array(*reached)).alias("finish")), "mix-queue")

    cut = _cut(queued, total * budget_share, max(1, -(-rows * max_passes // rows_per_bucket)))
    passes = F.when(F.col("finish").isNull(), 0).otherwise(F.size(F.filter("finish", lambda t: t <= F.lit(cut))))
    return queued.withColumn("passes", passes).withColumn("taken", (F.col("passes") * F.col("size")).cast("long"))


def _cut(queued: DataFrame, budget: float, bins: int) -> float:
    """The latest finish time whose copies, and all before them, fit the budget."""
    copies = queued.select("size", F.explode("finish").alias("finish")).withColumn("bin", F.floor(F.col("finish") * bins))
    by_bin = copies.groupBy("bin").agg(F.sum("size").alias("bin_size"), F.max("finish").alias("last"))
    running = F.sum("bin_size").over(Window.orderBy("bin"))
    whole = by_bin.withColumn("upto", running)
    row = whole.agg(F.max(F.when(F.col("upto") <= budget, F.col("last"))).alias("last"),
                    F.min(F.when(F.col("upto") > budget, F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before")))
                          ).alias("split")).first()
    if row["split"] is None:
        return row["last"] if row["last"] is not None else 0.0
    last = row["last"] if row["last"] is not None else -1.0
    inside = (copies.where(F.col("bin") == row["split"]["bin"]).groupBy("finish").agg(F.sum("size").alias("size"))
              .withColumn("upto", F.sum("size").over(Window.orderBy("finish")) + F.lit(row["split"]["before"]))
              .where(F.col("upto") <= budget).agg(F.max("finish")).first()[0])
    return inside if inside is not None else last


def mixed(docs: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it. Rows
    that cannot be told apart by doc_id, source and size share their passes by number.
    Other columns pass through, whatever their names."""
    return apart(docs, ("doc_id", "text", "source"), lambda d: _mixed(d, weights, budget_share, max_passes))


def _mixed(docs: DataFrame, weights, budget_share: float, max_passes: int) -> DataFrame:
    key = ["doc_id", "source", "size"]
    taken = fair_queue(docs, weights, budget_share, max_passes).select(*key, "passes").withColumn(
        "_row", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("passes").desc()))).where("passes > 0")
    names = [f"_k{i}" for i in range(3)]
    taken = taken.select(*(F.col(c).alias(n) for c, n in zip(key, names)), F.col("_row").alias("_k3"), "passes")
    rows = docs.withColumn("_size", word_count(text_of())).withColumn(
        "_row", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))))
    same = rows["doc_id"].eqNullSafe(taken["_k0"]) & rows["source"].eqNullSafe(taken["_k1"]) & (
        rows["_size"] == taken["_k2"]) & (rows["_row"] == taken["_k3"])
    joined = rows.join(taken, same).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns))
