"""Sharding by balanced label propagation: linked documents end in one shard, row counts at most one apart.

Documents that share a link key (here: the digest of the text) are linked.
Every linked document starts in a pseudo-random shard. In each round, Spark joins
tell every document how its neighbours are spread over the shards; it wants
to move to the shard that holds most of them and still has room. Quotas turn
the wishes for a shard into the share that fits, and a hash decides who goes, so
nothing is ranked or gathered. A group larger than a shard fills one shard per
round, and its rest gathers in the next.

Neighbourhoods are counted per (key, shard), never as pairs. Unlinked documents cut
no edge wherever they are; they fill what the linked ones leave, which makes
all counts exact. The driver sees only one number per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsim.session import materialize

SHARDS = 24
ROUNDS = 16
ROWS_PER_BUCKET = 2_048
FILL = 0.97       # of a shard's room is given away in a round, since hashes only meet a quota on average


def _share(*columns) -> Column:
    """A hash of columns as a number from 0 to below 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def numbered(rows: DataFrame, by: list[str], buckets: int, name: str) -> DataFrame:
    """Adds a gapless number from 0 within each value of ``by``: rows are cut by
    hash into buckets, bucket counts give offsets, and only a bucket is sorted.
    ``rows`` has a column ``spot`` (a hash of the row) and must be materialized."""
    cut = rows.withColumn("_bucket", F.floor(F.pmod("spot", F.lit(1 << 30)) / float(1 << 30) * buckets).cast("int"))
    counts = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*by, "_bucket").orderBy("spot", "doc_id", "size")
    return (cut.withColumn("_place", F.row_number().over(inside)).join(before, [*by, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_bucket", "_place", "_before"))


def propagate(linked: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Moves rows (link, spot, shard, ...) towards their neighbours' shards under quotas."""
    for turn in range(rounds):
        cells = materialize(linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n")), "shard-cells")
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = {t: capacity - load.get(t, 0) for t in range(shards)}
        free = [t for t, r in room.items() if r > 0]
        best = cells.where(F.col("shard").isin(free)).groupBy("link").agg(
            F.max(F.struct(F.col("n"), (-F.col("shard")).alias("to"))).alias("best"))
        wants = cells.join(best, "link").select(
            "link", "shard", "n", F.col("best.n").alias("best_n"), (-F.col("best.to")).alias("to")).where(
            (F.col("best_n") > F.col("n")) | ((F.col("best_n") == F.col("n")) & (F.col("to") < F.col("shard"))))
        wants = materialize(wants, "shard-wants")
        asked = {r["to"]: r["n"] for r in wants.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        quota = F.create_map(*[F.lit(x) for t, n in asked.items() for x in (t, min(1.0, FILL * room[t] / n))])[F.col("to")]
        small = F.create_map(*[F.lit(x) for t in asked for x in (t, max(1, room[t] // 16))])[F.col("to")]
        goes = F.when(F.col("n") <= small, _share("link", F.lit(turn))).otherwise(_share("spot", F.lit(turn)))
        moved = linked.join(wants.drop("best_n"), ["link", "shard"], "left")
        linked = materialize(moved.withColumn("shard", F.when(F.col("to").isNotNull() & ((quota >= 1.0) | (goes < quota)), F.col("to"))
                                              .otherwise(F.col("shard"))).drop("n", "to"), "shard-rows")
    return linked


def balanced_shards(docs: DataFrame, link: Column | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes + 8),
    text_crc32, link, shard, slot (gapless from 0 in its shard). The shards' row
    counts are at most one apart.

    ``link``: documents with the same value are linked; by default a digest of the
    text. A null link has no neighbours.

    Edge cases: a null text has size 8, crc 0 and no links; equal texts, the empty
    one too, are linked; rows with the same doc_id are placed one by one; with fewer
    rows than shards some shards stay empty; an empty table gives no rows; other
    columns are ignored.
    """
    link = F.md5("text") if link is None else link
    rows = materialize(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), link.alias("link"))
        .withColumn("spot", F.xxhash64("doc_id", "link", "size")), "shard-input")
    n = rows.count()
    share = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    shared = rows.where(F.col("link").isNotNull()).groupBy("link").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = materialize(shared.select("link", F.lit(True).alias("linked")), "shard-links")
    marked = materialize(rows.join(shared, "link", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "shard-marked")

    start = marked.where("linked").withColumn("shard", F.floor(_share("spot") * shards).cast("int"))
    placed = propagate(start, n // shards, shards, rounds) if n >= shards else start
    placed = materialize(numbered(materialize(placed, "shard-placed"), ["shard"], max(1, -(-n // (shards * 512))), "slot"), "shard-slots")
    limit = F.element_at(F.array(*map(F.lit, share)), F.col("shard") + 1)
    stays = placed.where(F.col("slot") < limit)
    columns = ["doc_id", "size", "text_crc32", "link", "spot"]
    fillers = marked.where(~F.col("linked")).select(*columns).unionByName(placed.where(F.col("slot") >= limit).select(*columns))
    fillers = numbered(materialize(fillers, "shard-fillers"), [], buckets, "number")

    kept = {r["shard"]: r["n"] for r in stays.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    shard, slot, upto = F.lit(None).cast("int"), F.lit(None).cast("long"), sum(s - kept.get(t, 0) for t, s in enumerate(share))
    for t in reversed(range(shards)):
        first = upto - (share[t] - kept.get(t, 0))
        inside = F.col("number") < upto
        shard = F.when(inside, F.lit(t)).otherwise(shard)
        slot = F.when(inside, F.col("number") - first + kept.get(t, 0)).otherwise(slot)
        upto = first
    # the last condition that holds is the outermost: numbers below the smallest bound
    filled = fillers.select("doc_id", "size", "text_crc32", "link", shard.alias("shard"), slot.cast("long").alias("slot"))
    return stays.select("doc_id", "size", "text_crc32", "link", "shard", F.col("slot").cast("long")).unionByName(filled)
