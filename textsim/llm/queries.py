"""The registered queries of the training-data operators, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsim.llm import (circulant_minhash, conversation_repair, label_shards, mixing, ngram_join, packing, phrase_mining, pii, quality_llr,
                         secret_forest, suffix_dedup, topk_search, toxicity_pu)
from textsim.session import ensure_checkpoint_dir
from textsim.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def deco(fn):
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run
    return deco


@query(sql=r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk, source_size * 2 AS cap FROM per
), weighed AS (
  SELECT *, [5, 2, 1][((rk - 1) % 3) + 1] AS weight, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget FROM ranked
), rising AS (
  SELECT *, row_number() OVER w AS place,
    CAST(sum(cap) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - cap AS cap_before,
    CAST(sum(weight) OVER () AS BIGINT) + weight - CAST(sum(weight) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS weight_left
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), rk)
), leveled AS (
  SELECT *, (budget - CAST(cap_before AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS level FROM rising
), fit AS (
  SELECT min(place) AS place, min_by(level, place) AS level FROM leveled WHERE CAST(cap AS DOUBLE) >= level * weight
), target AS (
  SELECT source, source_size, budget,
    CASE WHEN fit.place IS NULL OR leveled.place < fit.place THEN CAST(cap AS DOUBLE) ELSE fit.level * weight END AS target
  FROM leveled, fit
), queued AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.budget,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT size, budget, CAST(upto + source_size * p AS DOUBLE) / target AS finish FROM queued, range(2) AS passes(p) WHERE size > 0
), cut AS (
  SELECT max(finish) AS finish FROM (SELECT finish, budget, sum(size) OVER (ORDER BY finish) AS total FROM copies) WHERE total <= budget
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE size * (CAST(CAST(upto AS DOUBLE) / target <= cut.finish AS BIGINT)
    + CAST(CAST(upto + source_size AS DOUBLE) / target <= cut.finish AS BIGINT)) END AS taken
FROM queued, cut
""")
def op9_mixing(spark, sf_dir):
    """Which words of each document the mix of all sources takes."""
    mixed = mixing.fair_queue(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_pii(spark, sf_dir):
    """Personal data of every document: base counts and digest, all spans."""
    found = pii.find_pii(load(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.notation(base), 256).alias("base_sha256"),
                        pii.notation(F.col("spans")).alias("spans"))


@query()
def op8_packing(spark, sf_dir):
    """Every piece of every document in its sequence."""
    packed = packing.pack(load(spark, sf_dir, "documents", "doc_id", "text"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op6_sharding(spark, sf_dir):
    """The shard and slot of every document; equal texts are linked."""
    placed = label_shards.balanced_shards(load(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query()
def op3_quality(spark, sf_dir):
    """Base counts and the verdict for every document; labelled good documents are the trusted target."""
    trusted = load(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
    judged = quality_llr.quality(load(spark, sf_dir, "documents", "doc_id", "text"), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query(sql="""
WITH v AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.vector) = len(q.vector)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op2_topk(spark, sf_dir):
    """The 20 nearest vectors of every query vector."""
    return topk_search.top_k(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query()
def op4_toxicity(spark, sf_dir):
    """A toxicity score of every document; a third of the ids is held out from learning."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = toxicity_pu.toxicity(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "toxic"),
                                  ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity_pu.TOXIC_AT).cast("int").alias("predicted"))


@query()
def op5_secrets(spark, sf_dir):
    """Secrets in every document: start:end of each, comma-joined."""
    found = secret_forest.find_secrets(load(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"))


@query(sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w
), c AS (
  SELECT doc_id, len(g) AS n, g, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS k FROM s
), sets AS (
  SELECT k, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM c WHERE k IS NOT NULL GROUP BY k
), t AS (
  SELECT rep, n, unnest(g) AS g FROM sets
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach(x, y) AS (
  SELECT rep, rep FROM sets UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y
), comp AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT c.doc_id, c.n AS n_shingles, coalesce(comp.component_id, c.doc_id) AS component_id
FROM c LEFT JOIN sets ON sets.k = c.k LEFT JOIN comp ON comp.x = sets.rep
""")
def op1_ngram_jaccard(spark, sf_dir):
    """Near-duplicate components of all documents on four-word shingles at 0.85."""
    return ngram_join.jaccard_components(load(spark, sf_dir, "documents", "doc_id", "text"))


@query(sql="""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT doc_id, 1000 * c AS base, strlen(h) // 2 AS n, substr(h, 2000 * c + 1, 2100) AS h
  FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2000 + 1)) AS c FROM d)
), win AS (
  SELECT doc_id, base + i AS p, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, greatest(least(1000, n - 49 - base), 0))) AS i FROM part)
), least AS (
  SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, p FROM win JOIN least USING (s) WHERE first_doc < doc_id
), marked AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked) GROUP BY doc_id, island
), per AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail FROM spans GROUP BY doc_id
), pieces AS (
  SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_b FROM spans
), kept AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * from_b + 1, 2 * (a - from_b)), '' ORDER BY a) || substr(any_value(h), 2 * any_value(tail) + 1) AS k
  FROM pieces JOIN d USING (doc_id) JOIN per USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, strlen(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.k, d.h))) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
""")
def op10_suffix_dedup(spark, sf_dir):
    """Bytes of every document that repeat 50 bytes or more of an earlier one."""
    cut = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(sql=r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d
), words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k:
    list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase
  FROM words WHERE len(w) > 0
), f AS (
  SELECT lang, phrase, count(*) AS f, len(string_split(phrase, ' ')) AS words FROM grams GROUP BY lang, phrase
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), c AS (
  SELECT * FROM f WHERE words > 1 AND f >= 100
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first_part,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n.n,
    CAST((CAST(1000 AS HUGEINT) * a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_part
    JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c g ON g.lang = s.lang AND g.words > s.words AND g.f >= s.f
    AND instr(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') > 0
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = best.lang AND inside.phrase = best.phrase)
QUALIFY rank <= 2000
""")
def op13_phrase_mining(spark, sf_dir):
    """The collocations of every language."""
    return phrase_mining.collocations(load(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query(sql=r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS x, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8
), keyed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, tab,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b
  FROM conversations, tab
), hit AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS d FROM keyed
), damaged AS (
  SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM hit WHERE d <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) - 1 AS i FROM damaged
), judged AS (
  SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault,
    lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before
  FROM placed
), written(a, b, role) AS (
  VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')
), ops AS (
  SELECT a, b, 'K' AS letter, 0 AS w, role FROM written
  UNION ALL SELECT a, b, 'R', 1, NULL FROM written WHERE role <> 's'
  UNION ALL SELECT a, a, 'D', 2, NULL FROM (VALUES (0), (1), (2), (3)) AS t(a)
), ins(a, b, k) AS (
  VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)
), label AS (
  SELECT c, CAST(0 AS BIGINT) AS i, b AS state, printf('%012d', 5 * k) || repeat('I', k) AS label FROM (SELECT DISTINCT c FROM judged), ins WHERE a = 0
  UNION ALL
  SELECT c, i + 1, state, min(label) FROM (
    SELECT l.c, l.i, ins.b AS state, printf('%012d', CAST(l.label[1:12] AS BIGINT) + ops.w + CASE WHEN letter <> 'D' AND fault = 't' THEN 5 ELSE 0 END + 5 * ins.k)
      || l.label[13:] || letter || repeat('I', ins.k) AS label
    FROM label l JOIN judged r ON r.c = l.c AND r.i = l.i JOIN ops ON ops.a = l.state AND (ops.role IS NULL OR ops.role = initial)
      AND (letter = 'D' OR fault NOT IN ('b', 'd')) JOIN ins ON ins.a = ops.b
  ) GROUP BY c, i, state
), total AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY c
), best AS (
  SELECT l.c, min(label) AS label FROM label l JOIN total t ON t.c = l.c AND t.n = l.i WHERE state IN (0, 3) GROUP BY l.c
), letters AS (
  SELECT c, audit, unnest(range(1, len(audit) + 1)) AS j FROM (SELECT c, label[13:] AS audit FROM best)
), lines AS (
  SELECT l.c, j, audit[j] AS letter, len(replace(audit[1:j], 'I', '')) - 1 AS i, len(replace(audit[1:j], 'D', '')) - 1 + len(replace(audit, 'D', '')) % 2 AS p
  FROM letters l
), digest AS (
  SELECT lines.c, sha256(string_agg(CASE WHEN letter = 'K' THEN r.role WHEN p % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY j)) AS h
  FROM lines LEFT JOIN judged r ON r.c = lines.c AND r.i = lines.i WHERE letter <> 'D' GROUP BY lines.c
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(label[1:12] AS BIGINT), 0) AS cost, coalesce(label[13:], '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM keyed) k LEFT JOIN total USING (c) LEFT JOIN best USING (c) LEFT JOIN digest USING (c)
""")
def op12_conversation_repair(spark, sf_dir):
    """Faults of every damaged conversation, its cheapest edit script and the digest of what it leaves."""
    damaged = conversation_repair.damage(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    found, repaired = conversation_repair.repair(damaged)
    lines = conversation_repair.digests(repaired).select(F.col("conv_id").alias("c"), "repaired_sha256")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.join(lines, found["conv_id"].eqNullSafe(lines["c"]), "left").select(
        *found.columns, F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


@query(sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM w
), c AS (
  SELECT doc_id, len(g) AS n, g, CASE WHEN len(g) > 0 THEN md5(array_to_string(list_sort(g), chr(10))) END AS k FROM s
), sets AS (
  SELECT k, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM c WHERE k IS NOT NULL GROUP BY k
), t AS (
  SELECT rep, n, unnest(g) AS g FROM sets
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach(x, y) AS (
  SELECT rep, rep FROM sets UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y
), comp AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT c.doc_id, c.n AS n_shingles, coalesce(comp.component_id, c.doc_id) AS component_id,
  c.doc_id = coalesce(comp.component_id, c.doc_id) AS kept
FROM c LEFT JOIN sets ON sets.k = c.k LEFT JOIN comp ON comp.x = sets.rep
""")
def op11_circulant_minhash(spark, sf_dir):
    """Near-duplicate components of all documents on three-word shingles at 0.85, and the document of each that stays."""
    found = circulant_minhash.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
