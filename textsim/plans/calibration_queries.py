"""Labelled pairs, calibration and evaluation (G1-G7, A8-A15, X4): all seven pair types, scored with stems.

The SQL restates every generator and the stemmer, so that each query has a twin over all pairs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textsim.constants import (FALLBACK_EVAL_WEIGHTS, GRID_THRESHOLDS, IDF_UNSHARED_SQ, MINOR_EDIT_FILLERS, PAIR_TYPES,
                               SWEEP_HALF_POINTS, SYNONYMS, WEIGHTS)
from textsim.functions.scores import sql_weighted_score
from textsim.functions.text import WS, sql_str
from textsim.operators import calibrate as CAL
from textsim.operators import generate as G
from textsim.operators import metrics as M
from textsim.operators.lookup import RAW_SENT_MARK
from textsim.plans.oracle import profiles_cte
from textsim.plans.registry import query
from textsim.plans.style_queries import _LABELLED_SQL, labelled_texts
from textsim.session import materialize

# ------------------------------------------------------------------ Spark side


def _scored(spark, sf):
    return materialize(G.score_pair_list(G.labelled_pairs(labelled_texts(spark, sf)), use_stemming=True), "scored-pairs")


def _r6(c):
    return F.round(c, 6)


# -------------------------------------------------------------------- SQL side
_re = lambda p: sql_str(p.replace(r"\x85", r"\x{85}"))
_RAWSENTS = lambda e: (f"list_filter(list_transform(string_split(regexp_replace({e}, {_re(f'([.!?])[{WS}]+')}, "
                       f"{sql_str(chr(92) + '1' + RAW_SENT_MARK)}, 'g'), {sql_str(RAW_SENT_MARK)}), "
                       f"lambda s: regexp_replace(s, {_re(f'^[{WS}]+|[{WS}]+$')}, '', 'g')), lambda s: s <> '')")


def _sample(pool: str, salt: str, k: int) -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':{salt}')) AS r FROM {pool}) "
            f"WHERE r <= {k})")


def _sel(type_: str, text1: str, text2: str) -> str:
    label, _, expected = PAIR_TYPES[type_]
    return (f"({G.TYPE_INDEX[type_] * 100} + r)::BIGINT AS pair_id, {text1} AS text1, {text2} AS text2, "
            f"{label} AS label, '{type_}' AS type, {expected!r}::DOUBLE AS expected_min")


def _draw(n: str, salt: str, index: str) -> str:
    return f"(('0x' || left(md5(doc_id::VARCHAR || ':' || {index}::VARCHAR || ':{salt}'), 8))::BIGINT % {n})"


_WORDS = f"list_filter(regexp_split_to_array(text, {_re(f'[{WS}]+')}), lambda t: t <> '')"
_FILLERS = "[" + ", ".join(f"'{f}'" for f in MINOR_EDIT_FILLERS) + "]"
_SYNONYM = "CASE " + "regexp_replace(lower(x), '^[.,;:!?]+|[.,;:!?]+$', '', 'g')" + "".join(f" WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS) + " END"

K = {t: v[1] for t, v in PAIR_TYPES.items()}
_PAIRS_SQL = f"""lab AS ({_LABELLED_SQL}),
pool AS (SELECT doc_id, text, label FROM lab WHERE length(text) > 100),
ai AS (SELECT * FROM pool WHERE label = 1), hu AS (SELECT * FROM pool WHERE label = 0),
g1 AS (SELECT {_sel('identical', 'text', 'text')} FROM {_sample('ai', 'identical', K['identical'])}),
s2 AS (SELECT *, {_WORDS} AS w FROM {_sample('ai', 'minor', K['minor_edit'])}),
e2 AS (SELECT *, list_transform(range(greatest(len(w) // 15, 1)), lambda k: {{'pos': {_draw('len(w)', 'pos', 'k')},
       'f': {_FILLERS}[{_draw(str(len(MINOR_EDIT_FILLERS)), 'fill', 'k')} + 1]}}) AS ch FROM s2),
g2 AS (SELECT {_sel('minor_edit', 'text', "array_to_string(list_transform(w, lambda x, i: coalesce(list_filter(ch, lambda c: c.pos = i - 1)[-1].f, x)), ' ')")} FROM e2),
s3 AS (SELECT *, {_WORDS} AS w FROM {_sample('ai', 'swap', K['word_swap'])}),
e3 AS (SELECT *, list_transform(w, lambda x, i: {{'x': x, 'rep': CASE WHEN {_draw('2', 'coin', '(i - 1)')} = 0 THEN {_SYNONYM} END}}) AS sw FROM s3),
g3 AS (SELECT {_sel('word_swap', 'text', """array_to_string(list_transform(sw, lambda z: CASE WHEN z.rep IS NULL THEN z.x
       WHEN regexp_matches(left(z.x, 1), '^\\p{Lu}$') THEN upper(left(z.rep, 1)) || substr(z.rep, 2) ELSE z.rep END), ' ')""")} FROM e3),
s4 AS (SELECT *, {_RAWSENTS('text')} AS sents FROM {_sample('ai', 'shuffle', K['shuffle_sentences'])}),
g4 AS (SELECT {_sel('shuffle_sentences', 'text', "array_to_string(list_transform(list_sort(list_transform(sents, lambda x, i: {'h': md5(doc_id::VARCHAR || ':' || (i - 1)::VARCHAR || ':shuffle'), 's': x})), lambda z: z.s), ' ')")}
       FROM s4 WHERE len(sents) >= 3),
s5 AS (SELECT *, {_RAWSENTS('text')} AS sents FROM {_sample('ai', 'partial', K['partial_copy'])}),
o5 AS (SELECT r AS orank, text AS other, count(*) OVER () AS n_other FROM {_sample('hu', 'partial_other', K['partial_copy'])}),
g5 AS (SELECT {_sel('partial_copy', 'text', f"array_to_string(list_concat(sents[1:len(sents) // 2], ({_RAWSENTS('other')})[1:len(sents) // 2]), ' ')")}
       FROM s5 JOIN o5 ON ((r - 1) % n_other) + 1 = orank WHERE len(sents) >= 4),
a6 AS {_sample('ai', 'unrelated_a', K['unrelated'])}, h6 AS {_sample('hu', 'unrelated_h', K['unrelated'])},
c6 AS (SELECT (SELECT count(*) FROM a6) AS na, (SELECT count(*) FROM h6) AS nh),
r6 AS (SELECT na, nh, unnest(range(1, least({K['unrelated']}, na * nh) + 1)) AS r FROM c6 WHERE na * nh > 0),
g6 AS (SELECT {_sel('unrelated', 'a6.text', 'h6.text').replace('+ r)', '+ r6.r)')}
       FROM r6 JOIN a6 ON ((r6.r - 1) % na) + 1 = a6.r JOIN h6 ON (((r6.r - 1) // na) % nh) + 1 = h6.r),
b7 AS {_sample('ai', 'same_style', K['unrelated_same_style'] + 1)}, n7 AS (SELECT count(*) AS nb FROM b7),
g7 AS (SELECT {_sel('unrelated_same_style', 'x.text', 'y.text').replace('+ r)', '+ x.r)')}
       FROM b7 x CROSS JOIN n7 JOIN b7 y ON (x.r % nb) + 1 = y.r WHERE nb >= 2 AND x.r <= {K['unrelated_same_style']}),
lp AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4 UNION ALL SELECT * FROM g5 UNION ALL SELECT * FROM g6 UNION ALL SELECT * FROM g7)"""

_K2 = repr(IDF_UNSHARED_SQ)
_SCORED_SQL = f"""{_PAIRS_SQL},
t AS (SELECT pair_id * 2 AS text_id, text1 AS text FROM lp UNION ALL SELECT pair_id * 2 + 1, text2 FROM lp),
prof AS ({profiles_cte('t', stem=True)}),
tf AS (SELECT text_id, term, count(*)::DOUBLE AS tf FROM (SELECT text_id, unnest(te) AS term FROM prof) GROUP BY ALL),
tsq AS (SELECT text_id, sum(tf * tf) AS t_sq FROM tf GROUP BY text_id),
cs AS (SELECT lp.pair_id, sum(x.tf * y.tf) AS dot, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb FROM lp
       JOIN tf x ON x.text_id = lp.pair_id * 2 JOIN tf y ON y.text_id = lp.pair_id * 2 + 1 AND y.term = x.term GROUP BY lp.pair_id),
tok AS (SELECT text_id, unnest(toks) AS k FROM prof),
js AS (SELECT lp.pair_id, count(*) AS inter FROM lp JOIN tok x ON x.text_id = lp.pair_id * 2
       JOIN tok y ON y.text_id = lp.pair_id * 2 + 1 AND y.k = x.k GROUP BY lp.pair_id),
gr AS (SELECT text_id, unnest(grams) AS k FROM prof),
gs AS (SELECT lp.pair_id, count(*) AS inter FROM lp JOIN gr x ON x.text_id = lp.pair_id * 2
       JOIN gr y ON y.text_id = lp.pair_id * 2 + 1 AND y.k = x.k GROUP BY lp.pair_id),
comp AS (SELECT lp.pair_id, lp.label, lp.type, lp.expected_min,
    CASE WHEN coalesce(ta.t_sq, 0) = 0 OR coalesce(tb.t_sq, 0) = 0 THEN 0.0
         ELSE coalesce(cs.dot, 0) / sqrt((coalesce(cs.sa, 0) + {_K2} * (ta.t_sq - coalesce(cs.sa, 0)))
                                        * (coalesce(cs.sb, 0) + {_K2} * (tb.t_sq - coalesce(cs.sb, 0)))) END AS cosine,
    CASE WHEN len(pa.toks) + len(pb.toks) = 0 THEN 0.0
         ELSE coalesce(js.inter, 0) / (len(pa.toks) + len(pb.toks) - coalesce(js.inter, 0)) END AS jaccard,
    CASE WHEN len(pa.grams) + len(pb.grams) = 0 THEN 0.0
         ELSE coalesce(gs.inter, 0) / (len(pa.grams) + len(pb.grams) - coalesce(gs.inter, 0)) END AS ngram
  FROM lp JOIN prof pa ON pa.text_id = lp.pair_id * 2 JOIN prof pb ON pb.text_id = lp.pair_id * 2 + 1
  LEFT JOIN tsq ta ON ta.text_id = lp.pair_id * 2 LEFT JOIN tsq tb ON tb.text_id = lp.pair_id * 2 + 1
  LEFT JOIN cs ON cs.pair_id = lp.pair_id LEFT JOIN js ON js.pair_id = lp.pair_id LEFT JOIN gs ON gs.pair_id = lp.pair_id),
sp AS (SELECT pair_id, label, type, expected_min, {sql_weighted_score('cosine', 'jaccard', 'ngram', '0.0', WEIGHTS)} AS overall,
       cosine, jaccard, ngram FROM comp)"""

_SWEEP_SQL = f"""{_SCORED_SQL},
sw AS (SELECT g.t2, g.t2 / 2.0 AS threshold,
  count(*) FILTER (WHERE label = 1 AND overall >= g.t2 / 2.0) AS tp, count(*) FILTER (WHERE label = 0 AND overall >= g.t2 / 2.0) AS fp,
  count(*) FILTER (WHERE label = 0 AND overall < g.t2 / 2.0) AS tn, count(*) FILTER (WHERE label = 1 AND overall < g.t2 / 2.0) AS fn,
  avg(CASE WHEN (overall >= g.t2 / 2.0) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM sp CROSS JOIN (SELECT range AS t2 FROM range({SWEEP_HALF_POINTS[0]}, {SWEEP_HALF_POINTS[1]})) g GROUP BY g.t2)"""

_D = lambda s, st: f"({s!r}::DOUBLE + i::DOUBLE * {(s + st) - s!r}::DOUBLE)"
_GRID_SQL = f"""{_SWEEP_SQL},
cells AS (SELECT * FROM (SELECT i, j, cw, jw, 1.0::DOUBLE - cw - jw AS nw FROM (
   SELECT i, j, {_D(0.2, 0.05)} AS cw, {_D(0.1, 0.05).replace('i::', 'j::')} AS jw
   FROM (SELECT range AS i FROM range({CAL.GRID_SIZE})) CROSS JOIN (SELECT range AS j FROM range({CAL.GRID_SIZE}))))
   WHERE NOT (nw < 0.05 OR nw > 0.5)),
wg AS (SELECT c.i, c.j, c.cw, c.jw, c.nw, g.t AS threshold,
  avg(CASE WHEN ((c.cw * cosine + c.jw * jaccard + c.nw * ngram) * 100.0 >= g.t) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM sp CROSS JOIN cells c CROSS JOIN (SELECT range AS t FROM range({GRID_THRESHOLDS[0]}, {GRID_THRESHOLDS[1]})) g
  GROUP BY c.i, c.j, c.cw, c.jw, c.nw, g.t),
bw AS (SELECT * FROM wg WHERE accuracy > 0 ORDER BY accuracy DESC, i, j, threshold LIMIT 1),
bt AS (SELECT * FROM sw ORDER BY accuracy DESC, t2 LIMIT 1),
ch AS (SELECT coalesce(bw.cw, {FALLBACK_EVAL_WEIGHTS[0]!r}::DOUBLE) AS cw, coalesce(bw.jw, {FALLBACK_EVAL_WEIGHTS[1]!r}::DOUBLE) AS jw,
       coalesce(bw.nw, {FALLBACK_EVAL_WEIGHTS[2]!r}::DOUBLE) AS nw, coalesce(bw.threshold::DOUBLE, bt.threshold) AS thr
       FROM bt LEFT JOIN bw ON true),
fe AS (SELECT pair_id, type, label, (cw * cosine + jw * jaccard + nw * ngram) * 100.0 AS score,
       CASE WHEN (cw * cosine + jw * jaccard + nw * ngram) * 100.0 >= thr THEN 1 ELSE 0 END AS pred FROM sp CROSS JOIN ch),
cm AS (SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM fe)"""

_DIV = lambda a, b: f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"

# ---------------------------------------------------------------- registration


@query("gen_identical", f"WITH {_PAIRS_SQL} SELECT pair_id, md5(text1) AS text1_md5, md5(text2) AS text2_md5, label FROM g1")
def q_gen_identical(spark, sf):
    ai, _ = G.pools(labelled_texts(spark, sf))
    return G.gen_identical(ai).select("pair_id", F.md5("text1").alias("text1_md5"), F.md5("text2").alias("text2_md5"), "label")


@query("gen_shuffle", f"WITH {_PAIRS_SQL} SELECT pair_id, md5(text1) AS text1_md5, md5(text2) AS text2_md5, label FROM g4")
def q_gen_shuffle(spark, sf):
    ai, _ = G.pools(labelled_texts(spark, sf))
    return G.gen_shuffle(ai).select("pair_id", F.md5("text1").alias("text1_md5"), F.md5("text2").alias("text2_md5"), "label")


@query("gen_partial_copy", f"WITH {_PAIRS_SQL} SELECT pair_id, md5(text1) AS text1_md5, md5(text2) AS text2_md5, label FROM g5")
def q_gen_partial_copy(spark, sf):
    ai, hu = G.pools(labelled_texts(spark, sf))
    return G.gen_partial_copy(ai, hu).select("pair_id", F.md5("text1").alias("text1_md5"), F.md5("text2").alias("text2_md5"), "label")


@query("gen_unrelated", f"""WITH {_PAIRS_SQL} SELECT pair_id, type, md5(text1) AS text1_md5, md5(text2) AS text2_md5, label
FROM (SELECT * FROM g6 UNION ALL SELECT * FROM g7)""")
def q_gen_unrelated(spark, sf):
    ai, hu = G.pools(labelled_texts(spark, sf))
    return G.gen_unrelated(ai, hu).select("pair_id", "type", F.md5("text1").alias("text1_md5"), F.md5("text2").alias("text2_md5"), "label")


@query("gen_minor_edit", f"WITH {_PAIRS_SQL} SELECT * FROM g2")
def q_gen_minor_edit(spark, sf):
    ai, _ = G.pools(labelled_texts(spark, sf))
    return G.gen_minor_edit(ai)


@query("gen_word_swap", f"WITH {_PAIRS_SQL} SELECT * FROM g3")
def q_gen_word_swap(spark, sf):
    ai, _ = G.pools(labelled_texts(spark, sf))
    return G.gen_word_swap(ai)


@query("labelled_pairs", f"WITH {_PAIRS_SQL} SELECT * FROM lp")
def q_labelled_pairs(spark, sf):
    return G.labelled_pairs(labelled_texts(spark, sf))


@query("pair_pass_rate", f"""WITH {_SCORED_SQL} SELECT type, count(*) AS n_pairs,
avg(CASE WHEN overall / 100.0 >= expected_min THEN 1.0 ELSE 0.0 END) AS pass_rate FROM sp GROUP BY type""")
def q_pair_pass_rate(spark, sf):
    """Per type: share of pairs whose score reaches the generator's expected minimum (stemmed, all types)."""
    sp = G.score_pair_list(G.labelled_pairs(labelled_texts(spark, sf)), use_stemming=True)
    return sp.groupBy("type").agg(F.count(F.lit(1)).alias("n_pairs"),
                                  F.avg((F.col("overall") / 100.0 >= F.col("expected_min")).cast("double")).alias("pass_rate"))


@query("scored_pairs", f"""WITH {_SCORED_SQL} SELECT pair_id, label, type, overall, round(cosine, 6) AS cosine,
round(jaccard, 6) AS jaccard, round(ngram, 6) AS ngram FROM sp""")
def q_scored_pairs(spark, sf):
    s = _scored(spark, sf)
    return s.select("pair_id", "label", "type", "overall", _r6(F.col("cosine")).alias("cosine"),
                    _r6(F.col("jaccard")).alias("jaccard"), _r6(F.col("ngram")).alias("ngram"))


@query("type_counts", f"WITH {_SCORED_SQL} SELECT type, count(*) AS n_pairs FROM sp GROUP BY type")
def q_type_counts(spark, sf):
    return _scored(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("type_distribution", f"""WITH {_SCORED_SQL} SELECT type, any_value(label) AS label, round(avg(overall), 6) AS mean_score,
round(stddev_pop(overall), 6) AS std_score, min(overall) AS min_score, max(overall) AS max_score FROM sp GROUP BY type""")
def q_type_distribution(spark, sf):
    d = CAL.type_distribution(_scored(spark, sf))
    return d.select("type", "label", _r6(F.col("mean_score")).alias("mean_score"), _r6(F.col("std_score")).alias("std_score"),
                    "min_score", "max_score")


@query("threshold_sweep", f"WITH {_SWEEP_SQL} SELECT t2, threshold, tp, fp, tn, fn, round(accuracy, 6) AS accuracy FROM sw")
def q_threshold_sweep(spark, sf):
    s = CAL.threshold_sweep(spark, _scored(spark, sf))
    return s.select("t2", "threshold", "tp", "fp", "tn", "fn", _r6(F.col("accuracy")).alias("accuracy"))


@query("best_threshold", f"""WITH {_SWEEP_SQL} SELECT t2, threshold, round(accuracy, 6) AS accuracy FROM sw
ORDER BY accuracy DESC, t2 LIMIT 1""")
def q_best_threshold(spark, sf):
    b = CAL.best_threshold(CAL.threshold_sweep(spark, _scored(spark, sf)))
    return b.select("t2", "threshold", _r6(F.col("accuracy")).alias("accuracy"))


@query("weight_grid", f"""WITH {_GRID_SQL} SELECT round(cw, 2) AS cw, round(jw, 2) AS jw, round(nw, 2) AS nw, threshold,
round(accuracy, 6) AS accuracy FROM wg""")
def q_weight_grid(spark, sf):
    g = CAL.weight_grid(spark, _scored(spark, sf))
    return g.select(F.round("cw", 2).alias("cw"), F.round("jw", 2).alias("jw"), F.round("nw", 2).alias("nw"),
                    "threshold", _r6(F.col("accuracy")).alias("accuracy"))


@query("best_weights", f"""WITH {_GRID_SQL} SELECT round(cw, 2) AS cw, round(jw, 2) AS jw, round(nw, 2) AS nw, threshold,
round(accuracy, 6) AS accuracy FROM bw""")
def q_best_weights(spark, sf):
    b = CAL.best_weights(CAL.weight_grid(spark, _scored(spark, sf)))
    return b.select(F.round("cw", 2).alias("cw"), F.round("jw", 2).alias("jw"), F.round("nw", 2).alias("nw"),
                    "threshold", _r6(F.col("accuracy")).alias("accuracy"))


def _final(spark, sf):
    s = _scored(spark, sf)
    return CAL.final_eval(s, CAL.best_weights(CAL.weight_grid(spark, s)), CAL.best_threshold(CAL.threshold_sweep(spark, s)))


@query("final_eval", f"WITH {_GRID_SQL} SELECT pair_id, type, label, round(score, 6) AS score, pred, "
                     f"CASE WHEN pred = label THEN 1 ELSE 0 END AS correct FROM fe")
def q_final_eval(spark, sf):
    return _final(spark, sf).select("pair_id", "type", "label", _r6(F.col("score")).alias("score"), "pred", "correct")


@query("confusion_matrix", f"WITH {_GRID_SQL} SELECT tn, fp, fn, tp FROM cm")
def q_confusion_matrix(spark, sf):
    return M.confusion_counts(_final(spark, sf))


@query("binary_metrics", f"""WITH {_GRID_SQL} SELECT round({_DIV('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
round({_DIV('tp', 'tp + fp')}, 6) AS precision, round({_DIV('tp', 'tp + fn')}, 6) AS recall,
round({_DIV('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, tp + tn + fp + fn AS support FROM cm""")
def q_binary_metrics(spark, sf):
    b = M.binary_metrics(_final(spark, sf))
    return b.select(*[_r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "support")


@query("class_report", f"""WITH {_GRID_SQL},
per AS (SELECT '0' AS cls, {_DIV('tn', 'tn + fn')} AS precision, {_DIV('tn', 'tn + fp')} AS recall,
               {_DIV('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support FROM cm
        UNION ALL SELECT '1', {_DIV('tp', 'tp + fp')}, {_DIV('tp', 'tp + fn')}, {_DIV('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM cm),
allr AS (SELECT * FROM per
         UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
         UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                          sum(f1 * support) / sum(support), sum(support) FROM per)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM allr""")
def q_class_report(spark, sf):
    r = M.class_report(_final(spark, sf))
    return r.select("cls", *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("misclassified_by_type", f"""WITH {_GRID_SQL} SELECT type, count(*) AS n_errors,
round(count(*) * 100.0 / (SELECT count(*) FROM fe), 6) AS pct_of_pairs FROM fe WHERE pred <> label GROUP BY type""")
def q_misclassified_by_type(spark, sf):
    fe = _final(spark, sf)
    total = fe.agg(F.count(F.lit(1)).alias("total"))
    return (fe.filter(F.col("pred") != F.col("label")).groupBy("type").agg(F.count(F.lit(1)).alias("n_errors"))
            .crossJoin(total)  # one row
            .select("type", "n_errors", _r6(F.col("n_errors") * 100.0 / F.col("total")).alias("pct_of_pairs"))
            .orderBy(F.desc("n_errors"), "type"))
