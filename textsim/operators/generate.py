"""Labelled pair generators (G1-G6) and their scoring.

Sampling is deterministic: a pool is ordered by ``md5(id:salt)`` and the first
k rows are kept (a bounded top-k), so runs repeat exactly and SQL can restate
them.  Random positions and coins are drawn from the md5 of (id, index, salt).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsim.constants import MINOR_EDIT_FILLERS, PAIR_MIN_CHARS, PAIR_TYPES, SYNONYMS
from textsim.operators import profiles as P
from textsim.operators import similarity as S
from textsim.operators.lookup import raw_sentences, ws_tokens
from textsim.session import materialize

TYPE_INDEX = {t: i + 1 for i, t in enumerate(PAIR_TYPES)}
PAIR_SCHEMA = ["pair_id", "text1", "text2", "label", "type", "expected_min"]


def pools(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ai, human) texts longer than 100 characters; label 1 plays the AI class."""
    base = labelled.filter(F.char_length("text") > PAIR_MIN_CHARS).select("doc_id", "text", "label")
    return base.filter(F.col("label") == 1), base.filter(F.col("label") == 0)


def salted(col: str, salt: str):
    return F.md5(F.concat(F.col(col).cast("string"), F.lit(":" + salt)))


def draw(n, salt: str, index):
    """A number from 0 to n - 1 for each (document, index): the first eight hex digits of an md5, modulo n."""
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), index.cast("string"), F.lit(salt)))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n


def sample(pool: DataFrame, salt: str, k: int) -> DataFrame:
    """First k rows by md5(id:salt), ranked r = 1..k (a top-k: at most k rows reach one task)."""
    top = pool.withColumn("h", salted("doc_id", salt)).orderBy("h").limit(k)
    return top.withColumn("r", F.row_number().over(Window.orderBy("h")))


def _pairs(df: DataFrame, type_: str, text2) -> DataFrame:
    label, _, expected = PAIR_TYPES[type_]
    return df.select((F.lit(TYPE_INDEX[type_] * 100) + F.col("r")).cast("long").alias("pair_id"),
                     F.col("text").alias("text1"), text2.alias("text2"), F.lit(label).alias("label"),
                     F.lit(type_).alias("type"), F.lit(expected).alias("expected_min"))


def gen_identical(ai: DataFrame) -> DataFrame:
    return _pairs(sample(ai, "identical", PAIR_TYPES["identical"][1]), "identical", F.col("text"))


def gen_shuffle(ai: DataFrame) -> DataFrame:
    s = sample(ai, "shuffle", PAIR_TYPES["shuffle_sentences"][1]).withColumn("sents", raw_sentences(F.col("text")))
    s = s.filter(F.size("sents") >= 3)
    keyed = F.transform("sents", lambda x, i: F.struct(
        F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string"), F.lit("shuffle"))).alias("h"),
        x.alias("s")))
    return _pairs(s, "shuffle_sentences", F.array_join(F.transform(F.array_sort(keyed), lambda z: z["s"]), " "))


def gen_partial_copy(ai: DataFrame, human: DataFrame) -> DataFrame:
    k = PAIR_TYPES["partial_copy"][1]
    s = sample(ai, "partial", k).withColumn("sents", raw_sentences(F.col("text"))).filter(F.size("sents") >= 4)
    o = sample(human, "partial_other", k)
    o = o.select(F.col("r").alias("orank"), F.col("text").alias("other"),
                 F.count(F.lit(1)).over(Window.partitionBy()).alias("n_other"))  # at most k rows
    j = s.join(o, (F.pmod(F.col("r") - 1, F.col("n_other")) + 1) == F.col("orank"))  # both sides <= k rows
    half = (F.size("sents") / 2).cast("int")
    text2 = F.array_join(F.concat(F.slice("sents", 1, half), F.slice(raw_sentences(F.col("other")), 1, half)), " ")
    return _pairs(j, "partial_copy", text2)


def gen_unrelated(ai: DataFrame, human: DataFrame) -> DataFrame:
    """Rank-paired AI x human (60) and AI x other AI (30) pairs."""
    k = PAIR_TYPES["unrelated"][1]
    a = sample(ai, "unrelated_a", k)
    h = sample(human, "unrelated_h", k)
    na = a.agg(F.count(F.lit(1)).alias("na"))
    nh = h.agg(F.count(F.lit(1)).alias("nh"))
    r = na.crossJoin(nh).select("na", "nh", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("na") * F.col("nh"))))
                                .alias("r"))  # one row x at most k
    r = r.filter(F.col("na") * F.col("nh") > 0)
    x = (r.join(a.select(F.col("r").alias("ra"), "text"), (F.pmod(F.col("r") - 1, F.col("na")) + 1) == F.col("ra"))
         .join(h.select(F.col("r").alias("rh"), F.col("text").alias("t2")),
               (F.pmod(F.floor((F.col("r") - 1) / F.col("na")), F.col("nh")) + 1) == F.col("rh")))
    unrelated = _pairs(x, "unrelated", F.col("t2"))
    k2 = PAIR_TYPES["unrelated_same_style"][1]
    b = sample(ai, "same_style", k2 + 1)
    nb = b.agg(F.count(F.lit(1)).alias("nb"))
    bb = b.crossJoin(nb).filter((F.col("nb") >= 2) & (F.col("r") <= k2))  # nb: one row
    y = bb.join(b.select(F.col("r").alias("r2"), F.col("text").alias("t2")), (F.pmod(F.col("r"), F.col("nb")) + 1) == F.col("r2"))
    return unrelated.unionByName(_pairs(y, "unrelated_same_style", F.col("t2")))


def gen_minor_edit(ai: DataFrame) -> DataFrame:
    """max(1, words // 15) hash-chosen positions overwritten by a filler; later picks win."""
    s = sample(ai, "minor", PAIR_TYPES["minor_edit"][1]).withColumn("w", ws_tokens(F.col("text")))
    n = F.size("w")
    fillers = F.array(*[F.lit(x) for x in MINOR_EDIT_FILLERS])
    s = s.withColumn("changes", F.transform(
        F.sequence(F.lit(0), F.greatest((n / 15).cast("int"), F.lit(1)) - 1),
        lambda k: F.struct(draw(n, "pos", k).alias("pos"),
                           F.element_at(fillers, (draw(F.lit(len(MINOR_EDIT_FILLERS)), "fill", k) + 1).cast("int")).alias("f"))))
    edited = F.transform("w", lambda word, i: F.aggregate("changes", word,
                                                           lambda acc, c: F.when(c["pos"] == i, c["f"]).otherwise(acc)))
    return _pairs(s, "minor_edit", F.array_join(edited, " "))


def gen_word_swap(ai: DataFrame) -> DataFrame:
    """Synonym replacement with a hash coin (50 %); capitalised when the word was."""
    s = sample(ai, "swap", PAIR_TYPES["word_swap"][1]).withColumn("w", ws_tokens(F.col("text")))
    syn = F.create_map(*[F.lit(x) for pair in SYNONYMS for x in pair])

    def swap(word, i):
        key = F.regexp_replace(F.lower(word), r"^[.,;:!?]+|[.,;:!?]+$", "")
        rep = F.try_element_at(syn, key)
        coin = draw(F.lit(2), "coin", i) == 0
        cap = F.substring(word, 1, 1).rlike(r"^\p{Lu}$")
        return F.when(rep.isNotNull() & coin, F.when(cap, F.initcap(rep)).otherwise(rep)).otherwise(word)

    return _pairs(s, "word_swap", F.array_join(F.transform("w", swap), " "))


#: Of each pool, the salt of every sample and how many rows it takes.
AI_SAMPLES = {"identical": PAIR_TYPES["identical"][1], "shuffle": PAIR_TYPES["shuffle_sentences"][1], "partial": PAIR_TYPES["partial_copy"][1],
              "unrelated_a": PAIR_TYPES["unrelated"][1], "same_style": PAIR_TYPES["unrelated_same_style"][1] + 1,
              "minor": PAIR_TYPES["minor_edit"][1], "swap": PAIR_TYPES["word_swap"][1]}
HUMAN_SAMPLES = {"partial_other": PAIR_TYPES["partial_copy"][1], "unrelated_h": PAIR_TYPES["unrelated"][1]}


def drawn_texts(labelled: DataFrame) -> DataFrame:
    """The rows of ``labelled`` whose id is in one of the samples, as a table.

    The samples are taken of the ids alone, so the texts are read twice in all (once for their lengths, once to fetch
    those drawn) and not once or twice a sample. Whatever the input, at most a few hundred ids are drawn.
    """
    ids = materialize(labelled.filter(F.char_length("text") > PAIR_MIN_CHARS).select("doc_id", "label"), "pool-ids")
    picked = [sample(ids.filter(F.col("label") == label), salt, k).select(F.col("doc_id").alias("_drawn"))
              for label, samples in ((1, AI_SAMPLES), (0, HUMAN_SAMPLES)) for salt, k in samples.items()]
    drawn = F.broadcast(reduce(DataFrame.unionByName, picked).distinct())
    return materialize(labelled.join(drawn, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi"), "drawn-texts")


def labelled_pairs(labelled: DataFrame) -> DataFrame:
    """All seven pair types."""
    ai, human = pools(drawn_texts(labelled))
    return (gen_identical(ai).unionByName(gen_shuffle(ai)).unionByName(gen_partial_copy(ai, human))
            .unionByName(gen_unrelated(ai, human)).unionByName(gen_minor_edit(ai)).unionByName(gen_word_swap(ai)))


def score_pair_list(pairs: DataFrame, use_stemming: bool = True) -> DataFrame:
    """(pair_id, label, type, expected_min, overall, cosine, jaccard, ngram) for listed text pairs.

    The pair list is written to the checkpoint folder first: it is read twice
    (texts and pair ids), and the stemming UDF then runs over a plain scan
    rather than over the generators' top-k and window operators.
    """
    pairs = materialize(pairs, "labelled-pairs")
    texts = (pairs.select((F.col("pair_id") * 2).alias("text_id"), F.col("text1").alias("text"))
             .unionByName(pairs.select((F.col("pair_id") * 2 + 1).alias("text_id"), F.col("text2").alias("text"))))
    prof = P.build_profiles(texts, use_stemming)
    ab = pairs.select("pair_id", "label", "type", "expected_min",
                      (F.col("pair_id") * 2).alias("a"), (F.col("pair_id") * 2 + 1).alias("b"))
    comp = S.score(S.pair_components(ab.select("a", "b"), prof))
    return (ab.join(comp, ["a", "b"])
            .select("pair_id", "label", "type", "expected_min", F.col("overall_score").alias("overall"),
                    "cosine", "jaccard", "ngram"))

