"""Personal data: proposed by regular expressions, confirmed by checksums, weighed by nearby words.

Native column expressions only. A kind's matches come from ``regexp_extract_all``
and their places from ``split`` by the same pattern: the text is the pieces and
the matches in turn, so a match starts after the lengths of all before it.

The patterns match what their plain forms in ``PLAIN`` match (leftmost, non
overlapping, greedy). They are written with possessive quantifiers and start
conditions so that a run of a hundred thousand digits or letters costs linear
time and constant stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsim.llm.words import apart, let, text_of

# The plain form of the base patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: As they are run. A card keeps only chains of at least 12 digits, the least that can pass.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

#: A substring without which a text has no match; None: always search.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}

#: Score of a match that its checksum or form confirms, before context.
CONFIRMED = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "server", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "credit", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "whatsapp"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer", "tax id"),
}
AGAINST = ("version", "example", "isbn", "serial", "order no", "part no")
NEAR = 48                # characters before and after a match that are read for context words, those against it only before
LEAST = 4                # characters of the shortest match
CONTEXT_GAIN, CONTEXT_LOSS = 0.3, 0.3
KEEP_AT = 0.6            # kinds besides the base ones need this score

_CHUNK = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_before(values: Column) -> Column:
    """For each element of an int array the sum of those before it, by chunks:
    about n * 32 + (n / 64)^2 / 2 additions."""
    def by_chunk(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")),
                           lambda c: _sum(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK))))

    def offsets(chunks: Column) -> Column:
        return F.transform(chunks, lambda _, c: _sum(F.slice(chunks, F.lit(1), c)))

    def placed(v: Column, offset: Column) -> Column:
        return F.transform(v, lambda _, i: F.get(offset, F.floor(i / _CHUNK).cast("int"))
                           + _sum(F.slice(v, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)))
    return let(values, lambda v: let(by_chunk(v), lambda c: let(offsets(c), lambda o: placed(v, o))))


def texts_before(hits: Column, pieces: Column, n: int, least: int) -> Column:
    """For each match the ``n`` characters of the text before it, earlier matches included,
    by way of the pieces, as many back as matches of ``least`` characters can fill ``n``."""
    back = -(-n // least)
    ahead = F.slice(pieces, F.lit(1), F.size(hits))
    last = lambda s: F.substring(s, -n, n)
    return let(F.zip_with(ahead, hits, lambda p, h: last(F.concat(p, h))), lambda ends: F.transform(ahead, lambda p, i: last(F.concat(
        F.array_join(F.slice(ends, F.greatest(F.lit(1), i - back + 1), F.least(i, F.lit(back))), ""), p))))


def texts_after(hits: Column, pieces: Column, n: int, least: int) -> Column:
    """For each match the ``n`` characters of the text after it, later matches included."""
    first = lambda s: F.substring(s, 1, n)
    # piece and match that follow each match; the last piece has no match behind it
    follow = F.zip_with(F.slice(pieces, F.lit(2), F.size(hits)), F.slice(hits, F.lit(2), F.size(hits)),
                        lambda p, h: first(F.concat(p, F.coalesce(h, F.lit("")))))
    return let(follow, lambda f: F.transform(f, lambda _, i: first(F.array_join(F.slice(f, i + 1, F.lit(-(-n // least) + 1)), ""))))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def add(total: Column, i: Column, s: Column) -> Column:
        d = F.ascii(F.substring(s, F.length(s) - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)
    return let(digits, lambda s: F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), F.lit(0), lambda t, i: add(t, i, s)) % 10 == 0)


def mod97(iban: Column) -> Column:
    """True if a string of A-Z and 0-9, its first four characters moved to the end, is 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a < 58, rest * 10 + a - 48).otherwise(rest * 100 + a - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    """Whether a match of the pattern passes its checksum or form."""
    if kind == "ip":
        small = lambda p: F.coalesce(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).try_cast("int"), F.lit(256)) <= 255
        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(hit, " ", "")
        return F.length(plain).between(15, 34) & mod97(plain)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _mentions(near: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(near, F.lit(w))
    return found


def _spans(kind: str, hits: Column, pieces: Column) -> Column:
    """Confirmed spans of a kind: start, rank, kind, end, score; None stays None."""
    before = F.slice(pieces, F.lit(1), F.size(hits))
    starts = running_before(F.zip_with(before, hits, lambda p, h: F.length(p) + F.length(h)))

    def scored(hit: Column, near: Column, after: Column, start: Column) -> Column:
        score = let(F.struct(F.lower(near).alias("b"), F.lower(after).alias("a")), lambda n: F.lit(CONFIRMED[kind])
                    + F.when(_mentions(n["b"], CONTEXT[kind]) | _mentions(n["a"], CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
                    - F.when(_mentions(n["b"], AGAINST), CONTEXT_LOSS).otherwise(0.0))
        return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
                        (start + F.length(hit)).cast("long").alias("end"),
                        F.when(_confirmed(kind, hit), F.least(score, F.lit(1.0))).alias("score"))

    def span(z: Column) -> Column:
        return scored(z["hit"], z["before"], z["after"], z["start"] + F.length(z["piece"]))
    zipped = F.arrays_zip(hits.alias("hit"), before.alias("piece"), starts.alias("start"),
                          texts_before(hits, pieces, NEAR, LEAST).alias("before"), texts_after(hits, pieces, NEAR, LEAST).alias("after"))
    keep = (lambda s: s["score"].isNotNull()) if kind in BASE else (lambda s: s["score"] >= KEEP_AT)
    return F.filter(F.transform(zipped, span), keep)


def find_pii(docs: DataFrame) -> DataFrame:
    """Adds ``spans`` to docs (doc_id, text): an array of (start, rank, kind, end,
    score), by start, then kind. Places are code points, the end exclusive.

    A base kind keeps every match that its checksum or form confirms, whatever
    the score; an added kind (iban, ssn) must reach ``KEEP_AT`` with its context.

    Edge cases: a null or empty text has no spans; a null doc_id, repeated rows
    and other columns pass through untouched, whatever their names, but ``spans`` is
    replaced; an empty table stays empty.
    """
    return apart(docs, ("text",), _find_pii)


def _find_pii(docs: DataFrame) -> DataFrame:
    text = F.col("_pii_text")

    def searched(kind: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return hits if NEEDS[kind] is None else F.when(F.contains(text, F.lit(NEEDS[kind])), hits)
    found = docs.withColumn("_pii_text", text_of()).withColumns({f"_pii_{k}_hits": searched(k) for k in KINDS})
    some = found.withColumns({f"_pii_{k}_pieces": F.when(F.size(f"_pii_{k}_hits") > 0, F.split(text, PATTERNS[k], -1))
                              for k in KINDS})
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>")
    per_kind = [F.when(F.size(f"_pii_{k}_hits") > 0, _spans(k, F.col(f"_pii_{k}_hits"), F.col(f"_pii_{k}_pieces"))
                       ).otherwise(none) for k in KINDS]
    return some.withColumn("spans", F.array_sort(F.concat(*per_kind))).drop(
        "_pii_text", *(f"_pii_{k}_{x}" for k in KINDS for x in ("hits", "pieces")))


def notation(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The text of docs with each span found by ``find_pii`` replaced by its kind
    in angle brackets (of overlapping spans the one that starts first). Null texts stay null."""
    def put(done: Column, s: Column) -> Column:
        fresh = F.substring(F.col("text"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        return F.when(s["start"] < done["at"], done).otherwise(F.struct(
            s["end"].cast("int").alias("at"), F.concat(done["out"], fresh, F.lit("<"), s["kind"], F.lit(">")).alias("out")))
    folded = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put,
                         lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    return apart(docs, ("text",), lambda d: _find_pii(d).withColumn(
        "text", F.when(F.size("spans") > 0, folded).otherwise(F.col("text"))).drop("spans"))
