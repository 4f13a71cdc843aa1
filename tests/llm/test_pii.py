import hashlib
import re

from pyspark.sql import functions as F

from textsim.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, kind in enumerate(pii.BASE):
        for m in re.finditer(pii.PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


CASES = [
    None, "", "   ", "a@b.c", "a@b.c_d@e.f x@y", "..a@b..c@d.e.f-g", "x a.b+c%d@mail-1.example.com.", "é@é.fr é ab@cd.fr",
    "1.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8 001.02.255.0", "9999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111111111111111", "0" * 12, "0" * 19, "0" * 20, "12 34", "+1 (555) 123-4567 +49 30 1234567 +1 2", "+1(((((((", "++12345678901",
    "üü +1 555 123 4567 ö 1.2.3.4 ü a@b.de " * 3, "4111 1111 1111 1111" + " 5" * 3, "7" * 30000, "a" * 30000, "1.2.3.4 " * 500,
    "a.b" * 5000 + "@c" + ".d" * 5000, "1 2-3 " * 3000, "@" * 2000, "+" * 2000 + "1234567890",
]


def test_base_spans_match_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).withColumn(
        "base", F.filter("spans", lambda s: s["rank"] < 4)).select("doc_id", pii.notation(F.col("base")).alias("n")).collect()}
    for i, text in enumerate(CASES):
        assert got[i].n == ",".join(brute(text)), (i, (text or "")[:60])


def test_documents_match_brute_force(spark):
    from textsim.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_pii"](spark, sf).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_email == sum(x.startswith("email") for x in base)
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_added_kinds_need_checksum_or_context(spark):
    df = spark.createDataFrame([(1, "account DE89 3704 0044 0532 0130 00, yes"), (2, "DE88 3704 0044 0532 0130 00"),
                                (3, "my SSN is 123-45-6789."), (4, "code 123-45-6789"), (5, "ssn 000-45-6789")], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_pii(df).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: []}


def test_redact_and_edges(spark):
    df = spark.createDataFrame([(1, "mail a@b.de or 1.2.3.4!", "x"), (None, None, "y"), (2, "", None)], "doc_id long, text string, kind string")
    got = [tuple(r) for r in pii.redact(df).orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert got == [(1, "mail <email> or <ip>!", "x"), (2, "", None), (None, None, "y")]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_context_reaches_past_other_matches(spark):
    texts = ["SSN: 123-45-6789, 223-45-6789", "123-45-6789 and 223-45-6789 are the SSNs", "123-45-6789, 223-45-6789", "+1 22 +1 22 " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind) for s in r.spans if s.kind == "ssn"] for r in pii.find_pii(df).collect()}
    assert got == {0: [(5, "ssn"), (18, "ssn")], 1: [(0, "ssn"), (16, "ssn")], 2: [], 3: []}


def test_windows_are_those_of_the_whole_text(spark):
    texts = ["", "1.2.3.4", "ü 1.2.3.4 ö5.6.7.8 9.9.9.9", "1.2.3.4 " * 30 + "é" * 60 + "1.2.3.4" + " ü1.2.3.4" * 9]
    p = pii.PATTERNS["ip"]
    hits, pieces = F.regexp_extract_all("text", F.lit(p), F.lit(0)), F.split("text", p, -1)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", pii.texts_before(hits, pieces, 48, 4).alias("b"), pii.texts_after(hits, pieces, 48, 4).alias("a")).collect()
    for r in rows:
        spans = [m.span() for m in re.finditer(pii.PLAIN["ip"], r.text)]
        assert r.b == [r.text[max(0, s - 48):s] for s, _ in spans] and r.a == [r.text[e:e + 48] for _, e in spans]
