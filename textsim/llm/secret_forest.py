"""Secret scans: candidate strings, then a random forest that removes false positives.

Candidates are runs of key-like characters that hold a digit. The forest looks at
their length, character transitions, dictionary coverage, path and neighbouring
words. It is trained with Spark ML on labelled findings and then written out as
one native expression, so a text is searched, judged and redacted in its own
row: no UDF, no explode, no shuffle.

The tables hold no labelled findings; ``example_findings`` makes a fixed set of
them from templates (a rule, ``N_EXAMPLES`` rows). Pass your own as ``findings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsim.llm.pii import running_before, texts_after, texts_before
from textsim.llm.words import apart, let, text_of

CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,256}[0-9])[A-Za-z0-9_+/-]{12,}+={0,2}"
LEAST = 12               # characters of the shortest candidate
BEFORE, AFTER = 40, 16
SECRET_AT = 0.5
TREES, DEPTH, N_EXAMPLES = 15, 6, 4_000

# Words that a dictionary check counts, and words near a finding.
DICTIONARY = ("access", "admin", "api", "asset", "change", "class", "commit", "config", "data", "default", "demo", "dummy", "example",
              "fake", "file", "foo", "bar", "image", "index", "key", "name", "none", "page", "password", "path", "placeholder", "release",
              "sample", "secret", "server", "string", "table", "test", "todo", "token", "user", "value", "version", "your")
KEY_WORDS = "api[_ -]?key|access[_ -]?key|token|secret|passw|pwd|passphrase|credential|bearer|auth|private[_ -]?key"
HASH_WORDS = "sha-?[0-9]|md5|checksum|digest|hash|commit|revision|etag|uuid|guid|fingerprint"
NUMBER_WORDS = "order|invoice|card|phone|call|isbn|serial|account|number|item|build"


def features(value: Column, before: Column, after: Column) -> Column:
    """The forest's input, an array of doubles."""
    n = F.length(value).cast("double")
    share = lambda gone: (n - F.length(F.regexp_replace(value, gone, ""))) / n
    near = F.lower(before)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    changes = F.length(F.regexp_replace(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", "~")) - F.length(value)
    cases = F.length(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])", "~")) - F.length(value)
    repeats = n - F.length(F.regexp_replace(value, "(.)(?=\\1)", ""))
    words = F.length(value) - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), ""))
    return F.array(
        n, share("[0-9]"), share("[A-Za-z]"), share("[A-F]"), share("[aeiouAEIOU]"), share("[_+/=-]"),
        F.size(F.array_distinct(F.split(value, ""))) / n,                       # distinct characters
        changes / n, cases / n, repeats / n,                                     # transitions
        words / n,                                                               # dictionary coverage
        flag(value.rlike("^[0-9]+$")), flag(value.rlike("^[0-9a-fA-F]+$")),
        flag(value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-")),
        flag(value.rlike("/.*/") | before.rlike("[/.]$") | after.rlike("^\\.[a-z]{2,5}\\b")),   # path
        flag(near.rlike(f"({KEY_WORDS})[a-z0-9_]*[\"']?\\s*(is|:|=|:=|=>)?\\s*[\"']?(bearer )?$")), flag(near.rlike(KEY_WORDS)),
        flag(near.rlike(HASH_WORDS)), flag(near.rlike(NUMBER_WORDS)),            # neighbouring words
        flag(before.rlike("[=:]\\s*[\"']?$")), flag(before.rlike("[\"']$") & after.rlike("^[\"']")))


def example_findings(spark: SparkSession, n: int = N_EXAMPLES) -> DataFrame:
    """A fixed set of labelled findings: before, value, after, label (1: a secret)."""
    i = F.col("id")
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    h = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    size = pick([16, 18, 20, 24, 32, 40, 64], "size")
    hexed = F.substring(h, F.lit(1), size)
    coded = F.concat(F.substring(b64, F.lit(1), F.least(size, F.lit(36))), F.lit("7"))
    number = F.rpad(F.substring(F.regexp_replace(h, "[a-f]", ""), F.lit(1), pick([12, 13, 15, 16, 19], "digits")), 12, "3")
    uuid = F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.*)$", "$1-$2-$3-$4-$5")
    prefixed = F.concat(pick(["AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"], "prefix"), F.substring(b64, 1, 30), F.lit("4"))
    dull = F.concat(pick(["your-api-key-", "example_token_", "changeme-password", "sample-value-", "test-secret-key-", "xxxxxxxxxxxxxx",
                          "dummy_user_", "placeholder-"], "dull"), pick(["1", "123", "0000", "12345"], "tail"))
    named = F.concat(pick(["release-version-", "assets/img/logo-", "page/index/item-", "class_table_name_", "thonening", "heitschaft/", "docs/2024/file-"],
                          "named"), F.substring(h, 1, 3), F.lit("9"))
    start = pick(["", "and the ", "const ", "export ", "thon the ", "de la ", "x = 1; ", "\n", "# "], "start")
    key = F.concat(pick(["token", "password", "api_key", "API_TOKEN", "secret", "aws_secret_access_key", "passwd", "auth_token", "TOKEN",
                         "client_secret", "PASSWORD"], "key"), pick([" = \"", "=", ": ", ": \"", "=\"", " = '"], "sign"))
    plain = pick(["the ", "of and ", "erin onth ", "der ", "que ", "- ", "(", "\n", "en la "], "plain")
    sums = F.concat(pick(["sha256", "md5", "commit", "checksum", "etag", "sha1 digest", "hash", "uuid", "fingerprint"], "sum"), pick([": ", " = ", " ", " \""], "colon"))
    numbers = F.concat(pick(["order ", "card ", "call ", "invoice no ", "isbn ", "account ", "the ", "in ", "item "], "number"))
    after = pick(["\"", " ", "\n", "\";", " and", "."], "after")
    kinds = [  # before, value, label
        (F.concat(start, key), hexed, 1), (F.concat(start, key), coded, 1), (F.concat(start, key), prefixed, 1),
        (F.concat(start, plain), prefixed, 1), (F.concat(start, F.lit("Authorization: Bearer ")), coded, 1),
        (F.concat(start, sums), hexed, 0), (F.concat(start, sums), uuid, 0), (F.concat(start, key), dull, 0),
        (F.concat(start, numbers), number, 0), (F.concat(start, plain), named, 0), (F.concat(start, plain), number, 0), (F.concat(start, plain), uuid, 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    choose = lambda place: F.element_at(F.array(*[F.lit(k[place]) if place == 2 else k[place] for k in kinds]), (kind + 1).cast("int"))
    return spark.range(n).select(choose(0).alias("before"), choose(1).alias("value"), after.alias("after"), choose(2).alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list:
    """The forest as nested tuples (feature, threshold, low, high) or a leaf's share of
    secrets, from findings (before, value, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.where(F.col("label").isNotNull() & (F.length("value") > 0)).select(
        array_to_vector(features(F.col("value"), text_of("before"), text_of("after"))).alias("features"), F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.coalesce(2))

    def walk(node):
        if node.subtreeDepth() == 0:
            stats = node.impurityStats().stats()
            return float(stats[1] / (stats[0] + stats[1]))
        split = node.split()
        return split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())
    return [walk(t._call_java("rootNode")) for t in model.trees]


def vote(x: Column, forest: list) -> Column:
    """Mean share of secrets over the trees, for an array of features."""
    def tree(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        at, threshold, low, high = node
        return F.when(F.get(x, F.lit(at)) <= threshold, tree(low)).otherwise(tree(high))
    total = F.lit(0.0)
    for t in forest:
        total = total + tree(t)
    return total / len(forest)


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, secret_at: float = SECRET_AT) -> DataFrame:
    """Adds to docs (text): n_candidates, and secrets, an array of (start, end, score)
    in code points, end exclusive, of the candidates that score ``secret_at`` or more.

    Edge cases: a null, empty or blank text has no candidates; a run of key
    characters of any length is one candidate; repeated rows are judged alike; an
    empty table stays empty; other columns pass through, whatever their names, but
    ``n_candidates`` and ``secrets`` are replaced; findings with a null
    label or an empty value are not learned from.
    """
    return apart(docs, ("text",), lambda d: _find_secrets(d, findings, secret_at))


def _find_secrets(docs: DataFrame, findings: DataFrame | None, secret_at: float) -> DataFrame:
    forest = train(findings if findings is not None else example_findings(docs.sparkSession))
    found = docs.withColumn("_sec_text", text_of()).withColumn(
        "_sec_hits", F.regexp_extract_all("_sec_text", F.lit(CANDIDATE), F.lit(0)))
    some = found.withColumn("_sec_pieces", F.when(F.size("_sec_hits") > 0, F.split("_sec_text", CANDIDATE, -1)))
    hits, pieces = F.col("_sec_hits"), F.col("_sec_pieces")
    ahead = F.slice(pieces, F.lit(1), F.size(hits))
    zipped = F.arrays_zip(hits.alias("value"), ahead.alias("piece"), texts_before(hits, pieces, BEFORE, LEAST).alias("before"),
                          texts_after(hits, pieces, AFTER, LEAST).alias("after"),
                          running_before(F.zip_with(ahead, hits, lambda p, v: F.length(p) + F.length(v))).alias("start"))

    def judged(z: Column) -> Column:
        start = (z["start"] + F.length(z["piece"])).cast("long")
        score = let(features(z["value"], z["before"], z["after"]), lambda x: vote(x, forest))
        return F.struct(start.alias("start"), (start + F.length(z["value"])).alias("end"), score.alias("score"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,score:double>>")
    return some.withColumn("n_candidates", F.size(hits).cast("long")).withColumn(
        "secrets", F.when(F.size(hits) > 0, F.filter(F.transform(zipped, judged), lambda s: s["score"] >= secret_at)).otherwise(none)
    ).drop("_sec_text", "_sec_hits", "_sec_pieces")


def redact(docs: DataFrame, findings: DataFrame | None = None, secret_at: float = SECRET_AT, put: str = "<secret>") -> DataFrame:
    """The text of docs with each secret replaced; all other columns and null texts as they are."""
    def fold(done: Column, s: Column) -> Column:
        fresh = F.substring(F.col("text"), done["at"] + 1, (s["start"] - done["at"]).cast("int"))
        return F.struct(s["end"].cast("int").alias("at"), F.concat(done["out"], fresh, F.lit(put)).alias("out"))
    whole = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), fold,
                        lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    return apart(docs, ("text",), lambda d: _find_secrets(d, findings, secret_at).withColumn(
        "text", F.when(F.size("secrets") > 0, whole).otherwise(F.col("text"))).drop("n_candidates", "secrets"))
