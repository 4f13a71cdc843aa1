"""Style features, calibration, highlighting, ingest and lookup on hand-made rows."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textsim.constants import STYLE_FEATURES
from textsim.functions.report import highlight_matches
from textsim.functions.style import style_features, style_features_sql
from textsim.operators import calibrate as CAL
from textsim.operators import lookup as LK
from textsim.sources import ingest as ING

TEXTS = [
    (1, None),
    (2, "too short"),
    (3, "This is a simple test. It has three sentences here! Does it work, really?"),
    (4, "First paragraph has words and more words.\n\nSecond paragraph is here, and it is longer than the first one."),
    (5, "And so it goes, and so it goes. However the end is near; moreover, it is done. Yet again we try it."),
    (6, "Café résumé naïve words don't count as ASCII words, but these ones do count. Another sentence is right here."),
]


def test_style_features_match_sql(spark, duck):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    s = {r.doc_id: r for r in style_features(df).collect()}
    duck.register("style_docs", pd.DataFrame(TEXTS, columns=["doc_id", "text"]))
    d = {r[0]: r for r in duck.sql(style_features_sql("style_docs")).fetchall()}
    assert set(s) == set(d)
    for k in s:
        for i, f in enumerate(STYLE_FEATURES):
            assert getattr(s[k], f) == pytest.approx(d[k][i + 1], abs=1e-6), (k, f)
    assert all(getattr(s[1], f) == 0.0 for f in STYLE_FEATURES)
    assert all(getattr(s[2], f) == 0.0 for f in STYLE_FEATURES)
    assert s[4].avg_para_len == pytest.approx((7 + 12) / 2)
    assert s[3].lexical_density == pytest.approx(1 - s[3].func_word_ratio)


def test_threshold_sweep_matches_brute_force(spark):
    rows = [(1, 31.0), (1, 30.99), (0, 30.5), (0, 10.0), (1, 49.5), (0, 49.49), (1, 12.25)]
    scored = spark.createDataFrame(rows, "label int, overall double")
    got = {r.t2: (r.tp, r.fp, r.accuracy) for r in CAL.threshold_sweep(spark, scored).collect()}
    assert len(got) == 80
    for t2 in range(20, 100):
        t = t2 / 2
        tp = sum(1 for l, s in rows if l == 1 and s >= t)
        fp = sum(1 for l, s in rows if l == 0 and s >= t)
        acc = sum(1 for l, s in rows if (s >= t) == (l == 1)) / len(rows)
        assert got[t2] == (tp, fp, pytest.approx(acc))


def test_weight_grid_has_fifty_feasible_cells(spark):
    assert CAL.weight_cells(spark).count() == 50


def test_highlight_first_occurrence_and_nesting(spark):
    m = "array<struct<source_sentence:string,similarity:double>>"
    df = spark.createDataFrame([("a <b> a", [("a", 0.95), ("<b>", 0.85), ("zz", 0.75)]), ("plain", [])],
                               f"text string, matches {m}")
    out = [r.h for r in df.select(highlight_matches(F.col("text"), F.col("matches")).alias("h")).collect()]
    assert out[0].count("<span") == 2 and out[0].endswith(" a") and "&lt;b&gt;</span>" in out[0]
    assert 'title="Similarity: 95% (High)"' in out[0] and 'title="Similarity: 85% (Medium)"' in out[0]
    assert out[1] == "<p>plain</p>"


def test_ingest_encodings_and_rejects(spark):
    d = tempfile.mkdtemp(prefix="textsim-ingest-")
    files = {"u.txt": "héllo wörld".encode("utf-8"), "bom.txt": "﻿hi".encode("utf-8"),
             "l1.txt": "caf\xe9".encode("latin-1"), "x.csv": b"a,b", "doc.PDF": b"%PDF-1.4"}
    for n, b in files.items():
        with open(os.path.join(d, n), "wb") as fh:
            fh.write(b)
    docs, rejects = ING.ingest(ING.read_files(spark, d))
    got = {os.path.basename(r.path): (r.text, r.status) for r in docs.collect()}
    assert got["u.txt"] == ("héllo wörld", "ok")
    assert got["bom.txt"] == ("﻿hi", "ok")
    assert got["l1.txt"] == ("café", "ok")
    assert got["doc.PDF"] == (None, "no extractor")
    assert [os.path.basename(r.path) for r in rejects.collect()] == ["x.csv"]
    info = {r.name: (r.extension, r.size_readable) for r in ING.file_info(ING.read_files(spark, d)).collect()}
    assert info["doc.PDF"] == (".pdf", "0.0 KB")


def test_lookup_finds_contained_queries(spark):
    docs = spark.createDataFrame([(1, "Short one. This sentence has more than six words in it for sure. "
                                      "Another long sentence that will not be found anywhere at all today.")],
                                 "doc_id long, text string")
    src = spark.createDataFrame([("s1", "t1", "", "prefix This sentence has more than six words in it for sure. suffix"),
                                 ("s2", "t2", "", "unrelated body text with many words")],
                                "link string, title string, snippet string, body string")
    q = LK.query_sentences(docs)
    assert q.count() == 2
    hits = LK.lookup(q, src).collect()
    assert [(h.link, h.q_idx) for h in hits] == [("s1", 1)]


def test_pairs_read_the_texts_twice_and_not_once_a_sample(spark):
    """The seven types come from the ids drawn first, and are those of samples taken from the whole table."""
    from functools import reduce

    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from textsim.operators import generate as G

    text = F.concat(F.lit("One sentence about number "), F.col("id").cast("string"), F.lit(". Two more words here and there. Three, the end of it. Four is it! "),
                    F.repeat(F.lit("more "), (F.col("id") % 11).cast("int")))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 3 > 0).cast("int").alias("label"))
    rows = rows.unionByName(rows.where("doc_id < 9")).unionByName(rows.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    n = rows.count()
    got = sorted(map(tuple, G.labelled_pairs(rows.mapInArrow(count, rows.schema)).collect()))
    assert seen.value == 2 * n
    ai, human = G.pools(rows)
    parts = [G.gen_identical(ai), G.gen_shuffle(ai), G.gen_partial_copy(ai, human), G.gen_unrelated(ai, human), G.gen_minor_edit(ai), G.gen_word_swap(ai)]
    assert got == sorted(map(tuple, reduce(DataFrame.unionByName, parts).collect())) and len(got) == 280


def test_files_are_written_by_all_cores_and_read_by_few_tasks(spark, tmp_path):
    import re

    from textsim.plans import io_queries as IO

    rows = [(i, f"text {i}", "web") for i in range(40)] + [(3, "text 3", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    files = ING.read_files(spark, IO._write_files(spark, str(tmp_path)))
    found = [r.path for r in files.where("path like '%/txt/%'").select("path").collect()]
    assert len(found) == 40 and len({re.search(r"part-(\d+)", p).group(1) for p in found}) > 1
    assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    texts = {r.doc_id: r.n_chars for r in IO.q_ingest_text(spark, str(tmp_path)).collect()}
    assert texts == {**{i: len(f"text {i}\n") for i in range(40)}, 3: 14}


def test_files_equal_those_of_sparks_writer_without_sidecars(spark, tmp_path):
    import glob
    import os
    from urllib.parse import unquote

    from textsim.plans import io_queries as IO

    rows = [("1", "one"), ("2", None), (None, "no id"), ("a/b=c", "é\nnext"), ("7", "first"), ("7", "second"), ("8", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    docs.write.partitionBy("doc_id").text(f"{tmp_path}/spark")
    IO._write_to_folder(docs, f"{tmp_path}/own")

    def files(at):
        found = glob.glob(f"{tmp_path}/{at}/doc_id=*/part-*")
        return {os.path.basename(os.path.dirname(f)): sorted(open(f, "rb").read().split(b"\n")) for f in found}
    assert files("own") == files("spark") and len(files("own")) == 6 and "a/b=c" in {unquote(k)[7:] for k in files("own")}
    spark.createDataFrame([(i, f"text {i}", "web") for i in range(5)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    base = IO._write_files(spark, str(tmp_path)).removeprefix("file:")
    # Hadoop's local file system started a process for every file and directory, and wrote a checksum beside each
    assert len(glob.glob(f"{base}/txt/doc_id=*/part-*")) == 5 and not glob.glob(f"{base}/txt/**/.*.crc", recursive=True)
