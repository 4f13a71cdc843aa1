"""Spark session helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "textsim",
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE (coalescing, skew-join splitting) and the UI off."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is only read here; a
    scratch folder is chosen only when it is unset (local runs and tests).
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="textsim-ckpt-")
    os.makedirs(d, exist_ok=True) if "://" not in d else None
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB from now on, for rows that hold a whole block; a smaller limit stays.

    Spark's 64 MB, in vectors that double as they grow, are several hundred MB outside of an executor's heap.
    No result depends on it.
    """
    limit = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(_BATCH, None) or "").lower())
    if not limit or not 0 < int(limit[1]) << 10 * " kmg".index(limit[2] or " ") <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df, name: str, **options):
    """Write ``df`` as a parquet table under the checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of recomputing
    upstream stages), computes the plan once, and -- unlike an RDD checkpoint --
    lets later scans prune columns and push filters.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/textsim-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)
