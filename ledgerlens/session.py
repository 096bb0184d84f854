"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerlens") -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the caller brings its own session; nothing here is required.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset (local tests) do we pick a
    scratch folder of our own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its nodes share")
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` once as parquet in the shared checkpoint folder and
    read it back: lineage is cut, lost executors re-read files instead of
    recomputing, and the work runs once (a reliable RDD checkpoint would run
    the plan twice: once to count, once to write).
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder as a table bucketed by
    ``key``: sums by the key, or by it and more columns, need no exchange. The
    table is external, and known to this session's catalog only by its name."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), table)
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


_SHARED: dict[tuple, object] = {}


def files_version(*tables: DataFrame) -> tuple:
    """The files that tables are read from, with their sizes and times, as two numbers a table."""
    out = []
    for t in tables:
        files = t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        out.append(tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first()))
    return tuple(out)


def shared(spark: SparkSession, key: tuple, build: Callable[[], object]):
    """What ``build`` returns, built once per application and ``key``. For written
    tables and indexes over inputs that many queries read; the key names the
    inputs (with ``files_version``) and all parameters."""
    own = (spark.sparkContext.applicationId, *key)
    if own not in _SHARED:
        _SHARED[own] = build()
    return _SHARED[own]
