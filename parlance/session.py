"""Spark session and checkpoint-directory helpers.

Library code never hard-codes a local folder: iterative operators cut
lineage with ``DataFrame.checkpoint()`` into the directory named by the
session's ``spark.checkpoint.dir``.  Only a local session (tests, bench)
gets a scratch folder when that setting is missing.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "parlance") -> SparkSession:
    """A local session for tests and the bench script."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it
    as given.  Only when it is unset and the master is local do we create a
    scratch folder (tests).  On a cluster an unset value is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
    path = tempfile.mkdtemp(prefix="parlance-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Cut the lineage of an iterative step by writing it as a parquet table under the shared
    checkpoint folder and reading it back (never a local checkpoint): the result survives the loss
    of an executor, and its size statistics come from the files — a ``checkpoint()``ed frame would
    carry the size estimate of its whole origin plan forward, which grows without bound over many
    iterations of joins.  ``release`` deletes the table once nothing reads it any more."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return bool(fs.exists(p))


def release(*frames) -> None:
    """Delete the tables of frames that came from ``cut_lineage`` (others are left alone).  Call it when
    whatever was computed from them has itself been written."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            p, fs = _file_system(df.sparkSession, path)
            fs.delete(p, True)
            df._written_to = None


def release_rdd(spark: SparkSession, *rdds) -> None:
    """Delete what ``checkpoint`` wrote of RDDs that nothing reads any more."""
    for rdd in rdds:
        path = rdd.getCheckpointFile()
        if path:
            p, fs = _file_system(spark, path)
            fs.delete(p, True)
