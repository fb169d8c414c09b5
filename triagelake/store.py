"""Staged tables: lineage is cut by writing parquet to the cluster's shared folder.

An executor that is lost afterwards costs nothing but a re-read, and a plan that reads the same
intermediate twice computes it once. The folder is `spark.checkpoint.dir` where the cluster names
one; only where it is unset and the master is local (tests, a laptop) a local folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir, made once and removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder: a machine's own would lose staged tables")
            base = "file://" + tempfile.mkdtemp(prefix="triagelake-")
        root = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
        _ROOTS[app] = root
        atexit.register(_remove, spark, root)
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Remove one staged table that is needed no more."""
    _remove(spark, path)


def stage_path(df: DataFrame, name: str) -> str:
    """Write df as parquet into the shared folder and give its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: what follows starts from files, not from lineage."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(stage_path(df, name))
