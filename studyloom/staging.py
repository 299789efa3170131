"""Tables written to the cluster's shared folder, to cut lineage and to read a result more than once.

The folder is the one named by ``spark.checkpoint.dir``. Only where that setting is absent on a single
machine (master ``local``, as in tests) a temporary folder of this process is used; a cluster without it is an error,
as each executor would write to a disk of its own. Files written there survive the
loss of any executor; they are removed when the Python process ends, or by :func:`release`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="studyloom-"))
        named = _own_root[0]
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed at the end of the process."""
    path = f"{shared_root(spark)}/studyloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Remove everything written so far. DataFrames that still read it must not be used afterwards."""
    while _written:
        session, path = _written.pop()
        try:
            jvm = session.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(release)
