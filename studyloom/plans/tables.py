"""Reading the named tables of a folder, and sending the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let executors import this package, once a session, wherever they and the driver were started."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    archive = Path(tempfile.mkdtemp(prefix="studyloom-package-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))  # the driver hands it out
    _sent.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Lazy scan of ``folder/name.parquet``; filters and columns reach the scan."""
    send_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
