"""Session settings the engine is tuned for. Any existing session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold at every scale; sizes of partitions stay with the cluster's own defaults.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app_name: str = "studyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
