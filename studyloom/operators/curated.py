"""Curated tables beside tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, curated: DataFrame) -> DataFrame:
    """Each row of ``df`` with each row of a short curated table, which is packed into one row and sent along.

    For results that have a row for every learner and atom; the table is one that people write.
    """
    packed = curated.agg(F.collect_list(F.struct(*curated.columns)).alias("packed_"))
    return df.crossJoin(F.broadcast(packed)).select(*df.columns, F.inline("packed_"))
