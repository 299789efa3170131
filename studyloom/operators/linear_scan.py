"""Secondary sort with a single scan per partition.

Rows are range-partitioned on the full sort key, so a group that holds a third of all rows is
split over many partitions instead of filling one; each partition is scanned once in order. What
a scan emits at the two edges of its partition may continue in a neighbour; those pieces (two a
partition) are marked so that a later, tiny step can join them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def secondary_sort(df: DataFrame, *keys: str) -> DataFrame:
    """Range partitions on all ``keys``, sorted by them."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def scan_groups(df: DataFrame, order: list[str], schema: str, fold: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """For each group of equal first column: ``fold`` of its rows, which come in ``order``, one scan a partition.

    For folds whose groups have a proven bound (a learner's candidates), without the cost of a frame
    for each group. There are as many partitions as a shuffle has, since folds take time rather than
    space. Null keys are a group.
    """
    key = df.columns[0]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in it:
            out: list[tuple] = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += fold(held)
                    held = []
                held.append(row)
            if out:
                yield packed(out)
        if held and (out := fold(held)):
            yield packed(out)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
