"""Runs of repeated consecutive events, each collapsed into one event with count and duration.

Within an entity's sequence, the row number minus the row number among rows of the same value is
constant exactly along a run: between two runs of a value the first number grows and the second
doesn't. Runs are therefore the groups of equal entity, value and difference.

Rows are range-partitioned on the full sort key, so no entity has to fit in one task. A scan numbers
the rows of its partition batch by batch (it keeps the numbers of the one entity that a batch leaves
open) and aggregates each batch by entity, value and difference. Both numbers count from the start of
the partition, which shifts all differences of an entity and value alike. Only runs that touch a
partition's edge (two pieces a partition) can go on elsewhere; they are grouped once more by the
difference of their numbers among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.keys import iso_micros, joined_words
from studyloom.operators.linear_scan import secondary_sort
from studyloom.staging import stage

_PIECE = "entity string, value binary, seq long, first_rec_id long, lo_rec_id long, hi_rec_id long, first_us long, last_us long, n_events long, place long, edge boolean"
_PIECE_ARROW = pa.schema(
    [("entity", pa.string()), ("value", pa.binary()), *((c, pa.int64()) for c in ("seq", "first_rec_id", "lo_rec_id", "hi_rec_id", "first_us", "last_us", "n_events", "place")), ("edge", pa.bool_())]
)
_NONE_LOW, _NONE_HIGH = 2**63 - 1, -(2**63)


class _Numbers:
    """Row numbers within entity and within entity and value, carried from batch to batch of one sorted partition."""

    def __init__(self) -> None:
        self.entity: str | None = None
        self.rows = 0
        self.of_value: dict[bytes, int] = {}

    def groups(self, entity: pa.DictionaryArray, value: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the batch's rows in which equal entity, value and difference stand together, where each group begins in it, and each group's difference."""
        names = entity.dictionary.to_pylist()
        spelled = lambda codes: value.dictionary.take(pa.array(codes)).to_pylist()
        e, v = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (entity, value))
        n, width = len(e), len(value.dictionary)
        first = np.searchsorted(e, np.arange(len(names)))  # codes rise, since rows are sorted by entity
        in_entity = np.arange(n) - first[e]
        pair = e * width + v
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        start = np.flatnonzero(np.r_[True, sorted_pair[1:] != sorted_pair[:-1]])
        size = np.diff(np.append(start, n))
        in_value = np.arange(n) - np.repeat(start, size)  # in the new order
        in_entity = in_entity[order]
        goes_on = names[0] == self.entity
        if goes_on:
            open_ = np.flatnonzero(sorted_pair[start] < width)
            rows = int(size[open_].sum())
            in_entity[:rows] += self.rows
            in_value[:rows] += np.repeat([self.of_value.get(x, 0) for x in spelled(sorted_pair[start[open_]])], size[open_])
        island = in_entity - in_value
        begin = np.flatnonzero(np.r_[True, (sorted_pair[1:] != sorted_pair[:-1]) | (island[1:] != island[:-1])])
        if not (goes_on and len(names) == 1):
            self.entity, self.rows, self.of_value = names[-1], 0, {}
        last = np.flatnonzero(sorted_pair[start] >= (len(names) - 1) * width)
        self.rows += int(size[last].sum())
        for x, k in zip(spelled(sorted_pair[start[last]] % width), size[last].tolist()):
            self.of_value[x] = self.of_value.get(x, 0) + k
        return order, begin, island[begin]


def _scan(keep: int):
    """One pass over a sorted partition; holds one batch, one open run and the numbers of one entity's values."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, place = _Numbers(), None, 0

        def one(run: list, edge: bool) -> pa.RecordBatch:
            entity, value, _, *rest = run
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((entity, value, *rest, place, edge), _PIECE_ARROW)], schema=_PIECE_ARROW)

        for batch in it:
            if not batch.num_rows:
                continue
            order, begin, island = numbers.groups(batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode())
            seq, rec, at = (batch.column(i).to_numpy(zero_copy_only=False)[order] for i in (2, 3, 4))
            length = np.diff(np.append(begin, batch.num_rows))
            known = np.where(at == _NONE_HIGH, _NONE_LOW, at)
            cells = [seq[begin], rec[begin], np.minimum.reduceat(rec, begin), np.maximum.reduceat(rec, begin), np.minimum.reduceat(known, begin), np.maximum.reduceat(at, begin), length]
            where = order[begin]  # a group's first row in the batch
            by_place = np.argsort(where)
            where, island, cells = where[by_place], island[by_place], [c[by_place] for c in cells]

            def run_at(i: int) -> list:
                at_row = int(where[i])  # noqa: B023
                return [batch.column(0)[at_row].as_py(), batch.column(1)[at_row].as_py(), int(island[i]), *(int(c[i]) for c in cells)]  # noqa: B023

            start = run_at(0)
            if held is not None:
                if held[:3] == start[:3]:
                    for c, x, join in zip(cells, held[3:], (None, None, min, max, min, max, int.__add__)):
                        c[0] = join(x, int(c[0])) if join else x
                else:
                    if place == 0 or held[-1] >= keep:
                        yield one(held, place == 0)
                    place += 1
            held = run_at(len(where) - 1)
            if len(where) > 1:
                edge = np.zeros(len(where) - 1, bool)
                edge[0] = place == 0
                places = place + np.arange(len(edge))
                place += len(edge)
                shown = np.flatnonzero(edge | (cells[-1][:-1] >= keep))
                if len(shown):
                    rows = pa.array(where[shown])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows).cast(pa.string()), batch.column(1).take(rows).cast(pa.binary()), *(pa.array(c[shown], pa.int64()) for c in cells), pa.array(places[shown], pa.int64()), pa.array(edge[shown])], schema=_PIECE_ARROW)
        if held is not None:
            yield one(held, True)

    return scan


_NEEDED = ["entity", "value", "seq", "rec_id"]


def _rows(events: DataFrame) -> DataFrame:
    kinds = dict(zip(_NEEDED, ("string", "binary", "long", "long")))
    return events.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()), F.coalesce(F.col("at_us").cast("long"), F.lit(_NONE_HIGH)).alias("at_us"))


def collapse_runs(events: DataFrame, keep: int = 1) -> DataFrame:
    """Runs of ``events(entity string, value binary, seq long, rec_id long, at_us long)``.

    Rows are ordered by ``seq, rec_id`` within an entity; ``rec_id`` must be unique. A run is a
    longest stretch of neighbours with equal ``value``. Result, for runs of at least ``keep``
    events: ``entity, value, seq`` (of the first), ``lo_rec_id, hi_rec_id, first_us, last_us,
    duration_us, n_events``. Rows with a null entity, value, seq or rec_id aren't in a sequence. A
    null time counts as unknown: times and duration are null where no event of the run has one.
    Empty input gives no rows.
    """
    return _runs_of(secondary_sort(_rows(events).dropna(subset=_NEEDED), "entity", "seq", "rec_id"), keep)


def _runs_of(sorted_rows: DataFrame, keep: int) -> DataFrame:
    pieces = stage(sorted_rows.mapInArrow(_scan(keep), _PIECE), "run-pieces")
    # Pieces at the edges, at most two a partition, in order. A partition's second piece never continues
    # its first (rows of other runs may lie between), so one number is left out before it.
    order = Window.partitionBy("entity").orderBy("seq", "first_rec_id")
    edges = pieces.where("edge")
    number = F.row_number().over(order) + F.sum((F.col("place") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    island = number - F.row_number().over(Window.partitionBy("entity", "value").orderBy("seq", "first_rec_id"))
    joined = (
        edges.withColumn("island", island)
        .groupBy("entity", "value", "island")
        .agg(F.min("seq").alias("seq"), F.min("lo_rec_id").alias("lo_rec_id"), F.max("hi_rec_id").alias("hi_rec_id"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n_events").alias("n_events"))
        .where(F.col("n_events") >= keep)
    )
    columns = ("entity", "value", "seq", "lo_rec_id", "hi_rec_id", "first_us", "last_us", "n_events")
    runs = pieces.where("not edge").select(*columns).unionByName(joined.select(*columns))
    timed = F.col("last_us") != F.lit(_NONE_HIGH)
    first, last = F.when(timed, F.col("first_us")), F.when(timed, F.col("last_us"))
    return runs.select("entity", "value", "seq", "lo_rec_id", "hi_rec_id", first.alias("first_us"), last.alias("last_us"), (last - first).alias("duration_us"), "n_events")


def repeated_errors(profile_events: DataFrame, keep: int = 2) -> DataFrame:
    """Runs of the same error on the same task in each learner's sequence; see :func:`collapse_runs`.

    The value is tag and task in one spelling. It and the time are made after the sort, since the
    range partitioning reads its input twice.
    """
    raw = profile_events.select(F.col("student_id").cast("string").alias("entity"), F.col("attempt_seq").cast("long").alias("seq"), F.col("rec_id").cast("long").alias("rec_id"), "tag", "task_id", "ts").dropna(subset=["entity", "seq", "rec_id", "tag", "task_id"])
    value = F.concat(joined_words("tag"), F.lit("\u0001"), joined_words("task_id"))
    named = secondary_sort(raw, "entity", "seq", "rec_id").select("entity", value.alias("value"), "seq", "rec_id", iso_micros("ts").alias("at_us"))
    return _runs_of(_rows(named), keep)
