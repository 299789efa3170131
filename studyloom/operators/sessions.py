"""Sessions separated by gaps of inactivity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.keys import iso_micros, micros_of, uuid_key
from studyloom.operators.linear_scan import secondary_sort
from studyloom.operators.messages import message_identity
from studyloom.staging import stage

GAP_US = 30 * 60 * 1_000_000
_PIECES = pa.schema([("user_id", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("n_moments", pa.int64()), ("edge", pa.bool_())])


def _scan(gap_us: int):
    """Emit the sessions of one sorted partition; memory is one batch and one open session."""

    def batches(users: list, starts: list, ends: list, counts: list, edges: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(users, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(counts, pa.int64()), pa.array(edges, pa.bool_())], schema=_PIECES)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the open session: user, start, end, moments
        first = True
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            user, at = batch.column(0).cast(pa.string()), batch.column(1).to_numpy()
            fresh = np.empty(n, bool)
            fresh[0] = True
            if n > 1:
                other = pc.not_equal(user.slice(1), user.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                fresh[1:] = other | (np.diff(at) > gap_us)
            begin = np.flatnonzero(fresh)
            last = np.append(begin[1:], n) - 1
            starts, ends, counts = at[begin], at[last].copy(), (last - begin + 1).copy()
            names = user.take(pa.array(begin)).to_pylist()
            if held is not None:
                if held[0] == names[0] and starts[0] - held[2] <= gap_us:
                    starts = starts.copy()
                    starts[0] = held[1]
                    counts[0] += held[3]
                else:
                    yield batches([held[0]], [held[1]], [held[2]], [held[3]], [first])
                    first = False
            held = (names[-1], int(starts[-1]), int(ends[-1]), int(counts[-1]))
            if len(names) > 1:
                edge = np.zeros(len(names) - 1, bool)
                edge[0] = first
                first = False
                yield batches(names[:-1], starts[:-1], ends[:-1], counts[:-1], edge)
        if held is not None:
            yield batches([held[0]], [held[1]], [held[2]], [held[3]], [True])

    return scan


def sessionize(moments: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Sessions of ``moments(user_id string, at_us long)``: ``user_id, start_us, end_us, duration_us, n_moments``.

    Neighbouring moments more than ``gap_us`` apart are in different sessions; equal times and a
    single moment are fine. Rows with a null user or time don't count. Empty input gives no rows.
    A user's moments may span any number of partitions.
    """
    usable = moments.select(F.col("user_id").cast("string").alias("user_id"), F.col("at_us").cast("long").alias("at_us")).where("user_id is not null and at_us is not null")
    narrow = stage(usable, "moments")  # the range partitioning reads it twice
    pieces = secondary_sort(narrow, "user_id", "at_us").mapInArrow(_scan(gap_us), "user_id string, start_us long, end_us long, n_moments long, edge boolean")
    pieces = stage(pieces, "session-pieces")
    by_user = Window.partitionBy("user_id").orderBy("start_us", "end_us")
    before = by_user.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_us").over(before)
    joined = (
        pieces.where("edge")  # at most two a partition
        .withColumn("opens", (reach.isNull() | (F.col("start_us") - reach > gap_us)).cast("int"))
        .withColumn("session", F.sum("opens").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("user_id", "session")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_moments").alias("n_moments"))
        .drop("session")
    )
    whole = pieces.where("not edge").drop("edge").unionByName(joined)
    return whole.select("user_id", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_moments")


def learner_moments(submissions: DataFrame, job_requests: DataFrame, profile_events: DataFrame) -> DataFrame:
    """``user_id, at_us`` of every message and every error event with a readable time.

    A message counts once, with the earliest non-null ``submitted_at`` of its rows; a row that
    identifies no message counts by itself. The user is the one any row's request names.
    """
    users = job_requests.where("job_id is not null and user_id is not null").groupBy("job_id").agg(F.min("user_id").alias("user_id"))
    rows = submissions.select(
        F.coalesce(uuid_key("submission_id"), message_identity(F.col("delivery_id"))).alias("message"), "job_id", micros_of(submissions, "submitted_at").alias("at_us")
    )
    messages = rows.join(users, "job_id", "left").groupBy("message").agg(F.min("user_id").alias("user_id"), F.min("at_us").alias("at_us"))
    events = profile_events.select(F.col("student_id").alias("user_id"), iso_micros("ts").alias("at_us"))
    return messages.select("user_id", "at_us").unionByName(events)


def learner_sessions(submissions: DataFrame, job_requests: DataFrame, profile_events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Sittings of each learner over messages and error events together; see :func:`sessionize`."""
    return sessionize(learner_moments(submissions, job_requests, profile_events), gap_us)
