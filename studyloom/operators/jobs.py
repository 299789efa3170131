"""Queues and stores of requests: lookups, idempotent insertion, listings, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import DEFAULT, Settings


def latest_state(jobs: DataFrame, key: str = "job_id", order: str = "updated_at") -> DataFrame:
    """One row for each job, the one updated last; equal ones by all that they hold."""
    rest = [c for c in jobs.columns if c not in (key, order)]
    picked = jobs.groupBy(key).agg(F.max(F.struct(F.col(order).alias("o_"), F.struct(*rest).alias("r_"))).alias("x"))
    return picked.select(key, F.col("x.o_").alias(order), "x.r_.*").select(*jobs.columns)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of ``incoming`` whose key isn't there yet, one for each key (the first by all columns)."""
    rest = [c for c in incoming.columns if c != key]
    one = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("x")).select(key, "x.*").select(*incoming.columns)
    return one.join(existing.select(key), key, "left_anti")


def next_waiting(jobs: DataFrame, state: str, n: int = 1, status: str = "status", created: str = "created_at", key: str = "job_id") -> DataFrame:
    """The ``n`` oldest rows in a state; a single streaming writer stands for the lock."""
    return jobs.where(F.col(status) == state).orderBy(created, key).limit(n)


def latest(jobs: DataFrame, n: int, created: str = "created_at", key: str = "job_id") -> DataFrame:
    """The ``n`` newest rows."""
    return jobs.orderBy(F.desc(created), F.desc(key)).limit(n)


def update_where(df: DataFrame, test: Column, **new: Column) -> DataFrame:
    """Rows with columns replaced where ``test`` holds: what an UPDATE leaves behind."""
    return df.withColumns({name: F.when(test, value).otherwise(F.col(name)) for name, value in new.items()})


#: The states that a job can be in.
STATES = ("queued", "running", "done", "failed")


def checked_state(status: Column, states: tuple[str, ...] = STATES) -> Column:
    """The state as it is; a query that meets another one (null too) fails, as the table's constraint would."""
    return F.when(status.isin(*states), status).otherwise(F.raise_error(F.concat(F.lit("no state of a job: "), F.coalesce(status, F.lit("null")))))


def finished(jobs: DataFrame, test: Column, now: Column) -> DataFrame:
    """``done``, for running jobs only."""
    test = test & (F.col("status") == "running")
    return update_where(jobs, test, status=F.lit("done"), completed_at=now, updated_at=now)


def failed(jobs: DataFrame, test: Column, code: Column, message: Column, now: Column) -> DataFrame:
    """``failed`` with what went wrong, whatever the state was."""
    return update_where(jobs, test, status=F.lit("failed"), error_code=code, error_message=message, completed_at=now, updated_at=now)


def posted(jobs: DataFrame, test: Column, now: Column) -> DataFrame:
    """With the time of delivery."""
    return update_where(jobs, test, posted_at=now, updated_at=now)


def retried(jobs: DataFrame, test: Column, reason: Column, now: Column) -> DataFrame:
    """One more try; a new reason (at most 500 characters) takes the old one's place, null leaves it."""
    return update_where(jobs, test, retry_count=F.col("retry_count") + 1, error_message=F.coalesce(F.substring(reason, 1, 500), F.col("error_message")), updated_at=now)


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of an array, ranks rounded half to even; null for none."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.bround((F.size(values) - 1) * F.lit(p)).cast("int"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, with microseconds, between two timestamps."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6


def queue_statistics(jobs: DataFrame, now: Column, states: tuple[str, ...], done: str, waiting: str, start: str, end: str, since: str, settings: Settings = DEFAULT) -> DataFrame:
    """One row: counts by state and in all, latency of ``done`` rows in ms (mean, median, 95 %), how many ended lately, and the longest wait in seconds.

    Latencies are of the rows given, which a caller bounds (:func:`latest`); ``now`` is a timestamp.
    """
    status = F.col("status")
    latency = F.when((status == done) & F.col(start).isNotNull() & F.col(end).isNotNull(), seconds_between(F.col(start), F.col(end)) * 1000)
    wait = F.max(F.when(status == waiting, seconds_between(F.col(since), now)))
    recent = F.count(F.when((status == done) & (seconds_between(F.col(end), now) <= settings.throughput_seconds), 1))
    row = jobs.agg(*(F.count(F.when(status == s, 1)).alias(f"n_{s}") for s in states), F.avg(latency).alias("avg_ms"), F.collect_list(latency).alias("all_ms"), recent.alias("throughput"), wait.alias("longest_wait_s"))
    total = sum((F.col(f"n_{s}") for s in states[1:]), F.col(f"n_{states[0]}"))
    return row.select(*(f"n_{s}" for s in states), total.alias("n_total"), "avg_ms", nearest_rank(F.col("all_ms"), 0.5).alias("p50_ms"), nearest_rank(F.col("all_ms"), 0.95).alias("p95_ms"), F.size("all_ms").alias("n_samples"), "throughput", "longest_wait_s")


def newest_kept(rows: DataFrame, key: str, first_seen: str, last_seen: str, settings: Settings = DEFAULT) -> DataFrame:
    """A bounded keyed store, newest first: a key keeps the place of its first row and shows its last; only the newest keys stay.

    ``first_seen`` orders arrivals and is unique; ``last_seen`` picks the row shown.
    """
    rest = [c for c in rows.columns if c != key]
    places = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(first_seen).alias("first_"), F.max(F.struct(F.col(last_seen).alias("o_"), F.struct(*rest).alias("r_"))).alias("x"))
    kept = places.orderBy(F.desc("first_")).limit(settings.store_limit)
    return kept.select(key, F.col("x.r_.*"), F.row_number().over(Window.orderBy(F.desc("first_"))).alias("place"))  # at most the store's limit


def offsets_lag(ends: DataFrame, committed: DataFrame, key: str = "partition", offset: str = "offset") -> DataFrame:
    """One row ``lag``: how far committed offsets are behind, in all; a partition without one counts from 0."""
    done = committed.select(F.col(key).alias("k_"), F.col(offset).alias("c_"))
    behind = F.greatest(F.col(offset) - F.coalesce("c_", F.lit(0)), F.lit(0))
    return ends.join(done, F.col(key) == F.col("k_"), "left").agg(F.coalesce(F.sum(behind), F.lit(0)).alias("lag"))


# Answers of a receiver after which sending again makes sense, and the longest pause.
RETRY_GENERAL, RETRY_CALLBACK, LONGEST_PAUSE = (429, 502, 503, 504), (408, 429), 30.0


def retryable(status: Column) -> Column:
    """Whether a failed request may be sent again."""
    return F.coalesce(status.isin(*RETRY_GENERAL), F.lit(False))


def delivery_outcome(status: Column) -> Column:
    """``delivered``, ``permanent`` (not to be sent again) or ``transient``; no status is transient."""
    return F.when(status.between(200, 299), "delivered").when(status.between(400, 499) & ~status.isin(*RETRY_CALLBACK), "permanent").otherwise("transient")


def pause_before(attempt: Column) -> Column:
    """Seconds before the next try."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(LONGEST_PAUSE))
