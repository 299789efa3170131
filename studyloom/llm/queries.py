"""Queries of the text and sequence operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm.mixing import mix_sources
from studyloom.llm.runs import repeated_errors
from studyloom.llm.surrogates import personal_items, redact_texts
from studyloom.llm.tokens import encode_texts
from studyloom.llm.truncation import truncated_rows, truncation_report
from studyloom.plans.tables import table

_WORDS = "replace(replace(lower(trim({0})), '-', '_'), ' ', '_')"
_RUNS = f"""
  with e as (select student_id, attempt_seq, rec_id, {_WORDS.format("tag")} tag, {_WORDS.format("task_id")} task
             from profile_events where tag is not null and task_id is not null and attempt_seq is not null),
  n as (select *, row_number() over (partition by student_id order by attempt_seq, rec_id)
                - row_number() over (partition by student_id, tag, task order by attempt_seq, rec_id) island from e)
  select student_id, min(rec_id) lo_rec_id, max(rec_id) hi_rec_id, count(*) n_events
  from n group by student_id, tag, task, island having count(*) > 1"""


def secret(spark: SparkSession) -> bytes:
    """The key of replacements, from the setting ``spark.studyloom.secret``; a known one, for tests alone, where it is unset."""
    return spark.conf.get("spark.studyloom.secret", "for tests alone").encode()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated_rows(table(spark, folder, "profile_events"), "rec_id", "channel", "task_text")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(table(spark, folder, "profile_events"), "channel", "task_text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_errors(table(spark, folder, "profile_events")).select("lo_rec_id", "hi_rec_id")


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_errors(table(spark, folder, "profile_events")).select(F.col("entity").alias("student_id"), "lo_rec_id", "hi_rec_id", "n_events")


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """The whole sequence with every run, of one event too, as one row."""
    runs = repeated_errors(table(spark, folder, "profile_events"), keep=1)
    return runs.select(F.col("entity").alias("student_id"), "lo_rec_id", "hi_rec_id", "first_us", "last_us", "duration_us", "n_events")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets")).documents


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets")).shares


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_items(table(spark, folder, "documents"), "doc_id", "text", secret(spark))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with typed placeholders."""
    return redact_texts(table(spark, folder, "documents"), "doc_id", "text", secret(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p5_found": p5_found,
    "p5_runs": p5_runs,
    "p5_collapsed": p5_collapsed,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

ORACLES: dict[str, str] = {
    "p5_found": f"select lo_rec_id, hi_rec_id from ({_RUNS})",
    "p5_runs": _RUNS,
}
