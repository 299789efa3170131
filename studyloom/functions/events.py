"""Submission events as they come from a message stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.config import SUPPORTED_TASKS

#: The type of event that counts, and the fields that it has to hold.
EVENT_TYPE = "submission.created"
REQUIRED = ("submission_id", "user_id", "task_id", "task_number", "task_text", "is_correct")
SUBMISSION = "submission_id string, user_id string, task_id string, task_number int, task_text string, is_correct boolean, student_answer string, correct_answer string, submitted_at string"
ENVELOPE = f"event_id string, event_type string, schema_version string, occurred_at string, submission struct<{SUBMISSION.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>"


def parsed_event(raw: Column) -> Column:
    """The envelope of a JSON message; null fields where there is none or it can't be read."""
    return F.from_json(raw, ENVELOPE)


def event_defect(raw: Column) -> Column:
    """Why a message is skipped: ``bad_json``, ``other_type``, ``no_submission``, ``missing_fields``, ``unsupported_task``; null if it counts."""
    event = parsed_event(raw)
    present = F.json_object_keys(F.get_json_object(raw, "$.submission"))
    missing = F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(present, F.array().cast("array<string>")))) > 0
    return (
        F.when(F.try_parse_json(raw).isNull(), "bad_json")
        .when(F.coalesce(event["event_type"], F.lit("")) != EVENT_TYPE, "other_type")
        .when(event["submission"].isNull(), "no_submission")
        .when(missing, "missing_fields")
        .when(~F.coalesce(event["submission"]["task_number"].isin(*SUPPORTED_TASKS), F.lit(False)), "unsupported_task")
    )


def valid_submissions(messages: DataFrame, value: str = "value") -> DataFrame:
    """``event_id, occurred_at, submission.*`` of messages that count."""
    raw = F.col(value).cast("string")
    kept = messages.withColumn("event_", parsed_event(raw)).where(event_defect(raw).isNull())
    return kept.select("event_.event_id", "event_.occurred_at", "event_.submission.*")


def event_message(submission: Column, event_id: Column, occurred_at: Column) -> Column:
    """JSON message of a submission, as a sink sends it."""
    return F.to_json(F.struct(event_id.alias("event_id"), F.lit(EVENT_TYPE).alias("event_type"), F.lit("1.0").alias("schema_version"), occurred_at.alias("occurred_at"), submission.alias("submission")))
