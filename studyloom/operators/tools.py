"""Named tools over profiles: each takes a :class:`Context` and arguments and returns a DataFrame for all learners.

An unknown tool or bad arguments give a table with one ``error`` row instead of an exception.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.config import TOOL_TASKS
from studyloom.functions.cascade import SUBTYPE_LABELS
from studyloom.functions.tags import ERROR_LABELS
from studyloom.functions.text import clip, label, query_tokens
from studyloom.operators import graph, profile, prompts, retrieval
from studyloom.operators.curated import beside


class Context(NamedTuple):
    """Tables that tools read; see :mod:`studyloom.operators.profile`. ``base`` is ``student_id, atom, score`` of a search."""

    attempts: DataFrame
    errors: DataFrame
    counts: DataFrame
    atoms: DataFrame
    misconceptions: DataFrame
    bank: DataFrame
    base: DataFrame


class Tool(NamedTuple):
    description: str
    arguments: dict[str, str]
    run: Callable[..., DataFrame]


def _task(value: object) -> int | None:
    try:
        number = int(str(value))
    except ValueError:
        return None
    return number if number in TOOL_TASKS else None


def _count(value: object, default: int, most: int) -> int:
    try:
        number = int(str(value))
    except ValueError:
        number = default
    return max(1, min(most, number))


def _labels(c: str):
    return F.array_join(F.transform(F.slice(c, 1, 4), lambda s: label(s, SUBTYPE_LABELS)), ", ")


def _top(ctx: Context, n: int) -> DataFrame:
    return profile.top_errors(profile.decayed_scores(ctx.errors), n, ctx.atoms)


def _of_task(df: DataFrame, number: int | None) -> DataFrame:
    return df if number is None else df.where(F.col("task_number") == number)


def retrieve_learning_atoms(ctx: Context, task_number: object = None, subtype: object = None, k: object = 4, **_: object) -> DataFrame:
    """Atoms from the search of the learner's own queries; ``query`` is accepted and not used. Prerequisites may be of other tasks.

    A search within a task or subtype ranks all of its atoms, so those that ``base`` didn't meet take part with score 0.
    """
    number, kind = _task(task_number), " ".join(str(subtype or "").split())
    kind = None if kind in ("", "all_subtypes") else kind
    scores, base = profile.decayed_scores(ctx.errors), ctx.base
    if number is not None or kind is not None:
        asked = _of_task(ctx.atoms, number)
        asked = asked if kind is None else asked.where(F.array_contains("subtypes", kind))
        every = beside(base.select("student_id").distinct(), asked.select(F.col("id").alias("atom")))
        base = every.join(base, ["student_id", "atom"], "left").select("student_id", "atom", F.coalesce("score", F.lit(0.0)).alias("score"))
    found = retrieval.retrieve(base, ctx.atoms, scores, profile.skill_transfer(ctx.errors, ctx.atoms), graph.atom_weakness(scores, ctx.atoms), _count(k, 4, 6), number, kind)
    return found.join(ctx.atoms.withColumnRenamed("id", "atom"), "atom").select("student_id", "place", "title", clip("text", 900).alias("text"), "task_number", _labels("subtypes").alias("subtypes"), F.round("score", 4).alias("score"))


def get_student_profile_summary(ctx: Context, **_: object) -> DataFrame:
    return profile.summary(ctx.counts, _top(ctx, 8))


def get_recent_wrong_examples(ctx: Context, task_number: object = None, limit: object = 3, **_: object) -> DataFrame:
    return profile.recent_wrong_examples(ctx.attempts, ctx.errors, _count(limit, 3, 5), task_number=_task(task_number))


def get_recent_attempts(ctx: Context, task_number: object = None, only_wrong: bool = False, limit: object = 3, **_: object) -> DataFrame:
    return profile.recent_attempts(ctx.attempts, _count(limit, 3, 5), _task(task_number), bool(only_wrong))


def get_misconception_hints(ctx: Context, error_tags: list[str] | None = None, task_number: object = None, limit: object = 4, **_: object) -> DataFrame:
    """Hints for given tags, else for each learner's top errors; a learner without any gets them in file order."""
    from pyspark.sql import Window

    own = ctx.misconceptions if _task(task_number) is None else ctx.misconceptions.where(F.col("task_number") == _task(task_number))
    learners = ctx.counts.select("student_id").distinct()
    if error_tags:
        picked = beside(learners, own.where(F.col("error_tag").isin(list(error_tags))))
    else:
        top = _top(ctx, 8).select("student_id", F.col("tag").alias("error_tag"))
        bare = learners.join(top.select("student_id").distinct(), "student_id", "left_anti")
        picked = top.join(own, "error_tag").select("student_id", *own.columns).unionByName(beside(bare, own))
    place = F.row_number().over(Window.partitionBy("student_id").orderBy("ord"))
    return picked.withColumn("place", place).where(F.col("place") <= _count(limit, 4, 6)).select("student_id", "place", "title", F.col("text").alias("hint"), label("error_tag", ERROR_LABELS).alias("error"), "task_number")


def get_similar_solved_tasks(ctx: Context, query: str = "", task_number: object = None, limit: object = 2, **_: object) -> DataFrame:
    """Solved tasks like a query; tasks without a known number aren't of an asked one, so neither is any of a bank without ``task_number``."""
    number = _task(task_number)
    bank = ctx.bank if "task_number" in ctx.bank.columns else ctx.bank.withColumn("task_number", F.lit(None).cast("int"))
    learners = ctx.counts.select("student_id").distinct()
    queries = learners.select(F.col("student_id").alias("query_id"), "student_id", query_tokens(clip(F.lit(query), 320)).alias("tokens"))
    own = _of_task(profile.newest(ctx.errors, 100, "student_id", "seq", "rec_id"), number).select("student_id", "seq", "rec_id", F.coalesce("problem_katex", "task_text", F.lit("")).alias("problem"), F.coalesce("solution", F.lit("")).alias("solution"))
    return prompts.similar_solved(queries, own, _of_task(bank, number), _count(limit, 2, 4)).withColumnRenamed("query_id", "student_id")


def get_frontier_topics(ctx: Context, task_number: object = None, limit: object = 5, **_: object) -> DataFrame:
    weakness = graph.atom_weakness(profile.decayed_scores(ctx.errors), ctx.atoms)
    found = graph.frontier(weakness, ctx.atoms, _count(limit, 5, 6), _task(task_number))
    return found.join(ctx.atoms.withColumnRenamed("id", "atom"), "atom").select("student_id", "place", "title", "task_number", _labels("subtypes").alias("subtypes"), clip("text", 650).alias("text"))


# Names and arguments of the tools.
TOOLS: dict[str, Tool] = {
    "retrieve_learning_atoms": Tool("atoms for a learner's recent mistakes", {"query": "string", "task_number": "integer", "subtype": "string", "k": "integer"}, retrieve_learning_atoms),
    "get_student_profile_summary": Tool("totals, top errors and practised subtypes", {}, get_student_profile_summary),
    "get_recent_wrong_examples": Tool("recent wrong tasks", {"task_number": "integer", "limit": "integer"}, get_recent_wrong_examples),
    "get_recent_attempts": Tool("recent attempts", {"task_number": "integer", "only_wrong": "boolean", "limit": "integer"}, get_recent_attempts),
    "get_misconception_hints": Tool("known misconceptions", {"error_tags": "array", "task_number": "integer", "limit": "integer"}, get_misconception_hints),
    "get_similar_solved_tasks": Tool("solved tasks like a query", {"query": "string", "task_number": "integer", "limit": "integer"}, get_similar_solved_tasks),
    "get_frontier_topics": Tool("what to learn next", {"task_number": "integer", "limit": "integer"}, get_frontier_topics),
}


def call(ctx: Context, name: str, arguments: dict[str, object] | None = None) -> DataFrame:
    """The tool's table; argument names may hold blanks. What goes wrong is a table with one ``error``."""
    spark = ctx.atoms.sparkSession
    tool = TOOLS.get(name)
    if tool is None:
        return spark.createDataFrame([(f"unknown tool: {name}",)], "error string")
    known = {"_".join(str(k).split()): v for k, v in (arguments or {}).items()}
    try:
        return tool.run(ctx, **{k: v for k, v in known.items() if k in tool.arguments})
    except Exception as error:
        return spark.createDataFrame([(f"{type(error).__name__}: {error}",)], "error string")
