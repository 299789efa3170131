"""Files: curated knowledge, task banks, archives, profiles, notes, vectors.

Schemas are given, never inferred. Malformed rows are dropped where a source is known to be dirty
and are an error where people curate it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.config import SUPPORTED_TASKS
from studyloom.functions.text import clip, safe_id, strip
from studyloom.operators.prompts import content_digest
from studyloom.staging import stage

ATOM = "id string, title string, text string, task_number int, subtypes array<string>, error_tags array<string>, prerequisites array<string>, shared_skills array<string>, ord int"
TASK = "id string, task_number string, question string, problem_katex string, answer string"
ARCHIVE = "user_number string, task_number string, task_id string, submission_id string, node_name string, task_name string, is_correct string, submission_time string"
EVENT = "struct<tag:string,ts:string,attempt_seq:int,weight:double,task_number:int,task_id:string,subtype:string,student_answer:string,correct_answer:string,task_text:string,problem_katex:string,solution:string>"
PROFILE = f"student_id string, created_at string, updated_at string, attempts map<string,int>, wrong map<string,int>, error_scores map<string,double>, error_events array<{EVENT}>, skill_scores map<string,double>, decay_half_life double, attempt_seq int"


class AtomError(ValueError):
    """A curated atom lacks a required field."""


def _yaml(path: str) -> object:
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml package; JSON files are read without it") from error
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def _curated(path: str) -> list:
    import json

    raw = _yaml(path) if path.endswith((".yaml", ".yml")) else json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, list):
        raise AtomError(f"{path} must hold a list")
    return raw


def read_atoms(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Atoms of curated YAML or JSON files, in order; an item without id, title, text or task number is an error, absent lists are empty."""
    rows = []
    for path in paths:
        for i, item in enumerate(_curated(path)):
            lacking = [k for k in ("id", "title", "text", "task_number") if not isinstance(item, dict) or k not in item]
            if lacking:
                raise AtomError(f"item {i} of {path} lacks {', '.join(lacking)}")
            lists = [list(item.get(k) or []) for k in ("subtypes", "error_tags", "prerequisites", "shared_skills")]
            rows.append((str(item["id"]), str(item["title"]), str(item["text"]), int(item["task_number"]), *lists, len(rows)))
    return spark.createDataFrame(rows, ATOM)


def read_misconceptions(spark: SparkSession, path: str, known_tags: set[str], first_ord: int = 0) -> DataFrame:
    """Misconceptions as atoms with one tag each; items that are no mappings or have an unknown tag are skipped, the task number is 10 if absent."""
    kept = [m for m in _curated(path) if isinstance(m, dict) and m.get("error_tag") in known_tags]
    rows = [(str(m["id"]), str(m["title"]), str(m["text"]).strip(), int(m.get("task_number", 10)), [], [m["error_tag"]], [], [], first_ord + i) for i, m in enumerate(kept)]
    return spark.createDataFrame(rows, ATOM)


def misconception_hints(misconceptions: DataFrame, limit: int = 700) -> DataFrame:
    """``title, text, error_tag, task_number, ord`` with texts clipped."""
    return misconceptions.select(strip("title").alias("title"), clip("text", limit).alias("text"), F.get("error_tags", F.lit(0)).alias("error_tag"), "task_number", "ord")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON array; items that can't be read or have no whole task number are dropped."""
    raw = spark.read.schema(TASK).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    number = F.col("task_number").try_cast("int")
    return raw.where(number.isNotNull()).select(F.coalesce("id", F.lit("")).alias("task_id"), number.alias("task_number"), F.coalesce("question", F.lit("")).alias("question"), "problem_katex", strip(F.coalesce("answer", F.lit(""))).alias("answer"))


def read_solutions(spark: SparkSession, path: str, tasks_csv: str | None = None, users: int = 80, per_user: int = 80, most: int = 2500, in_all: int = 3000) -> DataFrame:
    """``task_number, problem, solution, source`` of solved tasks: the first few of the first users, then those of a table of tasks, up to totals.

    Both files are ones that people keep, read in their order; the totals are the feature.
    """
    schema = "user_id string, solutions array<struct<task_number:string,problem_katex:string,solution:string>>"
    first = spark.read.schema(schema).option("multiLine", True).json(path).limit(users)
    one = first.select(F.explode(F.slice("solutions", 1, per_user)).alias("s")).where("s is not null").limit(most)
    solved = one.select(F.col("s.task_number").try_cast("int").alias("task_number"), F.coalesce("s.problem_katex", F.lit("")).alias("problem"), F.coalesce("s.solution", F.lit("")).alias("solution"), F.lit("archive_submission").alias("source"))
    if tasks_csv is None:
        return solved
    bank = spark.read.csv(tasks_csv, header=True, encoding="UTF-8", multiLine=True, escape='"')
    column = lambda c: F.coalesce(F.col(c), F.lit("")) if c in bank.columns else F.lit("")
    more = bank.select(F.lit(None).cast("int").alias("task_number"), column("problem_katex").alias("problem"), column("solution").alias("solution"), F.lit("tasks_with_solutions").alias("source"))
    return solved.unionByName(more.limit(max(0, in_all - solved.count())))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Answers of an archive file (semicolons, mark of byte order, all text); rows of other tasks are left out."""
    raw = spark.read.schema(ARCHIVE).csv(path, sep=";", header=True, encoding="UTF-8", enforceSchema=True)
    number = F.col("task_number").try_cast("double").cast("int")
    moment = F.regexp_replace(strip("submission_time"), r"(?:[+].*|Z)$", "")
    return raw.where(number.isin(*SUPPORTED_TASKS)).select(
        F.regexp_replace(strip("user_number"), "^﻿", "").alias("user_number"), number.alias("task_number"), "task_id", "submission_id", "node_name", "task_name",
        F.lower(strip("is_correct")).isin("true", "1", "yes").alias("is_correct"), F.try_to_timestamp(moment).alias("submitted_at"),
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Stored profiles, one JSON a learner; missing maps are empty, missing numbers have their defaults."""
    raw = spark.read.schema(PROFILE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    maps = {c: F.coalesce(c, F.create_map().cast(t)) for c, t in (("attempts", "map<string,int>"), ("wrong", "map<string,int>"), ("error_scores", "map<string,double>"), ("skill_scores", "map<string,double>"))}
    rest = {"error_events": F.coalesce("error_events", F.array().cast(f"array<{EVENT}>")), "decay_half_life": F.coalesce("decay_half_life", F.lit(20.0)), "attempt_seq": F.coalesce("attempt_seq", F.lit(0))}
    return raw.withColumns(maps | rest)


#: Folders that stored profiles are spread over.
PROFILE_BUCKETS = 256


def write_profiles(profiles: DataFrame, path: str, buckets: int = PROFILE_BUCKETS) -> None:
    """Profiles as JSON lines in folders by a hash of the (cleaned) learner id; the committer makes the change whole or not at all."""
    bucket = F.pmod(F.xxhash64(safe_id("student_id")), F.lit(buckets)).cast("int")
    profiles.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def read_profile(spark: SparkSession, path: str, student_id: str, buckets: int = PROFILE_BUCKETS) -> DataFrame:
    """One learner's stored profile, from its folder alone."""
    wanted = F.pmod(F.xxhash64(safe_id(F.lit(student_id))), F.lit(buckets)).cast("int")
    return spark.read.schema(f"{PROFILE}, bucket int").json(path).where((F.col("bucket") == wanted) & (F.col("student_id") == student_id)).drop("bucket")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """``student_id, markdown, meta`` of ``*.md`` files with their ``*.meta.json`` neighbours, ``{}`` where there is none."""
    name = lambda end: F.regexp_extract(F.input_file_name(), rf"([^/]+){end}$", 1)
    notes = spark.read.text(f"{folder}/*.md", wholetext=True).select(name(r"\.md").alias("student_id"), F.col("value").alias("markdown"))
    metas = spark.read.option("pathGlobFilter", "*.meta.json").text(folder, wholetext=True).select(name(r"\.meta\.json").alias("student_id"), F.col("value").alias("meta"))
    return notes.join(metas, "student_id", "left").select("student_id", "markdown", F.coalesce("meta", F.lit("{}")).alias("meta"))


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)


def upsert_vectors(documents: DataFrame, path: str, group: str = "task_number") -> None:
    """Put documents into the index at ``path``: rows of known ids are replaced, others added; the new index takes the old one's place as a whole."""
    spark = documents.sparkSession
    old = spark.read.parquet(f"{path}/points")
    merged = stage(old.join(documents.select("id"), "id", "left_anti").unionByName(documents, allowMissingColumns=True), "vectors")
    write_vectors(merged, path, group)


def write_vectors(documents: DataFrame, path: str, group: str = "task_number") -> None:
    """An index of documents with vectors, in a folder for each task, and the digest of its texts beside it."""
    digest = content_digest(documents, "id", "text", group)
    counts = documents.groupBy(F.col(group).alias("g_")).agg(F.count("*").alias("n"))
    documents.write.mode("overwrite").partitionBy(group).parquet(f"{path}/points")
    digest.join(counts, F.col(group).eqNullSafe(F.col("g_"))).select(group, "digest", "n").write.mode("overwrite").parquet(f"{path}/digest")


def is_fresh(documents: DataFrame, path: str, group: str = "task_number") -> bool:
    """Whether the index at ``path`` was made from these documents: same groups, counts and texts."""
    spark = documents.sparkSession
    try:
        stored = spark.read.parquet(f"{path}/digest")
    except Exception:  # there is no index yet
        return False
    counts = documents.groupBy(F.col(group).alias("g_")).agg(F.count("*").alias("n"))
    now = content_digest(documents, "id", "text", group).join(counts, F.col(group).eqNullSafe(F.col("g_"))).select(group, "digest", "n")
    return now.exceptAll(stored.select(group, "digest", "n")).isEmpty() and stored.select(group, "digest", "n").exceptAll(now).isEmpty()
