"""The knowledge graph: prerequisites, dependents, weakness along edges, and what to learn next.

Atoms are ``id, title, text, task_number, subtypes, error_tags, prerequisites, shared_skills, ord``.
They are a curated table; per-learner results are joins of learners' scores with it.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.config import DEFAULT, Settings
from studyloom.operators.linear_scan import scan_groups


def edges(atoms: DataFrame) -> DataFrame:
    """``atom, prereq`` of each prerequisite that is itself an atom."""
    pairs = atoms.select(F.col("id").alias("atom"), F.explode(F.array_distinct("prerequisites")).alias("prereq"))
    return pairs.join(atoms.select(F.col("id").alias("prereq")), "prereq", "left_semi").select("atom", "prereq")


def unknown_tags(atoms: DataFrame, registry: DataFrame) -> DataFrame:
    """``id, tag`` of tags that ``registry(tag)`` doesn't hold; an index is built only where there are none."""
    return atoms.select("id", F.explode("error_tags").alias("tag")).join(registry.select("tag"), "tag", "left_anti").select("id", "tag")


def within(pairs: DataFrame, depth: int, start: str, end: str) -> DataFrame:
    """``start, end, hops``: nodes reached by up to ``depth`` edges, with the fewest hops; not the start itself."""
    step = pairs.select(F.col(start).alias("x_"), F.col(end).alias("y_"))
    reached = level = pairs.select(F.col(start).alias("from_"), F.col(end).alias("to_"), F.lit(1).alias("hops"))
    for hops in range(2, depth + 1):
        level = level.join(step, F.col("to_") == F.col("x_")).select("from_", F.col("y_").alias("to_"), F.lit(hops).alias("hops")).distinct()
        reached = reached.unionByName(level)
    return reached.where("from_ <> to_").groupBy(F.col("from_").alias(start), F.col("to_").alias(end)).agg(F.min("hops").alias("hops"))


def prerequisites(atoms: DataFrame, depth: int = 2) -> DataFrame:
    """``atom, prereq, hops``."""
    return within(edges(atoms), depth, "atom", "prereq")


def dependents(atoms: DataFrame, depth: int = 1) -> DataFrame:
    """``prereq, atom, hops``: what builds on an atom."""
    return within(edges(atoms), depth, "prereq", "atom")


# --- weakness ---


def atom_weakness(scores: DataFrame, atoms: DataFrame) -> DataFrame:
    """``student_id, atom, weakness`` where it is above 0: the mean of a learner's ``scores(student_id, tag, score)`` over the atom's tags."""
    tagged = atoms.select(F.col("id").alias("atom"), F.size("error_tags").alias("n"), F.explode("error_tags").alias("tag"))
    return scores.where("score > 0").join(tagged, "tag").groupBy("student_id", "atom").agg((F.sum("score") / F.greatest(F.first("n"), F.lit(1))).alias("weakness"))


def mastery_level(weakness: Column) -> Column:
    """1 minus weakness, within [0, 1]; 1 where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(weakness, F.lit(0.0))))


def predicted_weakness(weakness: DataFrame, atoms: DataFrame, depth: int = 2, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, atom, weakness, predicted``: a weakness is handed on to dependents, a fixed part of it with each hop.

    What a dependent gets comes from the root alone, so the sum is the weakness times a factor of the graph.
    """
    counts = dependents(atoms, depth).groupBy("prereq").agg(F.sum(F.pow(F.lit(settings.hop_factor), F.col("hops"))).alias("factor"))
    return weakness.join(counts, F.col("atom") == F.col("prereq"), "left").select("student_id", "atom", "weakness", (F.col("weakness") * (1 + F.coalesce("factor", F.lit(0.0)))).alias("predicted"))


def frontier(weakness: DataFrame, atoms: DataFrame, n: int = 5, task_number: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """``student_id, place, atom, priority``: weak atoms whose prerequisites are in hand, at most a few of one task unless a task is asked for."""
    predicted = predicted_weakness(weakness, atoms, settings=settings).where(F.col("weakness") >= settings.frontier_threshold)
    own = atoms.where(~F.col("id").startswith("mc_"))
    if task_number is not None:
        own = own.where(F.col("task_number") == task_number)
    listed = own.select(F.col("id").alias("atom"), "task_number", "ord", F.size("prerequisites").alias("n_pre"))
    pre = atoms.select(F.col("id").alias("atom"), F.explode("prerequisites").alias("prereq"))
    of_pre = pre.join(weakness.select("student_id", F.col("atom").alias("prereq"), "weakness"), "prereq").groupBy("student_id", "atom").agg(F.sum("weakness").alias("pre"))
    joined = predicted.join(listed, "atom").join(of_pre, ["student_id", "atom"], "left")
    mean = F.coalesce("pre", F.lit(0.0)) / F.greatest("n_pre", F.lit(1))
    scored = joined.withColumn("priority", F.col("weakness") + settings.frontier_predicted_weight * F.col("predicted") - settings.frontier_prereq_weight * mean)
    order = (F.desc(F.round("priority", 9)), "ord")
    if task_number is None:
        scored = scored.withColumn("in_task", F.row_number().over(Window.partitionBy("student_id", "task_number").orderBy(*order))).where(F.col("in_task") <= settings.frontier_per_task)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy(*order))).where(F.col("place") <= n).select("student_id", "place", "atom", "priority")


# --- order of learning ---


def _prerequisites_first(rows: list[tuple]) -> list[tuple]:
    """Depth first, each atom after those of its prerequisites that are selected too."""
    owner = rows[0][0]
    wanted = {atom: [p for p in before if p is not None] for _, _, atom, before in rows}
    done: dict[str, int] = {}
    open_: set[str] = set()
    for root in wanted:
        stack = [(root, iter(wanted[root]))] if root not in done else []
        open_.update(a for a, _ in stack)
        while stack:
            atom, rest = stack[-1]
            nxt = next((p for p in rest if p in wanted and p not in done and p not in open_), None)
            if nxt is None:
                done[atom] = len(done) + 1
                stack.pop()
            else:
                open_.add(nxt)
                stack.append((nxt, iter(wanted[nxt])))
    return [(owner, atom, place) for atom, place in done.items()]


def learning_order(selected: DataFrame, atoms: DataFrame, owner: str) -> DataFrame:
    """``<owner>, atom, place`` of ``selected(<owner>, atom, place)``, prerequisites first.

    The order depends on the visits before, so it is a fold over each owner's rows: one answer of a
    search, a few dozen.
    """
    joined = selected.join(atoms.select(F.col("id").alias("atom"), "prerequisites"), "atom").select(F.col(owner).cast("string").alias("owner"), "place", "atom", "prerequisites")
    return scan_groups(joined, ["place"], "owner string, atom string, place int", _prerequisites_first).withColumnRenamed("owner", owner)


# --- task labels ---


def label_tasks(atoms: DataFrame, tasks: DataFrame, universal: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """``atom, task_id``: the tasks (``task_id, task_number, subtype``) that an atom applies to.

    Those of a subtype it names; all of its number if it names none or a universal one, or if no task matches.
    """
    known = tasks.where("task_id is not null and length(task_id) > 0").select("task_id", F.col("task_number").alias("t_"), F.col("subtype").alias("s_"))
    wide = F.lit(False)
    for number, names in (universal or {}).items():
        wide = wide | ((F.col("task_number") == number) & F.arrays_overlap("subtypes", F.array(*map(F.lit, names))))
    own = atoms.select(F.col("id").alias("atom"), "task_number", "subtypes", ((F.size("subtypes") == 0) | F.coalesce(wide, F.lit(False))).alias("wide"))
    by_name = own.where("not wide").select("atom", "task_number", F.explode("subtypes").alias("s")).distinct()
    matched = by_name.join(known, (F.col("task_number") == F.col("t_")) & (F.col("s") == F.col("s_"))).select("atom", "task_id").distinct()
    bare = own.join(matched.select("atom").distinct(), "atom", "left_anti").select("atom", "task_number")
    return matched.unionByName(bare.join(known, F.col("task_number") == F.col("t_")).select("atom", "task_id").distinct())
