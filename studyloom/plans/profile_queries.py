"""Queries over learners' profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.config import DEFAULT
from studyloom.functions.cascade import SUBTYPE_LABELS, subtype_sql
from studyloom.functions.tags import ERROR_LABELS
from studyloom.functions.text import BLANK_RE2 as BLANK
from studyloom.operators import graph as G
from studyloom.operators import profile as P
from studyloom.operators.curated import beside
from studyloom.plans.data_queries import _KEY, _WORDS
from studyloom.plans.tables import table



def norm_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{BLANK}+', ' ', 'g'))"


def strip_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{BLANK}+', ''), '{BLANK}+$', '')"


def squeeze_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{BLANK}+', ' ', 'g'))"


def clip_sql(text: str, limit: int) -> str:
    t = squeeze_sql(f"coalesce({text}, '')")
    return f"case when length({t}) <= {limit} then {t} else regexp_replace(left({t}, {limit - 3}), '{BLANK}+$', '') || '...' end"


def error_label_sql(name: str) -> str:
    pairs = ", ".join("'" + tag + "': '" + text.replace("'", "''") + "'" for tag, text in ERROR_LABELS.items())
    return f"coalesce((map {{{pairs}}})[{name}], replace({name}, '_', ' '))"


def label_sql(name: str) -> str:
    return f"coalesce(case {name} " + " ".join(f"when '{k}' then '{v}'" for k, v in SUBTYPE_LABELS.items()) + f" end, replace({name}, '_', ' '))"


ATTEMPTS = f"""attempts as (
  select student_id, delivery_id, task_id, task_number, {subtype_sql(norm_sql("task_text"), "task_number")} subtype, is_correct ok, diagnostic_tags tags, submitted_at,
         task_text, student_answer, correct_answer, row_number() over (partition by student_id order by submitted_at nulls first, delivery_id) seq
  from (select *, row_number() over (partition by coalesce(k, 'row ' || delivery_id) order by submitted_at nulls last, delivery_id) nth from (select *, {_KEY} k from submissions)) s
  join (select job_id, min(user_id) student_id from job_requests where user_id is not null group by job_id) j using (job_id) where nth = 1)"""
ERRORS = f"""errors as (select student_id, attempt_seq::bigint seq, rec_id, {_WORDS.format("tag")} tag, coalesce(weight, 1.0) weight, task_number, task_id, subtype,
  student_answer, correct_answer, task_text, problem_katex, solution from profile_events where tag is not null and attempt_seq is not null)"""
KEPT = "kept as (select *, row_number() over (partition by student_id order by seq desc, rec_id desc) nth from errors qualify nth <= 300)"
SCORES = f"""{ERRORS}, {KEPT}, scores as (select student_id, tag, sum(weight * pow(1.0 + now - seq, -0.5)) score
  from (select *, max(seq) over (partition by student_id) now from kept) group by student_id, tag)"""
TOP = "top as (select *, row_number() over (partition by student_id order by round(score, 9) desc, tag) place from scores where score > 0 and tag in (select unnest(error_tags) from atoms) qualify place <= {0})"
COUNTS = """heads as (select * from profiles qualify row_number() over (partition by student_id order by attempt_seq desc, updated_at desc) = 1),
  counts as (select student_id, e.key subtype, e.value attempts, coalesce(wrong[e.key], 0) wrong from (select student_id, wrong, unnest(map_entries(attempts)) e from heads))"""
WEAK = f"""{SCORES}, weak as (select student_id, id atom, sum(score) / max(n) weakness from scores join (select id, greatest(len(error_tags), 1) n, unnest(error_tags) tag from atoms) using (tag)
  where score > 0 group by student_id, id)"""
EDGES = "edges as (select distinct id atom, prereq from (select id, unnest(prerequisites) prereq from atoms) where prereq in (select id from atoms))"


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    return P.attempt_log(table(spark, folder, "submissions"), table(spark, folder, "job_requests"))


def _errors(spark: SparkSession, folder: str) -> DataFrame:
    return P.error_log(table(spark, folder, "profile_events"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return P.decayed_scores(_errors(spark, folder))


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return P.stored_counts(table(spark, folder, "profiles"))


def _weakness(spark: SparkSession, folder: str) -> DataFrame:
    return G.atom_weakness(_scores(spark, folder), table(spark, folder, "atoms"))


def r6(name: str):
    return F.round(name, 6).alias(name)


def focus(spark: SparkSession) -> DataFrame:
    """A query for most subtypes; some have none."""
    rows = [(k, None if k in ("other", "deposit") else "ЕГЭ: " + v) for k, v in SUBTYPE_LABELS.items() if k != "optimisation"]
    return spark.createDataFrame(rows, "subtype string, query string")


def profile_attempt_seq(spark, folder):
    return _attempts(spark, folder).select("student_id", "delivery_id", "seq", "subtype", "ok")


def profile_counts(spark, folder):
    return P.attempt_counts(_attempts(spark, folder))


def profile_error_events(spark, folder):
    return P.attempt_errors(_attempts(spark, folder)).select("student_id", "seq", "place", "tag", "persistent", "weight")


def profile_persistence(spark, folder):
    errors = P.attempt_errors(_attempts(spark, folder))
    return errors.groupBy("student_id").agg(F.count("*").alias("n_errors"), F.sum(F.col("persistent").cast("long")).alias("n_persistent"))


def profile_error_scores_raw(spark, folder):
    return P.raw_scores(_errors(spark, folder)).select("student_id", "tag", r6("score"))


def profile_error_scores_decayed(spark, folder):
    return _scores(spark, folder).select("student_id", "tag", r6("score"))


def profile_top_errors(spark, folder):
    top = P.top_errors(_scores(spark, folder), 5, table(spark, folder, "atoms"))
    return top.select("student_id", "place", "tag", r6("score"))


def profile_top_errors_subtype(spark, folder):
    top = P.top_errors(_scores(spark, folder), 5, table(spark, folder, "atoms"), "trigonometric_eq")
    return top.select("student_id", "place", "tag", r6("score"))


def profile_skill_transfer(spark, folder):
    return P.skill_transfer(_errors(spark, folder), table(spark, folder, "atoms")).select("student_id", "skill", r6("score"))


def profile_mastery(spark, folder):
    return P.mastery(_counts(spark, folder)).select("student_id", "subtype", r6("mastery"))


def profile_detail_level(spark, folder):
    return P.accuracy_level(_counts(spark, folder)).select("student_id", "attempts", "wrong", r6("accuracy"), "detail")


def profile_retention(spark, folder):
    kept = P.retained(_errors(spark, folder))
    return kept.groupBy("student_id").agg(F.count("*").alias("n_kept"), F.min("seq").alias("oldest_seq"))


def profile_recent_attempts_kept(spark, folder):
    kept = P.newest(_attempts(spark, folder), DEFAULT.recent_limit, "student_id", "seq")
    return kept.groupBy("student_id").agg(F.count("*").alias("n_kept"), F.min("seq").alias("oldest_seq"))


def profile_summary(spark, folder):
    return P.summary(_counts(spark, folder), P.top_errors(_scores(spark, folder), 8, table(spark, folder, "atoms")))


def profile_recent_wrong(spark, folder):
    return P.recent_wrong(_errors(spark, folder))


def profile_recent_wrong_context(spark, folder):
    return P.recent_wrong_context(_errors(spark, folder))


def profile_recent_attempts(spark, folder):
    return P.recent_attempts(_attempts(spark, folder))


def profile_recent_wrong_examples(spark, folder):
    return P.recent_wrong_examples(_attempts(spark, folder), _errors(spark, folder))


def profile_concrete_mistakes(spark, folder):
    return P.concrete_mistakes(_errors(spark, folder))


def profile_past_context(spark, folder):
    return P.past_context(_errors(spark, folder))


def topic_queries(spark, folder):
    return P.topic_queries(_errors(spark, folder), 10)


def practised_subtypes(spark, folder):
    return P.practised_subtypes(_counts(spark, folder), focus(spark))


def atom_weakness(spark, folder):
    return _weakness(spark, folder).select("student_id", "atom", r6("weakness"))


def mastery_level(spark, folder):
    atoms = table(spark, folder, "atoms")
    learners = table(spark, folder, "profiles").select("student_id").distinct()
    pairs = beside(learners, atoms.where("task_number = 10").select(F.col("id").alias("atom")))
    levels = pairs.join(_weakness(spark, folder), ["student_id", "atom"], "left")
    return levels.select("student_id", "atom", F.round(G.mastery_level(F.col("weakness")), 6).alias("mastery"))


def predicted_weakness(spark, folder):
    return G.predicted_weakness(_weakness(spark, folder), table(spark, folder, "atoms")).select("student_id", "atom", r6("predicted"))


def frontier_topics(spark, folder):
    return G.frontier(_weakness(spark, folder), table(spark, folder, "atoms"), 6).select("student_id", "place", "atom", F.round("priority", 10).alias("priority"))


def frontier_topics_of_task(spark, folder):
    return G.frontier(_weakness(spark, folder), table(spark, folder, "atoms"), 5, 12).select("student_id", "place", "atom", F.round("priority", 10).alias("priority"))


def prereq_bfs(spark, folder):
    return G.prerequisites(table(spark, folder, "atoms"), 2)


def direct_dependents(spark, folder):
    return G.dependents(table(spark, folder, "atoms"), 1).select("prereq", "atom")


def atom_tag_check(spark, folder):
    registry = _errors(spark, folder).select("tag").distinct()
    return G.unknown_tags(table(spark, folder, "atoms"), registry)


def import_totals(spark, folder):
    """Totals of an import of the archive."""
    a = _attempts(spark, folder)
    return a.agg(F.countDistinct("student_id").alias("n_users"), F.count("*").alias("n_attempts"), F.sum((~F.col("ok")).cast("long")).alias("n_wrong"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        profile_attempt_seq, profile_counts, profile_error_events, profile_persistence, profile_error_scores_raw, profile_error_scores_decayed, profile_top_errors, profile_top_errors_subtype,
        profile_skill_transfer, profile_mastery, profile_detail_level, profile_retention, profile_recent_attempts_kept, profile_summary, profile_recent_wrong, profile_recent_wrong_context,
        profile_recent_attempts, profile_recent_wrong_examples, profile_concrete_mistakes, profile_past_context, topic_queries, practised_subtypes, atom_weakness, mastery_level,
        predicted_weakness, frontier_topics, frontier_topics_of_task, prereq_bfs, direct_dependents, atom_tag_check, import_totals,
    )
}

_EVENTS_OF_ATTEMPTS = f"""{ATTEMPTS}, raw as (select student_id, seq, task_number, unnest(case when len(tags) > 0 then tags else ['unknown'] end) tag,
    generate_subscripts(case when len(tags) > 0 then tags else ['unknown'] end, 1) - 1 place from attempts where not ok),
  flagged as (select *, tag <> 'unknown' and len(list_filter(coalesce(list(tag) over (partition by student_id order by seq, place rows between 12 preceding and 1 preceding), []), lambda x: x = tag)) >= 3 persistent from raw)"""
_SUBTYPE_TOP = TOP.format(5).replace("from atoms)", "from atoms where list_contains(subtypes, 'trigonometric_eq'))")
_FOCUS = "focus as (select * from (values " + ", ".join(f"('{k}', " + ("null" if k in ("other", "deposit") else f"'ЕГЭ: {v}'") + ")" for k, v in SUBTYPE_LABELS.items() if k != "optimisation") + ") t(subtype, query))"
_FRONTIER = f"""{WEAK}, {EDGES},
  hop as (select prereq, atom, 1 hops from edges union all select a.prereq, b.atom, 2 from edges a join edges b on a.atom = b.prereq),
  near as (select prereq, atom, min(hops) hops from hop where prereq <> atom group by 1, 2),
  pred as (select student_id, w.atom, weakness, weakness * (1 + coalesce(f, 0)) predicted from weak w left join (select prereq atom, sum(pow(0.7, hops)) f from near group by 1) using (atom)),
  pre as (select student_id, a.id atom, sum(weakness) s from (select id, unnest(prerequisites) p from atoms) a join weak on p = weak.atom group by 1, 2),
  front as (select student_id, p.atom, task_number, ord, weakness + 0.15 * predicted - 0.5 * coalesce(s, 0) / greatest(len(prerequisites), 1) priority
    from pred p join atoms on atoms.id = p.atom left join pre using (student_id, atom) where weakness >= 0.2 and not starts_with(p.atom, 'mc_'))"""

ORACLES: dict[str, str] = {
    "profile_attempt_seq": f"with {ATTEMPTS} select student_id, delivery_id, seq, subtype, ok from attempts",
    "profile_counts": f"with {ATTEMPTS} select student_id, subtype, count(*) attempts, count(*) filter (not ok) wrong from attempts group by 1, 2",
    "profile_error_events": f"with {_EVENTS_OF_ATTEMPTS} select student_id, seq, place, tag, persistent, case when persistent then 1.5::double else 1.0::double end weight from flagged",
    "profile_persistence": f"with {_EVENTS_OF_ATTEMPTS} select student_id, count(*) n_errors, count(*) filter (persistent) n_persistent from flagged group by 1",
    "profile_error_scores_raw": f"with {ERRORS} select student_id, tag, round(sum(weight), 6) score from errors group by 1, 2",
    "profile_error_scores_decayed": f"with {SCORES} select student_id, tag, round(score, 6) score from scores",
    "profile_top_errors": f"with {SCORES}, {TOP.format(5)} select student_id, place, tag, round(score, 6) score from top",
    "profile_top_errors_subtype": f"with {SCORES}, {_SUBTYPE_TOP} select student_id, place, tag, round(score, 6) score from top",
    "profile_skill_transfer": f"""with {ERRORS}, t as (select skill, tag, count(*) n from (select tag, unnest(shared_skills) skill from (select unnest(error_tags) tag, shared_skills from atoms)) group by 1, 2)
      select student_id, skill, round(sum(weight * n * 0.3), 6) score from errors join t using (tag) where tag <> 'unknown' group by 1, 2""",
    "profile_mastery": f"with {COUNTS} select student_id, subtype, round(case when attempts > 0 then greatest(0.0, least(1.0, 1 - wrong / attempts)) else 0.0 end, 6) mastery from counts",
    "profile_detail_level": f"""with {COUNTS}, t as (select student_id, sum(attempts)::bigint attempts, sum(wrong)::bigint wrong from counts group by 1), u as (select *, case when attempts > 0 then (attempts - wrong) / attempts else 0.0 end accuracy from t)
      select student_id, attempts, wrong, round(accuracy, 6) accuracy, case when accuracy < 0.3 then 'подробный' when accuracy < 0.6 then 'средний' else 'краткий' end detail from u""",
    "profile_retention": f"with {ERRORS}, {KEPT} select student_id, count(*) n_kept, min(seq) oldest_seq from kept group by 1",
    "profile_recent_attempts_kept": f"with {ATTEMPTS} select student_id, count(*) n_kept, min(seq) oldest_seq from (select * from attempts qualify row_number() over (partition by student_id order by seq desc) <= 100) group by 1",
    "profile_recent_wrong": f"""with {ERRORS}, one as (select * replace (coalesce(task_id, '') as task_id) from errors qualify row_number() over (partition by student_id, coalesce(errors.task_id, '') order by seq desc, rec_id desc) = 1)
      select student_id, row_number() over (partition by student_id order by seq desc, rec_id desc) place, task_id, task_number, coalesce(problem_katex, '') task_text, coalesce(solution, '') solution, student_answer, correct_answer from one qualify place <= 5""",
    "profile_recent_wrong_context": f"""with {ERRORS}, named as (select * replace (coalesce(nullif(task_id, ''), coalesce(task_number::varchar, 'None') || ':' || coalesce(task_text, '')) as task_id) from errors),
      one as (select * from named qualify row_number() over (partition by student_id, task_id order by seq desc, rec_id desc) = 1)
      select student_id, row_number() over (partition by student_id order by seq desc, rec_id desc) place, task_id, task_number, subtype, tag error_tag,
        {strip_sql("coalesce(nullif(problem_katex, ''), task_text, '')")} task_text, {strip_sql("coalesce(solution, '')")} solution, student_answer, correct_answer from one qualify place <= 5""",
    "profile_recent_attempts": f"""with {ATTEMPTS}, kept as (select * from attempts qualify row_number() over (partition by student_id order by seq desc) <= 100),
      one as (select * from kept qualify row_number() over (partition by student_id, task_id order by seq desc) = 1)
      select student_id, row_number() over (partition by student_id order by seq desc) place, task_id, task_number, {label_sql("subtype")} subtype, ok, {clip_sql("task_text", 900)} problem,
        array_to_string(list_transform(tags, lambda t: {error_label_sql('t')}), ', ') errors from one qualify place <= 3""",
    "profile_recent_wrong_examples": f"""with {ATTEMPTS}, {ERRORS}, {KEPT}, recent as (select * from attempts qualify row_number() over (partition by student_id order by seq desc) <= 100),
      every as (select student_id, coalesce(task_id, '') task_id, 0 origin, seq s, 0 r, subtype, task_text problem from recent where not ok
        union all select student_id, coalesce(task_id, ''), 1, seq, rec_id, subtype, coalesce(nullif(problem_katex, ''), task_text, '') from kept),
      one as (select * from every qualify row_number() over (partition by student_id, task_id order by origin, s desc, r desc) = 1)
      select student_id, row_number() over (partition by student_id order by origin, s desc, r desc) place, task_id, origin, {label_sql("coalesce(subtype, 'other')")} subtype, {clip_sql("problem", 900)} problem from one qualify place <= 3""",
    "profile_concrete_mistakes": f"""with {ERRORS}, aged as (select *, row_number() over (partition by student_id order by seq desc, rec_id desc) age from errors qualify age <= 20),
      one as (select student_id, student_answer sa, correct_answer ca, coalesce(subtype, 'other') st, min(age) age from aged where student_answer is not null and correct_answer is not null group by 1, 2, 3, 4)
      select student_id, row_number() over (partition by student_id order by age) place, 'В задаче на ' || {label_sql("st")} || ' ответил ' || sa || ', правильный ответ ' || ca line from one qualify place <= 2""",
    "profile_past_context": f"""with {ERRORS}, aged as (select *, {strip_sql("coalesce(task_text, '')")} t, row_number() over (partition by student_id order by seq desc, rec_id desc) age from errors qualify age <= 24),
      one as (select * from aged where length(t) >= 20 qualify row_number() over (partition by student_id, left(t, 400) order by age) = 1)
      select student_id, row_number() over (partition by student_id order by age) place, '  - (задание ' || coalesce(task_number::varchar, '') || '): ' || left(t, 380) line from one qualify place <= 5""",
    "topic_queries": f"""with {ERRORS}, {KEPT}, own as (select *, replace({strip_sql("coalesce(task_text, '')")}, chr(10), ' ') t from kept where task_number = 10),
      one as (select * from own where length(t) >= 15 qualify row_number() over (partition by student_id, left(t, 240) order by nth) = 1)
      select student_id, row_number() over (partition by student_id order by nth) place, 'ЕГЭ задание 10 (текст / тип): ' || left(t, 320) query from one qualify place <= 5""",
    "practised_subtypes": f"""with {COUNTS}, {_FOCUS}, first as (select *, row_number() over (partition by student_id order by attempts desc, subtype) place from counts where attempts > 0 and subtype in (select subtype from focus) qualify place <= 4)
      select student_id, place, query from first join focus using (subtype) where query is not null""",
    "profile_summary": f"""with {SCORES}, {TOP.format(8)}, {COUNTS},
      t as (select student_id, sum(attempts)::bigint attempts, sum(wrong)::bigint wrong from counts group by 1),
      a as (select student_id, string_agg({error_label_sql('tag')} || ' ' || round(round(score, 9)::decimal(18, 9), 2)::decimal(18, 2), '; ' order by place) top_errors from top group by 1),
      b as (select student_id, string_agg({label_sql("subtype")} || ' ' || attempts, '; ' order by attempts desc, subtype) practised from (select * from counts where attempts > 0 qualify row_number() over (partition by student_id order by attempts desc, subtype) <= 8) group by 1),
      c as (select student_id, string_agg({label_sql("subtype")} || ' ' || wrong, '; ' order by wrong desc, subtype) weak from (select * from counts where wrong > 0 qualify row_number() over (partition by student_id order by wrong desc, subtype) <= 8) group by 1)
      select student_id, attempts, wrong, case when attempts = 0 or (attempts - wrong) / attempts < 0.3 then 'подробный' when (attempts - wrong) / attempts < 0.6 then 'средний' else 'краткий' end detail,
        coalesce(top_errors, '') top_errors, coalesce(practised, '') practised, coalesce(weak, '') weak from t left join a using (student_id) left join b using (student_id) left join c using (student_id)""",
    "atom_weakness": f"with {WEAK} select student_id, atom, round(weakness, 6) weakness from weak",
    "mastery_level": f"""with {WEAK}, l as (select distinct student_id from profiles), a as (select id atom from atoms where task_number = 10)
      select student_id, atom, round(greatest(0.0, least(1.0, 1 - coalesce(weakness, 0))), 6) mastery from l cross join a left join weak using (student_id, atom)""",
    "predicted_weakness": f"with {_FRONTIER} select student_id, atom, round(predicted, 6) predicted from pred",
    "frontier_topics": f"""with {_FRONTIER}, capped as (select * from front qualify row_number() over (partition by student_id, task_number order by round(priority, 9) desc, ord) <= 2)
      select student_id, row_number() over (partition by student_id order by round(priority, 9) desc, ord) place, atom, round(priority, 10) priority from capped qualify place <= 6""",
    "frontier_topics_of_task": f"with {_FRONTIER} select student_id, row_number() over (partition by student_id order by round(priority, 9) desc, ord) place, atom, round(priority, 10) priority from front where task_number = 12 qualify place <= 5",
    "prereq_bfs": f"with {EDGES}, hop as (select atom, prereq, 1 hops from edges union all select a.atom, b.prereq, 2 from edges a join edges b on a.prereq = b.atom) select atom, prereq, min(hops) hops from hop where atom <> prereq group by 1, 2",
    "direct_dependents": f"with {EDGES} select prereq, atom from edges where prereq <> atom",
    "atom_tag_check": f"with {ERRORS} select id, tag from (select id, unnest(error_tags) tag from atoms) where tag not in (select tag from errors)",
    "import_totals": f"with {ATTEMPTS} select count(distinct student_id) n_users, count(*) n_attempts, count(*) filter (not ok) n_wrong from attempts",
}
