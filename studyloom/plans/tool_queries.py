"""Queries of the named tools, of submitted answers, and of streamed model output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.functions.cascade import subtype_sql
from studyloom.operators import submit, tools
from studyloom.plans import profile_queries as Q
from studyloom.plans.profile_queries import BLANK, error_label_sql, norm_sql
from studyloom.plans.retrieval_queries import _base
from studyloom.plans.tables import table
from studyloom.plans.text_queries import _PROMPT, normalize_task_sql


def _context(spark: SparkSession, folder: str) -> tools.Context:
    """The tables that tools read; each atom with a tag stands for a misconception of its first one."""
    atoms = table(spark, folder, "atoms")
    known = atoms.where("size(error_tags) > 0").select("title", "text", F.get("error_tags", F.lit(0)).alias("error_tag"), "task_number", "ord")
    bank = table(spark, folder, "task_bank").select(F.col("task_id").alias("ord"), "task_number", F.coalesce("question", F.lit("")).alias("problem"), F.coalesce("problem_katex", F.lit("")).alias("solution"))
    base = _base(spark, folder).select("student_id", "atom", "score")
    return tools.Context(Q._attempts(spark, folder), Q._errors(spark, folder), Q._counts(spark, folder), atoms, known, bank, base)


def tool_atoms(spark, folder):
    return tools.call(_context(spark, folder), "retrieve_learning_atoms", {"task number": "10", "k": 4})


def tool_summary(spark, folder):
    return tools.call(_context(spark, folder), "get_student_profile_summary")


def tool_wrong_examples(spark, folder):
    return tools.call(_context(spark, folder), "get_recent_wrong_examples", {"task_number": 10, "limit": "5"})


def tool_attempts(spark, folder):
    return tools.call(_context(spark, folder), "get_recent_attempts", {"limit": "3"})


def tool_hints(spark, folder):
    return tools.call(_context(spark, folder), "get_misconception_hints", {"error_tags": ["series_swapped_terms", "power_early_rounding", "root_wrong_formula"], "limit": 4}).select("student_id", "place", "title", "hint", F.col("error").alias("label"), "task_number")


def tool_solved_tasks(spark, folder):
    return tools.call(_context(spark, folder), "get_similar_solved_tasks", {"query": "насос наполняет бак", "task_number": "10"})


def tool_topics(spark, folder):
    return tools.call(_context(spark, folder), "get_frontier_topics", {"task_number": "12"}).select("student_id", "place", "title", "task_number")


def submit_answers(spark, folder):
    """All deliveries as submitted answers, with the tags that came along as a model's findings."""
    sent = table(spark, folder, "submissions")
    answers = sent.select(F.col("delivery_id").alias("submission_id"), F.col("job_id").alias("student_id"), "task_number", "task_id", "student_answer")
    found = sent.select(F.col("delivery_id").alias("submission_id"), F.posexplode("diagnostic_tags").alias("p", "tag")).select("submission_id", (F.col("p") + 1).alias("place"), "tag", F.lit(1.15).alias("weight"))
    out = submit.submit(answers, table(spark, folder, "task_bank"), found)
    return out.select("submission_id", "task_id", "task_number", "subtype", "ok", "correct_answer", "error", F.array_join("tags", ",").alias("tags"), F.round(F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x), 6).alias("weight"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tool_atoms, tool_summary, tool_wrong_examples, tool_attempts, tool_hints, tool_solved_tasks, tool_topics, submit_answers)}



def _form(c: str) -> str:
    return f"regexp_replace(replace({c}, ',', '.'), '{BLANK}+', '', 'g')"


_T10 = "'units_mismatch', 'lost_parentheses_or_sign', 'picked_wrong_variable', 'did_not_check_constraints', 'percent_used_as_number', 'percent_wrong_base', 'percent_chain_changes', 'mixture_not_using_balance', 'mixture_percent_not_to_fraction', 'mixture_wrong_total_mass', 'work_added_times_instead_of_rates', 'work_wrong_rate_equation', 'motion_mixed_time_and_distance', 'motion_wrong_relative_speed', 'motion_forgot_delay_or_stop', 'river_swap_plus_minus', 'river_forgot_v_gt_u', 'avg_speed_arithmetic_mean', 'avg_speed_used_wrong_total_time', 'progression_wrong_formula', 'progression_off_by_one'"
_T12 = "'deriv_wrong_rule', 'deriv_forgot_chain_rule', 'deriv_sign_error', 'critical_point_wrong_eq', 'critical_point_missed_domain', 'minmax_forgot_endpoints', 'minmax_wrong_sign_analysis', 'minmax_confused_min_max', 'trig_deriv_error', 'log_deriv_error', 'exp_deriv_error', 'quotient_rule_error', 'product_rule_error'"
_T6 = "'wrong_base_reduction', 'log_domain_missed', 'log_property_error', 'exp_property_error', 'trig_lost_solutions', 'trig_extra_solutions', 'irrational_no_check', 'quadratic_discriminant_error', 'forgot_back_substitution', 'sign_error_in_equation'"
_T13 = "'trig_forgot_odz_function', 'trig_forgot_odz_denominator', 'trig_lost_solutions', 'trig_extra_solutions', 'trig_wrong_reduction', 'trig_wrong_double_angle', 'trig_wrong_arc_inverse', 'trig_substitution_no_check', 'trig_lost_series_subst', 'trig_merging_series_wrong', 'trig_interval_endpoint', 'trig_selection_per_series_skip', 'trig_selection_circle_misread', 'trig_enumeration_no_outside_check'"
_T16 = "'fin_simple_vs_compound', 'fin_wrong_base_for_percent', 'fin_wrong_growth_factor', 'fin_off_by_one_periods', 'fin_order_charge_payment', 'fin_monthly_yearly_mismatch', 'fin_geometric_sum_index_off', 'fin_boundary_debt_not_zero', 'fin_overpayment_calc_error', 'fin_table_share_misread', 'fin_annuity_vs_diff_confusion', 'fin_replenishment_timing', 'fin_integer_constraint_ignored'"

ORACLES: dict[str, str] = {
    "tool_summary": Q.ORACLES["profile_summary"],
    "tool_attempts": Q.ORACLES["profile_recent_attempts"],
    "tool_hints": f"""with k as (select title, text, error_tags[1] t, task_number, ord from atoms where len(error_tags) > 0 and error_tags[1] in ('series_swapped_terms', 'power_early_rounding', 'root_wrong_formula')),
      l as (select distinct student_id from profiles where len(map_keys(attempts)) > 0)
      select student_id, row_number() over (partition by student_id order by ord) place, title, text hint, {error_label_sql('t')} label, task_number from l, k qualify place <= 4""",
    "submit_answers": f"""with b as (select task_id, task_number n, answer, {_PROMPT} text from task_bank),
      g as (select s.delivery_id, s.task_id, s.task_number, s.student_answer, s.diagnostic_tags, b.answer, b.text, case when b.task_id is null then 'unknown_task' when s.task_number is distinct from b.n then 'other_number' end error from submissions s left join b using (task_id)),
      o as (select *, case when error is null then coalesce({_form("student_answer")} = {_form("answer")}, false) end ok, {norm_sql(normalize_task_sql("text"))} normal,
        case task_number when 6 then [{_T6}] when 10 then [{_T10}] when 12 then [{_T12}] when 13 then [{_T13}] when 16 then [{_T16}] else [] end allowed from g),
      t as (select *, list_filter(coalesce(diagnostic_tags, []), lambda x: list_contains(allowed, x)) kept from o),
      d as (select *, list_filter(kept, lambda x, i: list_position(kept, x) = i) tags from t)
      select delivery_id submission_id, task_id, task_number, case when error is null then {subtype_sql("normal", "task_number")} end subtype, ok, case when error is null then answer end correct_answer, error,
        case when ok then '' when not ok then case when len(tags) = 0 then 'unknown' else array_to_string(tags, ',') end end tags,
        case when ok then 0.0 when not ok then case when len(tags) = 0 then 1.0 else round(len(tags) * 1.15, 6) end end::double weight from d""",
}
