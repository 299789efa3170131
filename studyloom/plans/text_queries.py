"""Queries of text functions and of texts put together, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom.config import TOOL_TASKS
from studyloom.functions import text as X
from studyloom.functions.cascade import SUBTYPE_LABELS, TAG_RULES, inferred_tag, subtype_of, subtype_sql
from studyloom.functions.tags import ERROR_LABELS, TASK_TAGS, allowed_tags
from studyloom.functions.mathml import task_page_text
from studyloom.operators import profile as P
from studyloom.operators import prompts as R
from studyloom.plans import profile_queries as Q
from studyloom.plans.profile_queries import BLANK, clip_sql, error_label_sql, label_sql, norm_sql, squeeze_sql, strip_sql
from studyloom.plans.tables import table


def _documents(spark, folder):
    return table(spark, folder, "documents")


def text_normalize(spark, folder):
    return _documents(spark, folder).select("doc_id", F.md5(X.normalize("text")).alias("digest"), F.length(X.normalize("text")).cast("long").alias("n"))


def task_text_normalize(spark, folder):
    return table(spark, folder, "profile_events").select("rec_id", F.md5(X.normalize_task("task_text")).alias("digest"))


def text_clip(spark, folder):
    return _documents(spark, folder).select("doc_id", X.clip("text", 120).alias("clipped"))


def answer_equality(spark, folder):
    t = table(spark, folder, "submissions")
    return t.select("delivery_id", X.same_answer("student_answer", "correct_answer").alias("same"), "is_correct")


def subtype_cascade(spark, folder):
    t = table(spark, folder, "task_bank").withColumn("normal", X.normalize(X.normalize_task(X.first_filled(X.strip("problem_katex"), "question"))))
    return t.select("task_id", subtype_of(F.col("normal"), F.col("task_number")).alias("subtype"))


def subtype_by_text(spark, folder):
    """Counts of error events by the subtype that their text has."""
    t = table(spark, folder, "profile_events").withColumn("normal", X.normalize("task_text"))
    return t.select("task_number", subtype_of(F.col("normal"), F.col("task_number")).alias("subtype")).groupBy("task_number", "subtype").agg(F.count("*").alias("n"))


def tag_inference(spark, folder):
    """By the whole registry, and by what is left of it without the tags at odd places, which leads to second choices."""
    t = table(spark, folder, "task_bank").withColumn("low", F.lower("question")).withColumn("allowed", allowed_tags(F.col("task_number")))
    some = F.filter("allowed", lambda x, i: i % 2 == 0)
    return t.select("task_id", inferred_tag(F.col("low"), F.col("task_number"), F.col("allowed")).alias("tag"), inferred_tag(F.col("low"), F.col("task_number"), some).alias("other_tag"))


def task_tags(spark, folder):
    """Tags that are allowed in each task of the bank."""
    numbers = table(spark, folder, "task_bank").select("task_number").distinct()
    tags = allowed_tags(F.col("task_number"))
    return numbers.select("task_number", F.size(tags).cast("long").alias("n"), F.get(tags, F.lit(0)).alias("first"), F.element_at(tags, -1).alias("last"))


def document_texts(spark, folder):
    """What of an atom goes into an index."""
    return table(spark, folder, "atoms").select("id", X.document_text("title", "text").alias("document"))


def subtype_labels(spark, folder):
    return table(spark, folder, "task_bank").select("task_id", X.label("subtype", SUBTYPE_LABELS).alias("label"))


def tag_labels(spark, folder):
    return table(spark, folder, "profile_events").groupBy(X.label("tag", ERROR_LABELS).alias("label")).agg(F.count("*").alias("n"))


def task_filter(spark, folder):
    t = table(spark, folder, "task_bank")
    return t.where((F.col("task_number") == 10) & (F.length("task_id") > 0) & (F.length(X.strip("answer")) > 0)).select("task_id", X.strip("answer").alias("answer"))


def query_tokens(spark, folder):
    return _documents(spark, folder).where("text is not null").select("doc_id", F.size(X.query_tokens("text")).cast("long").alias("n_tokens"), F.array_join(F.slice(X.query_tokens("text"), 1, 5), " ").alias("first"))


def token_overlap(spark, folder):
    t = table(spark, folder, "profile_events").where("task_text is not null")
    return t.select("rec_id", X.tokens_contained(X.query_tokens("task_text"), "problem_katex", "solution").cast("long").alias("n_common"))


def html_to_text(spark, folder):
    return table(spark, folder, "profile_events").select("rec_id", F.md5(X.html_to_text("task_text")).alias("digest"))


def task_pages(spark, folder):
    """Text of task pages with mathematical markup; checked against a tree walk in tests."""
    return table(spark, folder, "profile_events").select("rec_id", F.md5(task_page_text(F.col("task_text"))).alias("digest"))


def sanitize_output(spark, folder):
    return _documents(spark, folder).where("text is not null").select("doc_id", F.md5(X.sanitize_output("text")).alias("digest"))


#: Headings of the two sections that are looked at, in the words of different notes.
PRACTICE, EXAMPLE = "(?:Потренируйся|Практика)", "(?:Разбор примера|Разбор ошибки)"


def quality_scan(spark, folder):
    codes = X.quality_violations("text", PRACTICE, EXAMPLE)
    return _documents(spark, folder).where("text is not null").select("doc_id", F.array_join(codes, " | ").alias("codes"))


def violation_hints(spark, folder):
    t = _documents(spark, folder).where("text is not null").withColumn("codes", X.quality_violations("text", PRACTICE, EXAMPLE))
    return t.select("doc_id", X.violation_hints(F.col("codes")).alias("hints"))


def _notes(spark, folder):
    """Notes as a model returns them: JSON, some in fences, some with too few sections."""
    t = table(spark, folder, "atoms")
    body = F.to_json(F.named_struct(F.lit("what_to_remember"), F.col("title"), F.lit("typical_errors"), F.col("text"), F.lit("algorithm"), F.when(F.col("ord") % 3 != 0, F.concat(F.lit("## Повтор\n"), "text"))))
    return t.select("id", F.when(F.col("ord") % 2 == 0, body).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("raw"))


_NOTES_SQL = """notes as (select id, title, text, ord, case when ord % 3 <> 0 then '## Повтор' || chr(10) || text end alg from atoms)"""


def json_sections(spark, folder):
    return _notes(spark, folder).select("id", X.parse_sections("raw").alias("s")).select("id", F.coalesce(F.size("s"), F.lit(-1)).alias("n"), F.col("s")["algorithm"].alias("algorithm"))


def sections_markdown(spark, folder):
    return _notes(spark, folder).select("id", X.sections_to_markdown(X.parse_sections("raw")).alias("markdown")).where("markdown is not null")


def section_assembly(spark, folder):
    t = table(spark, folder, "atoms")
    parts = X.join_sections(("## Тема", F.col("title")), ("## Пусто", F.lit(" ")), ("## Текст", F.col("text")))
    return t.select("id", parts.alias("body"))


def safe_ids(spark, folder):
    return table(spark, folder, "submissions").groupBy(X.safe_id("submission_id").alias("id")).agg(F.count("*").alias("n"))


def argument_coercion(spark, folder):
    t = table(spark, folder, "submissions")
    return t.select(
        "delivery_id", X.limited_int("student_answer", 3, 1, 6).alias("limited"), X.optional_task(F.col("task_number").cast("string"), TOOL_TASKS).alias("task"),
        X.flag("submission_id", True).alias("flag"), F.array_join(X.string_list("correct_answer"), ",").alias("listed"),
    )


def student_order(spark, folder):
    from studyloom.operators.evaluation import student_order as key

    prefix, number, _ = key(F.col("student_id"))
    return table(spark, folder, "profiles").select("student_id", prefix.alias("prefix"), number.alias("number")).distinct()


def script_escape(spark, folder):
    return table(spark, folder, "atoms").select("id", X.script_json(F.struct(F.concat(F.lit("<b>&"), "title").alias("t"))).alias("json"))


def content_hash(spark, folder):
    return R.content_digest(table(spark, folder, "atoms"), "id", "text", "task_number")


def submissions_hash(spark, folder):
    return R.ids_digest(Q._attempts(spark, folder).select("student_id", F.col("delivery_id").cast("string").alias("id")), "student_id", "id")


def tool_queries(spark, folder):
    return R.wrong_answer_queries(P.recent_wrong_context(Q._errors(spark, folder)))


def judge_prompt_block(spark, folder):
    return R.wrong_task_block(P.recent_wrong_context(Q._errors(spark, folder)))


def query_set(spark, folder):
    errors = Q._errors(spark, folder)
    wrong = P.recent_wrong_context(errors).select("student_id", "place", F.concat(F.lit("ЕГЭ задание "), F.coalesce(F.col("task_number").cast("string"), F.lit("")), F.lit(": "), F.substring("task_text", 1, 100)).alias("query"))
    students = table(spark, folder, "profiles").select("student_id").distinct()
    parts = [(1, wrong)] + [(i + 2, P.topic_queries(errors, n, 3)) for i, n in enumerate(TOOL_TASKS)] + [(9, P.practised_subtypes(Q._counts(spark, folder), Q.focus(spark)).where("place <= 2"))]
    return R.query_sets(students, *parts)


def cold_start(spark, folder):
    pool = table(spark, folder, "atoms").select("task_number", F.col("title").alias("query"))
    return R.cold_start_queries(table(spark, folder, "profiles").select("student_id"), pool)


def task_pick(spark, folder):
    return R.pick_task(table(spark, folder, "task_bank"), 42)


def personalization_block(spark, folder):
    atoms = table(spark, folder, "atoms")
    errors = Q._errors(spark, folder)
    scores = P.decayed_scores(errors)
    topics = Q.G.frontier(Q.G.atom_weakness(scores, atoms), atoms, 6).join(atoms.select(F.col("id").alias("atom"), "title"), "atom")
    return R.learner_block(P.top_errors(scores, 8, atoms), topics, P.recent_wrong_context(errors))


def callback_snapshot(spark, folder):
    """What a result was made from: top tags with scores to three places, number and digest of the attempts."""
    top = P.top_errors(Q._scores(spark, folder), 8, table(spark, folder, "atoms"))
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat("tag", F.lit("="), F.format_string("%.3f", F.round(F.round("score", 9), 3))).alias("t"))))
    tags = top.groupBy("student_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ";").alias("top_error_tags"))
    return submissions_hash(spark, folder).join(tags, "student_id", "left").select("student_id", F.coalesce("top_error_tags", F.lit("")).alias("top_error_tags"), "n", "digest")


def argument_names(spark, folder):
    """Arguments of calls, with blanks in their names."""
    t = table(spark, folder, "task_bank")
    raw = F.when(F.col("task_number") == 13, "no json").otherwise(F.to_json(F.create_map(F.lit("task number"), F.col("task_number").cast("string"), F.lit(" error tags "), F.coalesce("subtype", F.lit("-")))))
    args = X.argument_map("raw")
    return t.select("task_id", raw.alias("raw")).select("task_id", args["task_number"].alias("task"), args["error_tags"].alias("tags"), F.size(args).cast("long").alias("n"))


def _diagnosed(spark, folder):
    """A model's diagnoses of error events: JSON, some in fences, some unreadable, some with tags that nobody knows."""
    t = table(spark, folder, "profile_events").where("tag is not null")
    body = F.to_json(F.struct(F.array(F.struct(F.lower(F.trim("tag")).alias("tag"), F.lit(" причина ").alias("reason")), F.struct(F.lit("nobody_knows").alias("tag"), F.lit("x").alias("reason")), F.struct(F.lit("unknown").alias("tag"), F.coalesce("subtype", F.lit("")).alias("reason"))).alias("mistakes")))
    kind = F.col("rec_id") % 4
    raw = F.when(kind == 0, "не JSON").when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    known = t.select(F.lower(F.trim("tag")).alias("tag")).distinct()
    return R.diagnoses(t.select(F.col("rec_id").alias("submission_id"), raw.alias("raw")), known)


def diagnosis_parse(spark, folder):
    return _diagnosed(spark, folder)


def rationale_join(spark, folder):
    return R.rationale(_diagnosed(spark, folder))


def context_bundle(spark, folder):
    """All that a note for a learner is written from."""
    atoms, errors = table(spark, folder, "atoms"), Q._errors(spark, folder)
    scores = P.decayed_scores(errors)
    titled = atoms.select(F.col("id").alias("atom"), "title", "text")
    topics = Q.G.frontier(Q.G.atom_weakness(scores, atoms), atoms, 6).join(titled, "atom").select("student_id", "place", "title")
    weak = Q.G.atom_weakness(scores, atoms).join(titled, "atom").withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc(F.round("weakness", 9)), "atom"))).where("place <= 4")
    return R.context_bundle(P.accuracy_level(Q._counts(spark, folder)), P.top_errors(scores, 8, atoms), P.concrete_mistakes(errors), topics, weak.select("student_id", "place", "atom", "title", "text"))


def similar_tasks(spark, folder):
    """For each learner with errors, solved tasks like the newest wrong one."""
    errors = Q._errors(spark, folder)
    newest = P.recent_wrong_context(errors, 1).where("length(task_text) > 0")
    queries = newest.select(F.col("student_id").alias("query_id"), "student_id", X.query_tokens(X.clip("task_text", 320)).alias("tokens"))
    solution = F.coalesce("solution", F.lit(""))
    problem = F.when(F.length(solution) > 0, X.first_filled("problem_katex", F.coalesce("task_text", F.lit("")))).otherwise("")  # without a solution a task only counts among the newest
    own = P.newest(errors.select("student_id", "seq", "rec_id", problem.alias("problem"), solution.alias("solution")), 100, "student_id", "seq", "rec_id")
    bank = table(spark, folder, "task_bank").select(F.col("task_id").alias("ord"), F.coalesce("question", F.lit("")).alias("problem"), F.coalesce("problem_katex", F.lit("")).alias("solution"))
    return R.similar_solved(queries, own, bank)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_normalize, task_text_normalize, text_clip, answer_equality, subtype_cascade, subtype_by_text, tag_inference, task_tags, document_texts, subtype_labels, tag_labels, task_filter, query_tokens, token_overlap, html_to_text,
        task_pages, sanitize_output, quality_scan, violation_hints, json_sections, sections_markdown, section_assembly, safe_ids, argument_coercion, student_order, script_escape, content_hash,
        submissions_hash, tool_queries, judge_prompt_block, query_set, cold_start, task_pick, personalization_block, callback_snapshot, similar_tasks, argument_names, diagnosis_parse, rationale_join, context_bundle,
    )
}


_TAIL = X._TAIL_MARKS.replace(X.BLANK, BLANK)


def _replace_all(text: str) -> str:
    for entity, character in X.ENTITIES:
        character = character.replace("'", "''")
        text = f"replace({text}, '{entity}', '{character}')"
    return text


def normalize_task_sql(text: str) -> str:
    t = squeeze_sql(f"translate({_replace_all(f'coalesce({text}, {chr(39) * 2})')}, chr(8202) || chr(8201) || chr(160) || '−–—', '   ---')")
    for pattern, new in ((_TAIL, ""), (rf"{BLANK}*;{BLANK}*;{BLANK}*$", ""), (rf"{BLANK}+\)", ")"), (rf"\({BLANK}+", "("), (rf"{BLANK}+([,.:;!?])", r"\1")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return strip_sql(t)


_TOKENS = "list_filter(regexp_extract_all(lower({0}), '([a-zа-яё0-9]+)', 1), lambda w: length(w) > 2)"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _tag_sql(step: int) -> str:
    """The tag among every ``step``-th tag of the task's registry."""
    lists = " ".join(f"when {n} then {list(tags[::step])!r}" for n, tags in TASK_TAGS.items())
    allowed = f"case task_number {lists} else [] end"

    def one(rules) -> str:
        cases = []
        for words, candidates in rules:
            pick = "coalesce(" + ", ".join(f"case when list_contains(a, '{c}') then '{c}' end" for c in candidates) + ", 'unknown')"
            test = " or ".join(f"contains(low, '{w}')" for w in words) or "true"
            cases.append(f"when {test} then {pick}")
        return f"case {' '.join(cases)} end"

    chosen = f"case when task_number = 6 then {one(TAG_RULES[6])} when task_number = 10 then {one(TAG_RULES[10])} else {one(TAG_RULES[12])} end"
    return f"select task_id, {chosen} tag from (select *, lower(question) low, {allowed} a from task_bank)"


_ID = X._ID
#: The same patterns without the flag that RE2 doesn't need.
_META, _INTERNAL = (p.replace("(?iu)", "(?i)") for p in (X._META_LINE, X._INTERNAL))
_LINE_RULES = f"""array_to_string(list_filter(string_split({{0}}, chr(10)), lambda l: length({strip_sql("l")}) = 0 or not (regexp_matches({strip_sql("l")}, '{_META}')
  or (regexp_matches({strip_sql("l")}, '{_INTERNAL}') and length({strip_sql("l")}) < 120
      and length(regexp_replace(regexp_replace(regexp_replace({strip_sql("l")}, '{_INTERNAL}', '', 'g'), '^[ .,:\\-–—•*#]+', ''), '[ .,:\\-–—•*#]+$', '')) < 15))), chr(10))"""
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '\({_ID}(?:,\s*{_ID})*\)', '', 'g'), '{_ID}', '', 'g')"


def _section(heading: str) -> str:
    has = rf"regexp_matches(text, '(?ims)^##\s*{heading}[ \t\r\x{{0B}}\f\n]*$')"
    return rf"case when {has} then regexp_replace(regexp_extract(text, '(?ims)^##\s*{heading}\s*?$(.*)', 1), '(?ms)^##\s+\S.*', '') end"


def _mentions(task: int) -> str:
    return rf"len(regexp_extract_all(body, '(?i)(?:задач[аи]|задани[ея])\s*:?\s*(?:№\s*|n\.?\s*)?{task}(?:[^0-9a-zа-яё_]|$)|(?:№|#)\s*{task}(?:[^0-9a-zа-яё_]|$)'))"


_PRACTICE_LINE = r"""[case when regexp_matches(lower(l), 'найдите\s+производную') or regexp_matches(lower(l), 'найти\s+производную') then 'practice_line: forbidden ''найдите производную''' end,
  case when regexp_matches(lower(l), 'найдите\s+производные') then 'practice_line: forbidden ''найдите производные''' end,
  case when regexp_matches(lower(l), 'реши(те)?\s+f') and regexp_matches(lower(l), '=\s*0') and regexp_matches(lower(l), 'задач|упражнен|найди|потренируйся') then 'practice_line: solve f''=0 posed as exam question' end,
  case when contains(lower(l), 'нет экстремума') or contains(lower(l), 'не существует экстремума') then 'practice_line: non-numeric answer (no extremum)' end,
  case when contains(l, '√') or contains(l, '\sqrt') then 'practice_line: sqrt in student-facing line' end,
  case when contains(l, 'π') or contains(l, '\pi') then 'practice_line: pi in student-facing line' end,
  case when regexp_matches(lower(l), '≈|примерно|приблизительно') then 'practice_line: approximation in practice / answer' end]"""
_EXAMPLE_LINE = r"""[case when regexp_matches(lower(l), '≈|примерно|приблизительно') then 'example_section: approximation not allowed in writeup' end,
  case when regexp_matches(lower(l), 'ответ|\*\*отв') and (contains(l, '√') or contains(l, '\sqrt')) then 'example_answer: sqrt in final answer line' end,
  case when regexp_matches(lower(l), 'ответ|\*\*отв') and (contains(l, 'π') or contains(l, '\pi')) then 'example_answer: pi in final answer line' end,
  case when regexp_matches(lower(l), 'ответ|\*\*отв') and contains(l, '≈') then 'example_answer: approx in answer line' end,
  case when regexp_matches(lower(l), 'почему\s+не\s+проверяем\s+концы') then 'example_text: wrong hint about skipping endpoints' end]"""
_SPLIT = "regexp_split_to_array({0}, '\\r\\n|\\n|\\r')"
_SCAN = f"""scan as (select doc_id, {strip_sql(_section(PRACTICE))} body, {_section(EXAMPLE)} shown from documents where text is not null),
  listed as (select doc_id, case when length(body) > 0 then list_concat(flatten(list_transform({_SPLIT.format("body")}, lambda l: {_PRACTICE_LINE})),
        [case when {_mentions(6)} < 1 or {_mentions(10)} < 1 or {_mentions(12)} < 1 then '{X.MIX}' end]) else ['{X.MISSING}'] end a,
      case when shown is not null then flatten(list_transform({_SPLIT.format("shown")}, lambda l: {_EXAMPLE_LINE})) else [] end b from scan),
  merged as (select doc_id, list_filter(list_concat(a, b), lambda x: x is not null) c from listed),
  codes as (select doc_id, list_filter(c, lambda x, i: list_position(c, x) = i) codes from merged)"""


def _hints_sql() -> str:
    parts = []
    for words, hint in X.HINTS:
        test = " or ".join("contains(v, '" + w.replace("'", "''") + "')" for w in words)
        parts.append(f"case when len(list_filter(codes, lambda v: {test})) > 0 then '" + hint.replace("'", "''") + "' end")
    listed = "list_filter([" + ", ".join(parts) + "], lambda h: h is not null)"
    return f"case when len({listed}) > 0 then array_to_string({listed}, chr(10)) else '{X.NO_HINT}' end"


_PROMPT = f"coalesce(nullif({strip_sql('problem_katex')}, ''), question)"
_BARE = "regexp_replace(regexp_replace(task_text, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_CONTEXT = Q.ORACLES["profile_recent_wrong_context"]
_TOOL_TEXT = "case when length(solution) > 0 then solution else task_text end"
_BLOCKS = """blk as (select g, left(sha256(i), 3) b, sha256(string_agg(h, '' order by i)) d, count(*) n from l group by 1, 2),
  dig as (select g, sum(n)::bigint n, sha256(string_agg(d, '' order by b)) digest from blk group by 1)"""
_DIAGNOSED = """with t as (select rec_id, lower(trim(tag)) tag, coalesce(subtype, '') s from profile_events where tag is not null and rec_id % 4 <> 0)
  select rec_id submission_id, 1 place, tag, 'причина' reason, 1.15::double weight from t union all
  select rec_id, 3, 'unknown', s, 1.15 from t where length(s) > 0 and 'unknown' in (select tag from t)"""

ORACLES: dict[str, str] = {
    "text_normalize": f"select doc_id, md5({norm_sql('text')}) digest, length({norm_sql('text')}) n from documents",
    "task_text_normalize": f"select rec_id, md5({normalize_task_sql('task_text')}) digest from profile_events",
    "text_clip": f"select doc_id, {clip_sql('text', 120)} clipped from documents",
    "answer_equality": f"select delivery_id, regexp_replace(replace(student_answer, ',', '.'), '{BLANK}+', '', 'g') = regexp_replace(replace(correct_answer, ',', '.'), '{BLANK}+', '', 'g') same, is_correct from submissions",
    "subtype_cascade": f"with t as (select task_id, task_number, {norm_sql(normalize_task_sql(_PROMPT))} n from task_bank) select task_id, {subtype_sql('n', 'task_number')} subtype from t",
    "subtype_by_text": f"with t as (select task_number, {norm_sql('task_text')} n from profile_events) select task_number, {subtype_sql('n', 'task_number')} subtype, count(*) n from t group by 1, 2",
    "tag_inference": f"select a.task_id, a.tag, b.tag other_tag from ({_tag_sql(1)}) a join ({_tag_sql(2)}) b using (task_id)",
    "task_tags": """select distinct task_number, case task_number when 6 then 10 when 10 then 21 when 12 then 13 when 13 then 14 when 16 then 13 else 0 end::bigint n,
      case task_number when 6 then 'wrong_base_reduction' when 10 then 'units_mismatch' when 12 then 'deriv_wrong_rule' when 13 then 'trig_forgot_odz_function' when 16 then 'fin_simple_vs_compound' end first,
      case task_number when 6 then 'sign_error_in_equation' when 10 then 'progression_off_by_one' when 12 then 'product_rule_error' when 13 then 'trig_enumeration_no_outside_check' when 16 then 'fin_integer_constraint_ignored' end last from task_bank""",
    "document_texts": "select id, title || chr(10) || text document from atoms",
    "subtype_labels": f"select task_id, {label_sql('subtype')} label from task_bank",
    "tag_labels": f"select {error_label_sql('tag')} label, count(*) n from profile_events group by 1",
    "task_filter": f"select task_id, {strip_sql('answer')} answer from task_bank where task_number = 10 and length(task_id) > 0 and length({strip_sql('answer')}) > 0",
    "query_tokens": f"with t as (select doc_id, {_TOKENS.format('text')} w from documents where text is not null) select doc_id, len({_DISTINCT.format('w')}) n_tokens, array_to_string(({_DISTINCT.format('w')})[1:5], ' ') first from t",
    "token_overlap": f"with t as (select rec_id, {_TOKENS.format('task_text')} w, lower(coalesce(problem_katex, '') || ' ' || coalesce(solution, '')) h from profile_events where task_text is not null) select rec_id, len(list_filter({_DISTINCT.format('w')}, lambda x: contains(h, x))) n_common from t",
    "html_to_text": f"select rec_id, md5(regexp_replace({squeeze_sql(_replace_all(_BARE))}, '{_TAIL}', '')) digest from profile_events",
    "sanitize_output": f"""with t as (select doc_id, text, {_LINE_RULES.replace("{0}", _CLEAN)} o from documents where text is not null)
      select doc_id, md5(case when length({strip_sql("text")}) = 0 then text when length({strip_sql("o")}) > 0 then o else {strip_sql("text")} end) digest from t""",
    "quality_scan": f"with {_SCAN} select doc_id, array_to_string(codes, ' | ') codes from codes",
    "violation_hints": f"with {_SCAN} select doc_id, {_hints_sql()} hints from codes",
    "json_sections": f"""with {_NOTES_SQL} select id, case when alg is null then -1 else 3 end n, {strip_sql("alg")} algorithm from notes""",
    "sections_markdown": f"""with {_NOTES_SQL} select id, '## Что важно запомнить' || chr(10) || chr(10) || {strip_sql("title")} || chr(10) || chr(10) || '## Типичные ошибки' || chr(10) || chr(10) || {strip_sql("text")}
      || chr(10) || chr(10) || '## Алгоритм решения' || chr(10) || chr(10) || {strip_sql("text")} markdown from notes where alg is not null""",
    "section_assembly": f"select id, '## Тема' || chr(10) || chr(10) || {strip_sql('title')} || chr(10) || chr(10) || '## Текст' || chr(10) || chr(10) || {strip_sql('text')} body from atoms",
    "safe_ids": r"select regexp_replace(submission_id, '[^\p{L}\p{N}_-]', '', 'g') id, count(*) n from submissions group by 1",
    "argument_coercion": rf"""select delivery_id, greatest(1, least(6, coalesce(case when regexp_matches({strip_sql("student_answer")}, '^[+-]?\d{{1,9}}$') then {strip_sql("student_answer")}::int end, 3))) limited,
      case when task_number in (6, 10, 12) then task_number end task, case when lower({strip_sql("submission_id")}) in ('0', 'false', 'no', 'off') then false else true end flag,
      coalesce(nullif({strip_sql("correct_answer")}, 'null'), '') listed from submissions""",
    "student_order": r"select distinct student_id, case when regexp_matches(student_id, '_u\d+$') then regexp_extract(student_id, '^(.*)_u\d+$', 1) else student_id end prefix, case when regexp_matches(student_id, '_u\d+$') then regexp_extract(student_id, '_u(\d+)$', 1)::bigint else 0 end number from profiles",
    "script_escape": r"""select id, '{"t":"' || chr(92) || 'u003cb' || chr(92) || 'u003e' || chr(92) || 'u0026' || title || '"}' json from atoms""",
    "content_hash": f"with l as (select task_number g, id i, sha256(id || '|' || coalesce(text, '') || chr(10)) h from atoms), {_BLOCKS} select g task_number, left(digest, 16) digest from dig",
    "submissions_hash": f"with {Q.ATTEMPTS}, l as (select student_id g, delivery_id::varchar i, delivery_id::varchar h from attempts), {_BLOCKS} select g student_id, n, 'sha256:' || left(digest, 32) digest from dig",
    "tool_queries": f"with c as ({_CONTEXT}) select student_id, place, {strip_sql(_TOOL_TEXT)} || coalesce(' Ученик ответил ' || student_answer || '.', '') || coalesce(' Правильный ответ ' || correct_answer || '.', '') query from c",
    "judge_prompt_block": f"""with c as ({_CONTEXT}), o as (select student_id, place, 'Задача ' || place || ':' || case when length(solution) > 0 then chr(10) || '- Условие задачи с примером решения: ' || solution when length(task_text) > 0 then chr(10) || '- Условие задачи: ' || task_text else '' end
      || coalesce(chr(10) || '- Ответ ученика: ' || student_answer, '') || coalesce(chr(10) || '- Правильный ответ: ' || correct_answer, '') t from c) select student_id, string_agg(t, chr(10) || chr(10) order by place) block from o group by 1""",
    "query_set": f"""with c as ({_CONTEXT}), every as (select student_id, 1 part, place at_, 'ЕГЭ задание ' || coalesce(task_number::varchar, '') || ': ' || left(task_text, 100) query from c
      union all select student_id, 2, place, query from ({Q.ORACLES["topic_queries"].replace("task_number = 10", "task_number = 6").replace("'ЕГЭ задание 10 (текст / тип): '", "'ЕГЭ задание 6 (уравнение / тип): '").replace("place <= 5", "place <= 3")})
      union all select student_id, 3, place, query from ({Q.ORACLES["topic_queries"].replace("place <= 5", "place <= 3")})
      union all select student_id, 4, place, query from ({Q.ORACLES["topic_queries"].replace("task_number = 10", "task_number = 12").replace("'ЕГЭ задание 10 (текст / тип): '", "'ЕГЭ задание 12 (микромодуль / тип задачи): '").replace("place <= 5", "place <= 3")})
      union all select student_id, 9, place, query from ({Q.ORACLES["practised_subtypes"]}) where place <= 2
      union all select distinct student_id, 1000000, 1, '{R.OVERVIEW}' from profiles),
      once as (select student_id, query, min((part, at_)) f from every where query is not null group by 1, 2)
      select student_id, row_number() over (partition by student_id order by f, query) place, query from once""",
    "cold_start": """with m as (select distinct p.student_id, a.task_number, a.title query, sha256(p.student_id || chr(1) || a.title) own from (select distinct student_id from profiles) p, atoms a),
      n as (select *, row_number() over (partition by student_id, task_number order by own) nth from m qualify nth <= 3) select student_id, row_number() over (partition by student_id order by task_number, nth) place, query from n""",
    "task_pick": f"select task_number, arg_min(task_id, sha256(task_id || '#42')) task_id from task_bank where length(task_id) > 0 and length({strip_sql('answer')}) > 0 group by 1",
    "callback_snapshot": f"""with t as (select student_id, string_agg(tag || '=' || round(round(score, 9)::decimal(18, 9), 3)::decimal(18, 3), ';' order by place) top_error_tags from (with {Q.SCORES}, {Q.TOP.format(8)} select * from top) group by 1),
      {Q.ATTEMPTS}, l as (select student_id g, delivery_id::varchar i, delivery_id::varchar h from attempts), {_BLOCKS}, h as (select g student_id, n, 'sha256:' || left(digest, 32) digest from dig)
      select student_id, coalesce(top_error_tags, '') top_error_tags, n, digest from h left join t using (student_id)""",
    "argument_names": "select task_id, case when task_number <> 13 then task_number::varchar end task, case when task_number <> 13 then coalesce(subtype, '-') end tags, case when task_number = 13 then 0 else 2 end n from task_bank",
    "diagnosis_parse": _DIAGNOSED,
    "rationale_join": f"select submission_id, string_agg(tag, ',' order by place) tags, string_agg(reason, ' - ' order by place) rationale from ({_DIAGNOSED}) group by 1",
    "context_bundle": f"""with {Q.SCORES}, {Q.TOP.format(8)}, {Q.COUNTS}, b as (select student_id, sum(attempts)::bigint a, sum(wrong)::bigint w from counts group by 1),
      e as (select student_id, list({error_label_sql('tag')} order by place) e from top where place <= 5 group by 1),
      m as (select student_id, string_agg('  - ' || line, chr(10) order by place) m from ({Q.ORACLES["profile_concrete_mistakes"]}) group by 1),
      f as (select student_id, string_agg('  - ' || title, chr(10) order by place) f from ({Q.ORACLES["frontier_topics"]}) x join atoms on id = atom where place <= 3 group by 1),
      r as (select student_id, row_number() over (partition by student_id order by round(weakness, 9) desc, atom) place, title, text from (with {Q.WEAK} select * from weak) x join atoms on id = atom qualify place <= 4),
      c as (select student_id, string_agg(place || '. ' || title || chr(10) || text, chr(10) || chr(10) order by place) c from r group by 1)
      select student_id, case when a = 0 or (a - w) / a < 0.3 then 'подробный' when (a - w) / a < 0.6 then 'средний' else 'краткий' end detail,
        case when e is null then '{R._NO_ERRORS}' else '{R._ERRORS_LEAD}' || chr(10) || array_to_string(list_transform(e, lambda x: '  - ' || x), chr(10)) || coalesce(chr(10) || chr(10) || '{R._EXAMPLES_LEAD}' || chr(10) || m, '') end errors_block,
        coalesce('{R._TOPICS_LEAD}' || chr(10) || f, '') frontier_block, coalesce('{R._MATERIAL_LEAD}' || chr(10) || c, '{R._NO_MATERIAL}') context_section, coalesce(len(e), 2)::int n_err_items, coalesce(e[1], '{R._ANY_ERROR}') top_err
      from b left join e using (student_id) left join m using (student_id) left join f using (student_id) left join c using (student_id)""",
}
