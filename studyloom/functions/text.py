"""Text functions as column expressions; all stay in the JVM.

Blanks are Unicode white space throughout. Every function gives null for null unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One blank character.
BLANK = r"\p{IsWhite_Space}"
#: The same for RE2.
BLANK_RE2 = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Entities that text from task pages holds, and what they stand for.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&minus;", "−"), ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))
_TAIL_MARKS = rf"(?:{BLANK}*[.;,:]){{2,}}{BLANK}*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, characters: str | None = None) -> Column:
    """Without blanks (or ``characters``, a regular expression for one of them) at both ends."""
    one = characters or BLANK
    return F.regexp_replace(F.regexp_replace(_c(c), rf"^{one}+", ""), rf"{one}+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), rf"{BLANK}+", " "))


def normalize(c: Column | str) -> Column:
    """Small letters, blanks squeezed: the form that keywords are looked up in."""
    return squeeze(F.lower(_c(c)))


def unescape(c: Column | str) -> Column:
    """The entities of :data:`ENTITIES` as characters."""
    out = _c(c)
    for entity, character in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(character))
    return out


def normalize_task(c: Column | str) -> Column:
    """Task text without entities, thin blanks, long dashes and doubled or detached punctuation. Empty for null."""
    t = F.translate(unescape(F.coalesce(_c(c), F.lit(""))), "   −–—", "   ---")
    t = squeeze(t)
    for pattern, new in ((_TAIL_MARKS, ""), (rf"{BLANK}*;{BLANK}*;{BLANK}*$", ""), (rf"{BLANK}+\)", ")"), (rf"\({BLANK}+", "("), (rf"{BLANK}+([,.:;!?])", "$1")):
        t = F.regexp_replace(t, pattern, new)
    return strip(t)


def clip(c: Column | str, limit: int) -> Column:
    """Squeezed text of at most ``limit`` characters, longer ones ending in three dots. Empty for null."""
    t = squeeze(F.coalesce(_c(c), F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 3), rf"{BLANK}+$", ""), F.lit("...")))


def answer_form(c: Column | str) -> Column:
    """An answer without blanks and with a decimal point."""
    return F.regexp_replace(F.replace(_c(c), F.lit(","), F.lit(".")), rf"{BLANK}+", "")


def same_answer(a: Column | str, b: Column | str) -> Column:
    """Whether two answers are equal in :func:`answer_form`."""
    return answer_form(a) == answer_form(b)


def safe_id(c: Column | str) -> Column:
    """Letters, digits, ``-`` and ``_`` only."""
    return F.regexp_replace(_c(c), r"[^\p{L}\p{N}_-]", "")


def query_tokens(c: Column | str) -> Column:
    """Distinct words of more than two letters or digits, in order of first use."""
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-zа-яё0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def tokens_contained(tokens: Column, *texts: Column | str) -> Column:
    """How many of the tokens occur, as substrings, in the texts; null texts are empty."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(_c(t), F.lit("")) for t in texts)))
    return F.size(F.filter(tokens, lambda t: F.contains(hay, t)))


def first_filled(*columns: Column | str) -> Column:
    """The first column that isn't null or empty, else the last as it is."""
    filled = [F.when(F.length(_c(c)) > 0, _c(c)) for c in columns[:-1]]
    return F.coalesce(*filled, _c(columns[-1]))


def label(c: Column | str, labels: dict[str, str]) -> Column:
    """The label of a name, else the name with blanks for underscores."""
    c = _c(c)
    if not labels:
        return F.replace(c, F.lit("_"), F.lit(" "))
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(table[c], F.replace(c, F.lit("_"), F.lit(" ")))


def document_text(title: Column | str, text: Column | str) -> Column:
    """What an index holds of a titled text; null if either is."""
    return F.concat(_c(title), F.lit("\n"), _c(text))


def flag(c: Column | str, default: bool | None) -> Column:
    """Three-state switch: yes-words, no-words, else the default."""
    t = F.lower(strip(c))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False).otherwise(F.lit(default).cast("boolean"))


def limited_int(c: Column | str, default: int, least: int, most: int) -> Column:
    """Whole number between bounds; what isn't one counts as the default."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.when(strip(c).rlike(r"^[+-]?\d{1,9}$"), strip(c).cast("int")), F.lit(default))))


def optional_task(c: Column | str, allowed: tuple[int, ...]) -> Column:
    """Whole number if it is an allowed task, else null."""
    n = F.when(strip(c).rlike(r"^[+-]?\d{1,9}$"), strip(c).cast("int"))
    return F.when(n.isin(*allowed), n)


def string_list(c: Column | str) -> Column:
    """Strings of a JSON list, or the text itself as the only one; blank ones are left out."""
    t = strip(F.coalesce(_c(c), F.lit("")))
    listed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    items = F.coalesce(listed, F.when((t == "") | (t == "null"), F.array().cast("array<string>")).otherwise(F.array(t)))
    return F.filter(F.transform(items, lambda x: strip(x)), lambda x: F.length(x) > 0)


def argument_map(c: Column | str) -> Column:
    """Named arguments of a JSON object, blanks in names as underscores; an empty map for anything else."""
    empty = F.create_map().cast("map<string,string>")
    parsed = F.coalesce(F.from_json(_c(c), "map<string,string>"), empty)
    return F.transform_keys(parsed, lambda k, v: F.regexp_replace(strip(k), rf"{BLANK}+", "_"))


def lines_of(c: Column | str) -> Column:
    return F.split(_c(c), "\r\n|\n|\r")


def html_to_text(c: Column | str) -> Column:
    """Tags, scripts and styles away, entities resolved, blanks squeezed, doubled closing marks away."""
    t = F.regexp_replace(_c(c), r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>", " ")
    t = squeeze(unescape(F.regexp_replace(t, "<[^>]+>", " ")))
    return F.regexp_replace(t, _TAIL_MARKS, "")


def script_json(c: Column) -> Column:
    """JSON that may stand inside a script element."""
    t = F.to_json(c)
    for character, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        t = F.replace(t, F.lit(character), F.lit(escaped))
    return t


# --- model output ---

# Ids and words of the internal scaffold that must not reach a reader.
_ID = r"t(?:06|1[02])_mm\d{1,2}"
_INTERNAL = rf"(?iu)(?:{_ID})|(?:phase|scaffold|mastery|micromodule|prereq|subtype)|(?:buggy.?rule|stepwise|diagnos)|(?:фаза\s*\d)|(?:порядок закрытия пробелов)"
_META_LINE = r"(?iu)^(?:в конспекте обнаружены ошибки|ниже приведены исправленные версии|исправленный конспект готов)(?:[^0-9a-zа-яё_]|$)"
_LONG_LINE, _SHORT_REST = 120, 15


def _without_internal_lines(c: Column) -> Column:
    def keep(line: Column) -> Column:
        bare = strip(line)
        rest = strip(F.regexp_replace(bare, _INTERNAL, ""), r"[ .,:\-–—•*#]")
        internal = bare.rlike(_INTERNAL) & (F.length(bare) < _LONG_LINE) & (F.length(rest) < _SHORT_REST)
        return (F.length(bare) == 0) | ~(bare.rlike(_META_LINE) | internal)

    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def sanitize_output(c: Column | str) -> Column:
    """A model's text without thinking blocks, internal ids, and short lines about internals.

    If nothing is left, the part after the last thinking block, else the text itself, stripped.
    """
    c = _c(c)
    t = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"\({_ID}(?:,\s*{_ID})*\)", ""), _ID, "")
    out = _without_internal_lines(t)
    parts = F.split(c, r"(?i)</think>\s*")
    tail = strip(F.element_at(parts, -1))
    fallback = F.when((F.size(parts) > 1) & (F.length(tail) > 0), _without_internal_lines(tail)).otherwise(strip(c))
    return F.when(F.length(strip(c)) == 0, c).when(F.length(strip(out)) > 0, out).otherwise(fallback)


def without_fence(c: Column | str) -> Column:
    """Text without a code fence around it."""
    t = strip(c)
    bare = F.regexp_replace(F.regexp_replace(t, r"^```\w*\n?", ""), r"\n?```\s*$", "")
    return strip(F.when(t.startswith("```"), bare).otherwise(t))


def relaxed_json(c: Column | str) -> Column:
    """The JSON object in a text: all of it without fence, else from the first brace to the last; null if there is none."""
    t = without_fence(c)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t).when((braces != "") & F.try_parse_json(braces).isNotNull(), braces)


def folded_stream(c: Column | str) -> Column:
    """The content of a streamed answer: deltas and messages of its JSON lines joined, stripped; null if there is none."""
    shape = "choices array<struct<delta:struct<content:string>,message:struct<content:string>>>, message struct<content:string>, response string"
    bare = F.transform(F.split(_c(c), "\r\n|\n|\r"), lambda x: strip(F.regexp_replace(strip(x), "^data:", "")))
    chunks = F.transform(F.filter(bare, lambda x: x.startswith("{")), lambda x: F.from_json(x, shape))
    empty = F.lit("")

    def content(chunk: Column) -> Column:
        first = F.get(chunk["choices"], 0)
        chosen = F.concat(F.coalesce(first["delta"]["content"], empty), F.coalesce(first["message"]["content"], empty))
        other = F.concat(F.coalesce(chunk["message"]["content"], empty), F.coalesce(chunk["response"], empty))
        return F.when(F.size(chunk["choices"]) > 0, chosen).otherwise(other)

    text = strip(F.array_join(F.transform(chunks, content), ""))
    return F.when(F.length(text) > 0, text)


# --- note sections ---

# Sections of a note, in order.
SECTIONS = (
    ("what_to_remember", "## Что важно запомнить"),
    ("typical_errors", "## Типичные ошибки"),
    ("algorithm", "## Алгоритм решения"),
    ("example", "## Разбор примера"),
    ("find_error", "## Найди ошибку"),
    ("checklist", "## Чеклист перед ответом"),
)
LEAST_SECTIONS = 3


def parse_sections(c: Column | str) -> Column:
    """Map of known sections of a JSON note (fences allowed), blank ones left out; null with fewer than three or without JSON."""
    data = F.from_json(without_fence(c), "map<string,string>")
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), strip(data[k]).alias("value")) for k, _ in SECTIONS))
    known = F.map_from_entries(F.filter(pairs, lambda p: F.length(p["value"]) > 0))
    return F.when(F.size(known) >= LEAST_SECTIONS, known)


def sections_to_markdown(sections: Column) -> Column:
    """Sections under their headings in order; a heading repeated at the start of a body is dropped. Null for no map."""
    parts = [
        F.when(F.length(sections[k]) > 0, F.concat(F.lit(h + "\n\n"), strip(F.regexp_replace(strip(sections[k]), r"^##\s+\S[^\n]*\n?", ""))))
        for k, h in SECTIONS
    ]
    return F.when(sections.isNotNull(), F.array_join(F.array_compact(F.array(*parts)), "\n\n"))


def join_sections(*pairs: tuple[str, Column]) -> Column:
    """Headings with their texts, empty ones skipped."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.length(strip(c)) > 0, F.concat(F.lit(h + "\n\n"), strip(c))) for h, c in pairs))), "\n\n")


# --- quality of a note ---

# Headings, and what a line of practice or of a worked example must not hold.
PRACTICE, EXAMPLE = "Потренируйся", "Разбор примера"
MIX = "practice_mix: require 1 task type 6 (equation), 1 task type 10 (text), 1 task type 12 (max/min on segment)"
MISSING = "missing_practice_section"


def section_body(c: Column | str, heading: str) -> Column:
    """The text under a second-level heading up to the next one; null if there is no such heading."""
    t = _c(c)
    start = rf"(?imsu)^##\s*{heading}[ \t\r\x{{0B}}\f\n]*$"
    rest = F.regexp_extract(t, rf"(?imsu)^##\s*{heading}\s*?$(.*)", 1)
    return F.when(t.rlike(start), F.regexp_replace(rest, r"(?ms)^##\s+\S.*", ""))


def _practice_codes(line: Column) -> Column:
    low = F.lower(line)
    about = [
        (low.rlike(r"найдите\s+производную") | low.rlike(r"найти\s+производную"), "practice_line: forbidden 'найдите производную'"),
        (low.rlike(r"найдите\s+производные"), "practice_line: forbidden 'найдите производные'"),
        (low.rlike(r"реши(те)?\s+f") & low.rlike(r"=\s*0") & low.rlike("задач|упражнен|найди|потренируйся"), "practice_line: solve f'=0 posed as exam question"),
        (F.contains(low, F.lit("нет экстремума")) | F.contains(low, F.lit("не существует экстремума")), "practice_line: non-numeric answer (no extremum)"),
        (F.contains(line, F.lit("√")) | F.contains(line, F.lit("\\sqrt")), "practice_line: sqrt in student-facing line"),
        (F.contains(line, F.lit("π")) | F.contains(line, F.lit("\\pi")), "practice_line: pi in student-facing line"),
        (low.rlike("≈|примерно|приблизительно"), "practice_line: approximation in practice / answer"),
    ]
    return F.array(*(F.when(test, F.lit(code)) for test, code in about))


def _example_codes(line: Column) -> Column:
    low = F.lower(line)
    answer = low.rlike(r"ответ|\*\*отв")
    about = [
        (low.rlike("≈|примерно|приблизительно"), "example_section: approximation not allowed in writeup"),
        (answer & (F.contains(line, F.lit("√")) | F.contains(line, F.lit("\\sqrt"))), "example_answer: sqrt in final answer line"),
        (answer & (F.contains(line, F.lit("π")) | F.contains(line, F.lit("\\pi"))), "example_answer: pi in final answer line"),
        (answer & F.contains(line, F.lit("≈")), "example_answer: approx in answer line"),
        (low.rlike(r"почему\s+не\s+проверяем\s+концы"), "example_text: wrong hint about skipping endpoints"),
    ]
    return F.array(*(F.when(test, F.lit(code)) for test, code in about))


def task_mentions(c: Column, task: int) -> Column:
    """How often a text names a task by its number."""
    return F.regexp_count(c, F.lit(rf"(?iu)(?:задач[аи]|задани[ея])\s*:?\s*(?:№\s*|n\.?\s*)?{task}(?![0-9a-zа-яё_])|(?:№|#)\s*{task}(?![0-9a-zа-яё_])"))


def quality_violations(c: Column | str, practice: str = PRACTICE, example: str = EXAMPLE) -> Column:
    """Codes of what a note breaks, each once, in the order found."""
    none = F.array().cast("array<string>")
    body, shown = strip(section_body(c, practice)), section_body(c, example)
    mixed = (task_mentions(body, 6) < 1) | (task_mentions(body, 10) < 1) | (task_mentions(body, 12) < 1)
    found = F.flatten(F.transform(lines_of(body), _practice_codes))
    first = F.when(F.length(body) > 0, F.concat(found, F.array(F.when(mixed, F.lit(MIX))))).otherwise(F.array(F.lit(MISSING)))
    second = F.when(shown.isNotNull(), F.flatten(F.transform(lines_of(shown), _example_codes))).otherwise(none)
    return F.array_distinct(F.array_compact(F.concat(first, second)))


# What to tell a writer about each group of codes.
HINTS = (
    (("practice_mix",), "В разделе «Потренируйся» должно быть: 1 задача №6 (уравнение), 1 задача №10 (текст) и 1 задача №12 (наибольшее/наименьшее на отрезке)."),
    (("approximation", "approx"), "Убери приближения (≈, «примерно») из разбора и ответов; подбери числа так, чтобы значения были точными десятичными."),
    (("производн", "f'"), "В «Потренируйся» и примерах нельзя спрашивать производную или решение f'(x)=0 как отдельную задачу — только формат №12: наибольшее/наименьшее на [a;b]."),
    (("sqrt", "pi", "approx"), "Убери √, π, ≈ из финальных ответов; подбери числа так, чтобы ответ был целым или конечной десятичной дробью."),
    (("non-numeric", "экстрем"), "Ответ к задаче — всегда одно число для бланка, не формулировки «нет экстремума»."),
    (("концы",), "Для отрезка [a;b] обязательно проверяй значения на концах и в критических точках; не пиши, что концы не нужны."),
)
NO_HINT = "Исправь нарушения формата ЕГЭ в конспекте."


def violation_hints(codes: Column) -> Column:
    """Hints for the codes, one a line."""

    def any_has(words: tuple[str, ...]) -> Column:
        test = lambda v: F.greatest(*(F.contains(v, F.lit(w)).cast("int") for w in words)) if len(words) > 1 else F.contains(v, F.lit(words[0])).cast("int")
        return F.exists(codes, lambda v: test(v) == 1)

    hints = F.array_compact(F.array(*(F.when(any_has(words), F.lit(hint)) for words, hint in HINTS)))
    return F.when(F.size(hints) > 0, F.array_join(hints, "\n")).otherwise(F.lit(NO_HINT))
