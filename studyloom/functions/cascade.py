"""Ordered keyword rules: the first rule that a text meets names it.

A rule is a label with groups of words; a group holds if one of its words occurs in the text (all
groups must), and none of the rule's excluded words may occur. Words are looked up in the form of
:func:`studyloom.functions.text.normalize`. The same rules give a column expression and SQL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    label: str
    groups: tuple[tuple[str, ...], ...] = ()
    never: tuple[str, ...] = ()


OTHER = "other"
_TRIG_13 = ("sin", "cos", "tg", "ctg", "син", "кос", "танг", "котанг")
_SQUARE = ("^2", "²", "{2}")
_DOUBLE = ("2x", "2 x", "\\cos2", "\\sin2")
_CURRENT = ("течение", "по течению", "против течения")
_BOAT = ("плот", "катер", "лодк", "баржа", "теплоход", "пароход")
_LAKE = ("озер", "пруд", "водохранилищ")
_CREDIT = ("кредит", "взять в долг", "погасить", "заёмщик", "заемщик")
_DEPOSIT = ("вклад", "вкладчик", "депозит", "положил", "пополн")

# Keyword rules of the subtypes of each task number, in order.
SUBTYPE_RULES: dict[int, tuple[Rule, ...]] = {
    6: (
        Rule("trigonometric_eq", (("sin", "cos", "tg", "ctg", "триг", "синус", "косинус", "тангенс", "арксинус", "arcsin"),)),
        Rule("logarithmic_eq", (("log", "ln", "логарифм"),)),
        Rule("irrational_eq", (("корень", "sqrt", "иррацион"),)),
        Rule("exponential_eq", (("^", "степен", "показател"),)),
        Rule("quadratic_eq", (("квадратн", "дискриминант", "биквадрат", "x²"),)),
        Rule("combined_eq", (("модул", "|", "систем", "уравнен"),)),
    ),
    10: (
        Rule("progression", (("прогресс", "арифметическ", "геометрическ", "a_n", "s_n", "q^", "член прогрессии"),)),
        Rule("joint_work", (("труба", "насос", "резервуар", "бак", "выполнит", "детал", "работая вместе", "производительность"),)),
        Rule("water_motion", (_CURRENT,), _LAKE),
        Rule("straight_motion", (_BOAT, _LAKE)),
        Rule("water_motion", ((*_CURRENT, *_BOAT),)),
        Rule("circular_motion", (("круг", "окружност", "кольц", "стрелк", "часов"),)),
        Rule("straight_motion", (("выехал", "встрет", "км/ч", "скорост", "прибыл", "догнал", "обгон"),)),
        Rule("percent_mixture", (("сплав", "раствор", "смес", "концентрац", "процент", "%", "доля"),)),
        Rule("equation_setup", (("уравнен", "неизвест", "составьте", "найдите значение"),)),
    ),
    12: (
        Rule("trig", (("sin", "cos", "tg", "ctg", "триг", "синус", "косинус", "тангенс"),)),
        Rule("exp_log", (("ln", "log", "логарифм", "e^", "exp", "экспонент"),)),
        Rule("quotient", (("/",), ("x", "f("))),
        Rule("product", (("·", "*"),)),
        Rule("product", (("(",), (")(",))),
        Rule("power_irrational", (("корень", "sqrt", "x^", "степен", "многочлен", "производн"),)),
        Rule("no_derivative", (("график", "по рисунку", "без производной", "возрастает", "убывает"),)),
    ),
    13: (
        Rule("log_trig", (("log", "ln ", "ln(", "лог"), _TRIG_13)),
        Rule("exp_trig", (("^x", "^{x", "^\\sin", "^{\\sin", "^\\cos", "^{\\cos"), _TRIG_13)),
        Rule("fractional_zero_numerator", (("\\frac", "/"), ("=0", "= 0"), _TRIG_13)),
        Rule("quadratic_in_one_func", (("tg",), _SQUARE)),
        Rule("mixed_double_angle", (_DOUBLE, _TRIG_13)),
        Rule("homogeneous_second", (_SQUARE, ("sin",), ("cos",), ("\\sin x\\cos", "sinxcos", "sin x cos"))),
        Rule("quadratic_in_one_func", (_SQUARE, _TRIG_13)),
        Rule("non_homogeneous_first", (("sin",), ("cos",)), _SQUARE),
        Rule("simplest_trig", (_TRIG_13,)),
    ),
    16: (
        Rule("optimisation", (("прибыл", "издержк", "себестоимост", "произвед"),), (*_CREDIT, *_DEPOSIT)),
        Rule("deposit", (_DEPOSIT,), _CREDIT),
        Rule("debt_schedule_credit", (("таблиц", "доля", "следующей таблице", "должен составлять"),)),
        Rule("differentiated_credit", (("одну и ту же сумму меньше", "одну и ту же величину меньше", "равными частями", "равными долями"),)),
        Rule("annuity_credit", (("равные плате", "одинаковые сумм", "равных плате", "ежегодно по"),)),
        Rule("find_rate_or_term", (("найдите r", "чему равно r", "ставк", "найдите n", "найдите наименьш", "целое число лет", "сколько лет"),)),
        Rule("annuity_credit", (_CREDIT,)),
    ),
}
# Candidates for the tag of an archive entry, by words of its labels; the first allowed candidate counts.
TAG_RULES: dict[int, tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]] = {
    6: (
        (("лог", "ln ", "ln(", "логарифм"), ("log_domain_missed", "log_property_error")),
        (("sin", "cos", "tg", "тригонометр", "синус", "косинус"), ("trig_lost_solutions", "trig_extra_solutions")),
        (("корень", "sqrt", "иррацион"), ("irrational_no_check",)),
        (("степен", "показател", "^", "a^x"), ("wrong_base_reduction", "exp_property_error")),
        (("квадрат", "дискриминант", "биквадрат"), ("quadratic_discriminant_error", "forgot_back_substitution")),
        ((), ("sign_error_in_equation", "forgot_back_substitution")),
    ),
    10: (
        (("течени", "по течению", "против течения", "теплоход", "катер", "лодк", "плот"), ("river_swap_plus_minus", "river_forgot_v_gt_u", "motion_wrong_relative_speed")),
        (("прогресс", "арифмет", "геометр", "член прогрессии"), ("progression_wrong_formula", "progression_off_by_one")),
        (("процент", "раствор", "смес", "концентрац", "сплав"), ("percent_wrong_base", "percent_used_as_number", "mixture_not_using_balance")),
        (("работ", "насос", "труба", "бак", "выполнит", "детал"), ("work_wrong_rate_equation", "work_added_times_instead_of_rates")),
        (("км/ч", "скорост", "встрет", "догнал", "выехал", "прибыл"), ("motion_wrong_relative_speed", "motion_mixed_time_and_distance")),
        (("средн",), ("avg_speed_arithmetic_mean", "avg_speed_used_wrong_total_time")),
        ((), ("picked_wrong_variable", "lost_parentheses_or_sign")),
    ),
    12: (
        (("sin", "cos", "tg", "ctg", "триг", "синус", "косинус", "тангенс"), ("trig_deriv_error",)),
        (("лог", "ln ", "ln(", "натуральн"), ("log_deriv_error",)),
        (("показател", "e^", "exp"), ("exp_deriv_error",)),
        (("частн", "отношен", "quotient"), ("quotient_rule_error",)),
        (("произвед", "product"), ("product_rule_error",)),
        (("экстремум", "минимум", "максимум", "критич", "производн"), ("critical_point_wrong_eq", "minmax_forgot_endpoints", "minmax_wrong_sign_analysis")),
        ((), ("deriv_wrong_rule", "deriv_sign_error")),
    ),
}
# Readable names of subtypes.
SUBTYPE_LABELS = {
    "joint_work": "совместную работу",
    "water_motion": "движение по воде",
    "straight_motion": "прямолинейное движение",
    "circular_motion": "движение по окружности",
    "percent_mixture": "проценты и смеси",
    "equation_setup": "составление уравнений",
    "progression": "прогрессии",
    "no_derivative": "анализ графика без производной",
    "power_irrational": "степенные и иррациональные функции",
    "quotient": "дробные функции",
    "product": "произведение функций",
    "exp_log": "показательные и логарифмические функции",
    "trig": "тригонометрические функции",
    "exponential_eq": "показательные уравнения",
    "logarithmic_eq": "логарифмические уравнения",
    "trigonometric_eq": "тригонометрические уравнения",
    "irrational_eq": "иррациональные уравнения",
    "quadratic_eq": "квадратные и приводимые к ним уравнения",
    "combined_eq": "смешанные уравнения и замены",
    "simplest_trig": "простейшие тригонометрические уравнения",
    "quadratic_in_one_func": "уравнения, сводимые к квадратному",
    "homogeneous_first": "однородные тригонометрические уравнения первой степени",
    "homogeneous_second": "однородные тригонометрические уравнения второй степени",
    "non_homogeneous_first": "линейные тригонометрические уравнения вида a·sin x + b·cos x = c",
    "factorisation": "уравнения, решаемые разложением на множители",
    "fractional_zero_numerator": "дробно-рациональные тригонометрические уравнения",
    "exp_trig": "показательно-тригонометрические уравнения",
    "log_trig": "логарифмо-тригонометрические уравнения",
    "mixed_double_angle": "уравнения со смешанными формулами (двойной угол, приведение)",
    "interval_selection": "отбор корней на отрезке",
    "annuity_credit": "кредит с равными платежами (аннуитет)",
    "differentiated_credit": "кредит с равными частями тела долга (дифференцированный)",
    "debt_schedule_credit": "кредит с заданным графиком долга",
    "find_rate_or_term": "обратная задача (найти ставку, срок или максимальную сумму)",
    "deposit": "вклад с пополнениями",
    "optimisation": "оптимизация прибыли или издержек",
    "other": "задачу",
}


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words occurs: one pattern, so that the generated code stays small."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def cascade(text: Column, rules: tuple[Rule, ...], default: str = OTHER) -> Column:
    """The label of the first rule that the (normalised) text meets; null for null.

    Pass a column that already holds the normalised text: the expression reads it many times.
    """
    out = None
    for rule in rules:
        test = F.lit(True)
        for group in rule.groups:
            test = test & _holds(text, group)
        if rule.never:
            test = test & ~_holds(text, rule.never)
        out = F.when(test, rule.label) if out is None else out.when(test, rule.label)
    return F.when(text.isNotNull(), out.otherwise(default))


def subtype_of(text: Column, task_number: Column) -> Column:
    """Subtype of a normalised task text by its number; a number without rules is read like 10."""
    out = None
    for number, rules in SUBTYPE_RULES.items():
        if number != 10:
            label = cascade(text, rules)
            out = F.when(task_number == number, label) if out is None else out.when(task_number == number, label)
    return out.otherwise(cascade(text, SUBTYPE_RULES[10]))


def inferred_tag(text: Column, task_number: Column, allowed: Column) -> Column:
    """Tag of an archive entry from the small letters of its labels, among the ``allowed`` tags of its task; else ``unknown``. Tasks without rules are read like 12."""
    out = None
    for number, rules in TAG_RULES.items():
        pick = None
        for words, candidates in rules:
            first = F.coalesce(*(F.when(F.array_contains(allowed, c), F.lit(c)) for c in candidates), F.lit("unknown"))
            test = _holds(text, words) if words else F.lit(True)
            pick = F.when(test, first) if pick is None else pick.when(test, first)
        if number != 12:
            out = F.when(task_number == number, pick) if out is None else out.when(task_number == number, pick)
        else:
            out = out.otherwise(pick)
    return out


def cascade_sql(text: str, rules: tuple[Rule, ...], default: str = OTHER) -> str:
    """SQL of :func:`cascade` for a SQL expression of the normalised text."""

    def any_of(words: tuple[str, ...]) -> str:
        return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"

    cases = []
    for rule in rules:
        tests = [any_of(g) for g in rule.groups] + ([f"not {any_of(rule.never)}"] if rule.never else [])
        cases.append(f"when {' and '.join(tests) or 'true'} then '{rule.label}'")
    return f"case when {text} is null then null {' '.join(cases)} else '{default}' end"


def subtype_sql(text: str, task_number: str) -> str:
    """SQL of :func:`subtype_of`."""
    cases = " ".join(f"when {task_number} = {n} then {cascade_sql(text, r)}" for n, r in SUBTYPE_RULES.items() if n != 10)
    return f"case {cases} else {cascade_sql(text, SUBTYPE_RULES[10])} end"
