"""Names of errors: which tags a task's errors can have, and how a tag is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of each task number.
TASK_TAGS: dict[int, tuple[str, ...]] = {
    6: (
        "wrong_base_reduction",
        "log_domain_missed",
        "log_property_error",
        "exp_property_error",
        "trig_lost_solutions",
        "trig_extra_solutions",
        "irrational_no_check",
        "quadratic_discriminant_error",
        "forgot_back_substitution",
        "sign_error_in_equation",
    ),
    10: (
        "units_mismatch",
        "lost_parentheses_or_sign",
        "picked_wrong_variable",
        "did_not_check_constraints",
        "percent_used_as_number",
        "percent_wrong_base",
        "percent_chain_changes",
        "mixture_not_using_balance",
        "mixture_percent_not_to_fraction",
        "mixture_wrong_total_mass",
        "work_added_times_instead_of_rates",
        "work_wrong_rate_equation",
        "motion_mixed_time_and_distance",
        "motion_wrong_relative_speed",
        "motion_forgot_delay_or_stop",
        "river_swap_plus_minus",
        "river_forgot_v_gt_u",
        "avg_speed_arithmetic_mean",
        "avg_speed_used_wrong_total_time",
        "progression_wrong_formula",
        "progression_off_by_one",
    ),
    12: (
        "deriv_wrong_rule",
        "deriv_forgot_chain_rule",
        "deriv_sign_error",
        "critical_point_wrong_eq",
        "critical_point_missed_domain",
        "minmax_forgot_endpoints",
        "minmax_wrong_sign_analysis",
        "minmax_confused_min_max",
        "trig_deriv_error",
        "log_deriv_error",
        "exp_deriv_error",
        "quotient_rule_error",
        "product_rule_error",
    ),
    13: (
        "trig_forgot_odz_function",
        "trig_forgot_odz_denominator",
        "trig_lost_solutions",
        "trig_extra_solutions",
        "trig_wrong_reduction",
        "trig_wrong_double_angle",
        "trig_wrong_arc_inverse",
        "trig_substitution_no_check",
        "trig_lost_series_subst",
        "trig_merging_series_wrong",
        "trig_interval_endpoint",
        "trig_selection_per_series_skip",
        "trig_selection_circle_misread",
        "trig_enumeration_no_outside_check",
    ),
    16: (
        "fin_simple_vs_compound",
        "fin_wrong_base_for_percent",
        "fin_wrong_growth_factor",
        "fin_off_by_one_periods",
        "fin_order_charge_payment",
        "fin_monthly_yearly_mismatch",
        "fin_geometric_sum_index_off",
        "fin_boundary_debt_not_zero",
        "fin_overpayment_calc_error",
        "fin_table_share_misread",
        "fin_annuity_vs_diff_confusion",
        "fin_replenishment_timing",
        "fin_integer_constraint_ignored",
    ),
}
# Descriptions of tags as learners read them.
ERROR_LABELS: dict[str, str] = {
    "river_swap_plus_minus": "Путаешь формулы по/против течения: по течению скорость $v+u$, против — $v-u$",
    "river_forgot_v_gt_u": "Забываешь проверить, что собственная скорость катера больше скорости течения ($v > u$)",
    "work_added_times_instead_of_rates": r"Складываешь времена вместо производительностей: надо $\frac{1}{t_1}+\frac{1}{t_2}$, а не $t_1+t_2$",
    "work_wrong_rate_equation": "Неверно составляешь уравнение совместной работы",
    "motion_wrong_relative_speed": "Ошибаешься со скоростью сближения или удаления",
    "motion_forgot_delay_or_stop": "Пропускаешь задержку старта или остановку при подсчёте общего времени",
    "motion_mixed_time_and_distance": "Путаешь время и расстояние в формулах",
    "avg_speed_arithmetic_mean": r"Считаешь среднюю скорость как среднее арифметическое вместо $S_{\text{общ}}/T_{\text{общ}}$",
    "avg_speed_used_wrong_total_time": "Неправильно находишь общее время или общее расстояние",
    "percent_used_as_number": "Используешь процент как число, забывая делить на 100",
    "percent_wrong_base": "Берёшь процент от неправильной базы (не от того числа)",
    "percent_chain_changes": "При последовательных изменениях складываешь проценты вместо умножения множителей",
    "mixture_not_using_balance": "Не составляешь баланс вещества при смешивании",
    "mixture_percent_not_to_fraction": "Забываешь перевести проценты в доли (делить на 100) при составлении уравнения",
    "mixture_wrong_total_mass": "Ошибаешься с общей массой при смешивании",
    "picked_wrong_variable": "Неудачно выбираешь переменную — уравнение получается сложнее, чем нужно",
    "lost_parentheses_or_sign": "Теряешь скобки или знак при алгебраических преобразованиях",
    "did_not_check_constraints": "Не проверяешь ограничения: скорость > 0, время > 0, масса > 0",
    "units_mismatch": "Единицы измерения не совпадают (часы и минуты, км и м)",
    "progression_wrong_formula": "Путаешь формулы арифметической и геометрической прогрессий",
    "progression_off_by_one": "Ошибаешься на единицу: $n$ вместо $n-1$ в формуле прогрессии",
    "deriv_wrong_rule": "Неверно берёшь производную (ошибка в правиле дифференцирования)",
    "deriv_forgot_chain_rule": "Пропускаешь цепное правило: забываешь умножить на производную внутренней функции",
    "deriv_sign_error": "Теряешь знак минус в производной",
    "critical_point_wrong_eq": "Неверно решаешь уравнение $f'(x) = 0$",
    "critical_point_missed_domain": r"Не учитываешь область определения (например, $\ln x$ при $x > 0$)",
    "minmax_forgot_endpoints": "Забываешь проверить значения функции на концах отрезка",
    "minmax_wrong_sign_analysis": "Ошибаешься в анализе знака производной на интервалах",
    "minmax_confused_min_max": "Путаешь точку экстремума (значение $x$) и значение функции $f(x)$",
    "trig_deriv_error": r"Ошибаешься в производных $\sin$/$\cos$ (знак минус у косинуса!)",
    "log_deriv_error": "Ошибаешься в производной логарифма",
    "exp_deriv_error": "Ошибаешься в производной экспоненты",
    "quotient_rule_error": "Ошибка в формуле производной дроби (знак в числителе)",
    "product_rule_error": "Ошибка в формуле производной произведения (забываешь второе слагаемое)",
    "wrong_base_reduction": "Неверно приводишь показательное уравнение к общему основанию или ошибаешься в степени",
    "log_domain_missed": "Не учитываешь ОДЗ логарифма (аргумент должен быть $>0$)",
    "log_property_error": "Неверно применяешь свойства логарифмов (сумма/разность/степень)",
    "exp_property_error": "Неверно применяешь свойства степеней при преобразовании уравнения",
    "trig_lost_solutions": "Теряешь решения тригонометрического уравнения (периодичность, серии)",
    "trig_extra_solutions": "Включаешь лишние корни после преобразований (проверь подстановкой)",
    "irrational_no_check": "Не проверяешь корни иррационального уравнения после возведения в степень",
    "quadratic_discriminant_error": "Ошибка в дискриминанте или в формуле корней квадратного уравнения",
    "forgot_back_substitution": "Решил замену $t$, но не вернулся к исходной переменной $x$",
    "sign_error_in_equation": "Ошибка знака при переносе слагаемых или раскрытии скобок",
    "unknown": "Не удалось определить причину ошибки (сервис диагностики недоступен).",
}


def allowed_tags(task_number: Column) -> Column:
    """Tags that errors in a task can have; an empty array for a number without any, null for null."""
    table = F.create_map(*(x for n, tags in TASK_TAGS.items() for x in (F.lit(n), F.array(*map(F.lit, tags)))))
    return F.when(task_number.isNotNull(), F.coalesce(table[task_number.cast("int")], F.array().cast("array<string>")))


def tag_table(spark) -> DataFrame:
    """``task_number, place, tag``: the registry as a short table."""
    return spark.createDataFrame([(n, i + 1, t) for n, tags in TASK_TAGS.items() for i, t in enumerate(tags)], "task_number int, place int, tag string")
