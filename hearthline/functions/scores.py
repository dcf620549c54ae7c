"""Scores from 0 to 100, verdicts and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp

#: The cap of a total without condition data, and the verdicts' least totals.
CAP_WITHOUT_DATA = 74
VERDICTS = ((80, "Bra"), (60, "OK"), (40, "Svak"))
LOWEST_VERDICT = "Dårlig"
#: The separate risk model.
RISK_TG3, RISK_TG2, RISK_TG2_CAP, RISK_MOST, RISK_WITHOUT_DATA, RISK_WEIGHT = 12, 5, 3, 30, 60, 0.30

_INF = float("inf")


def _line(x: Column, x0: float, y0: float, width: float, height: float) -> Column:
    return F.lit(y0) + (x - x0) / width * height


def cashflow_score(x: Column) -> Column:
    return F.when(x >= 1000, 100.0).when(x >= 0, F.lit(50.0) + x / 1000.0 * 50.0).when(x >= -2000, _line(x, -2000.0, 20.0, 2000.0, 30.0)).otherwise(0.0)


def return_score(x: Column) -> Column:
    """Jumps below zero: 0 % scores 0, -1 % scores 32."""
    return F.when(x >= 10, 100.0).when(x >= 8, _line(x, 8.0, 70.0, 2.0, 30.0)).when(x >= 6, _line(x, 6.0, 40.0, 2.0, 30.0)).when(x >= 0, x / 6.0 * 40.0).otherwise(F.greatest(F.lit(0.0), F.lit(40.0) + x * 8.0))


def break_even_score(rent: Column, break_even: Column) -> Column:
    gap = F.try_divide(break_even - rent, rent)
    known = (rent > 0) & break_even.isNotNull() & ~F.isnan(break_even) & (F.abs(break_even) < _INF)
    return F.when(~known, 0.0).when(gap <= -0.05, 100.0).when(gap >= 0.05, 0.0).otherwise(50.0)


def buffer_score(cashflow: Column, payment: Column, hoa: Column) -> Column:
    base = payment + hoa
    return F.when((cashflow <= 0) | (base <= 0), 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(cashflow, base) / 0.2 * 100.0)))


def econ_score(cashflow: Column, return_pct: Column, rent: Column, break_even: Column, payment: Column, hoa: Column) -> Column:
    parts = cashflow_score(cashflow) * 0.40 + return_score(return_pct) * 0.30
    return clamp(parts + break_even_score(rent, break_even) * 0.20 + buffer_score(cashflow, payment, hoa) * 0.10)


def non_blank(items: Column) -> Column:
    """How many entries of an array of text are more than white space; a null array has none."""
    return F.coalesce(F.size(F.filter(items, lambda x: F.trim(x) != "")), F.lit(0))


def age_points(years: Column) -> Column:
    return F.when(years.isNull() | (years < 0), 0).when(years < 10, 15).when(years <= 20, 0).otherwise(-15)


def condition_score(n_tg3: Column, n_tg2: Column, n_upgrades: Column | None = None, n_warnings: Column | None = None, ages: tuple[Column, ...] = ()) -> Column:
    raw = F.lit(100) - (n_tg3 * 15 + F.least(n_tg2, F.lit(5)) * 5)
    for age in ages:
        raw = raw + age_points(age)
    if n_upgrades is not None:
        raw = raw + F.least(F.lit(15), n_upgrades * 5)
    if n_warnings is not None:
        raw = raw - F.least(F.lit(40), n_warnings * 5)
    return clamp(raw.cast("double"))


def total_score(econ: Column, condition: Column, has_data: Column) -> Column:
    total = F.ceil(econ * F.lit(0.60) + condition * F.lit(0.40))
    return clamp(F.when(has_data, total).otherwise(F.least(total, F.lit(CAP_WITHOUT_DATA))).cast("double"))


def verdict(total: Column) -> Column:
    out = F.when(total >= VERDICTS[0][0], VERDICTS[0][1])
    for least, name in VERDICTS[1:]:
        out = out.when(total >= least, name)
    return out.otherwise(LOWEST_VERDICT)


def risk_score(n_tg3: Column, n_tg2: Column, has_data: Column) -> Column:
    """Counts blank entries too, unlike the condition score."""
    penalty = F.least(n_tg3 * RISK_TG3 + F.least(n_tg2, F.lit(RISK_TG2_CAP)) * RISK_TG2, F.lit(RISK_MOST))
    return F.when(~has_data & (n_tg3 == 0) & (n_tg2 == 0), RISK_WITHOUT_DATA).otherwise(F.greatest(F.lit(0), F.lit(100) - penalty)).cast("int")


def risk_total(econ: Column, risk: Column, has_data: Column) -> Column:
    total = F.ceil(F.lit(1.0 - RISK_WEIGHT) * econ + F.lit(RISK_WEIGHT) * risk)
    total = F.when(has_data, total).otherwise(F.least(total, F.lit(CAP_WITHOUT_DATA)))
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def cashflow_colour(x: Column) -> Column:
    return F.when(x < -2000, "red").when(x <= 0, "yellow").otherwise("green")


def return_colour(x: Column) -> Column:
    return F.when(x < 5, "red").when(x < 10, "yellow").otherwise("green")


def gap_colour(rent: Column, break_even: Column) -> Column:
    gap, edge = break_even - rent, rent * 0.05
    return F.when(gap > edge, "red").when(gap >= -edge, "yellow").otherwise("green")


def verdict_colour(name: Column) -> Column:
    return F.when(name == LOWEST_VERDICT, "red").when(name.isin("Svak", "OK"), "yellow").when(name == "Bra", "green").otherwise("neutral")
