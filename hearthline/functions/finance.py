"""Loan and cash-flow arithmetic over doubles. The order of operations is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_even

EQUITY_SHARE = 0.15


def default_equity(price: Column) -> Column:
    """15 % of a positive price, rounded half to even; else 0."""
    return F.when(price > 0, half_even(price * EQUITY_SHARE)).otherwise(F.lit(0.0)).cast("long")


def monthly_payment(principal: Column, rate_pct: Column, years: Column) -> Column:
    """Annuity payment; nothing to pay without a loan; null for a loan over no months."""
    months = (years * 12).cast("int")
    rate = rate_pct / 100.0 / 12.0
    growth = F.pow(1 + rate, months)
    return F.when(principal <= 0, F.lit(0.0)).when(months == 0, F.lit(None)).when(rate == 0, principal / F.nullif(months, F.lit(0))).otherwise(F.try_divide(principal * rate * growth, growth - 1))


def metrics(price: Column, equity: Column, rate_pct: Column, years: Column, rent: Column, hoa: Column, upkeep_pct: Column, vacancy_pct: Column, other: Column) -> dict[str, Column]:
    """Investment metrics by name. Where no rent could break even, break_even is infinite."""
    loan = F.greatest(price - equity, F.lit(0.0))
    payment = monthly_payment(loan, rate_pct, years)
    upkeep, vacancy = rent * (upkeep_pct / 100.0), rent * (vacancy_pct / 100.0)
    costs = payment + hoa + upkeep + vacancy + other
    cashflow = rent - costs
    noi_year = (rent - (hoa + upkeep + vacancy + other)) * 12
    invested = F.when(equity > 0, equity.cast("double")).otherwise(F.lit(1.0))
    repaid = F.greatest(payment * 12 - loan * (rate_pct / 100.0), F.lit(0.0))
    kept = F.lit(1.0) - upkeep_pct / 100.0 - vacancy_pct / 100.0
    return {
        "loan": loan,
        "m_payment": payment,
        "maint": upkeep,
        "vacancy": vacancy,
        "total_costs": costs,
        "cashflow": cashflow,
        "noi_year": noi_year,
        "break_even": F.when(kept > 0, (payment + hoa + other) / F.nullif(kept, F.lit(0.0))).otherwise(F.lit(float("inf"))),
        "principal_reduction_year": repaid,
        "total_equity_return_pct": (cashflow * 12 + repaid) / invested * 100.0,
        "legacy_net_yield_pct": noi_year / invested * 100.0,
    }
