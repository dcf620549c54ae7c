import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.functions import finance, numbers, scores
from hearthline.operators import decision

lit = lambda *xs: [F.lit(float(x)) for x in xs]
NAMES = ("m_payment", "cashflow", "noi_year", "break_even", "principal_reduction_year", "total_equity_return_pct")
# Worked by hand: price, equity, rate, years, rent, fees, upkeep, vacancy, other.
METRICS = [
    ((4500000, 675000, 5.1, 30, 18000, 3000, 6, 0, 800), (20767.828833, -7647.828833, 157440, 26135.98812, 54138.945991, -5.575556)),
    ((4000000, 800000, 5.25, 25, 18500, 3200, 7.5, 0, 1200), (19175.926885, -6463.426885, 152550, 25487.488525, 62111.122626, -1.93125)),
    ((1000000, 1000000, 5, 30, 10000, 0, 6, 0, 0), (0, 9400, 112800, 0, 0, 11.28)),
    ((1000000, 0, 0, 30, 10000, 1000, 6, 5, 0), (2777.777778, 5122.222222, 94800, 4244.694132, 33333.333333, 9480000)),
]


@pytest.mark.parametrize(("given_", "expected"), METRICS)
def test_metrics(value, given_, expected):
    m = finance.metrics(*lit(*given_))
    assert value(*(m[n] for n in NAMES)) == pytest.approx(expected, abs=1e-6)


def test_no_rent_breaks_even_and_no_months(value):
    m = finance.metrics(*lit(1e6, 0, 5, 30, 1e4, 0, 60, 40, 0))
    assert math.isinf(value(m["break_even"]))
    assert value(finance.monthly_payment(*lit(1e6, 5, 0))) is None


def test_equity_rounds_half_to_even(value):
    assert [value(finance.default_equity(F.lit(float(p)))) for p in (10, 30, -5, 4500000)] == [2, 4, 0, 675000]


CASES = [  # cash flow, break-even, return, payment, rent, fees, has data, grades 2, grades 3 -> condition, total, verdict
    ((1500, 15000, 12, 9000, 18000, 3000, True, [], []), (100, 98, "Bra")),
    ((1200, 19100, 8.5, 10000, 20000, 3500, True, ["a"], ["b"]), (80, 79, "OK")),
    ((2500, 15000, 12.5, 8500, 20000, 3200, False, [], []), (100, 74, "OK")),
    ((-1000, 23000, 5.5, 12000, 18000, 3500, True, [], []), (100, 55, "Svak")),
]


@pytest.mark.parametrize(("case", "expected"), CASES)
def test_scores(spark, case, expected):
    cols = "cashflow double, break_even double, total_equity_return_pct double, m_payment double, rent double, hoa double, has_tg_data boolean, tg2_items array<string>, tg3_items array<string>"
    df = spark.createDataFrame([(*map(float, case[:6]), *case[6:])], cols)
    r = decision.with_scores(df).first()
    assert (r.condition_score, r.total_score, r.verdict) == expected
    assert r.tg_cap_used == (not case[6])


def test_colours_and_risk(value):
    assert [value(scores.cashflow_colour(F.lit(x))) for x in (-2001, -2000, 0, 1)] == ["red", "yellow", "yellow", "green"]
    assert [value(scores.return_colour(F.lit(x))) for x in (4.99, 5, 9.99, 10)] == ["red", "yellow", "yellow", "green"]
    risk = lambda n3, n2, has: value(scores.risk_score(F.lit(n3), F.lit(n2), F.lit(has)))
    assert [risk(0, 0, False), risk(1, 0, False), risk(0, 2, True), risk(1, 4, True), risk(0, 0, True)] == [60, 88, 90, 73, 100]
    total = lambda e, r, has: value(scores.risk_total(F.lit(float(e)), F.lit(float(r)), F.lit(has)))
    assert [total(80, 100, True), total(60, 74, True), total(95, 100, False)] == [86, 65, 74]


def test_casts(value):
    nb = "4 500 000"
    assert value(numbers.whole(F.lit(nb)), numbers.decimal(F.lit("5,1")), numbers.whole(F.lit("5,1")), numbers.decimal(F.lit("4,500,000"))) == (4500000, 5.1, 51, 0.0)
    assert value(numbers.whole(F.lit("-18.9")), numbers.whole(F.lit("x"), 7), numbers.optional_decimal(F.lit("nan")), numbers.currency(F.lit("3 117 502 kr"))) == (-18, 7, None, 3117502)
    assert value(numbers.is_missing(F.lit("  ")), numbers.is_missing(F.lit("0")), numbers.area(F.lit("ca 62,5 m²"))) == (True, False, 62.5)


def _spec_scores(cf, roe, rent, be, pay, hoa):
    """Independent scalar statement of the economic score's parts."""
    a = 100 if cf >= 1000 else 50 + cf / 1000 * 50 if cf >= 0 else 20 + (cf + 2000) / 2000 * 30 if cf >= -2000 else 0
    b = 100 if roe >= 10 else 70 + (roe - 8) / 2 * 30 if roe >= 8 else 40 + (roe - 6) / 2 * 30 if roe >= 6 else roe / 6 * 40 if roe >= 0 else max(0, 40 + roe * 8)
    gap = (be - rent) / rent if rent > 0 else None
    c = 0 if gap is None else 100 if gap <= -0.05 else 0 if gap >= 0.05 else 50
    d = 0 if cf <= 0 or pay + hoa <= 0 else min(100, max(0, cf / (pay + hoa) / 0.2 * 100))
    return max(0, min(100, round(a * 0.40 + b * 0.30 + c * 0.20 + d * 0.10)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*(st.floats(lo, hi, allow_nan=False) for lo, hi in ((-5000, 5000), (-20, 20), (0, 40000), (0, 40000), (0, 30000), (0, 9000)))), min_size=1, max_size=40))
def test_econ_score_property(spark, rows):
    df = spark.createDataFrame(rows, "cf double, roe double, rent double, be double, pay double, hoa double")
    got = [r[0] for r in df.select(scores.econ_score(*(F.col(c) for c in df.columns))).collect()]
    assert got == [_spec_scores(*r) for r in rows]


def test_analyse(spark):
    raw = [("4 500 000", "675000", "5,1", "30", "18000", "3000", "6,0", "0", "800", ["x"], [" "], True), ("4,500,000", None, "5,1", "x", "18000", "3000", "6,0", "5", "800", [], [], False)]
    cols = ", ".join(f"{c} string" for c in decision.PARAMS) + ", tg2_items array<string>, tg3_items array<string>, has_tg_data boolean"
    a, b = decision.analyse(spark.createDataFrame(raw, cols)).collect()
    assert a.metrics.cashflow == pytest.approx(-7647.828833) and a.condition_score == 95 and a.verdict == "Dårlig"
    assert a.ui.status.setning == decision.NEGATIVE and len(a.actions) == 4 and a.key_figures[0].verdi == "-7 648 kr/mnd"
    # A comma is dropped in the metrics view and a point in the contract, which then reads no number.
    assert b.metrics.loan == 4500000 and b.price == 0.0 and b.metrics.vacancy == 900 and b.vacancy == 0
    assert a.text.startswith("**Vurdering:** svak. ROE -5.6%.")
