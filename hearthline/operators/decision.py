"""From analysis parameters to metrics, scores, and the decision shown to the user: one chain of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finance, numbers, scores

#: Parameters and whether the metrics view reads them as whole numbers.
PARAMS = {"price": True, "equity": True, "interest": False, "term_years": True, "rent": True, "hoa": True, "maint_pct": False, "vacancy_pct": False, "other_costs": True}
#: The texts of a decision.
NEGATIVE = "Marginal lønnsomhet. Cashflow negativ, men kan bedres med tiltak."
MODERATE = "Greit avkastningsnivå. Vurder tiltak for å styrke lønnsomhet."
SOLID = "Solid lønnsomhet med håndterbare forutsetninger."
ACTIONS = ("Forhandle pris ned", "Vurder moderat leieøkning", "Senk driftskostnader/felleskost om mulig", "Øk leie eller redusér EK-binding/forhandle rente")
POSITIVES = ("Positiv månedlig cashflow", "Sterk avkastning på egenkapital", "God buffer mot nullpunkt")
LOCAL_WORDS = ("svak", "ok", "god")


def normalise_params(params: DataFrame) -> DataFrame:
    """Raw text or number columns as the metrics view reads them: whole kroner and years, decimal rates."""
    cast = lambda c, w: numbers.whole(F.col(c), 30 if c == "term_years" else 0) if w else numbers.decimal(F.col(c))
    return params.withColumns({c: cast(c, w) for c, w in PARAMS.items()})


def contract(params: DataFrame) -> DataFrame:
    """The same columns as the contract reads them: all decimal but the term. A comma is a decimal point here."""
    return params.withColumns({c: numbers.whole(F.col(c), 30) if c == "term_years" else numbers.decimal(F.col(c)) for c in PARAMS})


def with_metrics(df: DataFrame, vacancy: Column | None = None) -> DataFrame:
    """df (typed parameters) with the eleven metrics."""
    c = {k: F.col(k).cast("double") for k in PARAMS}
    m = finance.metrics(c["price"], c["equity"], c["interest"], c["term_years"], c["rent"], c["hoa"], c["maint_pct"], c["vacancy_pct"] if vacancy is None else vacancy, c["other_costs"])
    return df.withColumns(m)


def with_scores(df: DataFrame) -> DataFrame:
    """Scores from metrics without vacancy (cashflow, break_even, ...), tg2_items, tg3_items and has_tg_data.

    Optional columns upgrades, warnings (arrays) and bath_age_years, kitchen_age_years, roof_age_years count if there.
    """
    has = set(df.columns)
    count = lambda c: scores.non_blank(F.col(c)) if c in has else None
    ages = tuple(F.col(c) for c in ("bath_age_years", "kitchen_age_years", "roof_age_years") if c in has)
    out = df.withColumn("econ_score", scores.econ_score(F.col("cashflow"), F.col("total_equity_return_pct"), F.col("rent"), F.col("break_even"), F.col("m_payment"), F.col("hoa")))
    out = out.withColumn("condition_score", scores.condition_score(count("tg3_items"), count("tg2_items"), count("upgrades"), count("warnings"), ages))
    out = out.withColumn("total_score", scores.total_score(F.col("econ_score"), F.col("condition_score"), F.col("has_tg_data")))
    return out.withColumns({"verdict": scores.verdict(F.col("total_score")), "tg_cap_used": ~F.col("has_tg_data")})


def _some(*choices: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order, four at most."""
    return F.slice(F.filter(F.array(*(F.when(when, F.lit(text)) for when, text in choices)), lambda x: x.isNotNull()), 1, 4)


def status_line(cashflow: Column, return_pct: Column) -> Column:
    return F.when(cashflow < 0, NEGATIVE).when(return_pct < 8, MODERATE).otherwise(SOLID)


def actions(cashflow: Column, return_pct: Column, rent: Column, break_even: Column) -> Column:
    return _some((cashflow < 0, ACTIONS[0]), (cashflow < 0, ACTIONS[1]), (break_even > rent, ACTIONS[2]), (return_pct < 8, ACTIONS[3]))


def positives(cashflow: Column, return_pct: Column, rent: Column, break_even: Column) -> Column:
    return _some((cashflow > 0, POSITIVES[0]), (return_pct >= 10, POSITIVES[1]), (break_even <= rent * 0.95, POSITIVES[2]))


def risks(tg3_items: Column, tg2_items: Column) -> Column:
    tagged = lambda items, tag: F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit(tag), x))
    return F.slice(F.concat(tagged(tg3_items, "TG3: "), tagged(tg2_items, "TG2: ")), 1, 8)


def key_figures(df_columns: dict[str, Column]) -> Column:
    c = df_columns
    one = lambda name, value, colour: F.struct(F.lit(name).alias("navn"), value.alias("verdi"), colour.alias("farge"))
    plain = F.lit("neutral")
    return F.array(
        one("Månedlig overskudd", numbers.grouped(c["cashflow"], " kr/mnd"), scores.cashflow_colour(c["cashflow"])),
        one("Leie for å gå i null", numbers.grouped(c["break_even"], " kr/mnd"), plain),
        one("Årlig nettoinntekt", numbers.grouped(c["noi_year"], " kr"), plain),
        one("Årlig nedbetaling på lån", numbers.grouped(c["principal_reduction_year"], " kr"), plain),
        one("Månedlig lånekostnader", numbers.grouped(c["m_payment"], " kr/mnd"), plain),
        one("Avkastning på egenkapital", F.format_string("%.1f %%", c["total_equity_return_pct"]), scores.return_colour(c["total_equity_return_pct"])),
    )


def decide(df: DataFrame) -> DataFrame:
    """with_scores() plus status, actions, positives, risks, key_figures and the nested ui struct."""
    out = with_scores(df)
    c = {k: F.col(k) for k in ("cashflow", "total_equity_return_pct", "rent", "break_even", "noi_year", "principal_reduction_year", "m_payment")}
    four = (c["cashflow"], c["total_equity_return_pct"], c["rent"], c["break_even"])
    out = out.withColumns({"status_line": status_line(*four[:2]), "actions": actions(*four), "positives": positives(*four), "risks": risks(F.col("tg3_items"), F.col("tg2_items")), "key_figures": key_figures(c)})
    part = lambda id_, label, col: F.struct(F.lit(id_).alias("id"), F.lit(label).alias("label"), F.col(col).alias("value"))
    ui = F.struct(
        F.struct(F.col("total_score").alias("score"), F.col("verdict").alias("dom"), F.col("status_line").alias("setning")).alias("status"),
        F.col("actions").alias("tiltak"), F.col("positives").alias("positivt"), F.col("risks").alias("risiko"), F.col("key_figures").alias("nokkel_tall"),
        F.struct(F.col("total_score").alias("value"), scores.verdict_colour(F.col("verdict")).alias("farge")).alias("scorelinjal"),
        F.array(part("econ", "Økonomi", "econ_score"), part("tr", "Tilstand", "condition_score")).alias("score_breakdown"), F.col("tg_cap_used"),
    )
    return out.withColumn("ui", ui)


def local_text(return_pct: Column, cashflow: Column, break_even: Column) -> Column:
    """The deterministic explanation that stands in for a language model's."""
    share = F.coalesce(return_pct, F.lit(0.0))
    word = F.when(share < 3, LOCAL_WORDS[0]).when(share >= 7, LOCAL_WORDS[2]).otherwise(LOCAL_WORDS[1])
    return F.format_string("**Vurdering:** %s. ROE %.1f%%.\n\nCashflow %.0f kr/mnd, break-even %.0f kr/mnd.", word, share, cashflow, break_even)


def analyse(params: DataFrame) -> DataFrame:
    """Raw parameters with tg2_items, tg3_items and has_tg_data -> metrics (with vacancy, as m_*) and the decision (without)."""
    names = list(finance.metrics(*(F.lit(0.0) for _ in range(9))))
    shown = F.struct(*(F.col(n) for n in names)).alias("metrics")
    rest = [c for c in params.columns if c not in PARAMS]
    raw = params.withColumn("_raw", F.struct(*(F.col(c) for c in PARAMS)))
    given = with_metrics(normalise_params(raw)).select(*rest, "_raw", shown)
    judged = decide(with_metrics(contract(given.select(*rest, "metrics", "_raw.*")), F.lit(0.0)))
    return judged.withColumn("text", local_text(F.col("metrics.total_equity_return_pct"), F.col("metrics.cashflow"), F.col("metrics.break_even")))
