"""Interest rates: percentages found in text, their median, and the cached estimate as of a time, or of each of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join

# Fixed values.
TTL_BANK, TTL_POLICY = 7 * 86_400, 86_400
NAMES = ("dnb_rate", "policy_rate", "margin")
POLICY_DEFAULT, MARGIN_DEFAULT = 4.50, 1.25
LEAST, MOST = 2.0, 10.0


def percentages(text: Column) -> Column:
    """All percentages within [2, 10]: decimals first, then whole ones (which also match digits after a decimal comma)."""
    number = lambda s: F.regexp_replace(s, ",", ".").try_cast("double")
    decimals = F.regexp_extract_all(text, F.lit(r"(?U)(\d{1,2}[.,]\d{1,2})\s*%"), F.lit(1))
    wholes = F.regexp_extract_all(text, F.lit(r"(?U)\b(\d{1,2})\s*%"), F.lit(1))
    return F.filter(F.transform(F.concat(decimals, wholes), number), lambda x: x.between(LEAST, MOST))


def _two_digits(x: Column) -> Column:
    """Two decimals of the binary number, ties to even: 4.225 is a little less, so 4.22."""
    return F.bround(x * 100, 0) / 100


def median_percentage(values: Column) -> Column:
    """The median of an array, two decimals; null if empty."""
    v, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(v, i.cast("int"))
    middle = F.when(n % 2 == 1, at(F.floor(n / 2) + 1)).otherwise((at(F.floor(n / 2)) + at(F.floor(n / 2) + 1)) / 2)
    return F.when(n > 0, _two_digits(middle))


def first_percentage(values: Column) -> Column:
    return _two_digits(F.try_element_at(values, F.lit(1)))


def latest(cache: DataFrame, asof: Column) -> DataFrame:
    """name, value, ts of each name's latest entry at or before asof (unix seconds)."""
    return cache.where(F.col("ts") <= asof).groupBy("name").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def interest_estimate(cache: DataFrame, asof: Column, fetched_bank: Column | None = None, fetched_policy: Column | None = None) -> DataFrame:
    """One row: rate, source, bank_rate, policy_rate, margin.

    A cached value within its time to live counts; else a fetched one; else the stale one. The bank's rate is the
    estimate if there is any; else policy plus margin. Knowing both recalibrates the margin.
    """
    held = latest(cache, asof).groupBy().pivot("name", list(NAMES)).agg(F.first("value").alias("value"), F.first("ts").alias("ts"))
    none = F.lit(None).cast("double")
    return held.select(*_estimate(asof, fetched_bank if fetched_bank is not None else none, fetched_policy if fetched_policy is not None else none))


def _estimate(asof: Column, fetched_bank: Column, fetched_policy: Column) -> list[Column]:
    """The estimate's columns from <name>_value and <name>_ts."""

    def pick(name: str, ttl: int, fetched: Column) -> Column:
        value, age = F.col(f"{name}_value"), asof - F.col(f"{name}_ts")
        return F.when(age < ttl, value).otherwise(F.coalesce(fetched, value))

    bank, policy = pick("dnb_rate", TTL_BANK, fetched_bank), pick("policy_rate", TTL_POLICY, fetched_policy)
    margin = F.coalesce(F.round(bank - policy, 2), F.col("margin_value"))
    fallback = F.round(F.coalesce(policy, F.lit(POLICY_DEFAULT)) + F.coalesce(margin, F.lit(MARGIN_DEFAULT)), 2)
    return [F.coalesce(bank, fallback).alias("rate"), F.when(bank.isNotNull(), "dnb").otherwise("policy+margin").alias("source"), bank.alias("bank_rate"), policy.alias("policy_rate"), margin.alias("margin")]


def interest_estimates(requests: DataFrame, cache: DataFrame, ts: str = "ts", span: int = 7 * 86_400) -> DataFrame:
    """requests (ts in unix seconds, optional fetched_bank and fetched_policy) with the estimate as of each one's own moment.

    cache has name, ts, value. Each distinct moment is looked up once for each name, in spans of time; a request without a
    moment finds nothing cached.
    """
    own = [F.col(c) if c in requests.columns else F.lit(None).cast("double") for c in ("fetched_bank", "fetched_policy")]
    asked = requests.select(F.col(ts).cast("long").alias("ts")).distinct().where("ts IS NOT NULL").select("ts", F.explode(F.array(*map(F.lit, NAMES))).alias("name"))
    found = asof_join(asked, cache, ["name"], "ts", ["value"], span)
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    wide = found.groupBy(F.col("ts").alias("_ts")).agg(*(of(n, c).alias(f"{n}_{k}") for n in NAMES for c, k in (("value", "value"), ("entry_ts", "ts"))))
    return requests.join(wide, F.col(ts).cast("long") == F.col("_ts"), "left").select(*requests.columns, *_estimate(F.col("_ts"), *own))
