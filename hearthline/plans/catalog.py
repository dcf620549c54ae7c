"""Registered queries of the analytics operators on the benchmark tables, each with its SQL twin.

The tables hold no property data, so every operator runs on a stand-in; the twin uses the same one:
an order is a purchase (price o_totalprice, equity 15 %, 5.1 % over 30 years, rent 0.5 % of the price, fees 800),
its line items are findings (returned: grade 3, accepted: grade 2), an event's user is a URL or an account, a
document's lines are report lines, and a document's chunks of 200 characters are its pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance, numbers, scores, texts, urls
from ..operators import decision, findings, geo, issues, links, pages, rates, records, rent

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- investment ---------------------------------------------------------------------------------------------------

_PAYMENT = "CASE WHEN loan <= 0 THEN 0.0 ELSE loan * (5.1/100.0/12.0) * pow(1 + 5.1/100.0/12.0, 360) / (pow(1 + 5.1/100.0/12.0, 360) - 1) END"
_INVEST = f"""
  p AS (SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_totalprice > 0 THEN round_even(o_totalprice * 0.15, 0) ELSE 0 END AS equity, o_totalprice * 0.005 AS rent FROM orders),
  l AS (SELECT *, greatest(price - equity, 0.0) AS loan FROM p),
  y AS (SELECT *, {_PAYMENT} AS pay, rent * (6.0/100.0) AS maint FROM l),
  m AS (SELECT *, rent - (pay + 800.0 + maint + 0.0 + 0.0) AS cashflow, (rent - (800.0 + maint + 0.0 + 0.0)) * 12 AS noi_year,
    CASE WHEN equity > 0 THEN equity ELSE 1.0 END AS invested, greatest(pay * 12 - loan * (5.1/100.0), 0.0) AS repaid,
    (pay + 800.0 + 0.0) / (1.0 - 6.0/100.0 - 0.0/100.0) AS break_even FROM y),
  r AS (SELECT *, (cashflow * 12 + repaid) / invested * 100.0 AS roe FROM m)"""


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return o.withColumns({
        "equity": finance.default_equity(F.col("price")).cast("double"), "interest": F.lit(5.1), "term_years": F.lit(30), "rent": F.col("price") * 0.005,
        "hoa": F.lit(800.0), "maint_pct": F.lit(6.0), "vacancy_pct": F.lit(0.0), "other_costs": F.lit(0.0),
    })


def _round(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(n), digits).alias(n) for n in names]


@query(f"""WITH {_INVEST} SELECT o_orderkey, CAST(equity AS BIGINT) AS equity, round(loan, 6) AS loan, round(pay, 6) AS m_payment, round(cashflow, 6) AS cashflow, round(noi_year, 6) AS noi_year,
  round(break_even, 6) AS break_even, round(repaid, 6) AS principal_reduction_year, round(roe, 6) AS total_equity_return_pct FROM r""")
def invest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = decision.with_metrics(_purchases(spark, sf_dir))
    return m.select("o_orderkey", F.col("equity").cast("long").alias("equity"), *_round("loan", "m_payment", "cashflow", "noi_year", "break_even", "principal_reduction_year", "total_equity_return_pct"))


_GRADES = "t AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n3, count(*) FILTER (l_returnflag = 'A') AS n2 FROM lineitem GROUP BY l_orderkey)"
_SCORED = f"""{_INVEST}, {_GRADES},
  j AS (SELECT r.*, coalesce(n3, 0) AS n3, coalesce(n2, 0) AS n2, n3 IS NOT NULL AS has_data FROM r LEFT JOIN t ON l_orderkey = o_orderkey),
  c AS (SELECT *,
    CASE WHEN cashflow >= 1000 THEN 100.0 WHEN cashflow >= 0 THEN 50.0 + cashflow / 1000.0 * 50.0 WHEN cashflow >= -2000 THEN 20.0 + (cashflow + 2000.0) / 2000.0 * 30.0 ELSE 0.0 END AS s1,
    CASE WHEN roe >= 10 THEN 100.0 WHEN roe >= 8 THEN 70.0 + (roe - 8.0) / 2.0 * 30.0 WHEN roe >= 6 THEN 40.0 + (roe - 6.0) / 2.0 * 30.0 WHEN roe >= 0 THEN roe / 6.0 * 40.0 ELSE greatest(0.0, 40.0 + roe * 8.0) END AS s2,
    CASE WHEN rent <= 0 THEN 0.0 WHEN (break_even - rent) / rent <= -0.05 THEN 100.0 WHEN (break_even - rent) / rent >= 0.05 THEN 0.0 ELSE 50.0 END AS s3,
    CASE WHEN cashflow <= 0 OR pay + 800.0 <= 0 THEN 0.0 ELSE least(100.0, greatest(0.0, cashflow / (pay + 800.0) / 0.2 * 100.0)) END AS s4 FROM j),
  e AS (SELECT *, CAST(greatest(0, least(100, round_even(s1 * 0.40 + s2 * 0.30 + s3 * 0.20 + s4 * 0.10, 0))) AS INTEGER) AS econ_score,
    CAST(greatest(0, least(100, 100 - (n3 * 15 + least(n2, 5) * 5))) AS INTEGER) AS condition_score FROM c),
  f AS (SELECT *, ceil(econ_score * CAST(0.60 AS DOUBLE) + condition_score * CAST(0.40 AS DOUBLE)) AS raw FROM e),
  g AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN has_data THEN raw ELSE least(raw, 74) END)) AS INTEGER) AS total_score FROM f)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    return li.agg(F.count_if(F.col("l_returnflag") == "R").alias("n3"), F.count_if(F.col("l_returnflag") == "A").alias("n2"))


@query(f"""WITH {_SCORED} SELECT o_orderkey, econ_score, condition_score, total_score, CASE WHEN total_score >= 80 THEN 'Bra' WHEN total_score >= 60 THEN 'OK' WHEN total_score >= 40 THEN 'Svak' ELSE 'Dårlig' END AS verdict,
  NOT has_data AS tg_cap_used, CASE WHEN cashflow < -2000 THEN 'red' WHEN cashflow <= 0 THEN 'yellow' ELSE 'green' END AS cashflow_colour, CASE WHEN roe < 5 THEN 'red' WHEN roe < 10 THEN 'yellow' ELSE 'green' END AS return_colour,
  CASE WHEN break_even - rent > rent * 0.05 THEN 'red' WHEN break_even - rent >= -(rent * 0.05) THEN 'yellow' ELSE 'green' END AS gap_colour FROM g""")
def invest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = decision.with_metrics(_purchases(spark, sf_dir)).join(_graded(spark, sf_dir), "o_orderkey", "left")
    m = m.withColumn("has_tg_data", F.col("n3").isNotNull())
    n3, n2 = F.coalesce("n3", F.lit(0)), F.coalesce("n2", F.lit(0))
    c = {k: F.col(k) for k in ("cashflow", "total_equity_return_pct", "rent", "break_even", "m_payment", "hoa")}
    m = m.withColumns({"econ_score": scores.econ_score(*c.values()), "condition_score": scores.condition_score(n3, n2)})
    m = m.withColumn("total_score", scores.total_score(F.col("econ_score"), F.col("condition_score"), F.col("has_tg_data")))
    return m.select(
        "o_orderkey", "econ_score", "condition_score", "total_score", scores.verdict(F.col("total_score")).alias("verdict"), (~F.col("has_tg_data")).alias("tg_cap_used"),
        scores.cashflow_colour(c["cashflow"]).alias("cashflow_colour"), scores.return_colour(c["total_equity_return_pct"]).alias("return_colour"), scores.gap_colour(c["rent"], c["break_even"]).alias("gap_colour"),
    )


@query(f"""WITH {_GRADES}, s AS (SELECT *, CASE WHEN n3 = 0 AND n2 = 0 THEN 100 ELSE greatest(0, 100 - least(n3 * 12 + least(n2, 3) * 5, 30)) END AS risk FROM t)
  SELECT l_orderkey AS o_orderkey, CAST(risk AS INTEGER) AS risk, CAST(greatest(0, least(100, ceil(CAST(0.7 AS DOUBLE) * 50.0 + CAST(0.3 AS DOUBLE) * risk))) AS INTEGER) AS total FROM s""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _graded(spark, sf_dir).withColumn("risk", scores.risk_score(F.col("n3"), F.col("n2"), F.lit(True)))
    return t.select("o_orderkey", "risk", scores.risk_total(F.lit(50.0), F.col("risk"), F.lit(True)).alias("total"))


@query(f"""WITH {_INVEST} SELECT o_orderkey,
  CASE WHEN cashflow < 0 THEN '{decision.NEGATIVE}' WHEN roe < 8 THEN '{decision.MODERATE}' ELSE '{decision.SOLID}' END AS status_line,
  concat_ws('|', CASE WHEN cashflow < 0 THEN '{decision.ACTIONS[0]}' END, CASE WHEN cashflow < 0 THEN '{decision.ACTIONS[1]}' END, CASE WHEN break_even > rent THEN '{decision.ACTIONS[2]}' END, CASE WHEN roe < 8 THEN '{decision.ACTIONS[3]}' END) AS actions,
  concat_ws('|', CASE WHEN cashflow > 0 THEN '{decision.POSITIVES[0]}' END, CASE WHEN roe >= 10 THEN '{decision.POSITIVES[1]}' END, CASE WHEN break_even <= rent * 0.95 THEN '{decision.POSITIVES[2]}' END) AS positives FROM r""")
def decision_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = decision.with_metrics(_purchases(spark, sf_dir))
    four = [F.col(c) for c in ("cashflow", "total_equity_return_pct", "rent", "break_even")]
    return m.select("o_orderkey", decision.status_line(*four[:2]).alias("status_line"), F.array_join(decision.actions(*four), "|").alias("actions"), F.array_join(decision.positives(*four), "|").alias("positives"))


@query("""SELECT o_orderkey, CAST(try_cast(replace(replace(t, ' ', ''), ',', '') AS DOUBLE) AS BIGINT) AS as_whole, try_cast(replace(replace(t, ' ', ''), ',', '.') AS DOUBLE) AS as_decimal
  FROM (SELECT o_orderkey, concat(CAST(o_orderkey % 1000 AS VARCHAR), ' ', CAST(o_orderkey % 7 AS VARCHAR), ',0') AS t FROM orders)""")
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(" "), (F.col("o_orderkey") % 7).cast("string"), F.lit(",0"))
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.whole(t).alias("as_whole"), numbers.decimal(t).alias("as_decimal"))


# -- rent ---------------------------------------------------------------------------------------------------------

_SEGMENT = "CASE WHEN (a > 0 AND a < 30) OR rooms <= 1 THEN 'hybel' WHEN a BETWEEN 30 AND 50 OR rooms = 2 THEN 'liten' WHEN (a > 50 AND a <= 90) OR rooms = 3 THEN 'standard' WHEN a > 90 OR rooms >= 4 THEN 'stor' ELSE 'standard' END"
_PART = "p AS (SELECT p_partkey, CAST(p_size * 3 AS DOUBLE) AS a, p_size % 5 AS rooms, CAST(5000 + p_partkey % 300 AS INTEGER) AS code FROM part)"


def _flats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3).cast("double").alias("area_m2"), (F.col("p_size") % 5).alias("rooms"), (F.lit(5000) + F.col("p_partkey") % 300).cast("int").alias("code"))


@query(f"WITH {_PART} SELECT p_partkey, a AS area_m2, rooms, {_SEGMENT} AS segment FROM p")
def rent_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flats(spark, sf_dir).select("p_partkey", "area_m2", "rooms", rent.segment(F.col("area_m2"), F.col("rooms")).alias("segment"))


_RANGES = ", ".join(f"({a}, {b}, '{n}', {i})" for i, (a, b, n) in enumerate(rent.BERGEN_RANGES))


@query(f"""WITH {_PART}, r(lo, hi, bucket, pri) AS (VALUES {_RANGES}), b AS (SELECT code, arg_min(bucket, pri) AS bucket FROM (SELECT DISTINCT code FROM p) JOIN r ON code BETWEEN lo AND hi GROUP BY code),
  s AS (SELECT p.*, bucket, {_SEGMENT} AS segment FROM p LEFT JOIN b USING (code)),
  k AS (SELECT *, CAST(250.0 AS DOUBLE) * CAST(CASE segment WHEN 'hybel' THEN 1.10 WHEN 'liten' THEN 1.05 WHEN 'stor' THEN 0.92 ELSE 1.0 END AS DOUBLE) AS kr FROM s)
  SELECT p_partkey, code, bucket, segment, kr AS kr_per_m2, CAST(round_even(a * kr / 100, 0) * 100 AS BIGINT) AS gross_rent FROM k""")
def rent_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(a, b, n, i) for i, (a, b, n) in enumerate(rent.BERGEN_RANGES)], "start int, end int, bucket string, priority int")
    f = rent.range_lookup(_flats(spark, sf_dir), "code", ranges, "bucket").withColumn("segment", rent.segment(F.col("area_m2"), F.col("rooms")))
    f = f.withColumn("kr_per_m2", rent.benchmark(F.lit("Bergen"), F.col("segment"), F.lit(None).cast("double")))
    return f.select("p_partkey", "code", "bucket", "segment", "kr_per_m2", rent.gross_rent(F.col("area_m2"), F.col("kr_per_m2")).alias("gross_rent"))


_PRICES = "c AS (SELECT CAST(c_nationkey AS VARCHAR) AS city, CASE WHEN c_custkey % 9 = 0 THEN concat(CAST(c_nationkey AS VARCHAR), ' snitt') ELSE concat('b', CAST(c_custkey AS VARCHAR)) END AS bucket, c_mktsegment AS segment, c_acctbal AS kr FROM customer)"


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    city = F.col("c_nationkey").cast("string")
    bucket = F.when(F.col("c_custkey") % 9 == 0, F.concat(city, F.lit(" snitt"))).otherwise(F.concat(F.lit("b"), F.col("c_custkey").cast("string")))
    return read(spark, sf_dir, "customer").select(city.alias("city"), bucket.alias("bucket"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("kr_per_m2"))


@query(f"WITH {_PRICES} SELECT city, segment, round(coalesce(max(kr) FILTER (bucket = city || ' snitt'), avg(kr)), 4) AS kr FROM c GROUP BY city, segment")
def city_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rent.city_average(_prices(spark, sf_dir)).withColumn("kr", F.round("kr", 4))


@query(f"""WITH {_PRICES}, b AS (SELECT city, segment, max(kr) AS base FROM c WHERE bucket = city || ' snitt' GROUP BY city, segment)
  SELECT lower(city) AS city, bucket, segment, round(kr / base, 6) AS ratio FROM c JOIN b USING (city, segment) WHERE bucket <> city || ' snitt' AND base <> 0""")
def bucket_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rent.bucket_ratios(_prices(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


_CITY_CASE = " ".join(f"WHEN contains(t, '{n}') THEN '{c}'" for n, c in rent.CITY_NEEDLES)
_CITY_CODES = " ".join(f"WHEN code BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in rent.CITY_RANGES)


@query(f"""WITH a AS (SELECT c_custkey, lower(concat(CASE c_custkey % 5 WHEN 0 THEN 'Nær Bergen' WHEN 1 THEN 'OSLO vest' ELSE '' END, ' ', 'vei 12 ', lpad(CAST(c_custkey * 37 % 10000 AS VARCHAR), 4, '0'), ' sted')) AS t FROM customer),
  b AS (SELECT *, try_cast(regexp_extract(t, '\\b(\\d{{4}})\\b', 1) AS INTEGER) AS code FROM a)
  SELECT c_custkey, CASE {_CITY_CASE} {_CITY_CODES} ELSE '' END AS city FROM b""")
def city_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "Nær Bergen").when(k % 5 == 1, "OSLO vest").otherwise("")
    address = F.concat(F.lit("vei 12 "), F.lpad((k * 37 % 10000).cast("string"), 4, "0"), F.lit(" sted"))
    return read(spark, sf_dir, "customer").select("c_custkey", rent.guess_city(name, address).alias("city"))


# -- findings -----------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS component FROM lineitem)
  SELECT o.l_orderkey, c.component FROM (SELECT o_orderkey AS l_orderkey FROM orders) o CROSS JOIN (SELECT unnest(range(1, 8)) AS component) c ANTI JOIN k ON k.l_orderkey = o.l_orderkey AND k.component = c.component""")
def missing_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("component"))
    every = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    found = findings.missing_components(li, "l_orderkey", "component", tuple(range(1, 8)), every)
    return found.select("l_orderkey", F.col("component").cast("long").alias("component"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber % 3 AS component, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS level, l_quantity AS score, l_extendedprice AS len, l_linenumber FROM lineitem)
  SELECT l_orderkey, CAST(component AS INTEGER) AS component, level, l_linenumber FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, component, level ORDER BY score DESC, len DESC, l_linenumber) = 1""")
def findings_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    f = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).cast("int").alias("component"), level.alias("level"), "l_linenumber", "l_quantity", "l_extendedprice")
    best = records.latest_per_key(f, ["l_orderkey", "component", "level"], F.col("l_quantity").desc(), F.col("l_extendedprice").desc(), F.col("l_linenumber"))
    return best.select("l_orderkey", "component", "level", "l_linenumber")


_GRADED_TEXT = "CASE event_id % 4 WHEN 0 THEN 'TG3 Bad: fukt i membran' WHEN 1 THEN 'Avvik TG 2 - sluk' WHEN 2 THEN 'Store eller alvorlige avvik' ELSE 'tg1 ingen avvik' END"


@query(f"""WITH t AS (SELECT event_id, {_GRADED_TEXT} AS s FROM events)
  SELECT event_id, CAST(CASE WHEN regexp_matches(s, '(?i)(^|[^a-z0-9_])tg\\s*[:\\-]?\\s*3\\b') THEN 3 WHEN regexp_matches(s, '(?i)(^|[^a-z0-9_])tg\\s*[:\\-]?\\s*2\\b') THEN 2 WHEN contains(lower(s), 'store eller alvorlige avvik') THEN 3 WHEN contains(lower(s), 'avvik som kan kreve tiltak') THEN 2 END AS INTEGER) AS level FROM t""")
def finding_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, "TG3 Bad: fukt i membran").when(k == 1, "Avvik TG 2 - sluk").when(k == 2, "Store eller alvorlige avvik").otherwise("tg1 ingen avvik")
    return read(spark, sf_dir, "events").select("event_id", findings.level(text).alias("level"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


@query()
def finding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction over documents' lines, with a grade put before each line in turn (the texts have none)."""
    grade = F.element_at(F.array(F.lit("TG3 Bad: fukt, "), F.lit("TG2 Tak: lekkasje, "), F.lit(""), F.lit("Oppsummering: ")), (F.col("pos") % 4 + 1).cast("int"))
    s = _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(grade, "line").alias("text"), F.lit("salgsoppgave").alias("source"))
    r = findings.report(s)
    return r.select("doc_id", F.size("tg3").alias("n3"), F.size("tg2").alias("n2"), F.array_join("missing", "|").alias("missing"), F.array_join(findings.format_entries(F.col("tg3"), 3), "|").alias("tg3"), "markdown")


_TERMS = ("the", "und", "que", "de")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), s AS (SELECT doc_id, lower(line) AS s FROM l)
  SELECT doc_id, count(*) FILTER (contains(s, 'the') OR contains(s, 'und') OR contains(s, 'que') OR contains(s, 'de')) AS n_hits, count(*) AS n_lines FROM s GROUP BY doc_id""")
def issue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = texts.has_any(F.lower("line"), _TERMS)
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(hit).alias("n_hits"), F.count("*").alias("n_lines"))


@query()
def issue_watch_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch-outs with terms that occur in the documents, those that a tagged block has left out."""
    terms = {"components": ("the", "der", "los", "les"), "issues": _TERMS}
    lines = _lines(spark, sf_dir)
    return issues.watch_outs(lines, issues.tagged(lines, 3, **terms), **terms)


# -- records ------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 6")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.recent(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 6, F.col("event_id").desc())


@query("SELECT count(*) AS total, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent, max(ts) AS last_run_at FROM events")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("ts")
    last = e.agg(F.max("ts").alias("last"))
    return records.summary(e.join(F.broadcast(last)), "ts", F.col("last") - F.expr("INTERVAL 7 DAYS"))


@query("""SELECT event_id, user_id, failures FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error') WHERE failures >= 2""")
def login_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return records.failures_in_window(e, "user_id", "ts", 86_400).where("failures >= 2").select("event_id", "user_id", "failures")


@query("""WITH t AS (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS since FROM events WHERE event_type = 'signup')
  SELECT event_id, user_id, since, coalesce(since < 86400, false) AS refused FROM t""")
def token_min_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return records.too_soon(e, "user_id", "ts", 86_400).select("event_id", "user_id", "since", "refused")


_SAVED = "s AS (SELECT o_orderkey, c_name AS label, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS score, o_orderdate AS saved_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(concat_ws(' ', c_name, o_orderpriority)), 'urgent'))"


@query(f"""WITH {_SAVED} SELECT * FROM (SELECT * FROM s ORDER BY coalesce(score, -1.0) DESC, saved_at DESC, label, o_orderkey LIMIT 8 OFFSET 8)""")
def saved_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    j = records.search(o.join(c, o["o_custkey"] == c["c_custkey"]), ["c_name", "o_orderpriority"], "URGENT")
    s = j.select("o_orderkey", F.col("c_name").alias("label"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("score"), F.col("o_orderdate").alias("saved_at"))
    return records.page(s, [*records.saved_order("score_desc"), F.col("o_orderkey")], 1)


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with odd ids are merged over those with even ones."""
    e = read(spark, sf_dir, "events").withColumn("version", F.struct("ts", "event_id"))
    out = records.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "version")
    return out.select("user_id", "event_type", "event_id", "value")


_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(f"""WITH j AS (SELECT user_id, {_STATUS} AS status, event_id % 101 AS progress, ts, event_id FROM events)
  SELECT user_id, arg_max(status, (ts, event_id)) AS status, arg_max(CASE WHEN status = 'done' THEN 100 ELSE progress END, (ts, event_id)) FILTER (status <> 'failed') AS progress, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events FROM j GROUP BY user_id""")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.job_states(job_events(read(spark, sf_dir, "events")), "user_id", "ts", "event_id")


def job_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("running")
    return events.select("user_id", status.alias("status"), (F.col("event_id") % 101).alias("progress"), "ts", "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def selected_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return records.selected(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), chosen, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def unselected_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return records.unselected(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), chosen, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(*) AS analyses, CAST(CASE WHEN count(*) >= 1000 THEN 5 WHEN count(*) >= 200 THEN 4 WHEN count(*) >= 50 THEN 3 WHEN count(*) >= 10 THEN 2 ELSE 1 END AS INTEGER) AS level FROM orders GROUP BY o_custkey")
def member_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("analyses"))
    return n.withColumn("level", records.level(F.col("analyses")))


# -- URLs and links -----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS head, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
  k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: contains(x, '=') AND NOT ends_with(x, '=') AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'gclid=') AND NOT starts_with(x, 'fbclid=')) AS kept FROM p)
  SELECT page_id, head || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS clean, head AS origin, nullif(regexp_extract(path, '(\\d{3,})', 1), '') AS listing_id FROM k""")
def url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", urls.clean_url(u).alias("clean"), urls.origin(u).alias("origin"), urls.listing_id(u, digits=3).alias("listing_id"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>', 1)) AS href FROM pages)
  SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM a GROUP BY page_id""")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.anchors(read(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>', 1)) AS href FROM pages),
  s AS (SELECT page_id, href, 10 * CAST(contains(lower(href), 'the') AS INTEGER) + 2 * CAST(contains(lower(href), 'a') AS INTEGER) - 30 * CAST(contains(lower(href), 'und') AS INTEGER) AS score FROM a)
  SELECT page_id, max(score) AS score FROM s WHERE score > 0 GROUP BY page_id""")
def link_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = links.anchors(read(spark, sf_dir, "pages")).withColumn("text", F.lit(""))
    best = links.best(links.scored(a, strong=("the",), weak=("a",), negative=("und",)))
    return best.select("page_id", "score")


@query()
def broker_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return links.choose(p, links.candidates(p, needles=("the", "und", "que")))


@query("""WITH d(priority, name, needle) AS (VALUES (1, 'blog', 'blog.'), (2, 'mobile', 'm.'), (3, 'com', '.com'), (4, 'generic', '.')), h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)
  SELECT page_id, arg_min(name, priority) AS driver FROM h JOIN d ON contains(host, needle) GROUP BY page_id""")
def driver_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    drivers = spark.createDataFrame([(1, "blog", "blog."), (2, "mobile", "m."), (3, "com", ".com"), (4, "generic", ".")], "priority int, name string, needle string")
    return links.dispatch(read(spark, sf_dir, "pages"), drivers)


# -- pages of documents -------------------------------------------------------------------------------------------

_CHUNKS = "c AS (SELECT doc_id, i AS page_no, substr(text, i * 200 + 1, 200) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(coalesce(text, '')) / 200.0) AS BIGINT)))) AS i FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))"
_CHUNK_SCORE = "s AS (SELECT doc_id, page_no, CAST(CASE WHEN contains(lower(t), 'the') THEN 3 ELSE 0 END + CASE WHEN contains(lower(t), 'die') THEN 2 ELSE 0 END - CASE WHEN contains(lower(t), 'que') THEN 2 ELSE 0 END AS INTEGER) AS score FROM c)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # no text: one empty page
    each = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 200.0).cast("int")) - 1)).alias("page_no"))
    t = F.lower(F.substring("text", F.col("page_no") * 200 + 1, F.lit(200)))
    has = lambda w, n: F.when(F.contains(t, F.lit(w)), n).otherwise(0)
    return each.select("doc_id", F.col("page_no").cast("long").alias("page_no"), (has("the", 3) + has("die", 2) - has("que", 2)).alias("score"))


@query(f"""WITH {_CHUNKS}, {_CHUNK_SCORE}, w AS (SELECT doc_id, page_no, unnest([20, 30, 40]) AS width, unnest([sum(score) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING),
  sum(score) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING), sum(score) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)]) AS total FROM s)
  SELECT doc_id, width, page_no AS start, CAST(total AS BIGINT) AS total FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, width ORDER BY total DESC, page_no) = 1""")
def sliding_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sliding_best(_chunks(spark, sf_dir))


@query(f"WITH {_CHUNKS}, {_CHUNK_SCORE} SELECT doc_id, page_no, CAST(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS BIGINT) AS cues_ahead FROM s")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.look_ahead(_chunks(spark, sf_dir), F.col("score") > 0).select("doc_id", "page_no", "cues_ahead")


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over each document's scores; SQL has none, so tests hold it against a loop."""
    p = _chunks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "score"))).alias("p"))
    return p.select("doc_id", pages.best_block(F.transform("p", lambda x: x["score"])).alias("b")).select("doc_id", "b.*")


# -- text, rates, geometry ----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT o_orderkey, concat('nominell ', replace(CAST(2 + o_orderkey % 8 AS VARCHAR), '.', ','), ',', CAST(10 + o_orderkey % 90 AS VARCHAR), ' % og ', CAST(o_orderkey % 15 AS VARCHAR), ' %') AS s FROM orders),
  v AS (SELECT o_orderkey, list_sort(list_filter(list_transform(list_concat(regexp_extract_all(s, '(\\d{1,2}[.,]\\d{1,2})\\s*%', 1), regexp_extract_all(s, '\\b(\\d{1,2})\\s*%', 1)), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)), lambda x: x BETWEEN 2.0 AND 10.0)) AS v FROM t)
  SELECT o_orderkey, len(v) AS n, round_even(100 * CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) / 2 END, 0) / 100 AS median FROM v""")
def percent_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.concat(F.lit("nominell "), (k % 8 + 2).cast("string"), F.lit(","), (k % 90 + 10).cast("string"), F.lit(" % og "), (k % 15).cast("string"), F.lit(" %"))
    v = read(spark, sf_dir, "orders").select("o_orderkey", rates.percentages(s).alias("v"))
    return v.select("o_orderkey", F.size("v").cast("long").alias("n"), rates.median_percentage(F.col("v")).alias("median"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ø', 'o'), 'å', 'a'), 'æ', 'ae'), 'é', 'e'), 'ü', 'u'), 'ö', 'o') AS simple FROM documents""")
def text_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", texts.simplify(F.col("text")).alias("simple"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS n_tokens, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS n_distinct FROM documents")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts.tokens(F.lower("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("SELECT o_orderkey, concat(replace(format('{:,.0f}', round_even(o_totalprice, 0)), ',', ' '), ' kr') AS shown, CAST(floor(o_totalprice / 500 + 0.5) * 500 AS BIGINT) AS approx FROM orders")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", numbers.grouped(p, " kr").alias("shown"), numbers.to_step(p, 500).cast("long").alias("approx"))


_CACHE = """c AS (SELECT CASE event_id % 5 WHEN 0 THEN 'policy_rate' WHEN 1 THEN 'margin' ELSE 'dnb_rate' END AS name, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS ts, value FROM events WHERE event_id % 3 > 0),
  u AS (SELECT name, ts, max(value) AS value FROM c GROUP BY name, ts),
  r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN 1703980800 + CAST(floor(epoch(o_orderdate)) AS BIGINT) % 5000000 END AS ts, CASE WHEN o_orderkey % 7 = 0 THEN 4.44 END AS fetched_bank FROM orders)"""


@query(f"""WITH {_CACHE}, w AS (SELECT r.*, d.value AS d, d.ts AS dt, p.value AS p, p.ts AS pt, m.value AS m FROM r
    ASOF LEFT JOIN (SELECT * FROM u WHERE name = 'dnb_rate') d ON r.ts >= d.ts ASOF LEFT JOIN (SELECT * FROM u WHERE name = 'policy_rate') p ON r.ts >= p.ts ASOF LEFT JOIN (SELECT * FROM u WHERE name = 'margin') m ON r.ts >= m.ts),
  b AS (SELECT *, CASE WHEN ts - dt < 604800 THEN d ELSE coalesce(fetched_bank, d) END AS bank, p AS policy FROM w),
  g AS (SELECT *, coalesce(round(bank - policy, 2), m) AS margin FROM b)
  SELECT o_orderkey, coalesce(bank, round(coalesce(policy, 4.5) + coalesce(margin, 1.25), 2)) AS rate, CASE WHEN bank IS NULL THEN 'policy+margin' ELSE 'dnb' END AS source, round(margin, 6) AS margin FROM g""")
def rates_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate as of each order's own moment, from a cache of rates that events wrote: many entries share an hour, some moments lie before or long after all."""
    e, k = F.col("event_id"), F.col("o_orderkey")
    name = F.when(e % 5 == 0, "policy_rate").when(e % 5 == 1, "margin").otherwise("dnb_rate")
    cache = read(spark, sf_dir, "events").where(e % 3 > 0).select(name.alias("name"), (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("ts"), "value")
    asked = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 11 > 0, F.unix_timestamp("o_orderdate") % 5_000_000 + 1_703_980_800).alias("ts"), F.when(k % 7 == 0, 4.44).alias("fetched_bank"))
    return rates.interest_estimates(asked, cache).select("o_orderkey", "rate", "source", *_round("margin"))


_GRID = [(i, f"cell{i}", float(i % 5 * 2), float(i // 5 * 2)) for i in range(20)]


@query(f"""WITH g(priority, name, x, y) AS (VALUES {", ".join(f"({i}, '{n}', {x}, {y})" for i, n, x, y in _GRID)}), p AS (SELECT c_custkey, (c_custkey % 97) / 8.0 + 0.01 AS lon, (c_custkey % 89) / 10.0 + 0.013 AS lat FROM customer)
  SELECT p.c_custkey, b.bucket FROM p LEFT JOIN (SELECT c_custkey, arg_min(name, priority) AS bucket FROM p JOIN g ON lon > x AND lon < x + 2 AND lat > y AND lat < y + 2 AND NOT (lon > x + 0.5 AND lon < x + 1 AND lat > y + 0.5 AND lat < y + 1) GROUP BY c_custkey) b USING (c_custkey)""")
def geo_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a square hole; no point lies on an edge."""
    box = lambda x, y, a: [[x, y], [x + a, y], [x + a, y + a], [x, y + a], [x, y]]
    cells = spark.createDataFrame([(i, n, [[box(x, y, 2.0), box(x + 0.5, y + 0.5, 0.5)]]) for i, n, x, y in _GRID], "priority int, name string, polygons array<array<array<array<double>>>>")
    k = F.col("c_custkey")
    points = read(spark, sf_dir, "customer").select("c_custkey", (k % 97 / 8.0 + 0.01).alias("lon"), (k % 89 / 10.0 + 0.013).alias("lat"))
    return geo.locate(points, cells, "c_custkey").select("c_custkey", "bucket")
