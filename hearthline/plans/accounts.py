"""Registered queries of accounts, saved analyses, jobs, findings' records and price tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import finance, numbers, scores, texts, web
from ..operators import decision, facts, findings, issues, links, pages, rates, records, rent
from ..sources import staging, tables
from .catalog import job_events, query, read
from .listings import pick, quoted, sql_pick, values

# -- accounts -----------------------------------------------------------------------------------------------------

NAMES = ("Ola.Nordmann", " kari_9 ", "ab", "navn med mellomrom", "x" * 21, "ÆØÅ", "a.b", "")
PASSWORDS = ("Abcdef1!", "abcdef1!", "ABCDEF1!", "Abcdefg!", "Abcdefg1", "Ab1!", "Lang Nok 1?", "Abcdef1\\")
AVATARS = ("\U0001f600", " \U0001f680️ ", "x", "", "\U0001f98b", "\U0001f355")
PAINTS = ("#f3f4f6", "10b981", " #6366F1 ", "#123456", "", "red")


@query(f"""WITH t AS (SELECT c_custkey, {sql_pick(NAMES, 'c_custkey')} AS n, {sql_pick(PASSWORDS, 'c_custkey')} AS p, {sql_pick(AVATARS, 'c_custkey')} AS e, {sql_pick(PAINTS, 'c_custkey')} AS c FROM customer)
  SELECT c_custkey, lower(trim(n)) AS username, regexp_full_match(trim(n), '[a-zA-Z0-9._]{{3,20}}') AS name_ok,
    length(p) >= 8 AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[^a-zA-Z0-9 ]') AS password_ok,
    CASE WHEN trim(replace(e, chr(65039), '')) IN ({', '.join(map(quoted, web.EMOJI))}) THEN trim(replace(e, chr(65039), '')) END AS emoji,
    CASE WHEN '#' || ltrim(upper(trim(c)), '#') IN ({', '.join(map(quoted, web.COLOURS))}) THEN '#' || ltrim(upper(trim(c)), '#') END AS colour FROM t""")
def account_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    n, p, e, c = (pick(w, k) for w in (NAMES, PASSWORDS, AVATARS, PAINTS))
    return read(spark, sf_dir, "customer").select("c_custkey", records.canonical_username(n).alias("username"), web.username_ok(n).alias("name_ok"), web.password_ok(p).alias("password_ok"), web.avatar_emoji(e).alias("emoji"), web.avatar_colour(c).alias("colour"))


@query("""WITH t AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS a, TIMESTAMP '2024-06-15 12:00:00' AS b FROM events), d AS (SELECT *, CAST(a AS DATE) AS x, CAST(b AS DATE) AS y FROM t),
  e AS (SELECT *, day(y) < day(x) AS short FROM d), f AS (SELECT *, day(y) - day(x) + CASE WHEN short THEN day(last_day(y - INTERVAL 1 MONTH)) ELSE 0 END AS dd, (year(y) - year(x)) * 12 + month(y) - month(x) - CASE WHEN short THEN 1 ELSE 0 END AS mm FROM e),
  g AS (SELECT *, CASE WHEN mm // 12 > 0 THEN (mm // 12) || ' år' END AS p1, CASE WHEN mm % 12 > 0 THEN (mm % 12) || CASE WHEN mm % 12 = 1 THEN ' måned' ELSE ' måneder' END END AS p2, CASE WHEN dd > 0 THEN dd || CASE WHEN dd = 1 THEN ' dag' ELSE ' dager' END END AS p3 FROM f),
  h AS (SELECT *, list_filter([p1, p2, p3], lambda p: p IS NOT NULL) AS ps FROM g)
  SELECT event_id, CASE WHEN a > b THEN 'Medlem i dag' WHEN len(ps) = 0 THEN 'Medlem i under en dag' WHEN len(ps) = 1 THEN 'Medlem i ' || ps[1] ELSE 'Medlem i ' || array_to_string(ps[1:len(ps) - 1], ', ') || ' og ' || ps[len(ps)] END AS told,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(make_timestamp(event_id * 1000003000000), '%Y-%m-%dT%H:%M:%S') || 'Z' END AS stamp FROM h""")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-06-15 12:00:00").cast("timestamp")
    seconds = F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 1_000_003).otherwise(0)
    return read(spark, sf_dir, "events").select("event_id", web.membership(F.col("ts").cast("timestamp"), now).alias("told"), web.iso(web.from_unix(seconds)).alias("stamp"))


@query("SELECT user_id, CAST(sum(greatest(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 - 1 END, 1), 1)) AS BIGINT) AS total FROM events GROUP BY user_id")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return records.running_totals(read(spark, sf_dir, "events").select("user_id", F.when(k % 3 != 0, k % 4 - 1).alias("n")), "user_id", "n")


@query("""SELECT user_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS since FROM (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'trialing' WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'past_due' ELSE 'canceled' END AS status FROM events) GROUP BY user_id""")
def subscription_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, and counts once."""
    kind = F.col("event_type")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(kind == "signup", "trialing").when(kind == "purchase", "active").when(kind == "error", "past_due").otherwise("canceled").alias("status"))
    return records.subscription_states(e.unionByName(e), "user_id", "event_id", "ts")


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'trialing' WHEN 1 THEN 'active' WHEN 2 THEN 'past_due' WHEN 3 THEN 'canceled' END AS status, CASE c_custkey % 3 WHEN 0 THEN 'admin' ELSE 'user' END AS role FROM customer)
  SELECT c_custkey, coalesce(status IN ('trialing', 'active', 'past_due'), false) AS paid, CASE WHEN role = 'admin' THEN role WHEN status IN ('trialing', 'active', 'past_due') THEN 'plus' ELSE 'user' END AS role_now FROM s""")
def subscription_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = pick(("trialing", "active", "past_due", "canceled", ""), k)
    status, role = F.when(k % 5 < 4, status), F.when(k % 3 == 0, "admin").otherwise("user")
    return read(spark, sf_dir, "customer").select("c_custkey", records.is_paid(status).alias("paid"), records.role_after(role, status).alias("role_now"))


@query("""WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS sub, c_mktsegment AS cus FROM customer),
  e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN -1 END AS uid, c_name AS sub, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment END AS cus FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT o_orderkey, coalesce(u.id, s.id, c.id) AS resolved_id FROM e LEFT JOIN u ON u.id = uid LEFT JOIN (SELECT sub, min(id) AS id FROM u WHERE sub IS NOT NULL GROUP BY sub) s ON s.sub = e.sub LEFT JOIN (SELECT cus, min(id) AS id FROM u GROUP BY cus) c ON c.cus = e.cus""")
def user_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    users = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("subscription_id"), F.col("c_mktsegment").alias("customer_id"))
    k = F.col("o_orderkey")
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(k % 3 == 0, F.col("o_custkey")).when(k % 3 == 1, -1).alias("user_id"), F.col("c_name").alias("subscription_id"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("customer_id"))
    return records.resolve_user(e, users).select("o_orderkey", "resolved_id")


@query("""WITH v AS (SELECT c_custkey, lower(c_mktsegment) || (c_custkey // 2 % 40) AS v FROM customer) SELECT c_custkey FROM v WHERE v IN (SELECT v FROM v GROUP BY v HAVING count(DISTINCT c_custkey) > 1)""")
def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.concat(F.lower("c_mktsegment"), (F.floor(k / 2) % 40).cast("string"))
    return records.conflicts(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", value).select("c_custkey")


@query("""SELECT event_id, user_id FROM events WHERE sha256('t' || (event_id % 7)) = sha256('t3') AND event_type <> 'view' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY""")
def token_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    hashed = F.sha2(F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string")), 256)
    t = e.select("event_id", "user_id", hashed.alias("token_hash"), F.when(F.col("event_type") == "view", F.col("ts")).alias("used_at"), F.col("ts").alias("expires_at"))
    now = e.agg((F.max("ts") - F.expr("INTERVAL 20 DAYS")).alias("now"))
    return records.valid_tokens(t.join(F.broadcast(now)), "t3", F.col("now")).select("event_id", "user_id")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'""")
def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rows_of(read(spark, sf_dir, "orders"), "o_custkey", 7, "o_orderstatus", "O").select("o_orderkey", "o_custkey")


@query("""SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 3 OFFSET 1)""")
def user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    own = o.join(F.broadcast(o.agg(F.min("o_custkey").alias("first"))), F.col("o_custkey") == F.col("first"))
    return records.limited(own, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3, 1).select("o_orderkey", "o_totalprice")


@query("""WITH u AS (SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL AND event_id % 4 > 0) AS a, arg_max(event_type, (ts, event_id)) FILTER (event_id % 2 = 0) AS b FROM events GROUP BY user_id)
  SELECT c_custkey, coalesce(a, c_acctbal) AS balance, coalesce(b, c_mktsegment) AS kind FROM customer LEFT JOIN u ON user_id = c_custkey""")
def row_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.when(k % 4 > 0, F.col("value")).alias("balance"), F.when(k % 2 == 0, F.col("event_type")).alias("kind"), "ts", "event_id")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("kind"))
    return records.apply_updates(c, e, "c_custkey", ["balance", "kind"], "ts", "event_id").select("c_custkey", "balance", "kind")


# -- saved analyses and jobs --------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '1e3' WHEN 4 THEN NULL ELSE '-7' END AS n, CASE o_orderkey % 4 WHEN 0 THEN ' x ' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE 'y' END AS s,
    CASE o_orderkey % 5 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '[1]' WHEN 2 THEN '{"a": ' WHEN 3 THEN ' {"b": [2]} ' ELSE '"x"' END AS j FROM orders)
  SELECT o_orderkey, CASE WHEN trim(n) = '' THEN 0.0 ELSE try_cast(trim(n) AS DOUBLE) END AS number, nullif(trim(s), '') AS text, CASE WHEN j IS NOT NULL AND json_valid(j) AND starts_with(trim(j), '{') THEN trim(j) END AS object FROM t""")
def saved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n, s, j = F.when(k % 6 != 4, pick((" 12.5 ", "abc", "", "1e3", "", "-7"), k)), F.when(k % 4 != 2, pick((" x ", "  ", "", "y"), k)), pick(('{"a": 1}', "[1]", '{"a": ', ' {"b": [2]} ', '"x"'), k)
    return read(spark, sf_dir, "orders").select("o_orderkey", web.number_or_null(n).alias("number"), texts.trimmed(s).alias("text"), web.object_or_null(j).alias("object"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 101 AS n FROM orders)
  SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 0 THEN n WHEN o_orderkey % 4 = 1 THEN n / 2.0 END AS DOUBLE) AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'Fukt' WHEN o_orderkey % 3 = 1 THEN 'Tak' END AS risk,
    CASE o_orderkey % 4 WHEN 0 THEN 'Gate ' || o_orderkey WHEN 1 THEN 'Finnkode ' || (o_orderkey + 1000000) WHEN 2 THEN 'https://x.no/a' ELSE 'Ukjent adresse' END AS title FROM t""")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 101).cast("string")
    gauge = F.when(k % 4 == 0, F.concat(F.lit('{"value": '), n, F.lit("}"))).otherwise(F.lit('{"value": "x"}'))
    status = F.when(k % 4 == 1, F.concat(F.lit('{"score": '), (k % 101 / 2.0).cast("string"), F.lit("}"))).otherwise(F.lit("{}"))
    risks = F.when(k % 3 == 0, F.lit('[null, " ", " Fukt "]')).when(k % 3 == 1, F.lit('["Tak", "Fukt"]')).otherwise(F.lit("[]"))
    args = F.concat(F.lit('{"decision_ui": {"scorelinjal": '), gauge, F.lit(', "status": '), status, F.lit(', "risiko": '), risks, F.lit("}}"))
    title, url = F.when(k % 4 == 0, F.concat(F.lit(" Gate "), k.cast("string"))).otherwise(F.lit(" ")), F.when(k % 4 == 1, F.lit("https://x.no/b")).when(k % 4 == 2, F.lit("https://x.no/a"))
    code = F.when(k % 4 == 1, (k + 1_000_000).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", web.history_score(args).alias("score"), web.history_risk(args).alias("risk"), web.history_title(title, url, code).alias("title"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Gate 1,  Bergen' WHEN 1 THEN 'Hus "Ro"' ELSE '' END AS address, o_orderdate AS d, o_totalprice AS p FROM orders)
  SELECT o_orderkey AS pos, concat_ws(',', CASE o_orderkey % 3 WHEN 0 THEN '"Gate 1, Bergen"' WHEN 1 THEN concat('"Hus ', '""', 'Ro', '""', '"') ELSE 'Tittel' END, strftime(CAST(d AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z'), CAST(CAST(floor(p / 5000 + 0.5) AS BIGINT) AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 'Lav' ELSE '' END, CAST(o_orderkey AS VARCHAR), CAST(CAST(floor(p + 0.5) AS BIGINT) AS VARCHAR), '') AS line FROM s""")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = read(spark, sf_dir, "orders").select(k.alias("pos"), pick(("Gate 1,  Bergen", 'Hus "Ro"', ""), k).alias("address"), F.lit("Tittel").alias("title"), F.col("o_orderdate").cast("timestamp").alias("saved_at"), (F.col("o_totalprice") / 5000).alias("score"),
                                           F.when(k % 2 == 0, "Lav").alias("risk"), k.cast("string").alias("code"), F.col("o_totalprice").alias("price"), F.lit(None).cast("string").alias("url"))
    return tables.export_lines(s)


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'f' || o_orderkey WHEN 1 THEN 'l' || o_orderkey ELSE '' END AS finnkode, CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'running' ELSE 'queued' END AS status, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 100 END AS INTEGER) AS progress, o_orderkey % 6 = 0 AS hit FROM orders""")
def stored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, F.format_string('"finnkode": "f%d", "listing_id": "x",', k)).when(k % 3 == 1, F.format_string('"finnkode": "", "listing_id": "l%d",', k)).otherwise(F.lit(""))
    status = F.when(k % 4 == 0, F.lit('"status": "done",')).when(k % 4 == 1, F.lit('"state": "running",')).otherwise(F.lit(""))
    raw = F.concat(F.lit("{"), code, status, F.when(k % 5 != 0, F.format_string('"progress": %d,', k % 100)).otherwise(F.lit("")), F.format_string('"id": %d}', k))
    cached = pick(('{"tg_version": 2, "tg2_details": []}', '{"tg_version": 1, "tg2_details": []}', '{"tg_version": 2}', "[2]", '{"tg_version": 2, "tg2_details": "x"}', "{broken"), k)
    return read(spark, sf_dir, "orders").select("o_orderkey", web.job_from_json(raw).alias("j"), tables.is_current(cached).alias("hit")).select("o_orderkey", "j.*", "hit")


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS depth FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'O' GROUP BY l_orderkey""")
def queue_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus")).alias("payload"))
    return records.queued_jobs(read(spark, sf_dir, "lineitem").select("l_orderkey"), o, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("depth"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY user_id) SELECT count(*) FILTER (e NOT IN ('purchase', 'error')) AS depth FROM l""")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.queue_depth(records.job_states(job_events(read(spark, sf_dir, "events")), "user_id", "ts", "event_id"))


# -- findings' records, scores, pages -----------------------------------------------------------------------------

_DETAIL_ROWS = [(" Bad ", None, None, " fukt ", None, 3), (None, "Kort", None, None, "TG2 side 4", 7), ("", " ", "", None, "x", 2), (None, None, "Lang tekst (s. 2)", None, "s. 2", None), ("Tak", "lekker", "taket lekker", None, " s. 9 ", 2)]


@query(f"""WITH d(i, label, short, hover, detail, source, tg) AS (VALUES {values((i, *(("" if x is None else x) for x in r[:5]), r[5] or 0) for i, r in enumerate(_DETAIL_ROWS))}),
  t AS (SELECT i, nullif(trim(label), '') AS l, coalesce(nullif(trim(short), ''), nullif(trim(detail), ''), nullif(trim(label), '')) AS s, coalesce(nullif(trim(hover), ''), nullif(trim(detail), ''), nullif(trim(short), ''), nullif(trim(label), '')) AS h, nullif(trim(source), '') AS o, CASE WHEN tg IN (2, 3) THEN tg ELSE 2 END AS tg FROM d),
  u AS (SELECT i, coalesce(l, s, h) AS label, coalesce(s, l, h) AS short, CASE WHEN o IS NOT NULL AND NOT contains(h, o) THEN h || ' (' || o || ')' ELSE h END AS hover, tg FROM t WHERE coalesce(l, s, h) IS NOT NULL)
  SELECT l_orderkey, l_linenumber, label, short, hover, CAST(tg AS INTEGER) AS tg, 'a|b' AS strings FROM lineitem JOIN u ON (l_orderkey + l_linenumber) % 5 = i""")
def detail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    rows = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("label", "short", "hover", "detail", "source"), r[:5], strict=True)), F.lit(r[5]).cast("int").alias("tg")) for r in _DETAIL_ROWS))
    one = F.array(F.get(rows, (k % len(_DETAIL_ROWS)).cast("int")))
    strings = web.clean_strings(F.array(F.lit(" a "), F.lit(None).cast("string"), F.lit("  "), F.lit("b")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(web.detail_records(one)).alias("d"), F.array_join(strings, "|").alias("strings")).select("l_orderkey", "l_linenumber", "d.*", "strings")


_FLAGS = """p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey % 4 - 1 AS score, o_orderkey % 3 = 0 AS cue, o_orderkey % 2 = 0 AS strong_term, o_orderkey % 7 = 0 AS extra_stop, o_orderkey % 5 = 0 AS iverdi_tpl FROM orders)"""


@query(f"""WITH {_FLAGS}, w AS (SELECT *, count(*) OVER n AS seen, sum(CASE WHEN cue OR score >= 2 OR iverdi_tpl THEN 1 ELSE 0 END) OVER n AS alike FROM p WINDOW n AS (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
  SELECT doc_id, page_no, (strong_term OR extra_stop) AND NOT cue AND page_no > 1 AND page_no >= 6 AND NOT (seen > 0 AND coalesce(alike, 0) >= seen // 2 + 1) AS stop FROM w""")
def stop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    p = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), number.alias("page_no"), (k % 4 - 1).alias("score"), (k % 3 == 0).alias("cue"), (k % 2 == 0).alias("strong_term"), (k % 7 == 0).alias("extra_stop"), (k % 5 == 0).alias("iverdi_tpl"), F.lit(1).alias("begin"))
    return pages.stop_pages(p, "begin").select("doc_id", "page_no", "stop")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 40 END AS a, o_orderkey % 5 AS u, o_orderkey % 12 AS w, o_orderkey % 3 AS n3, o_orderkey % 8 AS n2 FROM orders)
  SELECT o_orderkey, CAST(greatest(0, least(100, 100 - (n3 * 15 + least(n2, 5) * 5) + CASE WHEN a IS NULL THEN 0 WHEN a < 10 THEN 15 WHEN a <= 20 THEN 0 ELSE -15 END + least(u * 5, 15) - least(w * 5, 40))) AS INTEGER) AS score FROM t""")
def condition_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    score = scores.condition_score(k % 3, k % 8, k % 5, k % 12, (F.when(k % 7 != 0, k % 40),))
    return read(spark, sf_dir, "orders").select("o_orderkey", score.alias("score"))


@query("""WITH f AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_custkey FROM orders), c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(pos) AS first FROM f GROUP BY o_custkey, o_orderpriority)
  SELECT o_custkey, o_orderpriority FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) = 1""")
def page_engine_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.mode_first_seen(read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 7, -o_orderkey)) AS url, max(o_orderkey % 7) AS width, min(o_orderkey) AS first_pos FROM orders GROUP BY o_custkey""")
def widest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return records.best_image(read(spark, sf_dir, "orders").select("o_custkey", k.alias("url"), (k % 7).alias("width"), k.alias("pos")), "o_custkey")


@query("""SELECT o_custkey, o_orderkey AS link, greatest(o_orderkey % 10 / 10.0, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE o_orderkey % 7 / 5.0 END) AS confidence FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def first_verified_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = read(spark, sf_dir, "orders").select("o_custkey", k.alias("link"), (k % 10 / 10.0).alias("base"), F.when(k % 2 == 1, k % 7 / 5.0).alias("found"), (F.col("o_orderstatus") == "O").alias("verified"), (-k).alias("priority"))
    return links.first_verified(found, "o_custkey")


TONES = ("A", "energi: c (gul)", "G", "ukjent", "Energimerke F", "b")


@query(f"""WITH t AS (SELECT p_partkey, upper(regexp_extract({sql_pick(TONES, 'p_partkey')}, '(?i)\\b([A-G])\\b', 1)) AS l FROM part)
  SELECT p_partkey, CASE WHEN l IN ('A', 'B') THEN 'good' WHEN l IN ('C', 'D') THEN 'medium' WHEN l IN ('E', 'F', 'G') THEN 'poor' ELSE 'unknown' END AS tone FROM t""")
def energy_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", facts.energy_tone(pick(TONES, F.col("p_partkey"))).alias("tone"))


AREAS = ("Bolig 62,5 m² BRA", "ca 100 kvm", "ingen", "3 rom, 45 m2", "12.75 kvadratmeter")
PRICES = ("3 117 502 kr", "kr 990 000,-", "ukjent", "Totalt 12", "-5 000")
SLUGS = ("Antall rom", "BRA-i (m²)", "---", "Felleskost/mnd.", "Å B")


@query(f"""WITH t AS (SELECT p_partkey, {sql_pick(AREAS, 'p_partkey')} AS a, {sql_pick(PRICES, 'p_partkey')} AS m, {sql_pick(SLUGS, 'p_partkey')} AS s FROM part)
  SELECT p_partkey, try_cast(replace(nullif(regexp_extract(a, '(?i)(\\d+(?:[.,]\\d+)?)\\s*(?:m²|m2|kvm|kvadratmeter)', 1), ''), ',', '.') AS DOUBLE) AS area, try_cast(nullif(regexp_replace(regexp_extract(m, '(-?\\d[\\d\\s .]*)', 1), '[^\\d-]', '', 'g'), '') AS BIGINT) AS money,
    coalesce(nullif(trim(regexp_replace(lower(s), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'felt') AS slug FROM t""")
def fact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", numbers.area(pick(AREAS, k)).alias("area"), numbers.currency(pick(PRICES, k)).alias("money"), texts.slug(pick(SLUGS, k)).alias("slug"))


TIMES = ("ons 1. mai, ons 1. mai\ntor 2. mai", "Ingen visning", "man, , tir", "")


@query(f"""SELECT p_partkey, array_to_string(list_filter(list_distinct_kept, lambda x: x <> '' AND NOT contains(lower(x), 'ingen')), '|') AS times FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['ons 1. mai', 'tor 2. mai'] WHEN 1 THEN ['Ingen visning'] WHEN 2 THEN ['man', '', 'tir'] ELSE [''] END AS list_distinct_kept FROM part)""")
def showing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(facts.showings(pick(TIMES, F.col("p_partkey"))), "|").alias("times"))


@query("""SELECT o_orderkey, round_even(median(CAST(v AS DOUBLE)) * 100, 0) / 100 AS median, CAST(first(v ORDER BY i) AS DOUBLE) AS first FROM (SELECT o_orderkey, unnest([1, 2, 3, 4]) AS i, unnest([2 + o_orderkey % 7 + 0.25, 3.5, 2 + o_orderkey % 5 + 0.1, 9.99]) AS v FROM orders) GROUP BY o_orderkey""")
def rate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.array(k % 7 + 2.25, F.lit(3.5), k % 5 + 2.1, F.lit(9.99))
    return read(spark, sf_dir, "orders").select("o_orderkey", rates.median_percentage(v).alias("median"), rates.first_percentage(v).alias("first"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 12 - 1 AS DOUBLE) END AS r FROM orders)
  SELECT o_orderkey, CASE WHEN coalesce(r, 0.0) < 3 THEN 'svak' WHEN coalesce(r, 0.0) >= 7 THEN 'god' ELSE 'ok' END AS word, starts_with('x', 'x') AS local FROM t""")
def local_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = decision.local_text(F.when(k % 4 != 0, (k % 12 - 1).cast("double")), F.lit(100.0), F.lit(9000.0))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(text, r"Vurdering:\*\* (\w+)\.", 1).alias("word"), F.endswith(text, F.lit("Cashflow 100 kr/mnd, break-even 9000 kr/mnd.")).alias("local"))


@query("""SELECT o_orderkey, lower(trim(p)) AS key, concat(upper(substr(p, 1, 1)), substr(p, 2)) AS capital, round(12 * o_totalprice / 360, 6) AS per_month FROM (SELECT o_orderkey, o_totalprice, lower(o_orderpriority) AS p FROM orders)""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lower("o_orderpriority")
    month = finance.monthly_payment(F.col("o_totalprice"), F.lit(0.0), F.lit(30))
    return read(spark, sf_dir, "orders").select("o_orderkey", records.canonical_username(p).alias("key"), texts.capital(p).alias("capital"), F.round(month * 12, 6).alias("per_month"))


_RISKY = "CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE list_transform(range(0, o_orderkey % 6), lambda i: 'b' || i) END"


@query(f"""WITH t AS (SELECT o_orderkey, list_transform(range(0, o_orderkey % 7), lambda i: 'a' || i) AS a, {_RISKY} AS b FROM orders) SELECT o_orderkey, array_to_string(list_concat(list_transform(a, lambda x: 'TG3: ' || x), list_transform(b, lambda x: 'TG2: ' || x))[1:8], '|') AS risks,
  array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x)))[1:8], '|') AS merged FROM t""")
def risk_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    make = lambda p, n: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.concat(F.lit(p), (i - 1).cast("string")))
    some = lambda p, n: F.when(n > 0, make(p, n)).otherwise(F.array().cast("array<string>"))
    a, b = some("a", k % 7), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(some("b", k % 6))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(decision.risks(a, b), "|").alias("risks"), F.array_join(findings.merge_lists(a, b), "|").alias("merged"))


@query("""SELECT doc_id, len(text) AS n, lower(sha256(text)) AS digest FROM documents WHERE text IS NOT NULL""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import urls

    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.length("text").cast("long").alias("n"), urls.content_key(F.encode("text", "UTF-8")).alias("digest"))


@query("""WITH z(label, city, seg) AS (VALUES ('BUILDING', 'Oslo', 'a'), ('MACHINERY', 'Bergen', 'b')) SELECT c_custkey, city FROM customer JOIN z ON label = c_mktsegment""")
def zone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("BUILDING", "Oslo"), ("MACHINERY", "Bergen")], "label string, city string")
    return rent.labelled_city(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label")), labels).select("c_custkey", "city")


SPECIFIC = ("Bad: fukt i membran", "Tak", "ikke godkjent kjeller", "kort", "Fin utsikt mot fjorden i nord")


@query(f"""SELECT p_partkey, CAST([1, 0, 1, 0, 0][CAST(p_partkey % 5 + 1 AS INTEGER)] AS BOOLEAN) AS specific FROM part""")
def specific_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", issues.is_specific(pick(SPECIFIC, F.col("p_partkey"))).alias("specific"))


# -- saved pages' entries and facts -------------------------------------------------------------------------------

@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), e AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM l),
  t AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS cut FROM e),
  p AS (SELECT *, replace(replace(replace(replace(replace(replace(lower(cut), 'ø', 'o'), 'å', 'a'), 'æ', 'ae'), 'é', 'e'), 'ö', 'o'), 'ü', 'u') AS s FROM t),
  w AS (SELECT *, regexp_split_to_array(s, '[^a-z0-9]+') AS k, len(regexp_split_to_array(cut, '\\s+')) AS n FROM p)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, contains(s, 'of the') AS always FROM w WHERE length(s) >= 8 AND (contains(s, 'of the') OR (
    (list_has_any(k, ['the', 'der', 'uber', 'les']) OR contains(s, 'de la')) AND (list_has_any(k, ['and', 'und', 'que']) OR n >= 3)))""")
def specific_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specific lines of all documents, by terms that occur in them."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    kept = lines.where(issues.is_specific_entry(F.col("line"), ("the", "der", "uber", "les", "de la"), ("and", "und", "que"), "of the"))
    return kept.withColumn("always", F.contains(texts.simplify(F.col("line")), F.lit("of the")))


_FACTS = """'[{"key":" size ","order":"1 ' || p_size || ',5","value":' || p_size || '},{"id":"brand","name":"' || p_brand || '","amount":"' || p_type || '"},{"slug":" ","label":"x"},7,
 {"slug":"key","order":' || (p_partkey * 7919 % 3000) || ',"displayValue":{"n":' || p_partkey || '},"group":" Kostnader "},{"key":5,"id":"none","value":null,"amount":3},{"key":"type","label":"' || p_name || '","order":"x","value":"' || p_type || '"}]'"""
_PAIRS = """'[{"label":"' || p_name || '","value":"' || p_brand || '","order":"' || (p_partkey % 5) || '"},{"label":"Size","value":' || p_size || '},{"label":"Type","value":"' || p_type || '"},{"label":"","value":"x"},
 {"label":"Key","value":"' || p_partkey || '","order":" "},{"label":"Brand","value":"' || p_brand || '","order":' || (p_size % 4) || '.5},{"label":"None","value":"y","order":"z"}]'"""
_EACH = "SELECT p_partkey, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS i, unnest(CAST(j AS JSON[])) AS r FROM (SELECT p_partkey, CAST({} AS JSON) AS j FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")


@query(f"""WITH e AS ({_EACH.format(_FACTS)}), t AS (SELECT *, [CASE WHEN json_type(r, '$.' || x) = 'VARCHAR' THEN nullif(trim(json_extract_string(r, '$.' || x)), '') END FOR x IN ['key', 'id', 'slug', 'label', 'name', 'group']] AS s FROM e WHERE json_type(r) = 'OBJECT'),
  f AS (SELECT p_partkey, i, coalesce(s[1], s[2], s[3]) AS key, coalesce(s[4], s[5], s[1], s[2], s[3]) AS label, s[6] AS grp,
    CASE WHEN json_exists(r, '$.value') THEN json_extract_string(r, '$.value') WHEN json_exists(r, '$.amount') THEN json_extract_string(r, '$.amount') ELSE json_extract_string(r, '$.displayValue') END AS value,
    try_cast(replace(replace(json_extract_string(r, '$.order'), ' ', ''), ',', '.') AS DOUBLE) AS ord FROM t)
  SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY coalesce(ord, 1000), i) - 1 AS INTEGER) AS pos, key, label, value, grp, ord FROM f WHERE key IS NOT NULL""")
def saved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from JSON with all fields' other names, composed of every part's columns."""
    return _parts(spark, sf_dir).select("p_partkey", F.posexplode(facts.saved_facts(F.expr(_FACTS))).alias("pos", "f")).select("p_partkey", "pos", "f.*")


@query(f"""WITH e AS ({_EACH.format(_PAIRS)}), f AS (SELECT p_partkey, i, json_extract_string(r, '$.label') AS label, json_extract_string(r, '$.value') AS value, json_extract_string(r, '$.order') AS o FROM e WHERE json_type(r, '$.label') = 'VARCHAR' AND json_type(r, '$.value') = 'VARCHAR'),
  g AS (SELECT *, CASE WHEN trim(o) = '' THEN 0 ELSE coalesce(try_cast(o AS DOUBLE), i) END AS ord FROM f WHERE label <> '' AND value <> '')
  SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY ord, i) - 1 AS INTEGER) AS pos, label, value, CAST(ord AS DOUBLE) AS ord FROM g""")
def saved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-value pairs from JSON with numbers, text and blanks as orders, composed of every part's columns."""
    return _parts(spark, sf_dir).select("p_partkey", F.posexplode(facts.saved_pairs(F.expr(_PAIRS))).alias("pos", "f")).select("p_partkey", "pos", "f.*")
