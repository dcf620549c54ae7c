import re

from hearthline.llm import urlfilter
from hearthline.llm.entry import op7_url_filter
from tests.llm.conftest import SMALL, as_dicts

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def brute(url):
    """Every rule on every URL."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, verdict, rule = max(fits)
        return host, path, rule, verdict
    other = [r.verdict for r in urlfilter.PATTERNS if re.search(r.regex, host + path)]
    return host, path, None, other[0] if other else "allow"


def judged(df):
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()]


def test_whole_table(spark):
    pages = {r["page_id"]: brute(r["url"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op7_url_filter(spark, SMALL).collect()}
    assert got == pages


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "https://example.com/en", "https://example.com/en/", "https://a.b.example.com/en/x", "https://notexample.com/en/", "http://x.net/es/", "http://net/fr/q",
    "http://x.net/ES/", "http://com", "http://com/", "http://xcom/", "https://shop.org/cart", "https://shop.org/cartoon", "http://ads.x.org/", "http://x.org/wp-login.php", "http://x.org/wp-loginx", "http://x.org/calendar/2020/1/", "http://é.org/casino\n", "a://b://c.com/en/",
    "http://x.org?q=/cart/", "http://x.org#/cart/", "http://user@example.com/en/", "http://example.com:80/en/", "http://İ.net/es/", "http://x.com/" + "a/" * 50_000 + "casino",
]


def test_odd_urls(spark):
    df = spark.createDataFrame([(u, 1, 2, 3, 4) for u in URLS], "url string, verdict int, host int, _judged int, extra int")
    out = urlfilter.judge_urls(df)
    rows = as_dicts(out)
    assert out.columns == ["url", "_judged", "extra", "host", "path", "rule", "verdict", "n_candidates"]
    assert {(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {(u, *brute(u)) for u in URLS} and rows[0]["_judged"] == 3
    assert urlfilter.judge_urls(df.limit(0)).count() == 0
    assert judged(urlfilter.judge_urls(df.where("url is null"), rules=(), patterns=())) == [("", "", None, "allow")]


def test_only_candidates_run(spark):
    many = tuple(urlfilter.list_rule("block", f"site{i}.org", f"/p{i}/") for i in range(500))
    df = spark.createDataFrame([("http://site7.org/p7/x",), ("http://other.org/",)], "url string")
    rows = sorted(as_dicts(urlfilter.judge_urls(df, rules=many, patterns=())), key=lambda r: r["url"])
    assert [(r["rule"], r["verdict"], r["n_candidates"]) for r in rows] == [(None, "allow", 0), ("site7.org/p7/", "block", 1)]


def test_rule_goes_under_its_rarest_token():
    rules = (urlfilter.list_rule("block", "common.rare", "/"), urlfilter.pattern_rule("block", "x", ()))
    index, loose = urlfilter.build_index(rules, {"common": 9, "rare": 1})
    assert index == {"rare": [0]} and loose == [1]


def test_every_rule_is_fetched_by_a_token(spark):
    assert urlfilter.build_index((*urlfilter.LIST, *urlfilter.PATTERNS), {})[1] == []
    urls = ["http://a.org/cart", "http://a.org/x/checkout/", "http://ad.a.org/", "http://ADS.a.org/", "http://adserver.a.org/", "http://doubleclick.a.org/x"]
    rows = as_dicts(urlfilter.judge_urls(spark.createDataFrame([(u,) for u in [*urls, "http://plain.org/x"]], "url string")))
    assert {r["url"]: (r["verdict"], r["n_candidates"]) for r in rows} == {u: ("block", 1) for u in urls} | {"http://plain.org/x": ("allow", 0)}
