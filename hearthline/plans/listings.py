"""Registered queries of links, brokers, listings and the web layer's values, each with its SQL twin.

Words and URLs come from a row's number, so that every rule fires; the twins state the same rules in SQL over value tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..operators import brokers, listing, rent
from ..sources import html, images, staging
from .catalog import query, read


def pick(words: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.lit(list(words)), (n % len(words) + 1).cast("int"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pick(words: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(map(quoted, words))}][CAST(({n}) % {len(words)} + 1 AS INTEGER)]"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# -- brokers ------------------------------------------------------------------------------------------------------

SITES = (
    "https://dnbeiendom.no/bolig/", "https://proaktiv.no/", "https://privatmegleren.no/", "https://aktiv.no/", "https://eie.no/eiendom/", "https://eiendomsmegler1.no/", "https://askeiendomsmegling.no/",
    "https://krogsveen.no/kjope/", "https://krogsveen.no/annet/", "https://notar.no/bolig-til-salgs/", "https://obos.no/brukt-bolig/", "https://partners.no/eiendom/", "https://x.no/?tenant=", "https://nordvikbolig.no/boliger/",
    "https://hem.no/", "https://garanti.no/eiendom/", "https://ds.meglerhuset-rele.no/", "https://sem-johnsen.no/boliger/", "https://sormegleren.no/", "https://boaeiendom.no/", "https://EXBO.no/",
    "https://meglervisning.no/salgsoppgave/hent?instid=MSEXBO&id=", "https://meglervisning.no/salgsoppgave/hent?instid=OTHER&id=", "https://meglervisning.no/salgsoppgave/hent?id=", "https://outgoing.webtopsolutions.com/", "https://example.com/",
)
FOLDERS = (
    "https://cdn.eiendomssentralen.no/", "https://cdn.webmegler.no/proxy/webmegler/", "https://outgoing.webtopsolutions.com/hires/", "https://file-proxy.rfcdn.io/", "https://cdn.sanity.io/files/", "https://a.no/proxy/vitec/document/",
    "https://meglervisning.no/salgsoppgave/hent?estateid=", "https://digitalsalgsoppgave.emvest.no/0a1b2c3d-0000-1111-2222-333344445555/2?", "https://digitalsalgsoppgave.garanti.no/", "https://a.no/files/", "https://a.no/Vedlegg/Dokument/", "https://a.no/docs/", "https://a.no/",
)
FILES = ("salgsoppgave.pdf", "Digital_Salgsoppgave.PDF", "prospekt.pdf", "tilstandsrapport.pdf", "klikk.pdf", "wngetfile.ashx", "utskriftsvennlig", "budskjema.pdf", "plan.pdf", "x?y=1")
TEXTS = ("Salgsoppgave", "Last ned PDF", "Prospekt med vedlegg", "Energiattest", "", "Komplett salgsoppgave.pdf", "Dokument", "Se  PDF")

_SITES = f"s AS (SELECT page_id, {sql_pick(SITES, 'page_id')} || CAST(1000000 + page_id AS VARCHAR) AS page_url FROM pages)"
_HOSTS = f"h(pri, name, alt, pattern) AS (VALUES {values((i, b.name, a, p) for i, b in enumerate(brokers.BROKERS) for a, patterns in enumerate(b.hosts) for p in (patterns or ('',)))})"
_NAMED = f"""{_SITES}, {_HOSTS}, seen AS (SELECT DISTINCT page_url, lower(page_url) || ' instid=' || coalesce(regexp_extract(lower(page_url), '[?&]instid=([^&#]*)', 1), '') AS t FROM s),
  n AS (SELECT page_url, arg_min(name, pri) AS broker FROM (SELECT page_url, name, pri, alt FROM seen CROSS JOIN h GROUP BY page_url, name, pri, alt HAVING bool_and(regexp_matches(t, pattern))) GROUP BY page_url)"""


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(pick(SITES, k), (k + 1_000_000).cast("string")).alias("page_url"))


@query(f"WITH {_NAMED} SELECT page_id, page_url, broker FROM s JOIN n USING (page_url)")
def broker_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_pages(spark, sf_dir).withColumn("broker", brokers.broker_of(F.col("page_url")))


_LINKS = f"""{_NAMED}, l AS (SELECT page_id, page_url, broker, CAST(i AS BIGINT) AS pos, {sql_pick(FOLDERS, 'page_id // 26 + 3 * i')} || CAST(CASE WHEN i = 1 THEN 1000000 + page_id ELSE i END AS VARCHAR) || '/' || {sql_pick(FILES, 'page_id // 7 + i * i')} AS link,
    {sql_pick(TEXTS, 'page_id // 3 + i')} AS label FROM s JOIN n USING (page_url) CROSS JOIN range(0, 6) r(i)),
  b(broker, deny, allow, uses, url_deny, url_allow, url_must) AS (VALUES {values((b.name, b.deny, b.allow, int(b.label), b.url_deny, b.url_allow, b.url_must) for b in brokers.BROKERS)}),
  p(broker, place, pattern, points) AS (VALUES {values((b.name, *x) for b in brokers.BROKERS for x in b.points)}),
  o AS (SELECT l.*, lower(link) AS low, CASE WHEN uses = 1 THEN lower(label) || ' ' || lower(link) ELSE lower(link) END AS hay, deny, allow, url_deny, url_allow, url_must FROM l JOIN b USING (broker)),
  a AS (SELECT page_id, page_url, broker, pos, link, label, low,
    ((allow <> '' AND regexp_matches(hay, allow)) OR (url_allow <> '' AND regexp_matches(low, url_allow)) OR (allow = '' AND url_allow = ''))
    AND (deny = '' OR NOT regexp_matches(hay, deny)) AND (url_deny = '' OR NOT regexp_matches(low, url_deny)) AND (url_must = '' OR regexp_matches(low, url_must)) AS allowed FROM o),
  t AS (SELECT a.page_id, a.pos, sum(CASE WHEN regexp_matches(CASE place WHEN 'url' THEN low WHEN 'label' THEN lower(label) WHEN 'any' THEN low || ' ' || lower(label) ELSE lower(label) || chr(10) || low END, pattern) THEN points ELSE 0 END) AS points FROM a JOIN p ON a.broker = p.broker GROUP BY a.page_id, a.pos),
  j AS (SELECT a.*, CAST(coalesce(points, 0) + CASE WHEN broker = 'privatmegleren' AND contains(low, regexp_extract(page_url, '/(\\d{{6,}})\\b', 1)) AND regexp_extract(page_url, '/(\\d{{6,}})\\b', 1) <> '' THEN 40 ELSE 0 END
    + CASE WHEN broker = 'nordvik' THEN greatest(0, 20 - length(link) // 100) ELSE 0 END AS INTEGER) AS score FROM a LEFT JOIN t USING (page_id, pos))"""


def _site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("page_id"), F.col("pos")
    number = F.when(i == 1, k + 1_000_000).otherwise(i).cast("string")
    link = F.concat(pick(FOLDERS, F.floor(k / 26) + i * 3), number, F.lit("/"), pick(FILES, F.floor(k / 7) + i * i))
    return _site_pages(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumns({"link": link, "label": pick(TEXTS, F.floor(k / 3) + i)})


@query(f"WITH {_LINKS} SELECT page_id, pos, broker, link, label, allowed, score FROM j")
def broker_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brokers.judged(_site_links(spark, sf_dir)).select("page_id", "pos", "broker", "link", "label", "allowed", "score")


@query(f"""WITH {_LINKS} SELECT page_id, broker, link, score FROM j WHERE allowed
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, CASE WHEN broker IN ('notar', 'obosmegleren') THEN length(link) ELSE 0 END, pos) = 1""")
def broker_best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brokers.best_links(_site_links(spark, sf_dir), "page_id").select("page_id", "broker", "link", "score")


# -- links and images ---------------------------------------------------------------------------------------------

LABELS = ("Se salgsoppgave", "Nabolagsprofil", "PROSPEKT for utskrift", "Kontakt oss", "", "Vedlegg  til salgsoppgave", "Égenerklæring", "Last ned PDF", "Kart og bilder", "all nøkkelinformasjon")
HREFS = ("https://a.no/x.pdf", "https://a.no/getfile?id=1", "https://privatmegleren.no/docs/klikk.pdf#p", "https://a.no/kart.pdf", "https://b.no/side", "https://a.no/Salgsoppgave.PDF", "https://a.no/proxy/webmegler/1/wngetfile.ashx", "")


def _words(name: str, words: tuple[str, ...]) -> str:
    return f"{name}(w) AS (VALUES {values((w,) for w in words)})"


def _hits(text: str, table: str) -> str:
    return f"(SELECT count(*) FROM {table} WHERE contains({text}, w))"


@query(f"""WITH {_words('pos', web.POSITIVE)}, {_words('neg', web.NEGATIVE)}, {_words('lab', (*web.LABELS, *web.KEYWORDS))},
  c AS (SELECT DISTINCT page_id % 80 AS k, {sql_pick(HREFS, 'page_id % 80')} AS href, {sql_pick(LABELS, 'page_id % 80 // 8')} AS label FROM pages),
  t AS (SELECT *, lower(trim(regexp_replace(strip_accents(href || ' ' || label), '\\s+', ' ', 'g'))) AS both_, lower(trim(regexp_replace(strip_accents(label), '\\s+', ' ', 'g'))) AS low FROM c),
  r AS (SELECT k, href, label,
    CAST((CASE WHEN ends_with(lower(href), '.pdf') THEN 80 ELSE 0 END) + (CASE WHEN regexp_matches(href, '(?i){web.DOWNLOAD}') THEN 120 ELSE 0 END) + 40 * {_hits('both_', 'pos')} - 1000 * {_hits('both_', 'neg')} AS INTEGER) AS score,
    {_hits('low', 'neg')} = 0 AND {_hits('low', 'lab')} > 0 AS clickable, ends_with(lower(string_split(href, '#')[1]), '/docs/klikk.pdf') AS dummy,
    {_hits('lower(href)', 'neg')} = 0 AND NOT contains(lower(href), 'b.no/x') AND (contains(lower(href), 'b.no') OR contains(lower(href), '.pdf') OR regexp_matches(lower(href), '{web.DOWNLOAD}')) AS allowed FROM t)
  SELECT page_id, href, label, score, clickable, dummy, allowed FROM pages JOIN r ON page_id % 80 = k""")
def link_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 80
    p = read(spark, sf_dir, "pages").select("page_id", pick(HREFS, k).alias("href"), pick(LABELS, F.floor(k / 8)).alias("label"))
    return p.select("page_id", "href", "label", web.click_score(F.col("href"), F.col("label")).alias("score"), web.clickable(F.col("label")).alias("clickable"), web.dummy_pdf(F.col("href")).alias("dummy"), web.url_allowed(F.col("href"), ("b.no",), ("b.no/x",)).alias("allowed"))


IMAGES = (
    "https://images.finncdn.no/dynamic/1600w/item/1.jpg", "https://images.finncdn.no/dynamic/320w/item/1.jpg", "https://images.finncdn.no/dynamic/480x360/logo.png", "https://images.finncdn.no/item/1.jpg", "https://other.no/dynamic/1600w/1.jpg",
    "https://images.finncdn.no/dynamic/default/1_etg.png", "https://images.finncdn.no/dynamic/default/plantegning-2.jpg", "https://a.no/plan.svg", "https://a.no/hovedplan/x.jpg", "https://a.no/bilde.webp", "not a url",
)


@query(f"""WITH {_words('b', web.IMAGE_BLOCK)}, {_words('f', web.PLANS)}, c AS (SELECT k, {sql_pick(IMAGES, 'k')} AS url FROM range(0, {len(IMAGES)}) r(k)),
  t AS (SELECT *, lower(url) AS low, regexp_extract(lower(url), '^https?://([^/?#:]*)', 1) AS host, regexp_extract(lower(url), '^https?://[^/?#]*([^?#]*)', 1) AS path FROM c),
  r AS (SELECT k, url, ends_with(host, 'finncdn.no') AND contains(path, '/dynamic/') AND {_hits('path', 'b')} = 0 AND NOT coalesce(try_cast(regexp_extract(path, '/dynamic/(\\d+)(x|w)', 1) AS INTEGER) BETWEEN 1 AND 399, false) AS photo,
    {_hits("translate(low, '_-', '  ')", 'f')} > 0 OR regexp_matches(path, '\\.(svg|pdf)$') AS by_name, regexp_matches(regexp_replace(translate(path, '_-', '  '), '[^a-z0-9\\s]', ' ', 'g'), '{web.PLAN_WORDS}') AS dynamic FROM t)
  SELECT l_orderkey, l_linenumber, url, photo, by_name OR (dynamic AND (NOT regexp_matches(url, '\\.jpe?g$') OR l_discount * 20 >= 1.34)) OR (NOT regexp_matches(url, '\\.jpe?g$') AND contains(url, '://') AND l_discount * 20 >= 1.52) OR (l_linenumber >= 7 - 2 AND regexp_matches(url, '\\.(png|webp)$')) AS plan
  FROM lineitem JOIN r ON (l_orderkey + l_linenumber) % {len(IMAGES)} = k""")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pick(IMAGES, F.col("l_orderkey") + F.col("l_linenumber")).alias("url"), (F.col("l_discount") * 20).alias("ratio"))
    plan = web.floor_plan(F.col("url"), index=F.col("l_linenumber"), total=F.lit(7), ratio=F.col("ratio"))
    return li.select("l_orderkey", "l_linenumber", "url", web.listing_image(F.col("url")).alias("photo"), plan.alias("plan"))


_CDN = "https://images.finncdn.no/dynamic/"


@query(f"""SELECT page_id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN '{_CDN}1600w/f' || (page_id % 7) || '/p' || page_id || '.jpg' WHEN 1 THEN '{_CDN}' || CASE WHEN page_id % 2 = 0 THEN '1280w' ELSE '960w' END || '/g' || (page_id % 5) || '/q' || page_id || '.png'
  ELSE '{_CDN}1600w/z/l' || page_id || '.jpg' END AS url FROM pages CROSS JOIN range(0, 3) r(i)""")
def page_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of every page, its own HTML with nested JSON in its head (one picture in two widths, one under a key that ends the branch) and pictures in its article."""
    k = F.col("page_id")
    head = F.format_string(
        '<head><script type="application/ld+json">{"image": ["' + _CDN + '480w/f%d/p%d.jpg", {"url": "//images.finncdn.no/dynamic/1600w/f%d/p%d.jpg?x=1"}], "logo": {"url": "' + _CDN + '1600w/z/l%d.jpg"}}</script>'
        '<script>window.state = {"deep": {"list": [[{"photos": ["' + _CDN + '960w/g%d/q%d.png"], "name": "none"}]]}};</script>', k % 7, k, k % 7, k, k, k % 5, k)  # fmt: skip
    body = F.format_string("<article><img src='" + _CDN + "320w/g0/narrow%d.png'>", k)
    wide = F.when(k % 2 == 0, F.format_string("<img src='" + _CDN + "1280w/g%d/q%d.png?w=1'>", k % 5, k)).otherwise("")
    whole = F.replace(F.replace("html", F.lit("<head>"), head), F.lit("<article>"), F.concat(body, wide))
    return images.gallery(read(spark, sf_dir, "pages").select("page_id", whole.alias("html")))


# -- listings -----------------------------------------------------------------------------------------------------

_K = "o_orderkey"
_MONEY = "concat(CAST(1 + o_orderkey % 9 AS VARCHAR), ' ', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), ' 000 kr')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's key as a listing: some fields in its JSON, some only as labels, some nowhere."""
    k = F.col(_K)
    money = F.concat((k % 9 + 1).cast("string"), F.lit(" "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" 000 kr"))
    entry = lambda obj, key, value: F.struct(F.lit(obj).alias("obj"), F.lit("").alias("up"), F.lit(1).alias("depth"), F.lit(False).alias("linked"), F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit(False).alias("number"))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    found = F.array(
        entry(1, "object type", F.when(k % 3 == 0, F.lit(" Leilighet "))), entry(2, "street address", F.when(k % 4 != 0, F.concat(F.lit("Gate "), (k % 50).cast("string")))),
        entry(2, "postal code", F.lpad((k % 10000).cast("string"), 4, "0")), entry(2, "city", F.when(k % 5 != 0, F.lit("Bergen"))), entry(3, "price asking price nok", F.when(k % 2 == 0, money)),
        entry(4, "viewing from", F.concat(F.lit("2024-05-0"), (k % 9 + 1).cast("string"), F.lit("T12:00"))), entry(4, "viewing until", F.when(k % 3 == 1, F.lit("2024-05-09T13:00"))), entry(5, "number of bedrooms", k % 6),
    )
    pairs = F.array(pair("adresse", F.lit(" Veien 1 ")), pair("pris", money), pair("felleskost mnd", F.when(k % 7 != 0, F.concat((k % 9000).cast("string"), F.lit(" kr")))), pair("bruksareal", F.concat((k % 200).cast("string"), F.lit(",50 m²"))),
                    pair("byggear", F.concat(F.lit("ca. "), (k % 100 + 1900).cast("string"))), pair("energi merking", F.when(k % 2 == 1, F.lit("C - gul"))))
    o = staging.spread(read(spark, sf_dir, "orders").select(_K), _K).select(_K, F.concat(F.lit("https://x.no/ad/"), (k + 1_000_000).cast("string")).alias("url"), found.alias("entries"), pairs.alias("pairs"))
    return listing.key_numbers(o, _K)


_FIELDS = f"""f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN concat('Gate ', o_orderkey % 50, ', ', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'), CASE WHEN o_orderkey % 5 <> 0 THEN ' Bergen' ELSE '' END) ELSE 'Veien 1' END AS adresse,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Leilighet' END AS boligtype, regexp_replace({_MONEY}, '[^0-9]', '', 'g') AS prisantydning, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 9000 AS VARCHAR) END AS felleskostnader,
    CAST(o_orderkey % 6 AS VARCHAR) AS soverom, CAST(o_orderkey % 100 + 1900 AS VARCHAR) AS built, CASE WHEN o_orderkey % 2 = 1 THEN 'C - gul' END AS energimerke, concat(o_orderkey % 200, '.5') AS bra, CAST(o_orderkey + 1000000 AS VARCHAR) AS code,
    concat('2024-05-0', o_orderkey % 9 + 1, 'T12:00', CASE WHEN o_orderkey % 3 = 1 THEN '/2024-05-09T13:00' ELSE '' END) AS visning FROM orders)"""


@query(f"WITH {_FIELDS} SELECT * FROM f")
def key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"adresse": "adresse", "boligtype": "boligtype", "prisantydning": "prisantydning", "felleskostnader": "felleskostnader", "soverom": "soverom", "byggeår": "built", "energimerke": "energimerke", "BRA (m²)": "bra", "finn-kode": "code", "visningstidspunkter": "visning"}
    return _documents(spark, sf_dir).select(_K, *(F.col("key_numbers")[n].alias(a) for n, a in names.items()))


@query(f"""WITH {_FIELDS}, g AS (SELECT f.*, o_totalprice, CASE WHEN f.o_orderkey % 5 = 0 THEN NULL WHEN f.o_orderkey % 5 = 1 THEN 0 ELSE 77 END AS price0, CASE WHEN f.o_orderkey % 6 = 0 THEN NULL ELSE f.o_orderkey % 3 END AS hoa0 FROM f JOIN orders USING (o_orderkey))
  SELECT o_orderkey, CASE WHEN price0 IS NULL AND CAST(prisantydning AS BIGINT) > 0 THEN CAST(prisantydning AS BIGINT) ELSE price0 END AS total_price, CASE WHEN hoa0 IS NULL AND felleskostnader IS NOT NULL THEN CAST(felleskostnader AS BIGINT) ELSE hoa0 END AS hoa_month,
    price0 IS NULL AND CAST(prisantydning AS BIGINT) > 0 AS used_price, hoa0 IS NULL AND felleskostnader IS NOT NULL AS used_hoa, true AS has_any FROM g""")
def key_numbers_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    d = _documents(spark, sf_dir).withColumns({"total_price": F.when(k % 5 == 1, 0).when(k % 5 != 0, 77).cast("long"), "hoa_month": F.when(k % 6 != 0, k % 3).cast("long")})
    return listing.enriched(d).select(_K, "total_price", "hoa_month", "used_price", "used_hoa", listing.has_any_number(F.col("key_numbers")).alias("has_any"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's own HTML with a listing put into its head and article: images, linked data, page state, labels and prices, each missing on some pages."""
    k, host = F.col("page_id"), F.regexp_extract("url", "://([^/?#]+)", 1)
    head = F.concat(
        F.lit("<head>"), F.when(k % 2 == 0, F.format_string('<meta property="og:image" content="https://images.finncdn.no/dynamic/1600w/%d.jpg">', k)).otherwise(""),
        F.when(k % 3 == 0, F.format_string('<meta name="twitter:image" content="https://t.no/%d.png">', k)).otherwise(""),
        F.when(k % 7 != 0, F.format_string(
            '<script type="application/ld+json">{"@type": "Residence", "image": ["https://ld.no/%d.jpg", "x"], "address": {"streetAddress": "%s %d", "postalCode": "%04d", "addressLocality": "Bergen"}, '
            '"offers": [{"price": %d}], "geo": {"latitude": "60,%d", "longitude": 5.5}}</script>', k, host, k % 50, k % 10000, k % 9 * 100_000, k % 1000)).otherwise('<script type="application/ld+json">{"cut off": </script>'),
        F.when(k % 5 != 0, F.format_string(
            '<script id="__NEXT_DATA__" type="application/json">{"props": {"ad": {"objectType": {"value": " Leilighet "}, "askingPrice": {"amount": "%d 000 000 kr"}, '
            '"viewings": [{"viewingFrom": "2024-05-0%dT12:00", "viewingTo": "2024-05-09T13:00"}], "deep": [[{"energyLabel": "B"}]]}}}</script>', k % 9 + 1, k % 9 + 1)).otherwise(""),
    )
    body = F.concat(
        F.lit("<article>"), F.when(k % 4 == 1, F.format_string('<h2 data-testid="object-address">Kart <span>Storgata %d</span> Totalpris</h2>', k)).otherwise(""),
        F.format_string("<dl><dt>Soverom</dt><dd>%d</dd><dt>Bruksareal</dt><dd>%d,5 m²</dd><dt>Eieform</dt><dd>Selveier</dd></dl><p>Totalpris: %d 500 000 kr</p>", k % 6, k % 200 + 20, k % 9 + 1),
        F.when(k % 5 != 0, F.format_string("<p>Felleskostnader %d 250 kr</p>", k % 9 + 1)).otherwise(""),
    )
    whole = F.replace(F.replace("html", F.lit("<head>"), head), F.lit("<article>"), body)
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://x.no/ad?finnkode="), (k + 1_000_000).cast("string")).alias("url"), whole.alias("html"))


_HOST = "regexp_extract(url, '://([^/?#]+)', 1) || ' ' || (page_id % 50) || ', ' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || ' Bergen'"


@query(f"""SELECT page_id, 'https://x.no/ad?finnkode=' || (page_id + 1000000) AS source_url,
  CASE WHEN page_id % 2 = 0 THEN 'https://images.finncdn.no/dynamic/1600w/' || page_id || '.jpg' WHEN page_id % 3 = 0 THEN 'https://t.no/' || page_id || '.png' WHEN page_id % 7 <> 0 THEN 'https://ld.no/' || page_id || '.jpg' END AS image,
  CASE WHEN page_id % 4 = 1 THEN 'Storgata ' || page_id WHEN page_id % 7 <> 0 AND length({_HOST}) <= 80 THEN {_HOST} END AS address,
  CASE WHEN page_id % 7 <> 0 AND page_id % 9 <> 0 THEN page_id % 9 * 100000 ELSE (page_id % 9 + 1) * 1000000 + 500000 END AS total_price, CASE WHEN page_id % 5 <> 0 THEN (page_id % 9 + 1) * 1000 + 250 END AS hoa_month,
  CASE WHEN page_id % 7 <> 0 THEN CAST('60.' || (page_id % 1000) AS DOUBLE) END AS lat, CASE WHEN page_id % 7 <> 0 THEN 5.5::DOUBLE END AS lon, page_id % 200 + 20.5::DOUBLE AS area_m2, CAST(page_id % 6 AS INTEGER) AS rooms FROM pages""")
def listing_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.project(_listed(spark, sf_dir))


@query(f"""SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN {_HOST} END AS adresse, CASE WHEN page_id % 5 <> 0 THEN 'Leilighet' END AS boligtype, 'Selveier' AS eieform, CASE WHEN page_id % 5 <> 0 THEN CAST((page_id % 9 + 1) * 1000000 AS VARCHAR) END AS prisantydning,
  CAST(page_id % 6 AS VARCHAR) AS soverom, CASE WHEN page_id % 5 <> 0 THEN 'B' END AS energimerke, concat(page_id % 200 + 20, '.5') AS bra, CAST(page_id + 1000000 AS VARCHAR) AS code,
  CASE WHEN page_id % 5 <> 0 THEN concat('2024-05-0', page_id % 9 + 1, 'T12:00/2024-05-09T13:00') END AS visning, CAST(NULL AS VARCHAR) AS totalpris FROM pages""")
def page_key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared fields from the pages' HTML: parsed once, staged, then looked up by name."""
    names = {"adresse": "adresse", "boligtype": "boligtype", "eieform": "eieform", "prisantydning": "prisantydning", "soverom": "soverom", "energimerke": "energimerke", "BRA (m²)": "bra", "finn-kode": "code", "visningstidspunkter": "visning", "totalpris": "totalpris"}
    content = staging.staged(html.with_listing(_listed(spark, sf_dir)), "listing-pages")
    return listing.key_numbers(content, "page_id").select("page_id", *(F.col("key_numbers")[n].alias(a) for n, a in names.items()))


ADDRESSES = ("Kart Storgata 1 Prisantydning", "  Kart  Veien 2  totalpris ", "Kartveien 3", "Gate 4", " Prisantydning")


@query(f"""SELECT o_orderkey, trim(regexp_replace(trim(regexp_replace({sql_pick(ADDRESSES, 'o_orderkey')}, '^\\s*Kart\\s+', '')), '(?i)\\s+(Prisantydning|Totalpris)\\s*$', '')) AS address,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://own/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'http://code/' || o_orderkey ELSE 'https://www.finn.no/realestate/homes/ad.html?finnkode=' || o_orderkey END AS url FROM orders""")
def listing_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    code = F.when(k % 3 == 1, F.concat(F.lit(" http://code/"), k.cast("string"))).otherwise(k.cast("string"))
    own = F.when(k % 3 == 0, F.concat(F.lit("https://own/"), k.cast("string"))).when(k % 3 == 1, "")
    return read(spark, sf_dir, "orders").select(_K, listing.clean_address(pick(ADDRESSES, k)).alias("address"), listing.listing_url(own, code).alias("url"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'cached' || c_custkey WHEN c_custkey % 4 = 1 THEN '/files/' || c_custkey WHEN c_custkey % 4 = 2 THEN 'stable' || c_custkey END AS source,
  CASE WHEN c_custkey % 4 = 0 THEN 'cached' || c_custkey WHEN c_custkey % 2 = 0 THEN 'stable' || c_custkey END AS remote_url FROM customer""")
def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey")
    k, name = F.col("c_custkey"), lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string"))
    cache = c.where("c_custkey % 4 in (0, 3)").select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit(" "), name("cached"))).otherwise(" ").alias("pdf_url"))
    files, links = c.where("c_custkey % 4 in (0, 1)").select("c_custkey", name("/files/").alias("path")), c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("").alias("stable_pdf_url"), name("stable").alias("original_pdf_url"))
    return listing.document_source(c, cache, files, links, "c_custkey").select("c_custkey", "source", "remote_url")


CITIES = ("oslo", " Bergen kommune ", "TROMSØ", "hele landet", "Narvik", "alesund", "Små tettsteder/spredt", "Store Tettsteder ")


@query(f"""WITH m(k, v) AS (VALUES {values(dict(rent.CITY_NEEDLES).items())}), z(k, v) AS (VALUES {values((x.lower(), x) for x in rent.OPEN_ZONES)}), c AS (SELECT c_custkey, {sql_pick(CITIES, 'c_custkey')} AS name FROM customer),
  t AS (SELECT *, trim(regexp_replace(lower(trim(name)), ' kommune$', '')) AS a, lower(trim(name)) AS b FROM c)
  SELECT c_custkey, coalesce((SELECT v FROM m WHERE k = a), trim(name)) AS table_city, coalesce((SELECT v FROM (SELECT * FROM m UNION ALL SELECT * FROM z) WHERE k = b), trim(name)) AS zone_city FROM t""")
def city_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(CITIES, F.col("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", rent.canonical_city(name).alias("table_city"), rent.zone_city(name).alias("zone_city"))


# -- values of the web layer --------------------------------------------------------------------------------------

SUMMARIES = ("Økonomi 72. Tilstandsgrad 140. Greit.", "okonomi: 5 og TG 33", "Ingen tall", "economy ............................ 9", "tg2 og Økono 101")
_SUM = sql_pick(SUMMARIES, "o_orderkey")


@query(f"""WITH t AS (SELECT o_orderkey, {_SUM} AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 4000 - 10.5 END AS e, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 130 AS DOUBLE) END AS c, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Greit.' WHEN 2 THEN 'Godt' END AS st FROM orders),
  b AS (SELECT *, CAST(greatest(0, least(100, floor(e + 0.5))) AS INTEGER) AS e1, CAST(greatest(0, least(100, floor(c + 0.5))) AS INTEGER) AS c1 FROM t),
  x AS (SELECT *, nullif(concat_ws('. ', CASE WHEN e IS NOT NULL THEN 'Økonomi ' || e1 END, CASE WHEN c IS NOT NULL THEN 'Tilstandsgrad ' || c1 END, nullif(trim(st), '')), '') AS j FROM b)
  SELECT o_orderkey, CASE WHEN ends_with(j, '.') THEN j ELSE j || '.' END AS summary, (SELECT CASE WHEN v > 100 THEN 100 ELSE v END FROM (SELECT try_cast(nullif(regexp_extract(s, '(?i)\\b(?:økonomi|okonomi|economy|økono)[^0-9]{{0,16}}(\\d{{1,3}})', 1), '') AS INTEGER) AS v)) AS economy,
    (SELECT CASE WHEN v > 100 THEN 100 ELSE v END FROM (SELECT try_cast(nullif(regexp_extract(s, '(?i)\\b(?:tg|tilstandsgrad)[^0-9]{{0,16}}(\\d{{1,3}})', 1), '') AS INTEGER) AS v)) AS condition,
    CASE WHEN e IS NULL THEN NULL ELSE e1 END AS econ_value, CASE WHEN c IS NULL THEN NULL ELSE c1 END AS tr_value FROM x""")
def saved_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    e, c = F.when(k % 5 != 0, F.col("o_totalprice") / 4000 - 10.5), F.when(k % 3 != 0, (k % 130).cast("double"))
    status = F.when(k % 4 == 0, " ").when(k % 4 == 1, "Greit.").when(k % 4 == 2, "Godt")
    parts = web.breakdown(F.map_from_entries(F.filter(F.array(F.struct(F.lit("tr"), c.alias("v")), F.struct(F.lit("econ"), e.alias("v"))), lambda x: x["v"].isNotNull())))
    s = pick(SUMMARIES, k)
    return read(spark, sf_dir, "orders").select(_K, web.saved_summary(e, c, status).alias("summary"), web.economy_in(s).alias("economy"), web.condition_in(s).alias("condition"), F.get(parts, F.lit(0))["value"].alias("econ_value"), F.get(parts, F.lit(1))["value"].alias("tr_value"))


_MONEY_SIGN = "CASE WHEN m > 0 THEN '+' WHEN m < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(m)), ',', ' ') || ' kr/mnd'"
_PERCENT = "CASE WHEN r > 0 THEN '+' ELSE '' END || replace(printf('%.1f', floor(r * 10 + 0.5) / 10), '.', ',') || ' %'"


@query(f"""WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 9000 - 4000 AS DOUBLE) AS c, CAST(o_orderkey % 41 - 15 AS DOUBLE) / 2 AS r FROM orders), m AS (SELECT *, CAST(floor(c / 100 + 0.5) * 100 AS BIGINT) AS m FROM t), s AS (SELECT *, {_MONEY_SIGN} AS money, {_PERCENT} AS pct FROM m)
  SELECT o_orderkey, concat_ws('|', CASE WHEN c > 0 THEN 'Månedlig overskudd ca. ' || money || ' gir løpende inntekt.' END, CASE WHEN r >= 5 THEN 'Avkastning på egenkapital ' || pct || ' (positiv) og indikerer lønnsom kapitalbruk.' END) AS good,
    concat_ws('|', CASE WHEN c < 0 THEN 'Månedlig underskudd ca. ' || money || ' gir usikker inntekt og kan gi tap.' END, CASE WHEN r < 0 THEN 'Negativ avkastning på egenkapital: ' || pct || ' betyr at kapitalen taper verdi.' WHEN r < 5 THEN 'Avkastning på egenkapital ' || pct || ' er dårlig avkastning og gir svak lønnsomhet.' END) AS bad FROM s""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(_K)
    c, r = (k % 9000 - 4000).cast("double"), (k % 41 - 15).cast("double") / 2
    return read(spark, sf_dir, "orders").select(_K, F.array_join(web.positive_highlights(c, r), "|").alias("good"), F.array_join(web.negative_highlights(c, r), "|").alias("bad"))


FACTS = (("Bad", "Oppusset i 2019. Nytt sluk"), ("Byggeår", "1954"), ("Kjøkken", "hvitt"), ("Renovering", "delvis, 2010"), ("Stue", "pusset opp, ny rehab av pipe. Fin"), (" ", "bygget"), ("bad", "oppusset I 2019. nytt SLUK"))


@query(f"""WITH f(i, label, value) AS (VALUES {values((i, a, b) for i, (a, b) in enumerate(FACTS))}), {_words('k', web.RENOVATION)},
  o AS (SELECT o_orderkey, (i + o_orderkey) % {len(FACTS)} AS pos, trim(label) AS label, trim(value) AS value FROM orders CROSS JOIN f WHERE (o_orderkey + i) % 5 <> 0 AND trim(label) <> '' AND ({_hits('lower(label)', 'k')} > 0 OR {_hits('lower(value)', 'k')} > 0)),
  s AS (SELECT *, CASE WHEN {_hits('lower(label)', 'k')} > 0 THEN label WHEN regexp_matches(value, '(?i)\\boppusset\\b') THEN 'Oppusset ' || lower(label)
    ELSE upper(substr(trim(regexp_split_to_array(value, '[\\n.]')[1]), 1, 1)) || lower(substr(trim(regexp_split_to_array(value, '[\\n.]')[1]), 2)) END AS shown FROM o),
  d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey, lower(shown), lower(value) ORDER BY pos) = 1)
  SELECT o_orderkey, coalesce(string_agg(shown || ': ' || value, '|' ORDER BY pos), '') AS told FROM orders LEFT JOIN d USING (o_orderkey) GROUP BY o_orderkey""")
def renovation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col(_K), len(FACTS)
    every = F.array(*(F.struct(((k + i) % n).alias("pos"), F.lit(i).alias("i"), F.lit(a).alias("label"), F.lit(b).alias("value")) for i, (a, b) in enumerate(FACTS)))
    facts = F.array_sort(F.filter(every, lambda f: (k + f["i"]) % 5 != 0))
    told = web.renovation_facts(facts)
    return read(spark, sf_dir, "orders").select(_K, F.array_join(F.transform(told, lambda t: F.concat(t["label"], F.lit(": "), t["short"])), "|").alias("told"))
