"""Listings from what their pages say: declared fields, addresses, showings, and what fills what is missing.

Fields are looked up by an inverted index of names: a page's JSON entries and labels are rows, each distinct name is
compared with the declared names once, and rows meet the fields that want them in an equi-join on the name. Of each
page and field the row of the best source, and there the first, counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, urls
from ..sources import html, staging
from . import facts

# Field, names of its JSON keys, labels on the page, and how its value is read.
FIELDS = (
    ("adresse", (), ("adresse",), "text"),
    ("bydel", ("bydel", "district", "neighbourhood", "neighborhood", "område"), ("bydel", "område", "stadsdel"), "text"),
    ("kommune", ("kommune", "municipality"), ("kommune",), "text"),
    ("boligtype", ("boligtype", "propertytype", "objecttype"), ("boligtype", "type bolig"), "text"),
    ("eieform", ("eieform", "ownership", "ownershiptype"), ("eieform", "eierform"), "text"),
    ("prisantydning", ("prisantydning", "askingprice", "asking_price"), ("prisantydning", "pris"), "money"),
    ("totalpris", ("totalpris", "totalprice", "pris_total", "sumtotal"), ("totalpris",), "money"),
    ("fellesgjeld", ("fellesgjeld", "jointdebt"), ("fellesgjeld",), "money"),
    ("felleskostnader", ("felleskost", "felleskostnad", "felleskostnader", "sharedcost", "monthlycost"), ("felleskost", "felleskostnader", "fellesutgifter"), "money"),
    ("omkostninger", ("omkostninger", "kostnader", "costsum", "additionalcost"), ("omkostninger",), "money"),
    ("kommunale avgifter", ("kommunaleavgifter", "municipalfees"), ("kommunale avgifter", "kommunaleavgifter"), "money"),
    ("formuesverdi", ("formuesverdi", "taxvalue", "assessedvalue"), ("formuesverdi",), "money"),
    ("soverom", ("soverom", "antallsoverom", "bedrooms"), ("soverom", "antall soverom"), "whole"),
    ("etasje", ("etasje", "floor", "floornumber"), ("etasje",), "whole"),
    ("byggeår", ("byggeår", "byggår", "yearbuilt", "constructionyear"), ("byggeår", "byggår", "byggeaar"), "whole"),
    ("energimerke", ("energimerke", "energimerking", "energylabel", "energyclass"), ("energimerke", "energimerking", "energi"), "text"),
    ("primærrom (m²)", ("primærrom", "primaerrom", "p-rom", "prom", "primaryroom"), ("primærrom", "p-rom", "prom"), "area"),
    ("BRA (m²)", ("bruksareal", "bra", "bra_totalt"), ("bruksareal", "bra", "bra totalt"), "area"),
    ("tomt (m²)", ("tomteareal", "tomtestørrelse", "plotarea", "lotarea", "tomt"), ("tomteareal", "tomtestørrelse", "tomt"), "area"),
    ("finn-kode", ("finnkode", "adid", "listingid", "finncode"), (), "text"),
    ("visningstidspunkter", (), ("visning", "visninger"), "showings"),
)
STREET, POSTCODE, TOWN = ("streetaddress", "addressline1"), ("postalcode", "postnumber", "zip"), ("addresslocality", "city", "town")
START, END = "from|start|fra", "to|end|til|slutt"
_ISO = r"\d{4}-\d{2}-\d{2}"


#: Sources of a field, best first, and the distance between them in the order of candidates.
JSON_OBJECT, JSON_KEY, LABEL, URL = range(4)
_RANK = 1 << 40


def clean(value: Column, kind: str, number: Column | None = None) -> Column:
    """A field's text as text: trimmed, or the digits of an amount, the first whole number, an area as a number. number: whether JSON has it as a number."""
    text, number = F.trim(value), F.lit(False) if number is None else number
    plain = F.regexp_replace(F.regexp_replace(text, "[\\u00a0 ]", ""), "(?i)kr", "")
    if kind == "money":
        return F.when(number, F.bround(text.try_cast("double")).cast("long").cast("string")).otherwise(F.nullif(F.regexp_replace(plain, "[^0-9]", ""), F.lit("")))
    if kind == "whole":
        return F.nullif(F.regexp_extract(text, r"(-?\d+)", 1), F.lit(""))
    if kind == "area":
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "m²|m2|kvm|kvadratmeter", ""), ",", "."), "[^0-9.]", "")
        whole = F.when(number, text.try_cast("double")).otherwise(F.regexp_replace(bare, r"\.(?=.*\.)", "").try_cast("double"))
        return F.when(F.abs(whole - F.round(whole)) < 1e-6, F.round(whole).cast("long").cast("string")).otherwise(whole.cast("string"))
    if kind == "showings":
        return F.when(F.contains(value, F.lit("|")), value).otherwise(F.nullif(F.array_join(showing_times(value), "|"), F.lit("")))
    return F.nullif(text, F.lit(""))


def _rows(pages: DataFrame, key: str, found: str, pairs: str) -> DataFrame:
    """One row per JSON entry and per label of each page: source, place, name (and the name without spaces), value."""
    named = [F.col("e.key").alias("name"), F.replace("e.key", F.lit(" "), F.lit("")).alias("together"), F.col("e.value").alias("value")]
    in_json = pages.select(key, F.posexplode(found).alias("pos", "e")).select(key, F.lit(JSON_KEY).alias("source"), F.col("pos").cast("long"), *named, "e.obj", "e.up", "e.depth", "e.linked", "e.number")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("obj", "int"), ("up", "string"), ("depth", "int"))]
    labels = pages.select(key, F.posexplode(pairs).alias("pos", "e")).select(key, F.lit(LABEL).alias("source"), F.col("pos").cast("long"), *named, *none, F.lit(False).alias("linked"), F.lit(False).alias("number"))
    return in_json.unionByName(labels)


def _candidates(rows: DataFrame, key: str, field: str | Column, rank: int | Column, value: Column, number: Column | None = None, place: Column | None = None) -> DataFrame:
    field, rank = F.lit(field) if isinstance(field, str) else field, F.lit(rank) if isinstance(rank, int) else rank
    order = rank.cast("long") * _RANK + (F.col("pos") if place is None else place)
    return rows.select(key, field.alias("field"), order.alias("order"), value.alias("value"), (F.lit(False) if number is None else number).alias("number"))


def _best(candidates: DataFrame, key: str) -> DataFrame:
    """key, field, value, number of the first candidate of each."""
    best = candidates.groupBy(key, "field").agg(F.min_by(F.struct("value", "number"), "order").alias("b"))
    return best.select(key, "field", "b.value", "b.number")


def _name_index(rows: DataFrame) -> DataFrame:
    """source, name, field: which fields want a name. A page's names are few and shared, so this is small beside its rows."""
    wanted = []
    for field_name, keys, labels, _ in FIELDS:
        for source, names in ((JSON_KEY, keys), (LABEL, labels)):
            if names:
                wanted.append(F.when((F.col("source") == source) & html.names_match(F.col("name"), *names), F.lit(field_name)))
    return rows.select("source", "name").distinct().select("source", "name", F.explode(F.array_compact(F.array(*wanted))).alias("field"))


def json_addresses(rows: DataFrame, key: str) -> DataFrame:
    """Candidates of "adresse": street, postcode and town of each object that names a street; of repeated keys the last counts."""
    own = rows.where((F.col("source") == JSON_KEY) & F.col("together").isin(*STREET, *POSTCODE, *TOWN)).repartition(key)
    last = lambda names: F.max_by(F.coalesce(F.trim("value"), F.lit("")), F.when(F.col("together").isin(*names), F.col("pos")))
    objects = own.groupBy(key, "obj").agg(last(STREET).alias("street"), F.nullif(last(POSTCODE), F.lit("")).alias("code"), F.nullif(last(TOWN), F.lit("")).alias("town")).where("street <> ''")
    value = F.concat_ws(", ", "street", F.nullif(F.concat_ws(" ", "code", "town"), F.lit("")))
    return _candidates(objects, key, "adresse", JSON_OBJECT, value, place=F.col("obj"))


def json_showings(rows: DataFrame, key: str) -> DataFrame:
    """Candidates of "visningstidspunkter": start/end of every object with a key of viewings or showings, from its keys that hold a date, each once."""
    at, dated = F.col("together"), F.col("value").rlike(_ISO) | F.col("number")
    own = rows.where((F.col("source") == JSON_KEY) & (at.rlike("viewing|showing") | (dated & F.col("value").isNotNull()))).repartition(key)
    when = lambda x: F.when(dated & x, F.col("pos"))
    start = F.coalesce(F.max_by("value", when(at.rlike(START))), F.min_by("value", when(~at.rlike(f"{START}|{END}"))))
    objects = own.groupBy(key, "obj").agg(F.bool_or(at.rlike("viewing|showing")).alias("shown"), start.alias("start"), F.max_by("value", when(~at.rlike(START) & at.rlike(END))).alias("end"))
    told = objects.where("shown").select(key, "obj", F.concat_ws("/", "start", "end").alias("told")).where("told <> ''")
    every = told.groupBy(key).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("obj", "told"))), lambda x: x["told"])), "|").alias("value"))
    return _candidates(every, key, "visningstidspunkter", JSON_OBJECT, F.col("value"), place=F.lit(0))


def showing_times(text: Column) -> Column:
    """Times of a text, each once; those that say there are none go."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[\n,]+"), lambda x: F.trim(x)), lambda t: (t != "") & ~F.contains(F.lower(t), F.lit("ingen"))))


def key_numbers(pages: DataFrame, key: str, found: str = "entries", pairs: str = "pairs", url: str = "url") -> DataFrame:
    """key, key_numbers (a map of field to text, null where nothing is said) of pages (entries, pairs of plain key and value, url).

    A field comes from its JSON object, else the JSON keys, else the labels, else (the listing's number) the URL; then it
    is cleaned. Rows of one key are one page; a page that says nothing has a map of nulls.
    """
    rows = staging.staged(_rows(pages, key, found, pairs), "listing-rows")
    named = rows.where("value IS NOT NULL").join(_name_index(rows), ["source", "name"])
    code = F.coalesce(urls.listing_id(F.col(url)), F.nullif(F.regexp_extract(F.col(url), r"(\d{6,})", 1), F.lit("")))
    every = (
        _candidates(named, key, F.col("field"), F.col("source"), F.col("value"), F.col("number"))
        .unionByName(json_addresses(rows, key)).unionByName(json_showings(rows, key))
        .unionByName(_candidates(pages, key, "finn-kode", URL, code, place=F.lit(0)))
    )
    kinds = {}
    for name, _, _, kind in FIELDS:
        kinds.setdefault(kind, []).append(name)
    text = clean(F.col("value"), "text")
    for kind, names in kinds.items():
        text = F.when(F.col("field").isin(*names), clean(F.col("value"), kind, F.col("number"))).otherwise(text) if kind != "text" else text
    # A page has one or two candidates of a field, so summing up before rows are dealt saves nothing: dealt by page once, they are sorted once.
    told = _best(every.repartition(key), key).select(key, F.struct("field", text.alias("value")).alias("e")).groupBy(key).agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return told.select(key, F.create_map(*(x for name, *_ in FIELDS for x in (F.lit(name), F.try_element_at("m", F.lit(name))))).alias("key_numbers"))


def _amount(text: Column) -> Column:
    """Digits before a decimal comma, rounded; points only part thousands."""
    return F.bround(F.replace(F.replace(F.regexp_replace(text, "[^0-9,.]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")).cast("long")


#: What a page's text calls a price and the shared costs.
TEXT_PRICES, TEXT_COSTS = ("Totalpris", "Prisantydning"), r"Felleskostnader|Felleskost/mnd\.?|Fellesutgifter"
MOST_ADDRESS = 80


def _in_text(names: str) -> Column:
    return _amount(F.nullif(F.regexp_extract("text", rf"(?iU)(?:{names})\s*[:\s]\s*([0-9\s.\u00a0]+)kr?", 1), F.lit(""))).cast("string")


def project(pages: DataFrame, key: str = "page_id", column: str = "html", url: str = "url") -> DataFrame:
    """A listing per page: key, source_url, image, address, total_price, hoa_month, lat, lon, area_m2, rooms.

    image: what the head names, else the first of the linked data, else the gallery's; address: the page's own, else that of
    the linked data, with a digit and of at most 80 characters; price: the first offer of the linked data that isn't zero, else
    the text's; a position needs both numbers; area and rooms: labels before text. Nothing found is null; rows of one key are one page.
    """
    read = staging.staged(html.with_listing(pages.select(key, F.col(url).alias("source_url"), F.col(column).alias("html"))), "listing-pages")
    marked = lambda name: F.col("marks")[name]
    held = lambda address: F.when(address.rlike(r"\d") & (F.length(address) <= MOST_ADDRESS), address)
    own = [("source_url", 0, F.col("source_url")), ("image", 0, marked("og:image")), ("image", 1, marked("twitter:image")), ("image", 3, marked("gallery")), ("address", 0, held(clean_address(marked("address"))))]
    own += [("total_price", 1 + i, _in_text(name)) for i, name in enumerate(TEXT_PRICES)] + [("hoa_month", 0, _in_text(TEXT_COSTS))]
    own += [("area_m2", 0, facts.area(F.col("labels"), F.col("text")).cast("string")), ("rooms", 0, facts.rooms(F.col("labels"), F.col("text")).cast("string"))]
    told = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(rank).alias("rank"), v.alias("value")) for f, rank, v in own))
    plain = read.select(key, F.explode(told).alias("c")).select(key, "c.*")
    every = _candidates(plain.where("value IS NOT NULL OR field = 'source_url'"), key, F.col("field"), F.col("rank"), F.col("value"), place=F.lit(0))

    rows = _rows(read, key, "entries", "pairs").where("linked AND value IS NOT NULL")
    at = lambda depth, up, *names: (F.col("depth") == depth) & (F.col("up") == up if up else F.lit(True)) & F.col("together").isin(*names)
    rows = rows.where(at(1, "", "image") | at(2, "address", "streetaddress", "postalcode", "addresslocality") | at(2, "offers", "price") | at(3, "pricespecification", "price") | at(2, "geo", "latitude", "longitude"))
    pick = lambda up, name: F.max(F.when(at(2, up, name), F.trim("value")))
    objects = rows.where("depth = 2 AND up <> 'offers'").groupBy(key, "obj").agg(*(pick(u, n).alias(n) for u, n in (("address", "streetaddress"), ("address", "postalcode"), ("address", "addresslocality"), ("geo", "latitude"), ("geo", "longitude"))))
    street, code, town = (F.nullif(F.col(c), F.lit("")) for c in ("streetaddress", "postalcode", "addresslocality"))
    address = held(clean_address(F.coalesce(F.concat(street, F.lit(", "), code, F.lit(" "), town), street, town)))
    degrees = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double").cast("string")
    lat, lon = degrees(F.col("latitude")), degrees(F.col("longitude"))
    price = _amount(F.col("value"))
    for found in (
        _candidates(rows.where(at(1, "", "image") & ~F.col("number")), key, "image", 2, F.col("value")),
        _candidates(objects.where(address.isNotNull()), key, "address", 1, address, place=F.col("obj")),
        _candidates(rows.where(F.col("up").isin("offers", "pricespecification") & (price != 0)), key, "total_price", 0, price.cast("string")),
        _candidates(objects.where(lat.isNotNull() & lon.isNotNull()), key, "position", 0, F.concat_ws(" ", lat, lon), place=F.col("obj")),
    ):
        every = every.unionByName(found)
    best = _best(every, key)
    of = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
    names = ("source_url", "image", "address", "total_price", "hoa_month", "position", "area_m2", "rooms")
    wide = best.groupBy(key).agg(*(of(n).alias(n) for n in names))
    part = lambda i: F.split("position", " ")[i].cast("double")
    return wide.select(
        key, "source_url", "image", "address", F.col("total_price").cast("long").alias("total_price"), F.col("hoa_month").cast("long").alias("hoa_month"), part(0).alias("lat"), part(1).alias("lon"),
        F.col("area_m2").cast("double").alias("area_m2"), F.col("rooms").cast("int").alias("rooms"),
    )


def has_any_number(values: Column) -> Column:
    """Whether any key number is there."""
    return F.exists(F.map_values(values), lambda v: v.isNotNull() & (v != ""))


def clean_address(text: Column) -> Column:
    """Without the map's caption before and the price's after it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s*Kart\s+", "")), r"(?i)\s+(Prisantydning|Totalpris)\s*$", ""))


def enriched(listings: DataFrame, values: str = "key_numbers") -> DataFrame:
    """listings (total_price, hoa_month, key_numbers): key numbers fill a price or shared cost that is missing (zero is there).

    A price that reads as 0 doesn't count; a shared cost of 0 does. used_price and used_hoa say what was filled.
    """
    at = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(F.col(values), F.lit(n)), F.lit("")) for n in names))
    price = numbers.whole(F.coalesce(F.nullif(at("totalpris"), F.lit("0")), at("prisantydning")))
    hoa_text = at("felleskostnader")
    fill_price, fill_hoa = numbers.is_missing(F.col("total_price")) & (price > 0), numbers.is_missing(F.col("hoa_month")) & hoa_text.isNotNull()
    return listings.withColumns({
        "total_price": F.when(fill_price, price).otherwise(F.col("total_price")), "hoa_month": F.when(fill_hoa, numbers.whole(hoa_text)).otherwise(F.col("hoa_month")),
        "used_price": fill_price, "used_hoa": fill_hoa,
    })


def document_source(requests: DataFrame, cache: DataFrame, files: DataFrame, links: DataFrame, key: str = "analysis_id") -> DataFrame:
    """requests with source and remote_url: the cached URL, else the local file, else the stable or original URL (for ids of digits)."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = requests.join(cache.select(key, text(F.col("pdf_url")).alias("_cached")), key, "left").join(files.select(key, F.col("path").alias("_file")), key, "left")
    out = out.join(links.select(key, F.coalesce(text(F.col("stable_pdf_url")), text(F.col("original_pdf_url"))).alias("_link")), key, "left")
    link = F.when(F.col(key).cast("string").rlike("^[0-9]+$"), F.col("_link"))
    return out.withColumns({"source": F.coalesce("_cached", "_file", link), "remote_url": F.coalesce("_cached", link)}).drop("_cached", "_file", "_link")


def listing_url(payload_url: Column, code: Column) -> Column:
    """The job's own URL, else a code that is one, else the address of the listing with that code."""
    plain = F.trim(code)
    return F.coalesce(F.nullif(payload_url, F.lit("")), F.when(F.startswith(plain, F.lit("http")), plain), F.concat(F.lit("https://www.finn.no/realestate/homes/ad.html?finnkode="), plain))
