"""URLs as columns: parts, cleaning, origin, ids, and link scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import let

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# Words that make a link likely or unlikely to be a sales prospectus, and the points they give.
STRONG = ("salgsoppgave", "komplett salgsoppgave", "prospekt", "salgsprospekt", "salgspresentasjon", "for utskrift", "utskrift", "digitalformat", "last ned pdf", "se pdf")
WEAK = ("pdf",)
NEGATIVE = (
    "tilstandsrapport", "boligsalgsrapport", "byggteknisk", "fidens", "egenerkl", "egenerklæring", "energiattest", "epc", "nabolag", "nabolagsprofil", "nordvikunders",
    "anticimex", "boligkjøperforsikring", "prisliste", "/files/doc/", "garanti.no/files/doc", "contentassets/nabolaget", "budskjema", "samtykke", "planinfo", "tegning",
    "seksjon", "kart", "situasjonsplan", "kommunal", "gebyr", "avgift", "skatt",
)


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 network location, 3 path, 4 query; empty if absent."""
    return F.regexp_extract(url, _PARTS, n)


def query_pairs(query: Column) -> Column:
    """Array of (k, v), decoded: the first non-empty value of each key, in order of the keys."""
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    split = F.transform(F.split(query, "&"), lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, F.lit("=")) + 1)).otherwise("")).alias("v")))
    full = F.filter(split, lambda p: p["v"] != "")
    keys = F.transform(full, lambda p: p["k"])
    return F.filter(full, lambda p, i: F.array_position(keys, p["k"]) == i + 1)


def _is_tracking(key: Column) -> Column:
    return F.startswith(key, F.lit("utm_")) | key.isin("gclid", "fbclid")


def clean_url(url: Column) -> Column:
    """Without tracking parameters and fragment; escaped slashes undone."""
    u = F.replace(url, F.lit("\\/"), F.lit("/"))
    parts = F.struct(part(u, 1).alias("scheme"), part(u, 2).alias("host"), part(u, 3).alias("path"), part(u, 4).alias("query"))

    def joined(p: Column) -> Column:
        kept = F.filter(query_pairs(p["query"]), lambda q: ~_is_tracking(q["k"]))
        query = F.array_join(F.transform(kept, lambda q: F.concat(q["k"], F.lit("="), q["v"])), "&")
        head = F.concat(F.when(p["scheme"] != "", F.concat(F.lower(p["scheme"]), F.lit(":"))).otherwise(""), F.when(p["host"] != "", F.concat(F.lit("//"), p["host"])).otherwise(""))
        return F.concat(head, p["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))

    return F.when(url.isNotNull(), let(parts, joined))


def clean_if_tracked(url: Column) -> Column:
    """The variant that leaves a URL as it is, fragment included, if there is nothing to drop."""
    tracked = F.exists(query_pairs(part(url, 4)), lambda p: _is_tracking(p["k"]))
    return F.when(tracked, clean_url(url)).otherwise(url)


def origin(url: Column) -> Column:
    scheme, host = part(url, 1), part(url, 2)
    return F.when((scheme != "") & (host != ""), F.concat(F.lower(scheme), F.lit("://"), host)).otherwise("")


def absolute(base: Column, href: Column) -> Column:
    """href seen from base, for the forms that pages use: absolute, //host, /path, ?query, #fragment and relative paths."""
    parts = F.struct(F.lower(part(base, 1)).alias("scheme"), origin(base).alias("origin"), part(base, 3).alias("path"), part(base, 4).alias("query"), part(href, 1).alias("own"), href.alias("href"))

    def seen(p: Column) -> Column:
        folder = F.regexp_replace(p["path"], "[^/]*$", "")
        query = F.when(F.startswith(p["href"], F.lit("#")) & (p["query"] != ""), F.concat(F.lit("?"), p["query"])).otherwise("")
        return (
            F.when(p["own"] != "", p["href"])
            .when(F.startswith(p["href"], F.lit("//")), F.concat(p["scheme"], F.lit(":"), p["href"]))
            .when(F.startswith(p["href"], F.lit("/")), F.concat(p["origin"], p["href"]))
            .when(p["href"].rlike("^[?#]"), F.concat(p["origin"], p["path"], query, p["href"]))
            .otherwise(F.concat(p["origin"], F.when(folder == "", "/").otherwise(folder), F.regexp_replace(p["href"], r"^\./", "")))
        )

    return F.when(href.isNotNull() & (href != ""), let(parts, seen))


def listing_id(url: Column, name: str = "finnkode", digits: int = 6) -> Column:
    """The id parameter, else the first long run of digits in the path, else null."""
    named = F.try_element_at(F.filter(query_pairs(part(url, 4)), lambda p: p["k"] == name), F.lit(1))["v"]
    return F.coalesce(named, F.nullif(F.regexp_extract(part(url, 3), rf"(\d{{{digits},}})", 1), F.lit("")))


def _count(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def link_score(href: Column, text: Column, strong: tuple[str, ...] = STRONG, weak: tuple[str, ...] = WEAK, negative: tuple[str, ...] = NEGATIVE, suffix: str = ".pdf") -> Column:
    low = F.lower(F.concat_ws(" ", href, text))
    return F.contains(low, F.lit(suffix)).cast("int") * 8 + _count(low, strong) * 10 + _count(low, weak) * 2 - _count(low, negative) * 30


def raw_link_score(url: Column, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """For URLs found in raw HTML: any negative word outweighs the rest."""
    low = F.lower(url)
    return low.rlike("salgsoppgav|prospekt").cast("int") * 50 + F.contains(low, F.lit(".pdf")).cast("int") * 10 - (_count(low, negative) > 0).cast("int") * 100


def is_pdf(url: Column) -> Column:
    return url.rlike(r"(?i)\.pdf(?:$|\?)")


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def looks_like_pdf(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit(b"%PDF-")), F.lit(False))
