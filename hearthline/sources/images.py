"""Images of listings, harvested from the JSON in a page's scripts and from its text, by JVM expressions alone.

JSON is walked level by level: each round opens the objects and arrays found by the one before, one row per child, and
carries the child's place, so that reading order survives without recursion. Keys with a blocked word end a branch.
A round's rows are written before the next, every round's text is shorter, and the loop ends when nothing is nested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts, web
from .staging import staged

# Words of keys that lead to images, words that end a branch or a URL, and segments of a path that don't tell images apart.
KEYS = ("image", "images", "media", "carousel", "gallery", "photo", "photos", "url")
BLOCKED = (
    "logo", "ikon", "icon", "placeholder", "map", "kart", "floorplan", "plantegning", "fpa", "document", "doc", "pdf", "brochure", "diagram", "overlay", "badge", "avatar", "profile", "video",
    "thumb", "megler", "proff", "ansatt", "agent", "portrait", "portrett", "team", "staff", "profil", "employee", "human", "person", "people", "nav",
)
PLAIN_SEGMENTS = ("original", "full", "fullsize", "master", "scaled", "scale", "web", "desktop", "mobile", "widescreen", "optimized", "variant", "quality")
TYPES = "jpe?g|png|webp|avif|gif"
LEAST_JSON = 10

_LINKED = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
_URL = rf"""(?i)https?://[^"'\s]+\.(?:{TYPES})(?:[?#][^"'\s]*)?"""
_SIZE = r"(?i)^(?:\d{1,4}(?:x|w)?|w\d{1,4}|h\d{1,4}|c\d{1,4}|s\d{1,4}|q\d{1,4}|m\d{1,4}|xs|sm|md|lg)$"
#: A JSON value and the place where it stands: phase (linked data, other scripts, text), then the child's number at each level.
_PLACED = ["phase", "path", "value"]


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def scripts(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """key, phase, path, value: the JSON documents in scripts, the linked data first; an assignment to window around one goes."""
    own = F.trim(F.col("raw"))
    linked = pages.select(key, F.lit(0).alias("phase"), F.posexplode(F.regexp_extract_all(column, F.lit(_LINKED), F.lit(1))).alias("i", "raw")).withColumn("value", own)
    bare = F.regexp_replace(F.regexp_replace(own, r"^window\.[^=]+\s*=\s*", ""), r";\s*$", "")
    other = pages.select(key, F.lit(1).alias("phase"), F.posexplode(F.regexp_extract_all(column, F.lit(_SCRIPT), F.lit(1))).alias("i", "raw"))
    other = other.where(~F.contains("raw", F.lit("<")) & F.contains("raw", F.lit("{")) | own.rlike(r"^\[")).withColumn("value", bare).where(F.length("value") >= LEAST_JSON)
    return linked.unionByName(other).where(F.try_parse_json("value").isNotNull()).select(key, "phase", F.array("i").alias("path"), "value")


def children(nodes: DataFrame, key: str) -> DataFrame:
    """key, phase, path, name, kind, value of each child of objects and arrays: its key (null in arrays), the first character of its JSON, and its text."""
    is_object = F.startswith("value", F.lit("{"))
    read = lambda kind: (F.from_json("value", f"map<string,{kind}>"), F.from_json("value", f"array<{kind}>"))
    (texts, items), (values, parts) = read("string"), read("variant")
    opened = F.when(is_object, F.arrays_zip(F.map_keys(texts).alias("name"), F.map_values(texts).alias("value"), F.transform(F.map_values(values), _kind).alias("kind")))
    none = F.transform(items, lambda x: F.lit(None).cast("string"))
    opened = opened.otherwise(F.arrays_zip(none.alias("name"), items.alias("value"), F.transform(parts, _kind).alias("kind")))
    return nodes.select(key, "phase", "path", F.posexplode(opened).alias("i", "c")).select(key, "phase", F.concat("path", F.array("i")).alias("path"), "c.name", "c.kind", "c.value")


def _kind(value: Column) -> Column:
    return F.left(F.to_json(value), F.lit(1))


def json_strings(documents: DataFrame, key: str) -> DataFrame:
    """key, phase, path, value: strings in arrays, or under a key with a word of KEYS, outside branches under a BLOCKED word."""
    name = F.lower("name")
    nested, found = documents.where(F.left(F.trim("value"), F.lit(1)).isin("{", "[")), []
    roots = documents.where(F.startswith("value", F.lit('"'))).select(key, "phase", "path", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias("value"))
    while True:
        level = staged(children(nested, key).where(F.col("name").isNull() | ~_any(name, BLOCKED)), "json-level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found, roots)
        found.append(level.where((F.col("kind") == '"') & (F.col("name").isNull() | _any(name, KEYS))).select(key, *_PLACED))
        nested = level.where(F.col("kind").isin("{", "[")).select(key, *_PLACED)


def normal_url(value: Column) -> Column:
    """An image's URL without query and fragment, https where none is named; null if it isn't a photo of a listing."""
    text = F.replace(F.trim(value), F.lit("&amp;"), F.lit("&"))
    whole = texts.let(text, lambda t: F.when(F.startswith(t, F.lit("//")), F.concat(F.lit("https:"), t)).otherwise(t))
    root = "(?i)^(https?://[^/?#]+)"

    def parts(t: Column) -> Column:
        return F.struct(t.alias("t"), F.lower(F.regexp_extract(t, root, 1)).alias("host"), F.regexp_extract(t, root + "([^?#]*)", 2).alias("path"))

    def shown(p: Column) -> Column:
        typed = p["t"].rlike(rf"(?i)^https?://[^#]*\.(?:{TYPES})(?:[?#].*)?$") & (p["host"] != "")
        return F.when(typed & ~_any(F.lower(p["path"]), BLOCKED), F.concat(p["host"], p["path"]))

    return texts.let(texts.let(texts.let(whole, parts), shown), lambda url: F.when(web.listing_image(url), url))


def identity(url: Column) -> Column:
    """(key, width): host, folder and name of the picture without sizes, versions and ending, and the width that follows "dynamic"; key null without a path."""
    path = F.url_decode(F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]*", ""), r"\+", "%2B"))
    wide = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r"(\d{2,4})", 1), F.lit("")).cast("int"), F.lit(0))

    def said(segments: Column) -> Column:
        after = lambda i: (i > 0) & (F.lower(F.get(segments, i - 1)) == "dynamic")
        width = F.array_max(F.transform(segments, lambda s, i: F.when(after(i), wide(s)).otherwise(0)))
        size = lambda s, i: F.coalesce(after(i) & s.rlike(r"(?i)^(?:\d+[xw]?|w\d+)$"), F.lit(False))
        kept = F.filter(segments, lambda s, i: ~(F.lower(s).isin("dynamic", *PLAIN_SEGMENTS) | size(s, i) | s.rlike(_SIZE)))
        return F.struct(width.alias("width"), F.try_element_at(kept, F.lit(-1)).alias("name"), F.lower(F.try_element_at(kept, F.lit(-2))).alias("folder"))

    def named(s: Column) -> Column:
        base = texts.let(F.regexp_replace(F.lower(s["name"]), r"^(.+)\.[^.]*$", "$1"), lambda b: F.coalesce(F.nullif(F.regexp_replace(b, r"(?i)[-_](?:\d{1,2}|[a-f0-9]{1,4})$", ""), F.lit("")), b))
        key = F.when(s["name"].isNotNull(), F.concat_ws("/", F.regexp_extract(url, "^https?://([^/:]*)", 1), s["folder"], base))
        return F.struct(key.alias("key"), F.coalesce(s["width"], F.lit(0)).alias("width"))

    return texts.let(texts.let(F.filter(F.split(path, "/"), lambda x: x != ""), said), named)


def gallery(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, pos, url: each picture of a page once, at its widest, in the order of first sight: linked data, other scripts, then URLs anywhere in the page.

    Malformed JSON, and JSON that repeats a key in one object, is skipped. Rows of one key are one page; a page without pictures has no row.
    """
    in_json = json_strings(scripts(pages, key, column), key)
    anywhere = pages.select(key, F.lit(2).alias("phase"), F.posexplode(F.regexp_extract_all(column, F.lit(_URL), F.lit(0))).alias("i", "value")).select(key, "phase", F.array("i").alias("path"), "value")
    seen = in_json.unionByName(anywhere).withColumn("url", normal_url(F.col("value"))).where("url IS NOT NULL").withColumn("id", identity(F.col("url"))).where("id.key IS NOT NULL")
    place = F.struct("phase", "path")
    best = seen.groupBy(key, F.col("id.key").alias("picture")).agg(F.min(place).alias("first"), F.min_by("url", F.struct(-F.col("id.width"), "phase", "path")).alias("url"))
    listed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "picture", "url"))).alias("all"))
    return listed.select(key, F.posexplode("all").alias("pos", "p")).select(key, "pos", "p.url")
