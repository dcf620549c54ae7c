"""Typed key facts of a listing from its label-value pairs (array of label, value, pos)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers, texts

#: Key, words of a label, words that rule it out, group, order, kind. A spec takes the first label left that fits.
SPECS = (
    ("total_price", ("totalpris",), (), "Kostnader", 10, "money"),
    ("asking_price", ("prisantydning",), (), "Kostnader", 20, "money"),
    ("costs", ("omkostninger",), (), "Kostnader", 30, "money"),
    ("hoa_month", ("felleskostnader", "felleskost/mnd", "fellesutgifter"), (), "Kostnader", 40, "money"),
    ("tax_value", ("formuesverdi",), (), "Kostnader", 50, "money"),
    ("property_type", ("boligtype", "type bolig"), (), "Bolig", 100, "text"),
    ("ownership_type", ("eieform",), (), "Bolig", 110, "text"),
    ("rooms", ("rom", "antall rom"), ("soverom",), "Planløsning", 200, "money"),
    ("bedrooms", ("soverom", "antall soverom"), (), "Planløsning", 210, "money"),
    ("internal_bra_m2", ("internt bruksareal", "bra-i", "bra i"), (), "Areal", 300, "area"),
    ("primary_room_m2", ("primærrom", "p-rom", "prom", "p rom"), (), "Areal", 310, "area"),
    ("bra_m2", ("bruksareal", "bra totalt", "bra total", "bra"), ("internt",), "Areal", 320, "area"),
    ("external_bra_m2", ("eksternt bruksareal", "bra-e", "bra e"), (), "Areal", 330, "area"),
    ("balcony_terrace_m2", ("balkong/terrasse", "balkong", "terrasse"), (), "Areal", 340, "area"),
    ("plot_area_m2", ("tomteareal", "tomtestørrelse", "tomt"), (), "Tomt", 400, "area"),
    ("floor", ("etasje",), (), "Bygg", 500, "money"),
    ("built_year", ("byggeår", "byggår", "byggeaar"), (), "Bygg", 510, "money"),
    ("energy_label", ("energimerking", "energi", "energikarakter"), (), "Bygg", 520, "text"),
)
OTHER_ORDER = 1000
_SPEC = "array<struct<key:string,include:array<string>,exclude:array<string>,grp:string,ord:int,kind:string>>"
_FACT = "array<struct<key:string,label:string,value_str:string,value_num:double,grp:string,ord:int>>"


def _value(text: Column, kind: Column) -> Column:
    return F.when(kind == "money", numbers.currency(text).cast("double")).when(kind == "area", numbers.area(text))


def key_facts(pairs: Column, specs: tuple = SPECS) -> Column:
    """Array of (key, label, value_str, value_num, grp, ord), in order: the specs' facts, then the labels that none took.

    A number that can't be read leaves the text as the value; a repeated key gets _2, _3 and so on.
    """
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, i)).alias("include"), F.array(*map(F.lit, e)).cast("array<string>").alias("exclude"), F.lit(g).alias("grp"), F.lit(o).alias("ord"), F.lit(n).alias("kind")) for k, i, e, g, o, n in specs)).cast(_SPEC)
    start = F.struct(pairs.cast("array<struct<label:string,value:string,pos:int>>").alias("left"), F.array().cast(_FACT).alias("facts"))

    def take(s: Column, spec: Column) -> Column:
        fits = lambda a: F.exists(spec["include"], lambda w: F.contains(F.lower(F.trim(a["label"])), w)) & ~F.exists(spec["exclude"], lambda w: F.contains(F.lower(F.trim(a["label"])), w))
        hit = F.slice(F.filter(s["left"], fits), 1, 1)
        fact = F.transform(hit, lambda a: F.struct(spec["key"].alias("key"), a["label"].alias("label"), F.when(_value(F.trim(a["value"]), spec["kind"]).isNull(), F.trim(a["value"])).alias("value_str"), _value(F.trim(a["value"]), spec["kind"]).alias("value_num"), spec["grp"].alias("grp"), spec["ord"].alias("ord")))
        return F.struct(F.array_except(s["left"], hit).alias("left"), F.concat(s["facts"], fact).cast(_FACT).alias("facts"))

    def finish(s: Column) -> Column:
        other = F.filter(s["left"], lambda a: F.trim(a["value"]) != "")
        slugs = F.transform(other, lambda a: texts.slug(a["label"]))
        none = F.lit(None)

        def one(a: Column, i: Column) -> Column:
            slug = texts.slug(a["label"])
            before = F.size(F.filter(F.slice(slugs, F.lit(1), i), lambda k: k == slug)) + F.size(F.filter(s["facts"], lambda f: f["key"] == slug))
            key = F.when(before > 0, F.concat(slug, F.lit("_"), (before + 1).cast("string"))).otherwise(slug)
            return F.struct(key.alias("key"), a["label"].alias("label"), F.trim(a["value"]).alias("value_str"), none.cast("double").alias("value_num"), none.cast("string").alias("grp"), (F.lit(OTHER_ORDER) + i).alias("ord"))

        return F.concat(s["facts"], F.transform(other, one).cast(_FACT))

    return F.aggregate(rows, start, take, finish)


def _words(label: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(label), r"(?U)[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _first(pairs: Column, fits, value) -> Column:
    """The first readable value among the pairs that fit."""
    return F.try_element_at(F.filter(F.transform(F.filter(pairs, fits), lambda a: value(a["value"])), lambda v: v.isNotNull()), F.lit(1))


def rooms(pairs: Column, text: Column) -> Column:
    """Rooms by whole words of a label, all rooms before bedrooms; else a number after the word in the text."""
    number = lambda v: F.nullif(F.regexp_extract(v, r"(\d+)", 1), F.lit("")).cast("int")
    named = lambda w: lambda a: F.contains(_words(a["label"]), F.lit(f" {w} "))
    found = [_first(pairs, named(w), number) for w in ("rom", "antall rom", "soverom", "antall soverom")]
    return F.coalesce(*found, F.nullif(F.regexp_extract(text, r"(?iU)(?:soverom|rom)\D{0,10}(\d+)", 1), F.lit("")).cast("int"))


def area(pairs: Column, text: Column) -> Column:
    """Usable area before primary rooms before any area, from the labels; else from the text; else its first area."""
    kinds = (("bruksareal", "bra"), ("primærrom", "p-rom", "prom", "p rom"), ("boligareal", "areal"))
    read = lambda v: F.nullif(numbers.area(v), F.lit(0.0))
    named = lambda w: lambda a: F.contains(F.lower(F.trim(a["label"])), F.lit(w))
    labelled = [_first(pairs, named(w), read) for words in kinds for w in words]
    near = [numbers.decimal(F.nullif(F.regexp_extract(text, rf"(?iU){w}[^0-9]{{0,40}}(\d+(?:[.,]\d+)?)\s*(?:m²|m2|m\^2|kvm)", 1), F.lit("")), None) for words in kinds for w in words]
    return F.coalesce(*labelled, *near, numbers.area(text))


def showings(text: Column) -> Column:
    """The showings of a text, each once; those that say there are none go."""
    parts = F.transform(F.split(text, r"[\n,]+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & ~F.contains(_words(p), F.lit("ingen"))))


def lookup(pairs: Column, *labels: str) -> Column:
    """The value of the first pair whose label, letters and digits only, holds one of the labels or all its words."""
    plain = lambda s: F.regexp_replace(F.lower(s), r"(?U)[^\p{L}\p{N}]", "")

    def fits(a: Column) -> Column:
        hit = F.lit(False)
        for name in labels:
            hit = hit | F.contains(plain(a["label"]), F.lit("".join(c for c in name.lower() if c.isalnum())))
            hit = hit | (F.size(F.array_except(F.array(*map(F.lit, name.lower().split())), F.split(F.trim(_words(a["label"])), " "))) == 0)
        return (plain(a["label"]) != "") & hit

    return F.try_element_at(F.filter(pairs, fits), F.lit(1))["value"]


def fill_missing(value: Column, found: Column) -> Column:
    """value unless it is missing (null or blank; zero is there), then found."""
    return F.when(numbers.is_missing(value), found).otherwise(value)


def energy_tone(label: Column) -> Column:
    letter = F.upper(F.regexp_extract(label, r"(?i)\b([A-G])\b", 1))
    return F.when(letter.isin("A", "B"), "good").when(letter.isin("C", "D"), "medium").when(letter.isin("E", "F", "G"), "poor").otherwise("unknown")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _typed(value: Column) -> Column:
    """A struct of a variant's value, kind, and text if it is text, computed once however often they are named."""
    read = lambda k: F.struct(value.alias("value"), k.alias("kind"), F.when(k == "STRING", F.try_variant_get(value, "$", "string")).alias("text"))
    return F.when(value.isNotNull(), texts.let(_kind(value), read))


def _number(field: Column, of_text) -> Column:
    """A field as a double: a number, or text that of_text reads."""
    number = F.when(field["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(field["value"], "$", "double"))
    return F.coalesce(number, of_text(field["text"]))


def _records(raw: Column, names: tuple[str, ...], fact, keep, order) -> Column:
    """fact of each object in a JSON array (text) that keep holds, by order and place; order (by, told) is of its fields and place, fact of its fields and what order told. What is no array gives no fact."""
    fields = f"array<struct<{','.join(f'{n}:variant' for n in names)}>>"
    items = F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", fields), F.array().cast(fields))

    def each(r: Column, i: Column) -> Column:
        found = lambda f: texts.let(order(f, i), lambda by: F.struct(by["by"].alias("by"), i.alias("at"), fact(f, by["told"]).alias("fact")))
        return F.when(r.isNotNull(), texts.let(F.struct(*(_typed(r[n]).alias(n) for n in names)), found))

    # Variants can't be compared; the facts hold none.
    return F.transform(F.array_sort(F.filter(F.transform(items, each), lambda x: x.isNotNull() & keep(x["fact"]))), lambda x: x["fact"])


def saved_facts(raw: Column) -> Column:
    """Array of (key, label, value, grp, ord) from the JSON array (text) of a saved listing's facts.

    A fact has its key under key, id or slug, its label under label or name, else it is the key; its value is the first
    there is of value, amount and displayValue, a JSON null included, as text or JSON. Facts without a key go; those
    without a readable order come where 1000 is, ties in their own order.
    """
    filled = lambda t: F.when(F.trim(t) != "", F.trim(t))
    trimmed = lambda t: filled(F.when(t.rlike(r"(?U)^\s|\s\z"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t))
    some = lambda f, *names: F.coalesce(*(trimmed(f[n]["text"]) for n in names))

    def fact(f: Column, number: Column) -> Column:
        found = F.coalesce(*(F.when(f[n]["value"].isNotNull(), f[n]) for n in ("value", "amount", "displayValue")))
        value = lambda v: F.when(v["kind"] != "VOID", F.coalesce(v["text"], F.to_json(v["value"])))
        made = lambda key: F.struct(key.alias("key"), F.coalesce(some(f, "label", "name"), key).alias("label"), texts.let(found, value).alias("value"), some(f, "group").alias("grp"), number.alias("ord"))
        return texts.let(some(f, "key", "id", "slug"), made)

    order = lambda f, i: texts.let(_number(f["order"], numbers.optional_decimal), lambda n: F.struct(F.coalesce(n, F.lit(1000.0)).alias("by"), n.alias("told")))
    names = ("key", "id", "slug", "label", "name", "group", "order", "value", "amount", "displayValue")
    return _records(raw, names, fact, lambda f: f["key"].isNotNull(), order)


def saved_pairs(raw: Column) -> Column:
    """Array of (label, value, ord) from the JSON array (text) of a saved listing's label-value pairs.

    Both are text and not empty, or the pair goes; order is a number or text of one (blank text is 0), else the place.
    """
    plain = lambda t: F.when(F.trim(t) == "", F.lit(0.0)).otherwise(numbers.double(F.trim(t)))

    def order(f: Column, i: Column) -> Column:
        held = lambda n: texts.let(F.when(F.abs(n) < float("inf"), n).otherwise(i.cast("double")), lambda by: F.struct(by.alias("by"), by.alias("told")))
        return texts.let(_number(f["order"], plain), held)

    fact = lambda f, number: F.struct(f["label"]["text"].alias("label"), f["value"]["text"].alias("value"), number.alias("ord"))
    return _records(raw, ("label", "value", "order"), fact, lambda f: (F.length(f["label"]) > 0) & (F.length(f["value"]) > 0), order)
