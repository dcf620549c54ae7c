"""Market rent: city and district resolution through small dimension tables, then a price per square metre.

Dimensions (cities, postcode ranges, price tables) are joined on equal keys, ranges through blocks of numbers; Spark
broadcasts what is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..sources import staging

# Names, ranges and prices that results depend on.
OPEN_ZONES = ("Hele landet", "Store tettsteder", "Mellomstore tettsteder", "Små tettsteder/spredt")
SEGMENTS = ("hybel", "liten", "standard", "stor")
SEGMENT_FACTOR = {"hybel": 1.10, "liten": 1.05, "standard": 1.00, "stor": 0.92}
BASELINE = {
    "Hele landet": 260.0,
    "Oslo": 400.0,
    "Bergen": 250.0,
    "Trondheim": 280.0,
    "Stavanger": 270.0,
    "Tromsø": 290.0,
    "Kristiansand": 260.0,
    "Drammen": 270.0,
    "Fredrikstad": 250.0,
    "Sarpsborg": 230.0,
    "Skien": 240.0,
    "Porsgrunn": 240.0,
    "Sandnes": 260.0,
    "Ålesund": 250.0,
    "Haugesund": 240.0,
}
CITY_NEEDLES = (
    ("oslo", "Oslo"),
    ("bergen", "Bergen"),
    ("trondheim", "Trondheim"),
    ("stavanger", "Stavanger"),
    ("tromsø", "Tromsø"),
    ("tromso", "Tromsø"),
    ("kristiansand", "Kristiansand"),
    ("drammen", "Drammen"),
    ("fredrikstad", "Fredrikstad"),
    ("sarpsborg", "Sarpsborg"),
    ("skien", "Skien"),
    ("porsgrunn", "Porsgrunn"),
    ("sandnes", "Sandnes"),
    ("ålesund", "Ålesund"),
    ("alesund", "Ålesund"),
    ("haugesund", "Haugesund"),
)
CITY_RANGES = (
    (1, 1299, "Oslo"),
    (4000, 4099, "Stavanger"),
    (4300, 4399, "Sandnes"),
    (5003, 5299, "Bergen"),
    (5500, 5599, "Haugesund"),
    (6000, 6099, "Ålesund"),
    (7000, 7099, "Trondheim"),
    (9000, 9099, "Tromsø"),
    (1600, 1699, "Fredrikstad"),
    (1700, 1799, "Sarpsborg"),
    (3000, 3099, "Drammen"),
    (3700, 3799, "Skien"),
    (3900, 3999, "Porsgrunn"),
    (4600, 4699, "Kristiansand"),
)
#: The first range that fits counts, so "nord" is never reached by postcode.
BERGEN_RANGES = (
    (5003, 5050, "Bergen sentrum"),
    (5051, 5159, "Bergen sør"),
    (5100, 5139, "Bergen nord"),
    (5160, 5179, "Bergen vest"),
    (5260, 5269, "Bergen øst"),
    (5200, 5299, "Bergen sør"),
)
BERGEN_WORDS = (
    ("Bergen sentrum", ("sentrum", "bergenhus", "nøstet", "møhlenpris", "marken", "torgallmenningen", "verftet", "nordnes", "engens", "nygårdshøyden", "sydnes", "strandkaien")),
    ("Bergen vest", ("laksevåg", "loddefjord", "godvik", "melkeplassen", "damsgård", "fyllingsdalen", "kråkenes", "lyngbø", "gravdal", "vadmyra", "olsvik")),
    ("Bergen sør", ("årstad", "minde", "landås", "kronstad", "solheim", "danmarksplass", "wergeland", "fana", "ytrebygda", "nesttun", "paradis", "sandsli", "kokstad", "flesland", "nattland", "smørås")),
    ("Bergen nord", ("åsane", "eidsvåg", "toppe", "tellevik", "salhus", "myrdal")),
    ("Bergen øst", ("arna", "indre arna", "ytre arna", "espeland", "haukeland")),
)
OSLO_CENTRE = ("gamle oslo", "grünerløkka", "grunerloekka", "sagene", "st. hanshaugen", "st hanshaugen", "sentrum")
OSLO_WEST = ("frogner", "ullern", "vestre aker", "nordre aker")
WITH_DISTRICTS = ("Bergen", "Oslo")
BY_POINT, BY_TEXT, BY_CITY, WITH_RATIO, BY_BENCHMARK = 0.90, 0.70, 0.50, 0.85, 0.80
YEARLY_ABOVE, STEP = 1500.0, 100
#: Statistics zones; those without a city of their own keep their name.
ZONES = (
    ("00", "Hele landet", "Hele landet"),
    ("01", "Oslo og Bærum kommune", "Oslo"),
    ("02", "Akershus utenom Bærum kommune", "Akershus"),
    ("03", "Trondheim kommune", "Trondheim"),
    ("04", "Bergen kommune", "Bergen"),
    ("05", "Stavanger kommune", "Stavanger"),
    ("20", "Store tettsteder", "Store tettsteder"),
    ("21", "Mellomstore tettsteder", "Mellomstore tettsteder"),
    ("22", "Små tettsteder/spredt", "Små tettsteder/spredt"),
)


def segment(area: Column, rooms: Column) -> Column:
    """Ordered rules: rooms <= 1 is a studio whatever the area, and two rooms are small even at 120 m2."""
    a = F.coalesce(area.cast("double"), F.lit(0.0))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(((a > 0) & (a < 30)) | is_(rooms <= 1), "hybel").when(a.between(30, 50) | is_(rooms == 2), "liten")
        .when(((a > 50) & (a <= 90)) | is_(rooms == 3), "standard").when((a > 90) | is_(rooms >= 4), "stor").otherwise("standard")
    )


def postcode(address: Column) -> Column:
    """The first free-standing four digits."""
    return F.nullif(F.regexp_extract(address.cast("string"), r"(?U)\b(\d{4})\b", 1), F.lit("")).cast("int")


def canonical_city(name: Column) -> Column:
    """The table's spelling of a city; unknown names are trimmed."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r" kommune$", "")
    known = F.create_map(*(F.lit(x) for pair in dict(CITY_NEEDLES).items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.trim(plain)), F.trim(name))


def zone_city(name: Column) -> Column:
    """The statistics bureau's spelling: the table's cities, and the zones that aren't cities."""
    plain = F.lower(F.trim(name))
    known = F.create_map(*(F.lit(x) for pair in {**dict(CITY_NEEDLES), **{z.lower(): z for z in OPEN_ZONES}}.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), F.trim(name))


def labelled_city(zones: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """zones with city, by a table of labels; zones whose label it lacks go."""
    return zones.join(labels.select(label, "city"), label)


def _first_range(value: Column, ranges: tuple[tuple[int, int, str], ...]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for low, high, name in ranges:
        out = out.when(value.between(low, high), name)
    return out


def guess_city(*parts: Column) -> Column:
    """A city named in the text, in fixed order; else the postcode's; else empty."""
    text = F.lower(F.concat_ws(" ", *parts))
    named = F.when(F.lit(False), F.lit(""))
    for needle, city in CITY_NEEDLES:
        named = named.when(F.contains(text, F.lit(needle)), city)
    return F.coalesce(named, _first_range(postcode(text), CITY_RANGES), F.lit(""))


def bergen_by_postcode(code: Column) -> Column:
    return _first_range(code, BERGEN_RANGES)


def bergen_by_text(text: Column) -> Column:
    plain, out = F.lower(F.trim(text)), F.when(F.lit(False), F.lit(""))
    for name, words in BERGEN_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(plain, F.lit(w))
        out = out.when(hit, name)
    return out


def oslo_district(name: Column) -> Column:
    plain = F.lower(F.trim(name))
    return F.when(plain.isin(*OSLO_CENTRE), "Oslo sentrum").when(plain.isin(*OSLO_WEST), "Oslo vest").otherwise("Oslo øst")


#: Blocks of 2^k numbers, up to this k, that ranges are cut into.
WIDEST_BLOCK = 40


def blocks(ranges: DataFrame) -> DataFrame:
    """level, block, best: each range cut into the fewest blocks of 2^level numbers that start at multiples of it, two a level at most, and of each block the winner (priority, bucket).

    A block's winner is that of the ranges cut at it; a number's winner is the best of the blocks around it.
    """
    start, stop, level = F.col("start").cast("long"), F.col("end").cast("long") + 1, F.col("level")
    up = lambda x, k: -F.floor(-x / F.pow(F.lit(2.0), k)).cast("long")
    down = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")
    cut = ranges.where("start <= end").withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.lit(WIDEST_BLOCK), F.floor(F.log2(stop - start)).cast("int")))))
    cut = cut.withColumns({"a": up(start, level), "z": down(stop, level), "pa": up(start, level + 1) * 2, "pz": down(stop, level + 1) * 2})
    wide = level == WIDEST_BLOCK
    none = F.array().cast("array<bigint>")
    run = lambda a, z: F.when(a < z, F.sequence(a, z - 1)).otherwise(none)
    own = F.when(wide | (F.col("pa") >= F.col("pz")), run(F.col("a"), F.col("z"))).otherwise(F.concat(run(F.col("a"), F.col("pa")), run(F.col("pz"), F.col("z"))))
    return cut.select("level", F.explode(own).alias("block"), "priority", "bucket").groupBy("level", "block").agg(F.min(F.struct("priority", "bucket")).alias("best"))


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, name: str) -> DataFrame:
    """df with `name`, the bucket of the first (least priority) of possibly overlapping ranges of whole numbers (start, end, bucket, priority); null outside all.

    Distinct values meet the ranges' blocks in an equi-join on the block, one for each block size in use.
    """
    cut = staging.staged(blocks(ranges), "blocks")
    levels = sorted(r[0] for r in cut.select("level").distinct().collect())  # at most WIDEST_BLOCK + 1
    if not levels:
        return df.withColumn(name, F.lit(None).cast("string"))
    around = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col(value) / float(1 << k)).cast("long").alias("block")) for k in levels))).alias("b")
    hits = df.select(value).distinct().select(value, around).select(value, "b.*").join(cut, ["level", "block"])
    best = hits.groupBy(value).agg(F.min("best")["bucket"].alias(name))
    return df.join(best, value, "left")


def oslo_bucket(df: DataFrame, code: str, exact: DataFrame, prefixes: DataFrame) -> DataFrame:
    """df with oslo_bucket from exact (postnr, bydel, bucket), then the district's name, then prefixes (prefix2, bucket)."""
    by_code = exact.select(F.col("postnr").alias(code), F.coalesce("bucket", F.when(F.col("bydel").isNotNull(), oslo_district(F.col("bydel")))).alias("_exact"))
    by_prefix = prefixes.select(F.col("prefix2").alias("_prefix"), F.col("bucket").alias("_by_prefix"))
    valid = F.when(F.col(code).rlike("^[0-9]{4}$"), F.substring(code, 1, 2))
    out = df.join(by_code, code, "left").withColumn("_prefix", valid).join(by_prefix, "_prefix", "left")
    return out.withColumn("oslo_bucket", F.coalesce("_exact", "_by_prefix")).drop("_exact", "_by_prefix", "_prefix")


def city_average(prices: DataFrame) -> DataFrame:
    """city, segment, kr: the city's own average row ("<city> snitt") if there is one, else the mean over buckets."""
    own = F.lower(F.col("bucket")) == F.lower(F.concat("city", F.lit(" snitt")))
    return prices.groupBy("city", "segment").agg(F.coalesce(F.max(F.when(own, F.col("kr_per_m2"))), F.avg("kr_per_m2")).alias("kr"))


def bucket_ratios(prices: DataFrame) -> DataFrame:
    """city (lower case), bucket, segment, ratio of a bucket's price to its city's average row; no ratio to nothing."""
    own = F.col("bucket") == F.concat("city", F.lit(" snitt"))
    base = prices.where(own).groupBy("city", "segment").agg(F.max("kr_per_m2").alias("_base")).where("_base <> 0")
    out = prices.where(~own).join(base, ["city", "segment"])
    return out.select(F.lower("city").alias("city"), "bucket", "segment", (F.col("kr_per_m2") / F.col("_base")).alias("ratio"))


def benchmark(city: Column, seg: Column, table_value: Column) -> Column:
    """The table's city average, else the baseline times the segment's factor; never null."""
    base = F.create_map(*(F.lit(x) for pair in BASELINE.items() for x in pair))
    factor = F.create_map(*(F.lit(x) for pair in SEGMENT_FACTOR.items() for x in pair))
    return F.coalesce(table_value, F.coalesce(F.try_element_at(base, city), F.lit(BASELINE["Hele landet"])) * F.coalesce(F.try_element_at(factor, seg), F.lit(1.0)))


def gross_rent(area: Column, kr_per_m2: Column) -> Column:
    """A month's rent to the nearest hundred, ties to even; prices above the threshold are a year's."""
    monthly = F.when(kr_per_m2 > YEARLY_ABOVE, kr_per_m2 / 12.0).otherwise(kr_per_m2)
    return (half_even(F.greatest(F.lit(0.0), F.coalesce(area.cast("double"), F.lit(0.0))) * monthly / STEP) * STEP).cast("long")


def estimate(listings: DataFrame, prices: DataFrame, exact: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """listings (city, municipality, district, area, subarea, address, area_m2, rooms, optional point_bucket) with the rent estimate.

    A district comes from the point (point_bucket, already a district of the table), the postcode, or the text, in
    this order, and only if the price table has it; its ratio to the city's average scales the benchmark.
    """
    spark = listings.sparkSession
    has = set(listings.columns)
    text = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    given = F.nullif(F.trim(F.coalesce(F.nullif(text("city"), F.lit("")), text("municipality"), F.lit(""))), F.lit(""))
    raw = F.coalesce(given, guess_city(text("city"), text("municipality"), text("district"), text("area"), text("address")))
    df = listings.withColumn("_city", F.when(raw != "", canonical_city(raw)).otherwise("")).withColumn("segment", segment(F.col("area_m2"), F.col("rooms")))
    df = df.withColumn("_code", F.lpad(postcode(text("address")).cast("string"), 4, "0"))
    empty = lambda schema: spark.createDataFrame([], schema)
    df = oslo_bucket(df, "_code", exact if exact is not None else empty("postnr string, bydel string, bucket string"), prefixes if prefixes is not None else empty("prefix2 string, bucket string"))
    point = text("point_bucket")
    in_oslo, in_bergen = F.col("_city") == "Oslo", F.col("_city") == "Bergen"
    candidates = F.array(
        F.struct(F.when(in_oslo & point.isNotNull(), oslo_district(point)).when(~in_oslo, point).alias("bucket"), F.lit(BY_POINT).alias("confidence")),
        F.struct(F.when(in_bergen, bergen_by_postcode(F.col("_code").try_cast("int"))).when(in_oslo, F.col("oslo_bucket")).alias("bucket"), F.lit(BY_TEXT).alias("confidence")),
        *(F.struct(F.when(in_bergen, bergen_by_text(text(c))).alias("bucket"), F.lit(BY_TEXT).alias("confidence")) for c in ("district", "subarea", "area", "address")),
    )
    held = prices.where(F.col("city").isin(*WITH_DISTRICTS)).groupBy(F.col("city").alias("_city")).agg(F.collect_set("bucket").alias("_held"))
    standard = prices.where((F.col("segment") == "standard") & F.col("city").isin(*WITH_DISTRICTS)).select(F.col("city").alias("_city"), F.col("bucket").alias("_bucket"), F.col("kr_per_m2").alias("_kr"))
    average = city_average(prices).select(F.col("city").alias("_city"), "segment", F.col("kr").alias("_average"))
    df = df.join(held, "_city", "left")
    chosen = F.try_element_at(F.filter(candidates, lambda c: F.array_contains(F.col("_held"), c["bucket"])), F.lit(1))
    df = df.withColumn("_chosen", chosen).withColumn("_bucket", F.col("_chosen.bucket"))
    df = df.join(standard, ["_city", "_bucket"], "left")
    city_row = standard.where(F.col("_bucket") == F.concat("_city", F.lit(" snitt"))).select("_city", F.col("_kr").alias("_city_kr"))
    df = df.join(city_row, "_city", "left").join(average, ["_city", "segment"], "left")
    ratio = F.when(F.col("_city_kr") != 0, F.nullif(F.col("_kr"), F.lit(0.0)) / F.col("_city_kr"))
    kr = benchmark(F.when(F.col("_city") != "", F.col("_city")).otherwise("Hele landet"), F.col("segment"), F.col("_average"))
    df = df.withColumns({"_ratio": ratio, "_kr_m2": kr * F.coalesce(ratio, F.lit(1.0))})
    monthly = F.when(F.col("_kr_m2") > YEARLY_ABOVE, F.col("_kr_m2") / 12.0).otherwise(F.col("_kr_m2"))
    plain = F.when(F.col("_city") != "", F.concat("_city", F.lit(" snitt"))).otherwise("Hele landet")
    floor_ = F.greatest(F.coalesce(F.col("_chosen.confidence"), F.lit(BY_CITY)), F.when(F.col("_ratio").isNotNull(), WITH_RATIO).otherwise(BY_BENCHMARK))
    return df.select(
        *listings.columns, "segment", F.when(F.col("_city") != "", F.col("_city")).otherwise("Hele landet").alias("rent_city"), F.when(F.col("_ratio").isNotNull(), F.col("_bucket")).otherwise(plain).alias("bucket"),
        monthly.alias("kr_per_m2"), floor_.alias("confidence"), gross_rent(F.col("area_m2"), F.col("_kr_m2")).alias("gross_rent"),
    )


def zone_prices(spark: SparkSession, prices: DataFrame, rom_code: str = "1") -> DataFrame:
    """code, label, kr_per_m2 of each statistics zone."""
    seg = "hybel" if (rom_code or "1").strip() == "1" else "standard"
    zones = spark.createDataFrame(ZONES, "code string, label string, city string")
    found = city_average(prices).where(F.col("segment") == seg).select("city", "kr")
    return zones.join(found, "city", "left").select("code", "label", benchmark(F.col("city"), F.lit(seg), F.col("kr")).alias("kr_per_m2"))


def zone_rows(zones: DataFrame, updated: str) -> DataFrame:
    """Every zone in all four segments, prices with two decimals: the rows of the rent table's file."""
    each = zones.withColumn("segment", F.explode(F.array(*(F.lit(s) for s in SEGMENTS))))
    return each.select(F.col("label").alias("city"), F.concat("label", F.lit(" snitt")).alias("bucket"), "segment", F.format_string("%.2f", "kr_per_m2").alias("kr_per_m2"), F.lit(updated).alias("updated"))
