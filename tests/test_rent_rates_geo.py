from pyspark.sql import functions as F

from hearthline.operators import geo, rates, rent

PRICES = [("Oslo", "Oslo snitt", "standard", 400.0), ("Oslo", "Oslo vest", "standard", 440.0), ("Bergen", "Bergen snitt", "standard", 250.0), ("Bergen", "Bergen sør", "standard", 240.0), ("Trondheim", "Trondheim øst", "stor", 200.0), ("Trondheim", "Trondheim vest", "stor", 220.0)]


def prices(spark):
    return spark.createDataFrame([(*p, "Q3") for p in PRICES], "city string, bucket string, segment string, kr_per_m2 double, updated string")


def test_segment_order(value):
    seg = lambda a, r: value(rent.segment(F.lit(a).cast("double"), F.lit(r).cast("int")))
    assert [seg(120, 1), seg(120, 2), seg(45, None), seg(70, None), seg(95, None), seg(None, None), seg(0, 4), seg(29.9, 5)] == ["hybel", "liten", "liten", "standard", "stor", "standard", "stor", "hybel"]


def test_bergen_ranges(spark, value):
    by = lambda c: value(rent.bergen_by_postcode(F.lit(c)))
    assert [by(5003), by(5105), by(5170), by(5265), by(5270), by(5300)] == ["Bergen sentrum", "Bergen sør", "Bergen vest", "Bergen øst", "Bergen sør", None]
    ranges = spark.createDataFrame([(a, b, n, i) for i, (a, b, n) in enumerate(rent.BERGEN_RANGES)], "start int, end int, bucket string, priority int")
    df = spark.createDataFrame([(c,) for c in range(4990, 5310)], "code int")
    for r in rent.range_lookup(df, "code", ranges, "bucket").withColumn("chain", rent.bergen_by_postcode(F.col("code"))).collect():
        assert r.bucket == r.chain


def test_city_guess_and_names(value):
    g = lambda t: value(rent.guess_city(F.lit(t)))
    assert [g("Gata 1, 5105 sted"), g("nær OSLO, 5105"), g("0150"), g("9999"), g("Tromso")] == ["Bergen", "Oslo", "Oslo", "", "Tromsø"]
    assert [value(rent.canonical_city(F.lit(n))) for n in ("Oslo kommune", " alesund ", "Voss")] == ["Oslo", "Ålesund", "Voss"]


def test_estimate_cascade(spark):
    rows = [
        (1, "Oslo kommune", None, "Gata 1, 0250 Oslo", 75.0, 3, "Frogner"), (2, "", None, "Fanaveien 2, 5105 Bergen", 60.0, None, None), (3, None, "Trondheim", "", 100.0, 4, None),
        (4, "Bergen", None, "uten nummer", 60.0, None, "Fana"), (5, None, None, None, None, None, None), (6, "Bergen", None, "5170 Bergen", 60.0, 3, None),
    ]
    listings = spark.createDataFrame(rows, "id int, city string, municipality string, address string, area_m2 double, rooms int, district string")
    exact = spark.createDataFrame([("0250", "Frogner", None)], "postnr string, bydel string, bucket string")
    got = {r.id: r for r in rent.estimate(listings, prices(spark), exact).collect()}
    assert (got[1].bucket, got[1].confidence, got[1].gross_rent) == ("Oslo vest", 0.85, 33000)
    assert (got[2].bucket, got[2].kr_per_m2, got[2].gross_rent) == ("Bergen sør", 240.0, 14400)
    assert (got[3].segment, got[3].kr_per_m2, got[3].confidence, got[3].bucket) == ("stor", 210.0, 0.80, "Trondheim snitt")
    assert (got[4].bucket, got[4].confidence) == ("Bergen sør", 0.85)
    assert (got[5].rent_city, got[5].kr_per_m2, got[5].gross_rent) == ("Hele landet", 260.0, 0)
    assert (got[6].bucket, got[6].confidence) == ("Bergen snitt", 0.80)  # the table has no western district


def test_averages_and_ratios(spark):
    avg = {(r.city, r.segment): r.kr for r in rent.city_average(prices(spark)).collect()}
    assert avg == {("Oslo", "standard"): 400.0, ("Bergen", "standard"): 250.0, ("Trondheim", "stor"): 210.0}
    assert {(r.city, r.bucket): round(r.ratio, 4) for r in rent.bucket_ratios(prices(spark)).collect()} == {("oslo", "Oslo vest"): 1.1, ("bergen", "Bergen sør"): 0.96}
    zones = {r.code: r.kr_per_m2 for r in rent.zone_prices(spark, prices(spark), "2").collect()}
    assert zones["01"] == 400.0 and zones["00"] == 260.0 and zones["20"] == 260.0
    rows = rent.zone_rows(rent.zone_prices(spark, prices(spark)), "Q4")
    assert rows.count() == 36 and rows.where("city = 'Hele landet'").first().kr_per_m2 == "286.00"


def test_yearly_prices_and_rounding(value):
    gross = lambda a, k: value(rent.gross_rent(F.lit(a), F.lit(k)))
    assert [gross(50.0, 357.0), gross(50.0, 247.0), gross(-5.0, 300.0), gross(10.0, 2400.0)] == [17800, 12400, 0, 2000]


def test_percentages(value):
    found = rates.percentages(F.lit("nominell 5,4 % og effektiv 5.62% eller 6 %, 0,1 % og 12 %"))
    assert value(found) == [5.4, 5.62, 4.0, 6.0]
    assert value(rates.median_percentage(found), rates.first_percentage(found)) == (5.51, 5.4)
    assert value(rates.median_percentage(rates.percentages(F.lit("ingen")))) is None


def test_interest_estimate(spark):
    c = spark.createDataFrame([("dnb_rate", 5.0, 10), ("dnb_rate", 5.5, 100), ("policy_rate", 4.5, 999_990), ("margin", 1.1, 5), ("dnb_rate", 9.0, 2_000_000)], "name string, value double, ts long")
    now = F.lit(1_000_000)
    r = rates.interest_estimate(c, now).first()
    assert (r.rate, r.source, r.margin) == (5.5, "dnb", 1.0)  # stale, but nothing fresher
    r = rates.interest_estimate(c, now, fetched_bank=F.lit(6.0)).first()
    assert (r.rate, r.margin) == (6.0, 1.5)
    r = rates.interest_estimate(c.where("name <> 'dnb_rate'"), now).first()
    assert (r.rate, r.source) == (5.6, "policy+margin")
    r = rates.interest_estimate(c.limit(0), now).first()
    assert r.rate == 5.75


def test_geo(spark):
    ring = lambda x, y, a: [[x, y], [x + a, y], [x + a, y + a], [x, y + a], [x, y]]
    kind = "priority int, name string, polygons array<array<array<array<double>>>>"
    features = spark.createDataFrame([(1, "late", [[ring(0.0, 0.0, 9.0)]]), (0, "holed", [[ring(0.0, 0.0, 4.0), ring(1.0, 1.0, 1.0)], [ring(6.0, 6.0, 1.0)]])], kind)
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 6.5, 6.5), (4, 20.0, 1.0)], "id int, lon double, lat double")
    assert {r.id: r.bucket for r in geo.locate(points, features, "id").collect()} == {1: "holed", 2: "late", 3: "holed", 4: None}
