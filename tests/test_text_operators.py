from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.functions import texts, urls
from hearthline.operators import facts, findings, issues, links, pages
from hearthline.sources import html

SEGMENT = "doc_id string, pos long, text string, source string"


def segments(spark, *lines, source="3"):
    return spark.createDataFrame([("d", i, t, source) for i, t in enumerate(lines)], SEGMENT)


def test_text_helpers(value):
    assert value(texts.simplify(F.lit("ÆØÅ ß É"))) == "aeoa ss e"
    assert value(texts.strip_marks(F.lit("Ålesund på ø æ é"))) == "Alesund pa ø æ e"
    assert value(texts.collapse(F.lit("  a  b\n")), texts.slug(F.lit("Pris (kr)!")), texts.slug(F.lit("!!"))) == ("a b", "pris_kr", "felt")
    assert value(texts.ellipsis(F.lit("x" * 300), 220)) == "x" * 217 + "..."


def test_levels(value):
    level = lambda t: value(findings.level(F.lit(t)))
    assert [level("TG 3 bad"), level("tg:2"), level("ætg 3"), level("TG2 og TG3"), level("Avvik som kan kreve tiltak"), level("TG1")] == [3, 2, None, 3, 2, None]


def test_finding_of_one_line(spark):
    r = findings.report(segments(spark, "TG 3 Bad: Store skader i membran og tettsjikt", source="7")).first()
    assert [(x.komponent, x.grunn[-1], x.kilde_side) for x in r.tg3] == [("Bad", ".", "7")] and not r.tg2
    assert "Bad" not in r.missing and len(r.missing) == 10
    assert r.markdown == f"TG2\nIngen TG2-punkter funnet.\n\nTG3\n{r.tg3[0].grunn}"


def test_boundaries_and_fallback(spark):
    got = findings.candidates(segments(spark, "Vann trenger inn ved vindu i kjeller", "TG 2", "riper i maling", "", "ikke med", "TG3 Sluk", "lekkasje i rør", "Side 4", "fukt overalt")).orderBy("at").collect()
    assert [(x.at, x.level, x.component) for x in got] == [(1, 2, "riper i maling"), (5, 3, "Våtromsmembran")]  # a label without a component stands for one
    assert got[0].reason == "Vann trenger inn ved vindu i kjeller." and "overalt" not in got[1].reason


def test_summary_blocks(spark):
    got = findings.candidates(segments(spark, "Forhold som har fått TG2", "Bad: Oppsummering", "Fukt i vegg", "og i gulv.", "mer", "Tak: Oppsummering", "Utett tekking.")).orderBy("sub").collect()
    assert [(x.component, x.reason) for x in got] == [("Bad", "Fukt i vegg og i gulv."), ("Tak", "Utett tekking.")]


def test_duplicates(spark):
    rows = [("d", i, 0, 3, c, r, "1") for i, (c, r) in enumerate([("Ukjent", "Fukt i bad."), ("Bad", "Fukt i bad."), ("Bad", "Er gammelt."), ("Tak", "Fukt i bad.")])]
    df = spark.createDataFrame(rows, "doc_id string, at long, sub long, level int, component string, reason string, source string")
    assert sorted((r.at, r.component, r.reason) for r in findings.dedupe(df).collect()) == [(0, "Bad", "Fukt i bad."), (2, "Bad", "Er gammelt.")]
    assert [(r.at, r.reason) for r in findings.collapse_components(findings.dedupe(df)).collect()] == [(0, "Fukt i bad.")]


def test_formats(value, spark):
    assert value(findings.entry_text(2, F.lit("Tak"), F.lit("Taktekking - Slitasje."), F.lit("10"))) == "TG2 Tak: Taktekking - Slitasje. (Tilstandsrapport side 10)"
    merged = findings.merge_lists(F.array(F.lit("A"), F.lit(" b ")), F.array(F.lit("a"), F.lit(""), F.lit("C")))
    assert value(merged) == ["A", "b", "C"]
    c, r = findings.split_entry(F.lit("TG2: Tak - slitt"))
    assert value(c, r) == ("", "Tak - slitt") or value(c, r) == ("Tak", "slitt")
    label = lambda c, r: value(findings.label(F.lit(c), F.lit(r), F.lit(2)))
    assert [label("Trapp", "mangler håndløper"), label("Bad", "Råte i vegg"), label("", "")] == ["Manglende håndløper", "Råteskade", "TG2"]
    assert value(findings.detail(F.lit("Tak"), F.lit("Slitt"), F.lit(3), F.lit("side 4"))) == "TG3 Tak: Slitt. (Tilstandsrapport side 4)"


def _specific(text, components, terms):
    """Independent statement of the prefix rule."""
    import re

    words = {w for w in re.split("[^a-z0-9]+", text) if w}
    has = lambda q: q in text if " " in q else any(w.startswith(q) or q.startswith(w) for w in words)
    wrong = any(map(has, terms))
    return len(text) >= 8 and wrong and (any(map(has, components)) or len(words) >= 4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["fukt", "i", "bad", "vegg", "xyz", "ikke", "godkjent", "tak", "q9", "skade"]), max_size=6), min_size=1, max_size=25))
def test_specific_property(spark, rows):
    lines = [" ".join(r) for r in rows]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r[0] for r in df.select(issues.is_specific(F.col("t"))).collect()] == [_specific(x, issues.COMPONENT_TERMS, issues.ISSUE_TERMS) for x in lines]


def test_issues(spark, value):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["TG3 Bad: fukt i membran", "må utbedres", "TG2 tak", "Skade på vindu og råte i vegg", "Skade på vindu og råte i vegg"])], "doc_id string, pos long, line string")
    tagged = issues.tagged(lines, 3)
    assert [r.raw for r in tagged.collect()] == ["TG3 Bad: fukt i membran må utbedres"]
    assert [r.snippet for r in issues.watch_outs(lines, tagged).orderBy("rank").collect()] == ["Skade på vindu og råte i vegg Skade på vindu og råte i vegg", "Skade på vindu og råte i vegg"]
    assert value(issues.shorten(F.lit("bad: fukt i vegg. Mer om det. Tredje"))) == "Bad: Fukt i vegg Mer om det."
    items = spark.createDataFrame([("d", "tg2", 0, "Tak"), ("d", "tg3", 0, "TG3: Bad"), ("d", "watch", 0, "bad"), ("d", "upgrade", 1, "- Kjøkken")], "doc_id string, category string, pos int, text string")
    assert [r.question[:20] for r in issues.questions(items, 2).orderBy("rank").collect()] == ["Når utbedres «Bad», ", "Trengs tiltak snart "]


def best_block(scores):
    """Loop over the pages: blocks open at 2, close before 4 pages without points."""
    best, i, n = (None, -1, -1), 0, len(scores)
    while i < n:
        if scores[i] < 2:
            i += 1
            continue
        total = low = 0
        j = i
        while j < n:
            total += scores[j]
            low = low + 1 if scores[j] <= 0 else 0
            if low == 4:
                break
            j += 1
        stop = j - 4 if j < n else n - 1
        if total >= 8 and (best[0] is None or total > best[0]):
            best = (total, i, stop)
        i = j + 1
    return best


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-6, 9), min_size=0, max_size=30), min_size=1, max_size=30))
def test_best_block_property(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "s array<int>")
    assert [tuple(r[0]) for r in df.select(pages.best_block(F.col("s"))).collect()] == [best_block(r) for r in rows]


def test_report_spans(spark):
    anchor = ["Innhold vedlegg", "Tilstandsrapport\nns 3600 tg 2", "våtrom tg 2", "sluk tg 3", "drenering tg 2", "konklusjon tg 1", "Energiattest", "x"]
    keyword = ["x", "y byggemåte befaring", "z", "a", "b", "c", "energiattest"]
    block = ["x", "x", "oppsummering takstmann", "sammendrag anticimex"] + ["konklusjon"] * 2
    rows = [(d, i, t) for d, p in (("a", anchor), ("k", keyword), ("b", block), ("n", ["", "q"])) for i, t in enumerate(p)]
    p = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    spans = pages.report_span(p)
    got = {r.doc_id: (r.start, r.stop, r.method) for r in spans.collect()}
    assert got["a"] == (1, 5, "anchor") and got["k"] == (1, 5, "aggressive_keywords") and got["b"][2] == "fallback_block" and got["n"] == (None, None, None)
    assert {r.doc_id for r in pages.report_text(p, spans).collect()} == {"a", "k", "b"}
    assert pages.bundle_cut(p.where("doc_id = 'a'"), F.col("text").contains("Energi")).first().n_pages == 6


def test_validation(value):
    v = lambda n, t: value(pages.validate_document(F.lit(n), F.lit(t)))
    assert v(10, "x").reason == "too_small:10" and v(99999, "Salgsoppgave").matches == ["salgsoppgave"] and v(99999, "x").reason == "missing_keywords"
    assert value(pages.confidence(F.lit(True), F.lit(1)), pages.confidence(F.lit(True), F.lit(5)), pages.confidence(F.lit(False), F.lit(0))) == (0.9, 0.95, 0.25)


def test_urls(value):
    u = F.lit("HTTPS://x.no\\/a?utm_source=1&q=%41&q=2&e=&gclid=3#t")
    assert value(urls.clean_url(u)) == "https://x.no/a?q=A"
    assert value(urls.clean_if_tracked(F.lit("https://x.no/a?q=1#t")), urls.clean_if_tracked(F.lit("https://x.no/a?fbclid=1#t"))) == ("https://x.no/a?q=1#t", "https://x.no/a")
    assert value(urls.listing_id(F.lit("https://x.no/1234567?finnkode=9")), urls.listing_id(F.lit("https://x.no/a/1234567")), urls.listing_id(F.lit("https://x.no/12"))) == ("9", "1234567", None)
    base = F.lit("https://x.no/a/b?q=1")
    assert [value(urls.absolute(base, F.lit(h))) for h in ("/c", "c", "//y.no/d", "?z=1", "http://w/", "")] == ["https://x.no/c", "https://x.no/a/c", "https://y.no/d", "https://x.no/a/b?z=1", "http://w/", None]
    assert value(urls.link_score(F.lit("/salgsoppgave.pdf"), F.lit("")), urls.link_score(F.lit("/kart.pdf"), F.lit(""))) == (20, -20)


def test_links(spark):
    page = '<a href="/kart.pdf">kart</a><a class="k" href="/s.pdf">Se <b>komplett salgsoppgave</b></a><a href="//cdn.no/p.pdf">x</a><script>"/raw/prospekt.pdf"</script>'
    p = spark.createDataFrame([(1, "https://x.no/", page), (2, "https://y.no/q", "<p>none</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.choice for r in links.choose(p, links.candidates(p)).collect()} == {1: "https://x.no/s.pdf", 2: "https://y.no/q"}
    assert [r.href for r in links.best(links.scored(links.anchors(p))).collect()] == ["/s.pdf"]
    assert ("https://x.no/raw/prospekt.pdf", 60) in {(r.link, r.score) for r in links.raw_pdf_urls(p).collect()}


def test_html_and_facts(spark):
    page = """<div class="key-info"><dl><dt>Totalpris</dt><dd>3 117 502 kr</dd><dt>Antall rom</dt><dd>4</dd><dt>Primærrom</dt><dd>62,5 m²</dd></dl>
      <ul><li>Eieform: Selveier</li></ul></div><table><tr><th>Soverom</th><td>2</td></tr><tr><td>Pris!</td><td>x</td></tr></table>
      <script type="application/ld+json">{"offers": {"price": {"value": 7}}, "geo": [1]}</script><script type="application/ld+json">{bad</script><p>Hei <b>du</b></p><p>hei du</p>"""
    p = html.with_content(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    r = {x.page_id: x for x in p.withColumn("facts", facts.key_facts(F.col("pairs"))).withColumn("rooms", facts.rooms(F.col("pairs"), F.lit(""))).withColumn("m2", facts.area(F.col("pairs"), F.lit(""))).withColumn("price", html.json_value(F.col("json"), "price")).collect()}
    got = {f.key: (f.value_str, f.value_num, f.ord) for f in r[1].facts}
    assert got["total_price"] == (None, 3117502.0, 10) and got["rooms"][1] == 4 and got["bedrooms"][1] == 2 and got["primary_room_m2"][1] == 62.5
    assert got["ownership_type"][0] == "Selveier" and got["pris"] == ("x", None, 1000)
    assert r[1].rooms == 4 and r[1].m2 == 62.5 and r[1].price == "7" and len(r[1].json) == 1
    assert r[2].facts == [] and r[2].price is None
    s = html.segments(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "FINN").orderBy("pos").collect()
    assert [x.text for x in s][:2] == ["Soverom 2", "Pris! x"] and sum(x.text.lower() == "hei du" for x in s) == 1
