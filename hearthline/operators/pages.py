"""Where a condition report lies within a document's pages (doc_id, page_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import matches_any

# Patterns of pages inside, at the start and after the end of a report, and the limits of its span.
CUES = (
    r"\btilstandsrapport\b", r"\bboligsalgsrapport\b", r"\btilstandsrapport\s*\(ns\s*3600\)\b", r"\bns\s*3600\b", r"\bbygningsdeler\b", r"\bbyggteknisk?\s+gjennomgang\b",
    r"\bsammendrag av boligens tilstand\b", r"\boppsummering av avvik\b", r"\bkonklusjon\b", r"\btilstandsgrad\b", r"\btg\s*[0-3]\b", r"\bavvik\s+og\s+tiltak\b",
    r"\bnorsk\s*takst\b", r"\bnito\s*takst\b", r"\bbygningssakkyndig\b", r"\banticimex\b", r"\btaksthuset\b", r"\bnorconsult\b", r"\bbyggmester\b", r"\bnøkkeltakst\b", r"\btakstmann\b",
)
FOLLOW_CUES = (
    r"\bvåtrom\b", r"\butvendig\b", r"\binnvendig\b", r"\belektrisk(?:e|)\s+anlegg\b|\bsikringsskap\b", r"\bavløpsrør\b|\bvanntilførsel\b|\bsluk\b",
    r"\bvinduer\b|\bdører\b|\btak\b|\bdrenering\b", r"\btilstandsgrad\b|\btg\s*[0-3]\b", r"\barealer\b|\bbra\b|\bns\s*3940\b",
)
SOFT_ENDS = (r"\bvedlegg\b", r"\bkilder\s+og\s+vedlegg\b", r"\bplaninformasjon\b", r"\btegninger\b", r"\bkart\b", r"\bopplysninger\s+fra\s+kommunen\b", r"\bkommunale\s+opplysninger\b", r"\bforretningsfører\b")
STRONG_ENDS = (
    r"\begenerkl(æring|aering)\b", r"\bselgers\s+egenerkl(æring|aering)\b", r"\bboligselgerforsikring\b", r"\bbud(skjem|reglement)\b|\bkjøpetilbud\b", r"\benergiattest\b",
    r"\bnabolagsprofil\b", r"\bmeglerpakke\b", r"\bforbrukerinformasjon\s+om\s+budgivning\b|\bbudgivning\b", r"\b(liste over )?løsøre\b", r"\b(bilder|foto)\b",
)
EXTRA_STOPS = (r"\barealer,\s*byggetegninger\s+og\s+brannceller\b", r"^\s*arealer\s*$", r"\bbefarings\s*-\s*og\s+eiendomsopplysninger\b", r"\bp-?rom\b", r"\bs-?rom\b", r"\bbruksareal\b")
START_STRONG = (r"\btilstandsrapport\b", r"\bnøkkeltakst\b", r"\bbygningssakkyndig\b", r"\bbyggemåte\b", r"\bboligsalgsrapport\b")
START_SOFT = (r"\bbefaring\b", r"\bbygningsdeler\b", r"\btilstandsgrad\b", r"\btg\s*[0-3]\b")
HARD_STOPS = (r"\begenerkl(æring|aering)\b", r"\bselgers\s+egenerkl(æring|aering)\b", r"\benergiattest\b", r"\bnabolagsprofil\b", r"\bforbrukerinformasjon\s+om\s+budgivning\b", r"\bbudgivning\b")
POINTS = (
    (5, (r"\btilstandsrapport\b", r"\bboligsalgsrapport\b", r"\bns\s*3600\b")),
    (4, (r"\btg\s*[0-3]\b", r"\btilstandsgrad\b")),
    (3, (r"\bbygningsdeler\b", r"\bbyggteknisk", r"\bbyggemåte\b")),
    (2, (r"\bsammendrag\b", r"\boppsummering\b", r"\bkonklusjon\b")),
    (2, (r"\bnorsk\s*takst\b", r"\bnito\s*takst\b", r"\banticimex\b", r"\btaksthuset\b", r"\bbyggmester\b", r"norconsult", r"takstmann", r"\bnøkkeltakst\b")),
)
TITLES = ("tilstandsrapport", "boligsalgsrapport")
LOW_STREAK, LEAST_SUM, LEAST_PAGES, MOST_PAGES, START_LEAST, AHEAD = 4, 8, 4, 40, 6, 12


def _has(text: Column, *words: str) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def with_flags(pages: DataFrame) -> DataFrame:
    """pages with cue, follow_cue, soft_end, strong_end, extra_stop, attachments, template, contents, strict_title, title and score."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    lines = F.filter(F.transform(F.slice(F.split(low, r"\R"), 1, 10), lambda x: F.trim(x)), lambda x: x != "")
    strict = F.exists(lines, lambda x: ~_has(x, "innhold", "informasjon", "fakta", "vedlegg") & (F.startswith(x, F.lit(TITLES[0])) | F.startswith(x, F.lit(TITLES[1]))))
    head_lines = F.slice(F.split(low, r"\R"), 1, 20)
    flags = {
        "cue": matches_any(low, CUES), "follow_cue": matches_any(low, FOLLOW_CUES), "soft_end": matches_any(low, SOFT_ENDS), "strong_end": matches_any(low, STRONG_ENDS),
        "extra_stop": matches_any(low, EXTRA_STOPS),
        "attachments": _has(low, "vedlegg") & (_has(low, "tilstandsrapport") | (F.regexp_count(text, F.lit("\n")) >= 5)),
        "template": (
            _has(low, "oppdragsnr").cast("int") + _has(low, "befaringsdato", "rapportdato").cast("int") + (_has(text, "©") & _has(low, "verdi")).cast("int")
            + _has(low, " i verdi", "iverdi").cast("int") + _has(low, "gå til side").cast("int") + (_has(low, "side:") & _has(low, "av")).cast("int")
        ) >= 2,
        "contents": (_has(low, "innhold") & _has(low, "vedlegg")) | (_has(low, "vedlegg") & _has(low, "tilstandsrapport")),
        "strict_title": strict,
        "title": F.exists(head_lines, lambda x: _has(x, TITLES[0])) | _has(F.substring(low, 1, 1200), TITLES[0]),
    }
    out = pages.withColumns(flags)
    cue = F.col("cue")
    points = sum((F.when(matches_any(low, p), n).otherwise(0) for n, p in POINTS), F.lit(0))
    ends = F.when(F.col("strong_end") & ~cue, 20).when(F.col("strong_end"), 2).otherwise(0) + F.when(F.col("soft_end") & ~cue, 5).otherwise(0)
    ends = ends + F.when(F.col("extra_stop") & ~cue, 10).otherwise(0) + F.when(F.col("attachments"), 12).otherwise(0)
    return out.withColumn("score", F.when(text == "", -1).otherwise(points - ends))


def best_block(scores: Column) -> Column:
    """(total, start, stop) of the best block of page scores; total is null if none reaches LEAST_SUM.

    A block starts at a score of 2 or more and ends before LOW_STREAK pages in a row without a positive score, which
    its total includes. Of equal totals the first counts; the last page bounds a block that runs to the end.
    """
    start = F.struct(F.lit(None).cast("long").alias("total"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.lit(-1).alias("open"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("low"), F.lit(0).alias("at"))

    def close(s: Column, stop: Column) -> list[Column]:
        better = (s["sum"] >= LEAST_SUM) & (s["total"].isNull() | (s["sum"] > s["total"]))
        return [F.when(better, s["sum"]).otherwise(s["total"]).alias("total"), F.when(better, s["open"]).otherwise(s["start"]).alias("start"), F.when(better, stop).otherwise(s["stop"]).alias("stop")]

    def step(s: Column, x: Column) -> Column:
        opened, at = s["open"] >= 0, s["at"]
        begins = ~opened & (x >= 2)
        inside = opened | begins
        low = F.when(inside & (x <= 0), s["low"] + 1).otherwise(0)
        total = F.when(opened, s["sum"] + x).when(begins, x.cast("long")).otherwise(F.lit(0).cast("long"))
        now = F.struct(s["total"].alias("total"), s["start"].alias("start"), s["stop"].alias("stop"), F.when(begins, at).otherwise(s["open"]).alias("open"), total.alias("sum"))
        ends = opened & (low >= LOW_STREAK)
        closed = close(now, at - LOW_STREAK)
        kept = [now[n].alias(n) for n in ("total", "start", "stop")]
        pick = [F.when(ends, a).otherwise(b).alias(n) for n, a, b in zip(("total", "start", "stop"), closed, kept, strict=True)]
        return F.struct(*pick, F.when(ends, -1).otherwise(now["open"]).alias("open"), F.when(ends, F.lit(0).cast("long")).otherwise(now["sum"]).alias("sum"), F.when(ends, 0).otherwise(low).alias("low"), (at + 1).alias("at"))

    def finish(s: Column) -> Column:
        done = F.struct(*close(s, s["at"] - 1))
        return F.when(s["open"] >= 0, done).otherwise(F.struct(s["total"].alias("total"), s["start"].alias("start"), s["stop"].alias("stop")))

    return F.aggregate(scores, start, step, finish)


def _per_doc(pages: DataFrame, *columns: str) -> DataFrame:
    """doc_id and p, the document's pages in order as structs."""
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", *columns))).alias("p"))


def sliding_best(pages: DataFrame, widths: tuple[int, ...] = (20, 30, 40)) -> DataFrame:
    """doc_id, width, start, total: for each width the window of pages with the highest score sum, the first of equal ones."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    sums = {f"_w{n}": F.sum("score").over(w.rowsBetween(0, n - 1)) for n in widths}
    each = pages.withColumns(sums).withColumn("s", F.explode(F.array(*(F.struct(F.lit(n).alias("width"), F.col(f"_w{n}").alias("total")) for n in widths))))
    best = each.groupBy("doc_id", F.col("s.width").alias("width")).agg(F.max(F.struct(F.col("s.total").alias("total"), (-F.col("page_no")).alias("at"))).alias("b"))
    return best.select("doc_id", "width", (-F.col("b.at")).alias("start"), F.col("b.total").alias("total"))


def stop_pages(pages: DataFrame, start: str, least: int = 6, ahead: int = 3) -> DataFrame:
    """pages (doc_id, page_no, score and the flags) with `stop`: whether a report that begins at page `start` ends before this page.

    It does at a strong or extra end without a cue, once `least` pages are read, unless most of the next pages look like the report.
    """
    after = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(1, ahead)
    like = F.count_if(F.col("cue") | (F.col("score") >= 2) | F.col("iverdi_tpl")).over(after)
    seen = F.count("*").over(after)
    ends = (F.col("strong_term") | F.col("extra_stop")) & ~F.col("cue") & (F.col("page_no") > F.col(start)) & (F.col("page_no") - F.col(start) + 1 >= least)
    return pages.withColumn("stop", ends & ~((seen > 0) & (like >= F.floor(seen / 2) + 1)))


def look_ahead(pages: DataFrame, flag: Column, ahead: int = AHEAD) -> DataFrame:
    """pages with `cues_ahead`, on how many of this and the next pages the flag is set."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(0, ahead)
    return pages.withColumn("cues_ahead", F.sum(flag.cast("int")).over(w))


def contents_start(pages: DataFrame) -> DataFrame:
    """doc_id, toc_page: the page (from 0) that a table of contents within the first 30 pages gives the report."""
    low = F.lower("text")
    listed = pages.where((F.col("page_no") < 30) & _has(low, "innhold", "vedlegg") & (F.length("text") > 30))
    lines = listed.select("doc_id", "page_no", F.posexplode(F.split("text", r"\R")).alias("line_no", "line"))
    found = lines.select("doc_id", "page_no", "line_no", *(F.regexp_extract(F.trim("line"), r"(?iU)^(.*?)(?:\s+side)?\s+(\d{1,3})\s*$", i).alias(n) for i, n in ((1, "name"), (2, "no"))))
    found = found.where((F.col("no") != "") & _has(F.lower("name"), *TITLES)).withColumn("at", F.greatest(F.lit(0), F.col("no").cast("int") - 1))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    first = found.join(size, "doc_id").where("at < n").groupBy("doc_id").agg(F.min_by("at", F.struct("page_no", "line_no")).alias("at"))
    titled = pages.where("title").select("doc_id", F.col("page_no").alias("t"))
    near = first.join(titled, "doc_id", "left").groupBy("doc_id", "at").agg(F.min(F.when(F.col("t").between(F.col("at"), F.col("at") + 3), F.col("t"))).alias("t"))
    return near.select("doc_id", F.coalesce("t", "at").alias("toc_page"))


def anchor_span(pages: DataFrame) -> DataFrame:
    """doc_id, start, stop from titles: strict ones if there are any, scored by the cues that follow."""
    ahead = look_ahead(pages, F.col("cue") | F.col("follow_cue")).join(contents_start(pages), "doc_id", "left")
    allowed = ~F.col("attachments") & ~F.col("contents") & ~F.col("extra_stop") & (F.col("page_no") >= F.coalesce("toc_page", F.lit(0)))
    marked = ahead.where(allowed & (F.col("strict_title") | F.col("title")))
    marked = marked.withColumn("any_strict", F.max("strict_title").over(Window.partitionBy("doc_id"))).where("strict_title or not any_strict")
    early = F.lower(F.substring("text", 1, 400))
    points = F.col("cues_ahead") * 2 + F.when(F.col("strict_title"), 8).otherwise(0) - F.when(_has(early, "innhold", "informasjon"), 3).otherwise(0)
    start = marked.groupBy("doc_id").agg(F.max_by("page_no", F.struct(points, -F.col("page_no"))).alias("start"))

    state = lambda end, low, done: F.struct(end.alias("end"), low.alias("low"), done.alias("done"))

    def step(s: Column, p: Column) -> Column:
        stop = (p["page_no"] > F.col("start")) & (p["strong_end"] | p["extra_stop"]) & ~p["cue"]
        low = F.when(p["cue"] | p["follow_cue"], 0).otherwise(s["low"] + 1)
        faded = low >= LOW_STREAK
        end = F.when(stop, p["page_no"] - 1).when(faded, F.greatest(F.col("start"), p["page_no"] - LOW_STREAK)).otherwise(p["page_no"])
        return F.when(s["done"] | (p["page_no"] < F.col("start")), s).otherwise(state(end.cast("long"), low, stop | faded))

    docs = _per_doc(pages, "cue", "follow_cue", "strong_end", "extra_stop").join(start, "doc_id")
    end = F.aggregate("p", state(F.col("start").cast("long"), F.lit(0), F.lit(False)), step, lambda s: s["end"])
    return docs.select("doc_id", F.col("start").cast("long").alias("start"), F.greatest(F.col("start").cast("long"), end).alias("stop"))


def keyword_span(pages: DataFrame) -> DataFrame:
    """doc_id, start, stop from the page with most start words to the first hard stop, or the longest allowed span."""
    low = F.lower(F.coalesce("text", F.lit("")))
    count = lambda ps: sum((matches_any(low, (p,)).cast("int") for p in ps), F.lit(0))
    points = (count(START_STRONG) + _has(low, TITLES[0]).cast("int")) * 10 + count(START_SOFT) * 3
    p = pages.withColumns({"_points": points, "_hard": matches_any(low, HARD_STOPS)})
    start = p.groupBy("doc_id").agg(F.max(F.struct("_points", (-F.col("page_no")).alias("m"))).alias("b"), F.max("page_no").alias("last"))
    start = start.where(F.col("b._points") >= START_LEAST).select("doc_id", "last", (-F.col("b.m")).alias("start"))
    stop = p.where("_hard").join(start, "doc_id").where("page_no > start").groupBy("doc_id").agg((F.min("page_no") - 1).alias("hard"))
    out = start.join(stop, "doc_id", "left")
    length = F.col("hard") - F.col("start") + 1
    end = F.when(length.between(LEAST_PAGES, MOST_PAGES), F.col("hard")).otherwise(F.least(F.col("last"), F.col("start") + MOST_PAGES - 1))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), end.cast("long").alias("stop")).where(F.col("stop") - F.col("start") + 1 >= LEAST_PAGES)


def report_span(pages: DataFrame) -> DataFrame:
    """doc_id, start, stop, method: the anchor's span if it has LEAST_PAGES, else the keywords', else the best block's."""
    flagged = with_flags(pages)
    a = anchor_span(flagged).where(F.col("stop") - F.col("start") + 1 >= LEAST_PAGES).select("doc_id", F.struct("start", "stop", F.lit("anchor").alias("method")).alias("a"))
    k = keyword_span(flagged).select("doc_id", F.struct("start", "stop", F.lit("aggressive_keywords").alias("method")).alias("k"))
    b = _per_doc(flagged, "score").select("doc_id", best_block(F.transform("p", lambda x: x["score"])).alias("x")).where("x.total is not null")
    b = b.select("doc_id", F.struct(F.col("x.start").cast("long").alias("start"), F.col("x.stop").cast("long").alias("stop"), F.lit("fallback_block").alias("method")).alias("b"))
    every = pages.select("doc_id").distinct()
    return every.join(a, "doc_id", "left").join(k, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("a", "k", "b").alias("s")).select("doc_id", "s.*")


def report_text(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text: the pages of each span, in order, joined by newlines."""
    held = pages.join(spans, "doc_id").where(F.col("page_no").between(F.col("start"), F.col("stop")))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return held.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def first_pages_text(pages: DataFrame, most: int = 40) -> DataFrame:
    """doc_id, text of the first pages, blank ones left out."""
    held = pages.where((F.col("page_no") < most) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return held.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))


def bundle_cut(pages: DataFrame, negative: Column, least: int = 3, most: int = 80) -> DataFrame:
    """doc_id, n_pages to keep of a bundle: up to the first negative page from index `least` on, `most` at the most."""
    cut = F.min(F.when(negative & (F.col("page_no") >= least), F.col("page_no")))
    return pages.groupBy("doc_id").agg(F.least(F.coalesce(cut, F.count("*")), F.lit(most)).cast("long").alias("n_pages"))


def validate_document(size: Column, first_text: Column, words: tuple[str, ...] = ("salgsoppgave", "prospekt"), least_bytes: int = 50 * 1024) -> Column:
    """(ok, reason, matches): large enough, and one of the words on its first pages."""
    low = F.lower(first_text)
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    none = F.array().cast("array<string>")
    result = lambda ok, reason, m: F.struct(F.lit(ok).alias("ok"), reason.alias("reason"), m.alias("matches"))
    return (
        F.when(size < least_bytes, result(False, F.concat(F.lit("too_small:"), size.cast("string")), none))
        .when(first_text.isNull(), result(False, F.lit("text_extraction_failed"), none))
        .when(F.size(found) == 0, result(False, F.lit("missing_keywords"), none))
        .otherwise(result(True, F.lit(None).cast("string"), found))
    )


def confidence(ok: Column, matches: Column) -> Column:
    """0.25 for an invalid document, from 0.9 up to 0.95 by the words it matches."""
    return F.when(ok, F.round(F.least(F.lit(1.0), F.lit(0.85) + F.least(F.greatest(F.lit(1), matches) * 0.05, F.lit(0.1))), 3)).otherwise(0.25)
