"""Candidate links of pages: gathered, scored, deduplicated, and the best one chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

_ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
#: Link texts that announce a prospectus.
NEEDLES = ("se komplett salgsoppgave", "komplett salgsoppgave", "salgsoppgave", "se salgsoppgave", "prospekt", "se prospekt", "last ned prospekt", "last ned salgsoppgave", "komplett")


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos, href, text of every <a> with an href, in order."""
    hrefs = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2))
    each = pages.select(key, "url", F.posexplode(F.arrays_zip(hrefs.alias("h"), texts.alias("t"))).alias("pos", "a"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.col("a.t"), "(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    return each.select(key, "url", "pos", F.col("a.h").alias("href"), plain.alias("text"))


def scored(links: DataFrame, **words) -> DataFrame:
    """Links of a positive score, with it."""
    return links.withColumn("score", urls.link_score(F.col("href"), F.col("text"), **words)).where("score > 0")


def best(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Each page's link of the highest score; of equal ones the first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "pos"))
    return links.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def candidates(pages: DataFrame, key: str = "page_id", needles: tuple[str, ...] = NEEDLES) -> DataFrame:
    """Distinct absolute, cleaned links that a needle announces, then those to PDF files; each at its first place."""
    links = anchors(pages, key)
    links = links.withColumn("link", urls.clean_url(urls.absolute(F.col("url"), F.col("href")))).where("link is not null")
    announced = F.lower("text").rlike("|".join(needles))
    ranked = links.withColumn("strategy", F.when(announced, 0).when(urls.is_pdf(F.col("link")), 1)).where("strategy is not null")
    return ranked.groupBy(key, "link").agg(F.min(F.struct("strategy", "pos")).alias("at")).select(key, "link", "at.strategy", "at.pos")


def choose(pages: DataFrame, found: DataFrame, key: str = "page_id") -> DataFrame:
    """key, choice: the first candidate that is a PDF, else the first, else the page's own URL."""
    first = found.groupBy(key).agg(F.min_by("link", F.struct((~urls.is_pdf(F.col("link"))).alias("no"), "strategy", "pos")).alias("_link"))
    return pages.select(key, "url").join(first, key, "left").select(key, F.coalesce("_link", "url").alias("choice"))


def raw_pdf_urls(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, link, score of PDF URLs anywhere in the HTML: absolute, protocol-relative and rooted ones, as a set."""
    found = [F.regexp_extract_all("html", F.lit(p), F.lit(0)) for p in (r"(?iU)https?://[^\s\"'<>]+\.pdf\b", r"(?iU)(?<!:)//[^\s\"'<>]+\.pdf\b", r"(?iU)(?<![a-zA-Z0-9])/[^\s\"'<>]+\.pdf\b")]
    each = pages.select(key, "url", F.explode(F.array_distinct(F.concat(*found))).alias("hit"))
    each = each.withColumn("link", urls.absolute(F.col("url"), F.col("hit"))).withColumn("score", urls.raw_link_score(F.col("link")))
    return each.where("score > 0").select(key, "link", "score").distinct()


#: Characters of a needle that it is looked up by.
GRAM = 3


def dispatch(pages: DataFrame, drivers: DataFrame, key: str = "page_id") -> DataFrame:
    """key, driver: the registered driver (priority, name, needle) of least priority whose needle the URL's host holds.

    Needles are looked up by their first characters among the substrings of each distinct host, then compared whole.
    """
    host = F.lower(urls.part(F.col("url"), 2))
    told = pages.select(key, host.alias("_host"))
    places = F.sequence(F.lit(1), F.greatest(F.length("_host"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*(F.substring(F.col("_host"), i, F.lit(n)) for n in range(GRAM + 1))))))
    hosts = told.select("_host").distinct().where("_host IS NOT NULL").select("_host", F.explode(grams).alias("_gram"))
    hits = hosts.join(drivers.withColumn("_gram", F.left("needle", F.lit(GRAM))), "_gram").where(F.contains("_host", "needle"))
    best_ = hits.groupBy("_host").agg(F.min_by("name", "priority").alias("driver"))
    return told.join(best_, "_host", "left").select(key, "driver")


def first_verified(links: DataFrame, key: str) -> DataFrame:
    """Each key's first link (priority) that is verified, with the greater of base and verified confidence."""
    ok = links.where("verified").withColumn("confidence", F.greatest("base", F.coalesce("found", F.lit(0.0))))
    return ok.groupBy(key).agg(F.min_by(F.struct("link", "confidence"), "priority").alias("b")).select(key, "b.*")
