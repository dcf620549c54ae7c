"""Issues named in a document's lines (doc_id, pos, line): tagged ones, watch-outs, and follow-up questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts

# Simplified terms for parts of a building and for what may be wrong with them.
COMPONENT_TERMS = (
    "bad", "baderom", "vaskerom", "vatrm", "kjokken", "kjokkeninnredning", "kjeller", "loft", "tak", "taket", "taktekking", "takstein", "takbelegg", "pipe", "piper",
    "skorstein", "vindu", "vinduer", "dorer", "ytterdor", "ytterdoer", "innervegg", "yttervegg", "vegg", "vegger", "gulv", "bjelkelag", "grunnmur", "fundament", "drener",
    "radon", "ventilasjon", "avtrekk", "terrasse", "balkong", "veranda", "rekkverk", "trapp", "fasade", "kledning", "isolasjon", "mur", "betong", "puss", "sikringsskap",
    "elanlegg", "elektrisk", "elektro", "varmtvannsbereder", "bereder", "ror", "avlop", "avloppsror", "sanitar", "sluk", "membran", "vatrom", "garasje", "carport", "bod",
    "takstol", "bjaelke", "loftsbjelke", "nedlop", "takrenne", "renne", "yttertett", "tegl",
)
ISSUE_TERMS = (
    "ikke godkjent", "fukt", "fuktskade", "fuktmerke", "lekk", "rate", "raate", "mugg", "sopp", "skade", "skader", "sprekk", "sprekker", "defekt", "mangel", "avvik",
    "korrosjon", "rust", "utett", "svikt", "brudd", "fare", "risiko", "eldre", "gammel", "slitt", "slitasje", "oppgradering", "utbedring", "rehab", "oppussing", "avrenning",
    "setnings", "skjev", "ubehandlet", "sprukket", "manglende", "ukjent", "byttes", "bytte", "ma skiftes", "utskift", "brann", "brannfare", "kondens", "tett",
)
QUESTIONS = {
    "tg3": "Når utbedres «%s», og hvem dekker kostnaden?",
    "watch": "Hva er risiko og neste steg for «%s»?",
    "tg2": "Trengs tiltak snart for «%s», og hva er kostnaden?",
    "upgrade": "Er det budsjettert for «%s», og når gjøres det?",
}
MOST_BLOCK, NEXT_LINES = 300, 3


def normalise(text: Column) -> Column:
    """Without bullet, grade marks, repeated spaces, edge punctuation and enclosing brackets."""

    def without_grades(t: Column) -> Column:
        out = t
        for pattern in (r"\btilstands?grad\s*\d\b[:\-–—\s]*", r"\bTG\s*[-/]*\s*(?:0|1|2|3|iu)\b[:\-–—\s]*", r"\bTG\s*(?:0|1|2|3)\b"):
            out = F.regexp_replace(out, f"(?iU){pattern}", "")
        return F.when(t.rlike(r"[Tt][Gg]|[Gg][Rr][Aa][Dd]"), out).otherwise(t)  # the patterns are dear, and most texts have no mark

    out = texts.let(texts.without_bullet(F.trim(text)), without_grades)
    out = texts.trim_edges(F.regexp_replace(out, r"(?U)\s{2,}", " "))
    return texts.let(out, lambda t: F.when(F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")")), F.trim(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t))


def _term_pattern(terms: tuple[str, ...]) -> str:
    """Matches simplified text in which a term occurs: one of several words anywhere, a single one as a prefix of a token or the other way round."""
    end = "(?![a-z0-9])"

    def rest(suffixes: set[str]) -> str:
        if "" in suffixes:
            return ""
        own = [c + rest({s[1:] for s in suffixes if s[0] == c}) for c in sorted({s[0] for s in suffixes}) if re.match("[a-z0-9]", c)]
        return f"(?:{'|'.join([*own, end])})"

    singles = {t for t in terms if " " not in t}
    token = [rf"(?<![a-z0-9])(?=[a-z0-9]){rest(singles)}"] if singles else []
    return "|".join([*token, *(rf"\Q{t}\E" for t in terms if " " in t)]) or "(?!)"


def is_specific(text: Column, components: tuple[str, ...] = COMPONENT_TERMS, issues: tuple[str, ...] = ISSUE_TERMS) -> Column:
    """At least 8 characters, and an issue with either a component or 4 different words."""

    return texts.let(texts.simplify(text), lambda s: _specific(s, components, issues))


def _specific(simple: Column, components: tuple[str, ...] = COMPONENT_TERMS, issues: tuple[str, ...] = ISSUE_TERMS) -> Column:
    """is_specific() of simplified text."""
    return (F.length(simple) >= 8) & simple.rlike(_term_pattern(issues)) & (simple.rlike(_term_pattern(components)) | (F.size(F.array_distinct(texts.tokens(simple))) >= 4))


def is_specific_entry(text: Column, components: tuple[str, ...] = (*COMPONENT_TERMS, "grunn"), issues: tuple[str, ...] = ISSUE_TERMS, always: str = "ikke godkjent") -> Column:
    """The saved pages' rule: at least 8 characters, and `always`, or a component with an issue or in 3 words or more.

    Terms of one word are whole tokens here, those of several lie within the text; ß ends a token. Null and blank text is not specific.
    """

    def judged(p: Column) -> Column:
        simple, words = p["simple"], p["words"]

        def named(terms: tuple[str, ...]) -> Column:
            hit = F.arrays_overlap(words, F.array(*(F.lit(t) for t in terms if " " not in t)).cast("array<string>"))
            for t in terms:
                if " " in t:
                    hit = hit | F.contains(simple, F.lit(t))
            return hit

        return (F.length(simple) >= 8) & (named((always,)) | (named(components) & (named(issues) | (p["n"] >= 3))))

    facts = lambda t: F.struct(texts.simplify(t, F.lower).alias("simple"), texts.tokens(texts.simplify(t, F.lower)).alias("words"), F.size(F.split(t, r"(?U)\s+")).alias("n"))
    return F.coalesce(texts.let(texts.let(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), facts), judged), F.lit(False))


def blocks(lines: DataFrame) -> DataFrame:
    """lines with `block`: the line and the next three, up to one with a grade mark, or until over 300 characters."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    one = F.struct("line", F.length("line").alias("n"), F.coalesce(F.col("line").rlike(r"(?iU)\bTG\s*\d\b"), F.lit(False)).alias("graded"))
    out = lines.withColumn("_0", one)
    out = out.withColumns({f"_{i}": F.lead("_0", i).over(w) for i in range(1, NEXT_LINES + 1)})
    block, size, taken = F.col("line"), F.length("line"), F.lit(True)
    for i in range(1, NEXT_LINES + 1):
        x = F.col(f"_{i}")
        taken = taken & (size <= MOST_BLOCK if i > 1 else F.lit(True)) & x["line"].isNotNull() & ~x["graded"]
        block = F.concat(block, F.when(taken, F.concat(F.lit(" "), x["line"])).otherwise(""))
        size = size + 1 + x["n"]
    return out.withColumn("block", block).drop(*(f"_{i}" for i in range(NEXT_LINES + 1)))


def _specific_blocks(found: DataFrame, *extra: Column, **terms) -> DataFrame:
    """doc_id, pos, extra, plain and key of the blocks whose normal form is specific. It is computed within the generator, once a block: a filter on a column computes it anew."""

    def kept(plain: Column) -> Column:
        one = lambda key: F.when((plain != "") & _specific(key, **terms), F.array(F.struct(plain.alias("plain"), key.alias("key"))))
        return texts.let(texts.simplify(plain), one)

    return found.select("doc_id", "pos", *extra, F.explode(texts.let(normalise(F.col("block")), kept)).alias("_k")).select("*", "_k.*").drop("_k")


def _first_of_key(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def tagged(lines: DataFrame, grade: int, **terms) -> DataFrame:
    """doc_id, pos, raw, plain, key: the specific blocks that a line with the grade starts, each key once."""
    found = blocks(lines).where(F.col("line").rlike(rf"(?iU)\bTG\s*{grade}\b"))
    return _first_of_key(_specific_blocks(found, texts.collapse(F.col("block")).alias("raw"), **terms))


def watch_outs(lines: DataFrame, exclude: DataFrame, limit: int = 12, **terms) -> DataFrame:
    """doc_id, rank, snippet: the first specific blocks that name an issue, those with an excluded key (doc_id, key) left out."""
    issues = terms.get("issues", ISSUE_TERMS)
    found = blocks(lines).where(texts.has_any(texts.simplify(F.col("line")), issues))
    found = _specific_blocks(found, **terms).withColumn("key", F.trim("key")).withColumnRenamed("plain", "snippet")
    kept = _first_of_key(found.join(exclude.select("doc_id", "key"), ["doc_id", "key"], "left_anti"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select("doc_id", "rank", F.substring("snippet", 1, 200).alias("snippet"))


def shorten(text: Column, most_words: int = 24) -> Column:
    """"Component: reason." of an issue: its first sentence (two if under 12 words), at most so many words."""
    cut = r"(?s)^(.*?)[:–—\-](.*)$"
    clean_word = lambda w: F.regexp_replace(w, r"^[.,;:–—\-]+|[.,;:–—\-]+$", "")

    def halves(t: Column) -> Column:
        split = t.rlike(cut)
        reason = texts.collapse(F.when(split, F.regexp_extract(t, cut, 2)).otherwise(t))
        return F.struct(F.when(split, texts.trim_edges(F.regexp_extract(t, cut, 1))).otherwise("").alias("component"), texts.let(reason, lambda r: F.when(r == "", F.trim(t)).otherwise(r)).alias("reason"))

    def picked(reason: Column) -> Column:
        def of(parts: Column) -> Column:
            one, two = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
            return F.when(one.isNull(), reason).when((F.size(F.split(one, " ")) < 12) & two.isNotNull(), F.concat(one, F.lit(", "), two)).otherwise(one)

        words = F.filter(F.transform(F.split(texts.let(texts.sentences(reason), of), " "), clean_word), lambda w: w != "")
        return F.array_join(F.slice(words, 1, most_words), " ")

    def joined(p: Column) -> Column:
        both = lambda c: F.when(p["component"] == "", c).when(c == "", texts.capital(p["component"])).otherwise(F.concat(texts.capital(p["component"]), F.lit(": "), texts.capital(c)))
        whole = texts.capital(texts.trim_edges(texts.let(picked(p["reason"]), both)))
        return texts.let(whole, lambda t: F.when(t == "", "").otherwise(F.concat(t, F.lit("."))))

    return texts.let(texts.let(text, halves), joined)


def question_subject(text: Column) -> Column:
    out = F.regexp_replace(F.trim(text), r"^[\-*•]+\s*", "")
    for pattern in (r"\bTG\s*\d[:\-]?\s*", r"^\d+[.)]\s*"):
        out = F.regexp_replace(out, f"(?iU){pattern}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s{2,}", " "), r"^[ \t\-–—:;.]+|[ \t\-–—:;.]+$", "")
    return texts.ellipsis(out, 160)


def questions(items: DataFrame, limit: int = 6) -> DataFrame:
    """doc_id, rank, question from items (doc_id, category, pos, text): by category in fixed order, each subject once."""
    order = list(QUESTIONS)
    ranked = items.withColumn("_c", F.array_position(F.array(*map(F.lit, order)), F.col("category")))
    ranked = ranked.withColumn("subject", question_subject(F.col("text"))).where((F.col("subject") != "") & (F.col("_c") > 0))
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", texts.fold_case(F.col("subject"))).orderBy("_c", "pos"))).where("_n = 1")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("_c", "pos"))).where(F.col("rank") <= limit)
    template = F.try_element_at(F.create_map(*(F.lit(x) for p in QUESTIONS.items() for x in p)), F.col("category"))
    return ranked.select("doc_id", "rank", F.replace(template, F.lit("%s"), F.col("subject")).alias("question"))
