"""Condition findings from a document's segments (doc_id, pos, text, source).

A trigger line (a grade mark or a grade's header) owns the lines that follow it up to the next boundary: another
trigger, a summary header, a blank line or a section break. Lines are numbered and dealt into bands of positions, and
triggers meet the lines that they own, and those just before them, in equi-joins on (document, band): no document is in
one task, and what is dear to compute is computed for the lines that a trigger needs, after the triggers are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..sources import staging

# Components, and words that decide whether and how a finding is kept.
STANDARD_COMPONENTS = ("Bad", "Våtromsmembran", "Drenering", "Tak", "Vinduer", "Yttervegger", "Ventilasjon", "Elektro/Sikringsskap", "Bereder", "Radon", "Pipe/ildsted")
#: Whole words or beginnings of words, without marks; "tak" counts as a whole word only.
COMPONENT_PREFIXES = (
    ("Bad", ("bad", "bader", "wc", "dusj")),
    ("Våtromsmembran", ("vatrom", "membran", "sluk", "tettsjikt", "smoremembran")),
    ("Drenering", ("drener", "grunnmur", "fuktsik", "drens")),
    ("Tak", ("taktek", "takren", "takkon", "takste", "undertak", "yttertak", "saltak", "pulttak", "tak", "taket")),
    ("Vinduer", ("vindu", "vindus", "vindauge")),
    ("Yttervegger", ("yttervegg", "fasad", "kledning", "ytterkled")),
    ("Ventilasjon", ("ventil", "avtrekk", "lufting", "inneklima")),
    ("Elektro/Sikringsskap", ("elektr", "sikring", "elanlegg", "jordfeil", "sikringsskap", "kursfort")),
    ("Bereder", ("bereder", "varmtvann", "vvb")),
    ("Radon", ("radon",)),
    ("Trapp", ("trapp", "handlop", "handloper")),
    ("Pipe/ildsted", ("pipe", "ildsted", "skorstein", "pipelop", "peis", "skorste")),
)
IMPORTANT_COMPONENTS = (
    "bad", "våtrom", "vatrom", "membran", "drener", "taknedløp", "grunnmur", "kjeller", "tak", "taktek", "undertak", "elektro", "sikring", "jordfeil", "el-anlegg", "elanlegg",
    "varmtvann", "bereder", "pipe", "ildsted", "skorstein", "radon", "ventilasjon", "avløp", "avlop", "rør", "ror", "brann", "sprinkler", "sluk",
)
IMPORTANT_REASONS = (
    "fukt", "fuktskade", "fuktmerke", "lekk", "lekkasje", "vann", "drener", "taknedløp", "grunnmur", "kjeller", "membran", "sluk", "fall mot sluk", "fall til sluk", "bakfall",
    "avløp", "avlop", "rør", "ror", "elektr", "sikring", "jordfeil", "brann", "ildsted", "pipe", "skorstein", "radon", "ventilasjon", "råte", "raate", "mugg", "sopp", "kondens",
    "korrosjon", "rust", "setning", "bærekonstruksjon", "konstruksjon", "utett", "teknisk rom", "varmtvann", "mangler", "handløper", "håndløper", "bom",
)
COSMETIC = ("riper", "små hull", "hakk", "merker", "overflate", "maling", "sparkel", "tapet", "kosmetisk", "små skader", "løse fliser", "flateavvik", "overflateslitasje")
NEGATIVE = ("ingen avvik", "ingen forhold", "ingen registrert", "ingen synlige skader", "normal slitasje")
PRIORITY = ("mangler", "fukt", "lekk", "lekkasje", "råte", "mugg", "bom", "fall", "ikke godkjent", "utett", "taknedløp")
SKIP_TRIGGERS = ("tilstandsgrad", "fordeling av", "anslag på utbedringskostnad", "anslag for utbedringskostnad", "ingen umiddelbare kostnader", "tg0", "tg1", "tg iu", "tg-iu", "avvik som ikke krever", "tilstandsgrader")
DEFINITIONS = (
    "tilstandsgrad", "bygningsdelen", "konstruksjoner som ikke er undersøkt", "fordeling av tilstandsgrader", "fordeling av", "anslag på utbedringskostnad",
    "anslag for utbedringskostnad", "boligbygg", "gå til side", "ingen umiddelbare kostnader", "tiltak mellom", "tiltak over", "tiltak under",
)
SECTION_BREAKS = ("INFORMASJON", "VEDLEGG", "BOLIGSALGSRAPPORT", "TILSTANDSRAPPORT", "OPPDRAG", "BOLIGSELGERFORSIKRING", "BUDREGLEMENT", "BILDER", "INNHOLD", "SIDE")
HEADERS = {3: "store eller alvorlige avvik", 2: "avvik som kan kreve tiltak"}
SUMMARY_HEADER, SUMMARY_BLOCKS, SUMMARY_WORD = "sammendrag av boligens tilstand", ("forhold som har fått", "bygningsdeler med"), "oppsummering"
SKIP_REASONS = ("vedlagt salgsoppgaven", "i tillegg kan det gis", "fremlagt dokumentasjon")
LABEL_OVERRIDES = (
    (r"taknedløp[^.]*over bakken", "Åpne taknedløp"),
    (r"mangler\s+håndløper", "Manglende håndløper"),
    (r"fall[^.]{0,80}sluk", "Lavt slukfall"),
    (r"\bbom\b[^.]{0,80}flis", "Løs gulvflis"),
    (r"råte", "Råteskade"),
    (r"mugg", "Muggfare"),
    (r"ikke godkjent", "Ikke godkjent"),
    (r"lekk", "Lekkasjerisiko"),
)
LABEL_STOPWORDS = (
    "er", "som", "den", "det", "de", "til", "for", "med", "mot", "fra", "over", "under", "mellom", "innen", "innenfor", "utenfor", "og", "men", "eller", "at", "på", "i", "å", "har",
    "skal", "kan", "må", "bør", "blir", "ble", "blitt", "enn", "en", "et", "av", "ved", "mer", "halvparten", "side", "tg2", "tg3",
)
LABEL_SIGNALS = (
    "fukt", "lekk", "lekkasje", "lekkasjer", "rate", "mugg", "mangler", "skade", "skader", "avvik", "sluk", "fall", "bom", "rust", "korrosjon", "svikt", "ikke", "godkjent", "brann",
    "drenering", "grunnmur", "kjeller", "tak",
)
UNKNOWN, MOST_REASON, BACK_REASON, BACK_COMPONENT = "Ukjent", 220, 12, 5
_GRADE = r"(?iU)(?<!\w)TG\s*[:\-]?\s*"


def level(text: Column) -> Column:
    """3 or 2 for a trigger line, an explicit grade before a header and 3 before 2; else null."""
    low = F.lower(text)
    marked = F.when(text.rlike(_GRADE + r"3\b"), 3).when(text.rlike(_GRADE + r"2\b"), 2)
    return marked.when(F.contains(low, F.lit(HEADERS[3])), 3).when(F.contains(low, F.lit(HEADERS[2])), 2)


def is_section_break(text: Column) -> Column:
    return texts.has_any(F.upper(text), SECTION_BREAKS) | text.rlike(r"(?U)^\s*\d+[.)]")


_PREFIX_OF = {prefix: name for name, prefixes in COMPONENT_PREFIXES for prefix in prefixes}
_PREFIXES = "(?<![a-z0-9])(" + "|".join("tak(?![a-z0-9])" if p == "tak" else p for p in _PREFIX_OF) + ")"


def find_component(text: Column) -> Column:
    """The component whose word comes first in the text, or null: one search for all words, those of the first component first."""
    names = F.create_map(*(F.lit(x) for pair in _PREFIX_OF.items() for x in pair))
    return F.try_element_at(names, F.regexp_extract(F.lower(texts.strip_marks(F.lower(text))), _PREFIXES, 1))


#: What stands before the first [.!?] that follows anything but edges of a sentence.
FIRST_SENTENCE = r"^[ .,:;–—\-!?]*([^.!?]+)"


def clean_reason(text: Column) -> Column:
    """The first sentence of a reason, without what it advises; empty if nothing worth telling remains."""
    out = texts.without_bullet(texts.collapse(text))
    out = F.regexp_replace(out, r"(?iU)^(?:Forhold som har fått|Bygningsdeler med)\s+[^:]{0,150}?Oppsummering\s*[:\-]*\s*", "")
    out = F.regexp_replace(out, r"(?iU)^Oppsummering(?: av)?\s+[^:]{0,120}?[:\-]\s*", "")
    out = texts.trim_edges(F.try_element_at(F.split(out, r"(?iU)\b(?:Tiltak|Konsekvens|Arsak|Anbefaling)\b"), F.lit(1)))
    out = texts.let(out, lambda t: texts.trim_edges(F.coalesce(texts.filled(F.regexp_extract(t, FIRST_SENTENCE, 1)), t)))
    out = texts.ellipsis(texts.let(out, lambda t: F.when(t.rlike(r"^\p{L}"), texts.capital(t)).otherwise(t)), MOST_REASON)

    def told(t: Column) -> Column:
        low = texts.fold_case(t)
        bad = (t == "") | F.startswith(low, F.lit(SUMMARY_WORD)) | F.startswith(low, F.lit("type ")) | texts.has_any(low, SKIP_REASONS)
        return F.when(bad | t.isNull(), "").when(F.endswith(t, F.lit(".")), t).otherwise(F.concat(t, F.lit(".")))

    return texts.let(out, told)


def is_relevant(original: Column, component: Column) -> Column:
    """An important word in the reason, or an important component whose reason is neither cosmetic nor a denial."""

    def counts(low: Column) -> Column:
        hit = texts.has_any(low, IMPORTANT_REASONS)
        return (low != "") & (hit | (texts.has_any(texts.fold_case(component), IMPORTANT_COMPONENTS) & ~texts.has_any(low, COSMETIC) & ~texts.has_any(low, NEGATIVE)))

    return texts.let(texts.fold_case(original), counts)


def inline_reason(text: Column) -> Column:
    """What stands around the grade mark, joined as the mark was; empty if that is but a header."""
    mark = _GRADE + r"[23][:\-\s.]*"
    edges = r"^[ \-—–:•.;]+|[ \-—–:•.;]+$"

    def cut(s: Column) -> Column:
        at = F.instr(s["t"], s["m"])
        before = F.regexp_replace(F.substring(s["t"], F.lit(1), at - 1), edges, "")
        return F.struct(s["m"].alias("m"), before.alias("before"), F.trim(F.substr(s["t"], at + F.length(s["m"]))).alias("after"))

    def joined(s: Column) -> Column:
        mark_ = F.when(F.contains(s["m"], F.lit("-")), " - ").when(F.contains(s["m"], F.lit(":")), ": ").otherwise(" ")
        both = F.when((s["before"] != "") & (s["after"] != ""), F.concat(s["before"], mark_, s["after"])).otherwise(F.concat(s["before"], s["after"]))
        return F.regexp_replace(F.coalesce(F.when(s["m"].isNotNull(), both), F.lit("")), edges, "")

    header = lambda t: F.regexp_replace(texts.fold_case(t), r"^[ .:;\-]+|[ .:;\-]+$", "").isin(*HEADERS.values())
    found = texts.let(F.trim(text), lambda t: F.struct(t.alias("t"), texts.filled(F.regexp_extract(t, mark, 0)).alias("m")))
    return texts.let(texts.let(texts.let(found, cut), joined), lambda t: F.when(header(t), "").otherwise(t))


def component_label(text: Column) -> Column:
    """The text before a colon, else a line of at most six words (five of them); a trailing number goes."""

    def short(clean: Column) -> Column:
        few = texts.let(F.split(texts.collapse(clean), " "), lambda words: F.when(F.size(words) <= 6, F.array_join(F.slice(words, 1, 5), " ")))
        return F.when(F.contains(clean, F.lit(":")), F.trim(F.substring_index(clean, ":", 1))).otherwise(few)

    label = texts.let(F.regexp_replace(F.trim(text), r"^[•\-* ]+", ""), short)
    return texts.filled(F.trim(F.regexp_replace(label, r"(?U)\s*[\-–—]+\s*\d+$", "")))


def _points(cleaned: Column) -> Column:
    """What a reason is worth by itself, when it stands in for a trigger's own."""
    low = texts.fold_case(cleaned)
    has = lambda w: F.contains(low, F.lit(w))
    return F.lit(1) + texts.has_any(low, IMPORTANT_REASONS).cast("int") * 2 + (has("fall") & has("sluk")).cast("int") * 2 + has("bom").cast("int") + has("mangler").cast("int")


#: Lines of a document that share a band.
BAND = 64


def _band(n: Column) -> Column:
    return F.floor(n / BAND).cast("long")


def numbered(segments: DataFrame) -> DataFrame:
    """doc_id, pos, text, source with n (0, 1, ... in order of pos, whatever its gaps), band, level and boundary, and d, a key of the document that is never null.

    Numbers come from counts of each stretch of positions, so that only counts of a document meet in one task.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    base = segments.select(key.alias("d"), "doc_id", F.col("pos").cast("long").alias("pos"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), "source", _band(F.col("pos")).alias("part"))
    counts = base.groupBy("d", "part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("d", "part").orderBy("pos", "text", "source")) - 1
    out = base.join(counts.select("d", "part", before.alias("_before")), ["d", "part"]).withColumn("n", F.col("_before") + place)
    out = out.withColumns({"level": level(F.col("text")), "band": _band(F.col("n"))})
    summary = F.col("level").isNull() & F.contains(F.lower("text"), F.lit(SUMMARY_HEADER))
    return out.withColumn("boundary", (F.col("text") == "") | F.col("level").isNotNull() | summary | is_section_break(F.col("text"))).drop("part", "_before")


def _triggers(lines: DataFrame) -> DataFrame:
    """Trigger lines with `next`, the number of the next boundary or of the document's end: within the band by its lines, beyond it by the first boundary of each band."""
    marks = lines.where("boundary")
    ends = lines.groupBy("d").agg((F.max("n") + 1).alias("first")).select("d", (_band(F.col("first")) + 1).alias("band"), "first")
    firsts = marks.groupBy("d", "band").agg(F.min("n").alias("first")).unionByName(ends)
    after = firsts.select("d", "band", F.lead("first").over(Window.partitionBy("d").orderBy("band")).alias("after"))
    near = F.lead("n").over(Window.partitionBy("d", "band").orderBy("n"))
    out = marks.withColumn("near", near).join(after, ["d", "band"]).withColumn("next", F.coalesce("near", "after")).drop("near", "after", "boundary")
    return out.where(F.col("level").isNotNull() & ~texts.has_any(texts.fold_case(F.col("text")), SKIP_TRIGGERS))


def _owned(triggers: DataFrame, lines: DataFrame) -> DataFrame:
    """d, at (the trigger's number), level and the trigger's lines: all bands that it reaches, and there the lines before the next boundary."""
    reach = triggers.where("next > n + 1").select("d", F.col("n").alias("at"), "next", "level", F.explode(F.sequence(_band(F.col("n") + 1), _band(F.col("next") - 1))).alias("band"))
    inside = lines.where("NOT boundary").select("d", "doc_id", "band", "n", "pos", "text", "source")
    return inside.join(reach, ["d", "band"]).where("n > at AND n < next").drop("band", "next")


def _facts(lines: DataFrame) -> DataFrame:
    """What a line is worth to a trigger after it."""
    low = texts.fold_case(F.col("text"))
    out = lines.withColumns({
        "cleaned": clean_reason(F.col("text")), "hit": texts.has_any(low, IMPORTANT_REASONS), "soft": texts.has_any(low, COSMETIC) | texts.has_any(low, NEGATIVE),
        "aside": F.contains(low, F.lit(SUMMARY_WORD)) | F.startswith(low, F.lit("er det")), "label_component": find_component(F.coalesce(component_label(F.col("text")), F.lit(""))),
    })
    return out.withColumns({"points": _points(F.col("cleaned")), "own_component": find_component(F.col("cleaned"))})


def _earlier(triggers: DataFrame, lines: DataFrame) -> DataFrame:
    """d, at, before: the facts of the lines before each trigger, nearest first. They lie in the trigger's band or the one before."""
    at = F.col("n")
    bands = F.array_distinct(F.array(_band(F.greatest(at - BACK_REASON, F.lit(0))), _band(F.greatest(at - 1, F.lit(0)))))
    wanted = triggers.select("d", at.alias("at"), F.explode(bands).alias("band"))
    near = _facts(lines.join(wanted.select("d", "band").distinct(), ["d", "band"], "left_semi"))
    one = F.struct(F.col("n"), F.struct("text", "source", "boundary", "cleaned", "own_component", "label_component", "hit", "soft", "aside", "points").alias("p"))
    joined = near.join(wanted, ["d", "band"]).where((F.col("n") < F.col("at")) & (F.col("n") >= F.col("at") - BACK_REASON))
    return joined.groupBy("d", "at").agg(F.transform(F.reverse(F.array_sort(F.collect_list(one))), lambda x: x["p"]).alias("before"))


def _fallback(before: Column, component: Column, important: Column) -> Column:
    """(score, reason, source, original, match): the best of the lines before a trigger."""
    none = F.struct(F.lit(-1).alias("score"), F.lit("").alias("reason"), F.lit("").alias("source"), F.lit("").alias("original"), F.lit("").alias("match"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        stop = p["boundary"] & (p["text"] != "")
        usable = (p["text"] != "") & ~stop & ~p["aside"] & (p["cleaned"] != "") & (p["hit"] | (important & ~p["soft"]))
        same = F.coalesce(p["own_component"] == component, F.lit(False))
        points = p["points"] + F.when(same, 2).when(p["own_component"].isNotNull(), 1).otherwise(0)
        better = usable & ((points > s["score"]) | ((points == s["score"]) & (F.length(p["cleaned"]) > F.length(s["reason"]))))
        new = F.struct(points.alias("score"), p["cleaned"].alias("reason"), p["source"].alias("source"), p["text"].alias("original"), F.coalesce(p["own_component"], F.lit("")).alias("match"), (same & (points >= 5)).alias("done"))
        ended = F.struct(*(s[n].alias(n) for n in ("score", "reason", "source", "original", "match")), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(stop, ended).when(better, new).otherwise(s)

    return F.aggregate(before, none, step)


def _summary_findings(owned: DataFrame, triggers: DataFrame) -> DataFrame:
    """Findings of summary blocks: below each "oppsummering" line, the first line, or two if it has no full stop."""
    blocks = triggers.where(texts.has_any(texts.fold_case(F.col("text")), SUMMARY_BLOCKS)).select("d", F.col("n").alias("at"), F.col("pos").alias("place"))
    inside = owned.join(blocks, ["d", "at"])
    w = Window.partitionBy("d", "at").orderBy("n")
    head = F.contains(texts.fold_case(F.col("text")), F.lit(SUMMARY_WORD))
    inside = inside.withColumn("_sub", F.sum(head.cast("int")).over(w)).where("_sub > 0")
    sub = Window.partitionBy("d", "at", "_sub").orderBy("n")
    inside = inside.withColumns({"_n": F.row_number().over(sub) - 1, "_before": F.lag("text").over(sub), "_title": F.first("text").over(sub)})
    taken = inside.where((F.col("_n") == 1) | ((F.col("_n") == 2) & ~F.contains("_before", F.lit("."))))
    ordered = F.array_sort(F.collect_list(F.struct("n", "text", "source")))
    found = taken.groupBy("d", "doc_id", "at", "place", "_sub", "level").agg(F.first("_title").alias("title"), ordered.alias("l"))
    found = found.select("d", "doc_id", "at", "place", "level", F.col("_sub").alias("sub"), component_label(F.col("title")).alias("label"), texts.collapse(F.array_join(F.transform("l", lambda x: x["text"]), " ")).alias("original"), F.element_at("l", 1)["source"].alias("source"))
    found = found.withColumns({"component": F.coalesce(find_component(F.coalesce("label", F.lit(""))), "label", F.lit(UNKNOWN)), "reason": clean_reason(F.col("original"))})
    return found.where((F.col("reason") != "") & is_relevant(F.col("original"), F.col("component")))


def _told(triggers: DataFrame, owned: DataFrame, summaries: DataFrame) -> DataFrame:
    """Triggers with what they and their lines say: original, reason, component (null if the text names none) and first_label."""
    follow = owned.groupBy("d", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("f"))
    t = triggers.withColumn("at", F.col("n")).join(summaries.select("d", "at").distinct(), ["d", "at"], "left_anti").join(follow, ["d", "at"], "left")
    marked = F.col("text").rlike(_GRADE + r"[23]\b")
    t = t.withColumn("f", F.coalesce("f", F.array().cast("array<string>")))

    def said(parts: Column, inline: Column) -> Column:
        return F.struct(inline.alias("inline"), parts.alias("parts"), texts.collapse(F.array_join(parts, " ")).alias("original"))

    own = F.when(marked, inline_reason(F.col("text"))).otherwise("")
    own = texts.let(own, lambda i: texts.let(F.filter(F.concat(F.array(i), F.col("f")), lambda x: x != ""), lambda parts: said(parts, i)))
    # Rows go by a filter of the array, not of the table: that would be pushed down with a second copy of all that it reads.
    kept = F.filter(F.array(own), lambda s: (F.size(s["parts"]) > 0) & ~texts.has_any(texts.fold_case(s["original"]), DEFINITIONS))
    t = t.withColumn("said", F.explode_outer(kept)).where("said IS NOT NULL").select("*", "said.*").drop("said")
    labelled = F.transform("f", lambda x: find_component(F.coalesce(component_label(x), F.lit(""))))
    later = F.try_element_at(F.filter(labelled, lambda c: c.isNotNull()), F.lit(1))
    t = t.withColumns({"first_label": component_label(F.element_at("parts", 1)), "reason": clean_reason(F.col("original"))})
    t = t.withColumn("named", F.coalesce(find_component(F.col("original")), find_component(F.coalesce(component_label(F.col("inline")), F.lit(""))), later))
    return t.select("d", "doc_id", "n", "pos", "level", "source", "original", "reason", "first_label", "named", _ok(F.col("named")).alias("ok"))


def _ok(component: Column) -> Column:
    return component.isNotNull() & (F.col("reason") != "") & is_relevant(F.col("original"), component)


def candidates(segments: DataFrame) -> DataFrame:
    """doc_id, at, sub, level, component, reason, source: one row for each finding, before duplicates are joined."""
    lines = staging.staged(numbered(segments), "lines")
    triggers = staging.staged(_triggers(lines), "marks")  # three steps read it
    owned = _owned(triggers, lines)
    summaries = staging.staged(_summary_findings(owned, triggers), "summaries")
    told = staging.staged(_told(triggers, owned, summaries), "triggers")
    # Only triggers whose own lines name no component or no reason that counts look back.
    open_ = told.where("NOT ok").join(_earlier(told.where("NOT ok"), lines).withColumnRenamed("at", "n"), ["d", "n"], "left")
    open_ = open_.withColumn("before", F.coalesce("before", F.expr("array()").cast(f"array<{_FACT}>")))
    near = F.try_element_at(F.filter(F.transform(F.slice("before", 1, BACK_COMPONENT), lambda p: p["label_component"]), lambda c: c.isNotNull()), F.lit(1))
    open_ = open_.withColumn("component", F.coalesce("named", near, "first_label", F.lit(UNKNOWN)))
    open_ = open_.withColumn("ok", _ok(F.col("component"))).withColumn("important", texts.has_any(texts.fold_case(F.col("component")), IMPORTANT_COMPONENTS))
    open_ = open_.withColumn("fb", _fallback(F.col("before"), F.col("component"), F.col("important"))).where(F.col("ok") | (F.col("fb.score") >= 0))
    swap = ~F.col("ok") & (F.col("component") == UNKNOWN) & (F.col("fb.match") != "")
    shown = lambda component, reason, source, sub, at: [F.col("doc_id"), at.alias("at"), sub.cast("long").alias("sub"), "level", component.alias("component"), reason.alias("reason"), source.alias("source")]
    plain = told.where("ok").select(*shown(F.col("named"), F.col("reason"), F.col("source"), F.lit(0), F.col("pos")))
    looked = open_.select(*shown(
        F.when(swap, F.col("fb.match")).otherwise(F.col("component")), F.when(F.col("ok"), F.col("reason")).otherwise(F.col("fb.reason")),
        F.when(F.col("ok") | (F.col("fb.source") == ""), F.col("source")).otherwise(F.col("fb.source")), F.lit(0), F.col("pos")))
    blocks = summaries.select(*shown(F.col("component"), F.col("reason"), F.col("source"), F.col("sub"), F.col("place")))
    return plain.unionByName(looked).unionByName(blocks)


_FACT = "struct<text:string,source:string,boundary:boolean,cleaned:string,own_component:string,label_component:string,hit:boolean,soft:boolean,aside:boolean,points:int>"


def reason_score(reason: Column) -> Column:
    low = texts.fold_case(reason)
    return F.when(F.startswith(low, F.lit("er ")), -2).otherwise(0) + F.when(texts.has_any(low, IMPORTANT_REASONS), 3).otherwise(0) + F.when(texts.has_any(low, PRIORITY), 2).otherwise(0) + F.least(F.floor(F.length(reason) / 40), F.lit(2)).cast("int")


def _keep_best(found: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The best row of each key, at the place of the key's first row."""
    w = Window.partitionBy("doc_id", *keys)
    out = found.withColumn("_n", F.row_number().over(w.orderBy(*order, "at", "sub"))).withColumn("_first", F.min(F.struct("at", "sub")).over(w)).where("_n = 1")
    return out.withColumn("at", F.col("_first.at")).withColumn("sub", F.col("_first.sub")).drop("_n", "_first")


def dedupe(found: DataFrame) -> DataFrame:
    """One row per (component, reason, level), then per (reason, level): a component named in the reason wins, then a known, then a longer one."""
    key = {"_c": texts.fold_case(F.col("component")), "_r": texts.collapse(texts.fold_case(F.col("reason")))}
    one = _keep_best(found.withColumns(key), ["_c", "_r", "level"], F.length("reason").desc())
    known = ~F.trim("_c").isin("", UNKNOWN.lower())
    named = known & F.contains("_r", texts.collapse(F.col("_c")))
    return _keep_best(one, ["_r", "level"], named.desc(), known.desc(), F.length("component").desc()).drop("_c", "_r")


def collapse_components(found: DataFrame) -> DataFrame:
    """One row per (component, level): the reason of highest score, then the longest, then the first."""
    keyed = found.withColumns({"_c": texts.fold_case(F.col("component")), "_s": reason_score(F.col("reason"))})
    return _keep_best(keyed, ["_c", "level"], F.col("_s").desc(), F.length("reason").desc()).drop("_c", "_s")


def extract(segments: DataFrame) -> DataFrame:
    """doc_id, at, sub, level, component, reason, source: the findings of each document."""
    return collapse_components(dedupe(candidates(segments)))


def report(segments: DataFrame) -> DataFrame:
    """doc_id, tg3, tg2 (arrays of komponent, grunn, kilde_side), missing (standard components without a finding), markdown."""
    found = extract(segments)
    ordered = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == n, F.struct("at", "sub", "component", "reason", "source")))), lambda x: F.struct(x["component"].alias("komponent"), x["reason"].alias("grunn"), x["source"].alias("kilde_side")))
    lists = segments.select("doc_id").distinct().join(found.groupBy("doc_id").agg(ordered(3).alias("tg3"), ordered(2).alias("tg2")), "doc_id", "left")
    empty = F.array().cast("array<struct<komponent:string,grunn:string,kilde_side:string>>")
    lists = lists.select("doc_id", F.coalesce("tg3", empty).alias("tg3"), F.coalesce("tg2", empty).alias("tg2"))
    named = F.transform(F.concat("tg3", "tg2"), lambda x: x["komponent"])
    body = lambda c, n: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["grunn"]), "\n")).otherwise(f"Ingen TG{n}-punkter funnet.")
    markdown = F.concat(F.lit("TG2\n"), body("tg2", 2), F.lit("\n\nTG3\n"), body("tg3", 3))
    return lists.withColumns({"missing": F.array_except(F.array(*map(F.lit, STANDARD_COMPONENTS)), named), "markdown": markdown})


def source_label(source: Column) -> Column:
    clean = F.trim(source)
    low = texts.fold_case(clean)
    number = F.regexp_extract(clean, r"\d+", 0)
    return (
        F.when(clean == "", "").when(clean.rlike("^[0-9]+$"), F.concat(F.lit("Tilstandsrapport side "), clean))
        .when(F.startswith(low, F.lit("side")), F.when(number != "", F.concat(F.lit("Tilstandsrapport side "), number)).otherwise("Tilstandsrapport"))
        .when(low.isin("salgsoppgave", "finn"), texts.capital(low)).otherwise(clean)
    )


def entry_text(level_: int, component: Column, reason: Column, source: Column) -> Column:
    """TG2 Component: reason (source), without the parts that are empty."""
    c, r = F.trim(component), F.trim(reason)
    head = F.concat_ws(": ", F.nullif(c, F.lit("")), F.nullif(r, F.lit("")))
    label = source_label(F.coalesce(source, F.lit("")))
    text = F.concat(F.lit(f"TG{level_} "), head, F.when(label != "", F.concat(F.lit(" ("), label, F.lit(")"))).otherwise(""))
    return F.when(head != "", text)


def format_entries(entries: Column, level_: int, limit: int = 8) -> Column:
    """The first texts of an array of (komponent, grunn, kilde_side), each once whatever its case."""
    shown = F.filter(F.transform(entries, lambda e: entry_text(level_, F.coalesce(e["komponent"], F.lit("")), F.coalesce(e["grunn"], F.lit("")), e["kilde_side"])), lambda x: x.isNotNull())
    return F.slice(texts.unique_first(shown, texts.fold_case), 1, limit)


def merge_lists(first: Column, second: Column, limit: int = 8) -> Column:
    """Both arrays in order, trimmed, blanks out, each text once whatever its case."""
    none = F.array().cast("array<string>")
    both = F.filter(F.transform(F.concat(F.coalesce(first, none), F.coalesce(second, none)), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(texts.unique_first(both, texts.fold_case), 1, limit)


def split_entry(text: Column) -> tuple[Column, Column]:
    """(component, reason) of "TG2 Component: reason"; without a separator all of it is the reason."""
    plain = F.regexp_replace(F.trim(text), r"(?iU)^\s*TG\s*[-:]?\s*\d\s*", "")
    cut = r"(?Us)^(.*?)\s*[:\-–]\s*(.*)$"
    has = plain.rlike(cut)
    return F.when(has, F.trim(F.regexp_extract(plain, cut, 1))).otherwise(""), F.when(has, F.trim(F.regexp_extract(plain, cut, 2))).otherwise(F.trim(plain))


def _plain(word: Column) -> Column:
    return F.translate(F.lower(word), "å", "a")


def label_tokens(text: Column, exclude: Column | None = None) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-zÆØÅæøå0-9][A-Za-zÆØÅæøå0-9\-]*)"), F.lit(1)), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    stop = F.array(*map(F.lit, LABEL_STOPWORDS))
    keep = lambda t: (t != "") & ~F.array_contains(stop, _plain(t)) & ~F.startswith(_plain(t), F.lit("tg")) & ((F.length(t) > 2) | (_plain(t) == "bom"))
    out = F.filter(found, keep)
    return out if exclude is None else F.filter(out, lambda t: ~F.array_contains(exclude, _plain(t)))


def label(component: Column, reason: Column, level_: Column) -> Column:
    """Up to three words for a finding: a stock phrase, else signal words of the reason first, with the component among them."""
    stock = F.when(F.lit(False), "")
    for pattern, name in LABEL_OVERRIDES:
        stock = stock.when(texts.fold_case(reason).rlike(f"(?iU){pattern}"), name)
    own = label_tokens(component)
    other = label_tokens(reason, F.transform(own, _plain))
    signals = F.array(*map(F.lit, LABEL_SIGNALS))
    strong = F.exists(other, lambda t: F.array_contains(signals, _plain(t)))
    words = texts.unique_first(F.when(strong, F.concat(other, own)).otherwise(F.concat(own, other)), F.lower)
    top = F.slice(words, 1, 3)
    first = F.try_element_at(own, F.lit(1))
    named = first.isNull() | F.exists(top, lambda t: _plain(t) == _plain(first))
    top = F.when(named, top).otherwise(F.concat(F.slice(top, 1, 2), F.array(first)))
    return F.coalesce(stock, F.when(F.size(top) > 0, texts.capital(F.array_join(top, " "))), F.concat(F.lit("TG"), level_.cast("string")))


def detail(component: Column, reason: Column, level_: Column, source: Column) -> Column:
    c, r = F.trim(component), F.trim(reason)
    body = F.when((c != "") & ~F.contains(F.lower(r), F.lower(c)), F.concat_ws(": ", c, F.nullif(r, F.lit("")))).otherwise(r)
    body = F.when((body != "") & ~body.rlike(r"[.!?]$"), F.concat(body, F.lit("."))).otherwise(body)
    where = source_label(F.coalesce(source, F.lit("")))
    return F.concat(F.concat_ws(" ", F.concat(F.lit("TG"), level_.cast("string")), F.nullif(body, F.lit(""))), F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise(""))


def details(found: DataFrame) -> DataFrame:
    """doc_id, at, label, short, hover, tg of each finding, each (label, short, level) once."""
    component, reason = F.trim("component"), F.trim("reason")
    short = F.coalesce(F.nullif(F.trim(F.regexp_replace(texts.collapse(reason), r"\.+$", "")), F.lit("")), F.nullif(component, F.lit("")))
    out = found.where((component != "") | (reason != "")).withColumns({"label": label(component, reason, F.col("level")), "hover": detail(component, reason, F.col("level"), F.col("source"))})
    out = out.withColumn("short", F.coalesce(short, "label"))
    rank = F.row_number().over(Window.partitionBy("doc_id", texts.fold_case(F.col("label")), texts.fold_case(F.col("short")), "level").orderBy("at", "sub"))
    return out.withColumn("_n", rank).where("_n = 1").select("doc_id", "at", "label", "short", "hover", F.col("level").alias("tg"))


def missing_components(found: DataFrame, key: str = "doc_id", component: str = "component", components: tuple = STANDARD_COMPONENTS, documents: DataFrame | None = None) -> DataFrame:
    """key, component of each standard component that none of the key's findings has; documents: all keys, those without findings too."""
    keys = (found if documents is None else documents).select(key).distinct()
    every = keys.withColumn(component, F.explode(F.array(*map(F.lit, components))))
    return every.join(found.select(key, component), [key, component], "left_anti")
