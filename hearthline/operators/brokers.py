"""Estate brokers as data: whose page a URL is, which of its links may be the prospectus, and how good each one is.

A broker is a row of patterns over lower-case text; links are judged by CASE expressions over the registry, so a page
table is dispatched and scored in one pass, without a join and without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .links import anchors

PDF = r"\.pdf$"
ANY_PDF = r"\.pdf([?#][^\s\"']*)?$"
# Patterns that several brokers share.
_TAKEN = r"tilstandsrapport|boligsalgsrapport|ns3600|ns_3600|ns-3600|energiattest|egenerkl|nabolag|nabolagsprofil|anticimex|takst|bud|prisliste|vilkår|terms|cookies"
_NAMED = r"salgsoppgav|prospekt|utskriftsvennlig|komplett|digital_salgsoppgave"
_CUES = r"salgsoppgav|prospekt|utskriftsvennlig|komplett|digital"
_SHORT = r"salgsoppgav|prospekt|utskriftsvennlig|komplett"
_OFFERED = r"salgsoppgav|prospekt|utskriftsvennlig|komplett|digital[_\-]?salgsoppgave|se\s+pdf|last\s+ned\s+pdf"
_OTHER = r"tilstandsrapport|boligsalgsrapport|takst|fidens|estates|energiattest|nabolag|nabolagsprofil|contentassets/nabolaget|egenerkl|budskjema|kjøpekontrakt|vilkår|terms|cookies"
_MEMBER = r"tilstandsrapport|boligsalgsrapport|ns[\s_-]*3600|energiattest|egenerkl|nabolag|takst|boligselgerforsikring|bud|budskjema|vedtekter|arsberetning|årsberetning|regnskap|sameie|kontrakt|kjopetilbud"
_REPORT = r"tilstandsrapport|boligsalgsrapport|ns[\s_\-]?3600|bygningssakkyndig|tilstandsgrader|energiattest|energimerke|nabolag|nabolagsprofil|egenerkl|budskjema|vilkår|terms|cookies"
_HINTS = r"wngetfile\.ashx|/getdocument|/getfile|/download"
_RANK = (("url", _OFFERED, 4), ("url", PDF, 1))


@dataclass(frozen=True)
class Broker:
    """hosts: alternatives, each of patterns that the page's URL must all match. deny and allow look at label and URL, or at the
    URL alone; url_deny, url_allow (enough by itself) and url_must at the URL. points: (url, label, any or both, pattern, points);
    `both` sees the label, a line end, the URL. same_id: points if the page's own number is in the URL. shorter: equal scores go to
    the shorter URL. length_points: 20 less one for each 100 characters."""

    name: str
    hosts: tuple[tuple[str, ...], ...]
    deny: str = ""
    allow: str = ""
    label: bool = True
    url_deny: str = ""
    url_allow: str = ""
    url_must: str = ""
    points: tuple[tuple[str, str, int], ...] = ()
    same_id: int = 0
    shorter: bool = False
    length_points: bool = False


# The registry, first match first.
BROKERS = (
    Broker("dnbeiendom", ((r"dnbeiendom\.no",),), _TAKEN, _NAMED, label=False, url_allow=PDF),
    Broker("proaktiv", ((r"proaktiv\.no",),),
           r"tilstandsrapport|tilstandsgrader|bygningssakkyndig|nøkkeltakst|boligsalgsrapport|energiattest|energimerke|nabolag|nabolagsprofil|egenerkl|budskjema|kjøpekontrakt|vilkår|terms|cookies",
           r"prospekt|salgsoppgav|digital_salgsoppgave|digital-salgsoppgave|utskriftsvennlig|komplett",
           points=(("url", r"cdn\.webmegler\.no|webmegler\.no|azureedge\.net|cloudfront\.net|blob\.core\.windows\.net|proaktiv\.no/media/", 20), ("label", r"prospekt|salgsoppgav|utskriftsvennlig|komplett", 40))),
    Broker("privatmegleren", ((r"privatmegleren\.no",),), _OTHER + r"|ns[\s\-_]*3600", _OFFERED, url_deny=r"/docs/klikk\.pdf(#|$)", url_allow=PDF, same_id=40,
           points=(("url", PDF, 25), ("any", _OFFERED, 40), ("any", r"prospekt", 30), ("any", r"salgsoppgav", 30), ("url", r"(^|/)klikk\.pdf$|/docs/klikk\.pdf", -500))),
    Broker("aktiv", ((r"aktiv\.no",),), _TAKEN, _NAMED + r"|file-proxy\.rfcdn\.io|/aktiv/",
           points=(("any", _SHORT, 60), ("url", PDF, 25), ("url", r"file-proxy\.rfcdn\.io|/aktiv/", 20), ("url", r"digital~salgsoppgave|salgsoppgave|prospekt", 20))),
    Broker("eie", ((r"eie\.no",),), r"nabolagsprofil|naboprofil|energiattest|anticimex|boligselgerforsikring|bud|budskjema|prisliste|vilkår|terms|cookies", r"salgsoppgave|digital_salgsoppgave|prospekt",
           url_deny=r"registrer|logg-inn|/files/|/media/other/",
           points=(("url", PDF, 20), ("url", r"digital_salgsoppgave", 60), ("both", r"salgsoppgave[^\n]*\n|prospekt", 40), ("url", r"^[a-z]+://cdn\.eiendomssentralen\.no([/?#]|$)", 30), ("label", r"vedlegg", 5))),
    Broker("em1", ((r"eiendomsmegler1\.no",),), _TAKEN, _CUES),
    Broker("ask", ((r"askeiendomsmegling\.no|ask\.webtopsolutions\.com|outgoing\.webtopsolutions\.com",),),
           r"tilstands|boligsalgs|energiattest|nabolag|nabolagsprofil|egenerkl|budskjema|meglerpakke|forsikring", r"salgsoppgav|prospekt|digital|utskrifts|komplett|download|last ned",
           url_allow=r"^[a-z]+://[^/?#]*outgoing\.webtopsolutions\.com([/?#]|$)", url_must=PDF,
           points=(("url", r"outgoing\.webtopsolutions\.com", 40), ("url", PDF, 20), ("url", r"hires", -5), ("url", r"salgsopp", 30), ("url", r"prospekt", 25))),
    Broker("krogsveen", ((r"krogsveen\.no", r"/kjope/|/boliger-til-salgs"),), _MEMBER, _SHORT),
    Broker("notar", ((r"notar\.no/bolig-til-salgs/",),), _OTHER, rf"{_HINTS}|/proxy/webmegler/.+/wngetfile\.ashx|{ANY_PDF}|{_OFFERED}", label=False, points=_RANK, shorter=True),
    Broker("obosmegleren", ((r"obos\.no/brukt-bolig/",),), _OTHER, rf"{ANY_PDF}|{_HINTS}|{_OFFERED}", label=False, points=_RANK, shorter=True),
    Broker("partners", ((r"partners\.no/eiendom/|tenant=",),), _OTHER + r"|ns[\s\-_]*3600", rf"{ANY_PDF}|{_HINTS}|/proxy/webmegler/|{_OFFERED}", label=False,
           points=(("url", r"/proxy/webmegler/", 200), ("url", r"wngetfile\.ashx", 150), ("url", _OFFERED, 60), ("url", PDF, 20))),
    Broker("nordvik", ((r"nordvikbolig\.no/boliger/",),), _MEMBER + r"|nabolagsprofil|contentassets/nabolaget|fidens", _SHORT, length_points=True,
           points=(("label", PDF, 30), ("any", r"salgsoppgav", 40), ("any", r"prospekt", 20), ("any", r"utskriftsvennlig|komplett", 10))),
    Broker("heimdal", ((r"hem\.no/",),), url_must=r"^https?://meglervisning\.no/salgsoppgave/hent\?[^\"']*\b(instid=mshmdl|estateid=)[^\"']+"),
    Broker("garanti", ((r"garanti\.no/eiendom/",),), r"tilstandsrapport|boligsalgsrapport|ns3600|ns_3600|ns-3600|energiattest|nabolag|contentassets/nabolaget|egenerkl|anticimex|bud|prisliste|vilkår|terms|cookies",
           r"digitalsalgsoppgave\.garanti\.no|meglervisning\.no/salgsoppgave/hent", label=False),
    Broker("kalandpartners", ((r"partners\.no/eiendom/",),), _MEMBER, _SHORT, label=False),
    Broker("rele", ((r"meglerhuset-rele",),), _REPORT, r"prospekt|salgsoppgav|digital[_\- ]salgsoppgave|utskriftsvennlig|komplett",
           points=(("url", r"/proxy/vitec/", 200), ("url", r"/document/|wngetfile\.ashx", 120), ("url", r"prospekt|salgsoppgav|utskriftsvennlig|komplett", 80), ("url", PDF, 20))),
    Broker("semjohnsen", ((r"sem-johnsen\.no/boliger/",),), _REPORT, r"salgsoppgav|prospekt|utskriftsvennlig|komplett|for\s*utskrift|se\s*pdf|last\s*ned\s*pdf",
           points=(("url", r"cdn\.sanity\.io/files/", 200), ("url", r"salgsoppgav|prospekt|utskriftsvennlig|komplett|for\s*utskrift|se\s*pdf|last\s*ned\s*pdf", 60), ("url", PDF, 20))),
    Broker("sormegleren", ((r"bolig\.eiendomsmeglervest\.no/|digitalsalgsoppgave\.emvest\.no/|sormegleren\.no/",),), _REPORT, url_must=r"digitalsalgsoppgave\.emvest\.no/[0-9a-f\-]{36}/2|/vedlegg/document|/vedlegg/dokument"),
    Broker("boa", ((r"boaeiendom\.no",),), _TAKEN, _NAMED, url_allow=PDF, points=(("url", PDF, 30), ("any", _NAMED, 50), ("any", r"dokument|vedlegg", 8), ("any", _TAKEN, -200))),
    Broker("exbo", ((r"exbo\.no",), (r"meglervisning\.no/salgsoppgave/hent", r" instid=(msexbo)?$")), _TAKEN + r"|contentassets/nabolaget", _CUES, url_allow=r"meglervisning\.no/salgsoppgave/hent"),
    Broker("generic_local", ((),),
           r"tilstandsrapport|boligsalgsrapport|takst|energiattest|egenerkl|egen-erkl|nabolag|nabolagsprofil|bud|prisliste|vilkår|terms|personvern|privacy|vedtekter|avhendingslova|anticimex|boligkjøperforsikring",
           _NAMED, url_deny=r"(^|/)klikk\.pdf$", url_must=PDF, points=(("url", PDF, 10), ("url", r"digital_salgsoppgave", 40), ("url", r"salgsoppgav", 40), ("url", r"prospekt", 25))),
)


def host_text(url: Column) -> Column:
    """What `hosts` look at: the lower-case URL and its instid parameter, empty if there is none."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.concat(low, F.lit(" instid="), F.regexp_extract(low, r"[?&]instid=([^&#]*)", 1))


def broker_of(url: Column) -> Column:
    """The first broker whose page this is; every URL is at least the last one's."""
    seen, out = host_text(url), None
    for b in BROKERS:
        hit = F.lit(False)
        for patterns in b.hosts:
            every = F.lit(True)
            for p in patterns:
                every = every & seen.rlike(p)
            hit = hit | every
        out = F.when(hit, b.name) if out is None else out.when(hit, b.name)
    return out


def _by_broker(name: Column, value) -> Column:
    out = None
    for b in BROKERS:
        out = F.when(name == b.name, value(b)) if out is None else out.when(name == b.name, value(b))
    return out


def allowed(name: Column, url: Column, label: Column) -> Column:
    """Whether the broker's link may be the prospectus."""
    low = F.lower(F.coalesce(url, F.lit("")))
    both = F.concat_ws(" ", F.lower(label), low)

    def rule(b: Broker) -> Column:
        hay, ok = both if b.label else low, F.lit(not b.allow and not b.url_allow)
        if b.allow:
            ok = ok | hay.rlike(b.allow)
        if b.url_allow:
            ok = ok | low.rlike(b.url_allow)
        for pattern, seen, wanted in ((b.deny, hay, False), (b.url_deny, low, False), (b.url_must, low, True)):
            if pattern:
                ok = ok & (seen.rlike(pattern) if wanted else ~seen.rlike(pattern))
        return ok & (low != "")

    return _by_broker(name, rule)


def score(name: Column, url: Column, label: Column, page_url: Column) -> Column:
    low, text = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    seen = {"url": low, "label": text, "any": F.concat(low, F.lit(" "), text), "both": F.concat(text, F.lit("\n"), low)}

    def total(b: Broker) -> Column:
        out = F.lit(0)
        for where, pattern, points in b.points:
            out = out + F.when(seen[where].rlike(pattern), points).otherwise(0)
        if b.same_id:
            own = F.regexp_extract(page_url, r"/(\d{6,})\b", 1)
            out = out + F.when((own != "") & F.contains(low, own), b.same_id).otherwise(0)
        if b.length_points:
            out = out + F.greatest(F.lit(0), F.lit(20) - F.floor(F.length(url) / 100)).cast("int")
        return out

    return _by_broker(name, total)


def judged(links: DataFrame) -> DataFrame:
    """links (page_url, link, label) with broker, allowed and score."""
    named = links.withColumn("broker", broker_of(F.col("page_url")))
    return named.withColumns({"allowed": allowed(F.col("broker"), F.col("link"), F.col("label")), "score": score(F.col("broker"), F.col("link"), F.col("label"), F.col("page_url"))})


def best_links(links: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Each page's best allowed link: highest score; of equal ones the shorter for brokers that say so, then the first."""
    shorter = _by_broker(F.col("broker"), lambda b: F.length("link") if b.shorter else F.lit(0))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), shorter, pos))
    return judged(links).where("allowed").withColumn("_rank", rank).where("_rank = 1").drop("_rank", "allowed")


def prospectus_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """From whole pages (url, html): every anchor as the broker of its page judges it, the best one of each page."""
    found = anchors(pages, key)
    links = found.select(key, "pos", F.col("url").alias("page_url"), urls.absolute(F.col("url"), F.col("href")).alias("link"), F.col("text").alias("label"))
    return best_links(links.where("link is not null"), key)
