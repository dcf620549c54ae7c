"""The findings of whole documents against a plain loop over their lines."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from hearthline.functions import texts
from hearthline.operators import findings
from hearthline.plans import catalog

SF = "/root/testdata/sf0.001"
EDGES, WORDS = " .,:;–—-", [(p, name) for name, prefixes in findings.COMPONENT_PREFIXES for p in prefixes]


def fold(t):
    return t.lower().replace("ß", "ss")


def grade(t):
    for n in (3, 2):
        if re.search(rf"(?i)(?<!\w)TG\s*[:\-]?\s*{n}\b", t):
            return n
    return next((n for n in (3, 2) if findings.HEADERS[n] in t.lower()), None)


def is_boundary(t):
    return not t or grade(t) is not None or findings.SUMMARY_HEADER in t.lower() or any(w in t.upper() for w in findings.SECTION_BREAKS) or bool(re.match(r"\s*\d+[.)]", t))


def component(t):
    plain = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).lower()
    places = []
    for order, (p, name) in enumerate(WORDS):
        m = re.search(rf"(?<![a-z0-9])(?:{'tak(?![a-z0-9])' if p == 'tak' else p})", plain)
        if m:
            places.append((m.start(), order, name))
    return min(places)[2] if places else None


def label(t):
    clean = re.sub(r"^[•\-* ]+", "", t.strip(" "))
    words = " ".join(clean.split()).split(" ")
    got = clean.split(":")[0].strip(" ") if ":" in clean else " ".join(words[:5]) if len(words) <= 6 else ""
    return re.sub(r"\s*[\-–—]+\s*\d+$", "", got).strip(" ") or None


def reason(t):
    out = re.sub(r"^[\-*•⁃∙●]+\s*", "", " ".join(t.split()))
    out = re.sub(r"(?i)^(?:Forhold som har fått|Bygningsdeler med)\s+[^:]{0,150}?Oppsummering\s*[:\-]*\s*", "", out)
    out = re.sub(r"(?i)^Oppsummering(?: av)?\s+[^:]{0,120}?[:\-]\s*", "", out)
    out = re.split(r"(?i)\b(?:Tiltak|Konsekvens|Arsak|Anbefaling)\b", out)[0].strip(EDGES)
    parts = [p for x in re.split("[.!?]+", out) if (p := x.strip(EDGES))]
    out = (parts[0] if parts else out).strip(EDGES)
    out = out[:1].upper() + out[1:] if out[:1].isalpha() else out
    out = re.sub(r"[,;:\- ]+$", "", out[:217]) + "..." if len(out) > 220 else out
    low = fold(out)
    if not out or low.startswith((findings.SUMMARY_WORD, "type ")) or any(w in low for w in findings.SKIP_REASONS):
        return ""
    return out if out.endswith(".") else out + "."


def counts(original, name):
    low, has = fold(original), lambda t, words: any(w in t for w in words)
    return bool(low) and (has(low, findings.IMPORTANT_REASONS) or has(fold(name), findings.IMPORTANT_COMPONENTS) and not has(low, findings.COSMETIC) and not has(low, findings.NEGATIVE))


def inline(t):
    m = re.search(r"(?i)(?<!\w)TG\s*[:\-]?\s*[23][:\-\s.]*", t)
    if not re.search(r"(?i)(?<!\w)TG\s*[:\-]?\s*[23]\b", t) or not m:
        return ""
    edge = " -—–:•.;"
    before, after = t[: m.start()].strip(edge), t[m.end() :].strip(" ")
    joint = " - " if "-" in m.group() else ": " if ":" in m.group() else " "
    out = (before + joint + after if before and after else before + after).strip(edge)
    return "" if fold(out).strip(" .:;-") in findings.HEADERS.values() else out


def points(text):
    low = fold(text)
    return 1 + 2 * any(w in low for w in findings.IMPORTANT_REASONS) + 2 * ("fall" in low and "sluk" in low) + ("bom" in low) + ("mangler" in low)


def loop(lines):
    """(at, sub, level, component, reason) of a document's lines (pos, text), walked one by one."""
    out, texts = [], [t.strip(" ") for _, t in lines]
    for i, text in enumerate(texts):
        level = grade(text)
        if level is None or any(w in fold(text) for w in findings.SKIP_TRIGGERS):
            continue
        own = []
        for t in texts[i + 1 :]:
            if is_boundary(t):
                break
            own.append(t)
        found = []
        if any(w in fold(text) for w in findings.SUMMARY_BLOCKS):
            heads = [j for j, t in enumerate(own) if findings.SUMMARY_WORD in fold(t)]
            for sub, (j, k) in enumerate(zip(heads, [*heads, len(own)][1:], strict=True), 1):
                taken = own[j + 1 : k][:2]
                taken = taken[:1] if taken and "." in taken[0] else taken
                original = " ".join(" ".join(taken).split())
                name = component(label(own[j]) or "") or label(own[j]) or findings.UNKNOWN
                if taken and reason(original) and counts(original, name):
                    found.append((lines[i][0], sub, level, name, reason(original)))
        if found:
            out += found
            continue
        parts = [t for t in (inline(text), *own) if t]
        original = " ".join(" ".join(parts).split())
        if not parts or any(w in fold(original) for w in findings.DEFINITIONS):
            continue
        before = texts[max(0, i - findings.BACK_REASON) : i][::-1]
        names = [component(original), component(label(inline(text)) or ""), *(component(label(t) or "") for t in own), *(component(label(t) or "") for t in before[: findings.BACK_COMPONENT]), label(parts[0]), findings.UNKNOWN]
        name, told = next(x for x in names if x), reason(original)
        if told and counts(original, name):
            out.append((lines[i][0], 0, level, name, told))
            continue
        best, important = (-1, "", ""), any(w in fold(name) for w in findings.IMPORTANT_COMPONENTS)
        for t in before:
            if t and is_boundary(t):
                break
            low, r = fold(t), reason(t)
            if not t or not r or findings.SUMMARY_WORD in low or low.startswith("er det"):
                continue
            hit, soft = any(w in low for w in findings.IMPORTANT_REASONS), any(w in low for w in (*findings.COSMETIC, *findings.NEGATIVE))
            if not (hit or important and not soft):
                continue
            same, worth = component(r) == name, points(r)
            worth += 2 if same else 1 if component(r) else 0
            if worth > best[0] or worth == best[0] and len(r) > len(best[1]):
                best = (worth, r, component(r) or "")
                if same and worth >= 5:
                    break
        if best[0] >= 0:
            out.append((lines[i][0], 0, level, best[2] if name == findings.UNKNOWN and best[2] else name, best[1]))
    return sorted(out)


def check(spark, documents):
    rows = [(d, p, t, "3") for d, lines in documents.items() for p, t in lines]
    found = findings.candidates(spark.createDataFrame(rows, "doc_id string, pos long, text string, source string").repartition(4))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.at, r.sub, r.level, r.component, r.reason))
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, lines in documents.items() if (x := loop(lines))}


def test_random_lines(spark):
    rng = random.Random(11)
    words = ["fukt", "i", "Bad", "tak", "vegg", "riper", "ingen avvik", "TG2", "TG 3:", "tg1", "Oppsummering", "fall mot sluk", "bom", "Side 4", "1.", "lekkasje.", "vinduer", "er det", "membran", "mangler", "Forhold som har fått", "normal slitasje", "og", "-"]
    documents = {}
    for d in range(40):
        pos, lines = 0, []
        for _ in range(rng.choice([3, 40, 200])):
            pos += rng.choice([1, 1, 1, 2, 90])
            lines.append((pos, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 5, 8])))))
        documents[f"d{d}"] = lines
    assert sum(len(loop(x)) for x in documents.values()) > 200
    check(spark, documents)


def test_whole_table(spark):
    """The lines of the registered query, the whole smallest table."""
    grades = ("TG3 Bad: fukt, ", "TG2 Tak: lekkasje, ", "", "Oppsummering: ")
    documents = {}
    for r in catalog._lines(spark, SF).where(F.col("line").isNotNull()).collect():
        documents.setdefault(str(r.doc_id), []).append((r.pos, grades[r.pos % 4] + r.line))
    check(spark, {d: sorted(x) for d, x in documents.items()})


def test_no_text_is_worked_on_twice(spark, monkeypatch):
    """In the plan of what triggers say, each dear step stands once; triggers themselves are chosen once."""
    plans, staged = {}, findings.staging.staged
    monkeypatch.setattr(findings.staging, "staged", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or staged(df, name))
    findings.candidates(spark.createDataFrame([("d", 0, "TG2 Tak: lekkasje", "3")], "doc_id string, pos long, text string, source string"))
    once = {"boligbygg": 1, "Bygningsdeler med)": 1, r"\s*[23][:\-\s.]*": 1, "Konsekvens|": 1}
    assert {w: plans["triggers"].count(w) for w in once} == once
    assert sum(p.count("ingen umiddelbare kostnader") for n, p in plans.items() if n != "triggers") == 1


def test_words_are_found_as_by_a_pattern(spark):
    """has_any, collapse and strip_marks, which look for less than they did, against their plain definitions."""
    words = ("fukt", "fuktskade", "fall mot sluk", "sluk", "rør", "råte", ".*", "a|b", "e")
    rows = [None, "", "fuk", "xfuktskadex", "rør", "rör", "a|b", "axb", "...", ".*", "RÅTE", "é", "  a  b ", "a\tb", "a  b", " x", "x\n", "ǻß ﬁ ½", "plain text", "a\u0085b"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", "t", texts.has_any(F.col("t"), words), texts.has_any(F.col("t"), ()), texts.collapse(F.col("t")), texts.strip_marks(F.col("t"))).collect()
    for _, t, some, none, flat, bare in got:
        if t is None:
            assert (some, none, flat, bare) == (None, None, None, None)
            continue
        assert (some, none) == (any(w in t for w in words), False), t
        assert flat == re.sub(r"\s+", " ", t).strip(" ") and bare == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")), repr(t)
