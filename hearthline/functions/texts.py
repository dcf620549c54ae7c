"""Text normalisation and tokens. Patterns carry (?U), so that letters and spaces are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a simplified key spells out (after case folding).
SIMPLE = (("ø", "o"), ("å", "a"), ("æ", "ae"), ("é", "e"), ("ü", "u"), ("ö", "o"))
_EDGES, _LINE_ENDS = " .,:;–—-", r"[\n\r\x85\u2028\u2029]"
_BULLET = r"^[\-*•⁃∙●]+\s*"


def let(value: Column, use) -> Column:
    """use(value), the value computed once: nested expressions that name it often would multiply."""
    return F.element_at(F.transform(F.array(value), use), 1)


def filled(text: Column) -> Column:
    """Null for an empty text; nullif() would compute it twice."""
    return let(text, lambda t: F.when(t != "", t))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; a text of single spaces is not rebuilt."""
    return let(text, lambda t: F.trim(F.when(t.rlike(r"(?U)[^\S ]|  "), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t)))


def fold_case(text: Column) -> Column:
    """Case folding for Western text: lower case, with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def simplify(text: Column, lower=fold_case) -> Column:
    out = lower(text)
    for a, b in SIMPLE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_marks(text: Column) -> Column:
    """NFKD without combining marks (ø and æ stay), by ICU through SQL's reflect(); ASCII is its own."""
    decomposed = lambda t: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(t, F.lit("")), F.lit(True))
    return let(text, lambda t: F.when(F.octet_length(t) == F.length(t), t).when(t.isNotNull(), F.regexp_replace(decomposed(t), r"\p{M}+", "")))


def words_norm(text: Column) -> Column:
    """Lower-case words without marks, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(text)), r"(?U)[^\p{L}\p{N}]+", " "))


def compact_norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip_marks(text)), r"(?U)[^\p{L}\p{N}]+", "")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9."""
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda x: x != "")


def trim_edges(text: Column) -> Column:
    """Without edge punctuation, also before a line's end that ends the text."""
    bare = lambda t: F.trim(t, F.lit(_EDGES))
    return let(text, lambda t: F.when(t.rlike(rf"{_LINE_ENDS}\z"), F.regexp_replace(t, f"^[{_EDGES}]+|[{_EDGES}]+$", "")).otherwise(bare(t)))


def without_bullet(text: Column) -> Column:
    return F.regexp_replace(text, _BULLET, "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), trim_edges), lambda s: s != "")


def capital(text: Column) -> Column:
    return let(text, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def ellipsis(text: Column, most: int) -> Column:
    cut = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r"[,;:\- ]+$", ""), F.lit("..."))
    return let(text, lambda t: F.when(F.length(t) > most, cut(t)).otherwise(t))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text: each is looked for by its bytes, which costs far less than a pattern of all."""
    least = [w for w in words if not any(x != w and x in w for x in words)]  # a word that holds another is found by it
    return let(text, lambda t: F.when(t.isNotNull(), F.exists(F.array(*map(F.lit, least)).cast("array<string>"), lambda w: F.contains(t, w))))


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?iU)" + "|".join(patterns))


def unique_first(items: Column, key) -> Column:
    """Array without later entries of an equal key; order stays."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def slug(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("felt"))


def trimmed(text: Column, most: int | None = None) -> Column:
    """Null for blank text; cut to a length."""
    out = F.nullif(F.trim(text), F.lit(""))
    return F.substring(out, 1, most) if most else out


def safe_id(text: Column) -> Column:
    """A file-name-safe form of an id."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.\-]", "_")
