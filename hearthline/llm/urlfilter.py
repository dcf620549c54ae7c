"""URL allow and block lists with pattern rules.

Every rule, a host and path pair or a free pattern, is a regular expression
with the literal tokens that any matching URL must hold. A rule is indexed
under the rarest of these tokens, by the corpus's own token counts. The tokens
of a URL fetch its candidate rules, and only those run their expression. Rules
without a literal token are tried on every URL.

Defined results: a null URL, or one without "://", has empty host and path,
fits no list rule and is judged by the patterns alone; repeated rows are judged
alike; of list rules that fit equally long the first counts; URLs of any length
are judged whole; an empty table gives an empty result; columns named like the
outputs are replaced.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: Rules lie in every Python worker; longer lists must be split by the caller.
MOST_RULES = 100_000
_TOKEN = re.compile(r"[a-z0-9]+")
_KINDS = "host string, path string, rule string, verdict string, n_candidates int"


@dataclass(frozen=True)
class Rule:
    """A list rule (host and path prefix) or, with a pattern, a search in host + path."""

    verdict: str
    name: str
    tokens: tuple[str, ...]
    regex: str
    listed: bool = True


def list_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """The last path token may go on in a URL (/en/x, but also /entry for /en), so it counts only before a further '/'."""
    whole = path if not path or path.endswith("/") else path.rpartition("/")[0]
    tokens = tuple(_TOKEN.findall(host.lower())) + tuple(_TOKEN.findall(whole.lower()))
    return Rule(verdict, host + path, tokens, rf"(?s:^(?:[^\n]*\.)?{re.escape(host.lower())}\n{re.escape(path)})")


def pattern_rule(verdict: str, pattern: str, tokens: tuple[str, ...]) -> Rule:
    """tokens: whole lower-case tokens that every URL matched by the pattern holds."""
    return Rule(verdict, pattern, tokens, pattern, False)


#: The contract's rules.
LIST = (
    list_rule("allow", "com"),
    list_rule("block", "example.com", "/en/"),
    list_rule("allow", "www.example.com", "/en/"),
    list_rule("block", "net", "/es/"),
    list_rule("block", "net", "/fr/"),
)
#: Paths and hosts that hold no prose, each with its literal tokens.
PATTERNS = (
    pattern_rule("block", r"/wp-(?:admin|login)\b", ("wp",)),
    pattern_rule("block", r"/cart(?:/|$)", ("cart",)),
    pattern_rule("block", r"/checkout(?:/|$)", ("checkout",)),
    pattern_rule("block", r"/calendar/\d{4}/\d{1,2}\b", ("calendar",)),
    pattern_rule("block", r"^ad\.", ("ad",)),
    pattern_rule("block", r"^ads\.", ("ads",)),
    pattern_rule("block", r"^adserver\.", ("adserver",)),
    pattern_rule("block", r"^doubleclick\.", ("doubleclick",)),
    pattern_rule("block", r"\bcasino\b", ("casino",)),
    pattern_rule("block", r"\bporn\b", ("porn",)),
)


@functools.cache
def _compiled(regex: str) -> re.Pattern:
    """A worker compiles a rule when a URL first fetches it, once."""
    return re.compile(regex)


def _split(url: str | None) -> tuple[str, str]:
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def _tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(f"{host} {path}".lower()))


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token to rules, each under its rarest token; and the rules that have none."""
    index: dict[str, list[int]] = {}
    loose = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            loose.append(i)
    return index, loose


def token_counts(urls: DataFrame, column: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs: one number a token of the rule list."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit("([a-z0-9]+)")))
    known = F.array_intersect(tokens, F.array(*map(F.lit, wanted))) if wanted else F.array().cast("array<string>")
    return {r["t"]: r["n"] for r in urls.select(F.explode(known).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge_urls(pages: DataFrame, column: str = "url", rules: tuple[Rule, ...] = LIST, patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (of the longest fitting list rule, else null), verdict and n_candidates.

    Without a list rule the first fitting pattern decides, else `default`.
    """
    every = (*rules, *patterns)
    if len(every) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    index, loose = build_index(every, token_counts(pages, column, every))

    @F.pandas_udf(_KINDS)
    def judged(urls: pd.Series) -> pd.DataFrame:
        out = []
        for url in urls:
            host, path = _split(url)
            ids = loose + [i for t in _tokens(host, path) if t in index for i in index[t]]
            best, other = None, None
            for i in sorted(ids):
                rule = every[i]
                if rule.listed:
                    if (best is None or len(rule.name) > len(best.name)) and _compiled(rule.regex).match(f"{host}\n{path}"):
                        best = rule
                elif other is None and _compiled(rule.regex).search(host + path):
                    other = rule
            out.append((host, path, best and best.name, (best or other).verdict if best or other else default, len(ids)))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "n_candidates"])

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "n_candidates")]
    (name,) = free_names(pages, "_judged")
    return pages.select(*kept, judged(F.col(column)).alias(name)).select(*kept, f"{name}.*")
