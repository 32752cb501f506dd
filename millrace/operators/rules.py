"""Secret rules as data: keyword rules built from a keyword table, and the irregular ones.

The keyword table is a parameter: a text file with entries ``rule keyword @case``, where
``~`` stands for an optional ``_`` or ``-`` and ``@-`` says that the keyword has no case
of its own. By default it is ``keywords.txt`` beside this module.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from pathlib import Path

KEYWORDS = Path(__file__).resolve().with_name("keywords.txt")
PACKS = ("compat", "intended")

# Labels that do not follow from the keyword, by keyword.
SPECIAL_LABELS = {"local~storage~key": "Local Storage Key", "local~storage~secret": "Local Storage Secret", "secret~sso": "SSO Secret", "jdbc:mysql": "jdbc"}

# The irregular rules (rule number, texts of which one must occur, pattern). In compat they are kept with
# their slips; the intended pack has what they evidently were to find. Rules 11, 19 and 738 differ from their source
# in what Java would read otherwise: its white space has U+000B, and a '[' in a class opens another one.
IRREGULAR = [
    (9, ["Basic "], r"Basic [A-Za-z0-9+/]{15}", None),
    (10, ["xox"], r"(xox[p|b|o|a]-[0-9]{12}-[0-9]{12}-[0-9]{12}-[a-z0-9]{32})", r"xox[pboa]-[0-9]{12}-[0-9]{12}-[0-9]{12}-[a-z0-9]{32}"),
    (11, ["Bearer"], r"Bearer[\t\n\f\r ]+[a-fA-F0-9]+", None),
    (12, ["https://hooks"], r"https://hooks.slack.com/services/T[a-zA-Z0-9_]{8}/B[a-zA-Z0-9_]{8}/[a-zA-Z0-9_]{24}", r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]{8}/B[a-zA-Z0-9_]{8}/[a-zA-Z0-9_]{24}"),
    (13, [], r"""[f|F][a|A][c|C][e|E][b|B][o|O][o|O][k|K].{0,30}['"\\s][0-9a-f]{32}['"\\s]""", r"""[fF][aA][cC][eE][bB][oO][oO][kK].{0,30}['"\t\n\f\r ][0-9a-f]{32}['"\t\n\f\r ]"""),
    (14, [], r"""[t|T][w|W][i|I][t|T][t|T][e|E][r|R].{0,30}['"\\s][0-9a-zA-Z]{35,44}['"\\s]""", r"""[tT][wW][iI][tT][tT][eE][rR].{0,30}['"\t\n\f\r ][0-9a-zA-Z]{35,44}['"\t\n\f\r ]"""),
    (15, [], r"[h|H][e|E][r|R][o|O][k|K][u|U].{0,30}[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}", r"[hH][eE][rR][oO][kK][uU].{0,30}[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}"),
    (16, ["key-"], r"key-[0-9a-zA-Z]{32}", None),
    (17, ["-us"], r"[0-9a-f]{32}-us[0-9]{1,2}", None),
    (18, ["sk_live_"], r"sk_live_[0-9a-z]{32}", None),
    (19, ["qooqleusercontent", "googleusercontent"], r"[0-9(+-\[0-9A-Za-z_]{32}.apps.qooqleusercontent.com", r"[0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com"),
    (20, ["AIza"], r"AIza[0-9A-Za-z-_]{35}", None),
    (21, ["6L"], r"6L[0-9A-Za-z-_]{38}", None),
    (22, ["ya29"], r"ya29\\.[0-9A-Za-z\\-_]+", r"ya29\.[0-9A-Za-z_-]+"),
    (23, ["AKIA"], r"AKIA[0-9A-Z]{16}", None),
    (24, ["amzn"], r"amzn\\.mws\\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    (25, ["amazonaws"], r"s3\\.amazonaws.com[/]+|[a-zA-Z0-9_-]*\\.s3\\.amazonaws.com", r"s3\.amazonaws\.com/+|[a-zA-Z0-9_-]*\.s3\.amazonaws\.com"),
    (26, ["EAACEdEose0cBA"], r"EAACEdEose0cBA[0-9A-Za-z]+", None),
    (27, ["key-"], r"key-[0-9a-zA-Z]{32}", None),
    (28, ["SK"], r"SK[0-9a-fA-F]{32}", None),
    (29, ["AC"], r"AC[a-zA-Z0-9_\\-]{32}", r"AC[a-zA-Z0-9_-]{32}"),
    (30, ["AP"], r"AP[a-zA-Z0-9_\\-]{32}", r"AP[a-zA-Z0-9_-]{32}"),
    (31, ["access_token$"], r"access_token\\$production\\$[0-9a-z]{16}\\$[0-9a-f]{32}", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}"),
    (32, ["sq0csp-"], r"sq0csp-[ 0-9A-Za-z\\-_]{43}", r"sq0csp-[0-9A-Za-z_-]{43}"),
    (33, ["sqOatp-", "sq0atp-"], r"sqOatp-[0-9A-Za-z\\-_]{22}", r"sq0atp-[0-9A-Za-z_-]{22}"),
    (34, ["sk_live_"], r"sk_live_[0-9a-zA-Z]{24}", None),
    (35, ["rk_live_"], r"rk_live_[0-9a-zA-Z]{24}", None),
    (36, ["@github"], r"[a-zA-Z0-9_-]*:[a-zA-Z0-9_\\-]+@github\\.com*", r"[a-zA-Z0-9_-]*:[a-zA-Z0-9_-]+@github\.com"),
    (37, ["-----BEGIN PRIVATE KEY-----"], r"-----BEGIN PRIVATE KEY-----[a-zA-Z0-9\\S]{100,}-----END PRIVATE KEY-----", r"-----BEGIN PRIVATE KEY-----[a-zA-Z0-9+/=\t\n\f\r ]{100,}-----END PRIVATE KEY-----"),
    (38, ["-----BEGIN RSA PRIVATE KEY-----"], r"-----BEGIN RSA PRIVATE KEY-----[a-zA-Z0-9\\S]{100,}-----END RSA PRIVATE KEY-----", r"-----BEGIN RSA PRIVATE KEY-----[a-zA-Z0-9+/=\t\n\f\r ]{100,}-----END RSA PRIVATE KEY-----"),
    (42, [], r"(?i)zendesk(_api_token|_key|_token|-travis-github|_url|_username)(\\s|=)", r"(?i)zendesk(?:_api_token|_key|_token|-travis-github|_url|_username)[\t\n\f\r =]"),
    (731, [], r"""(?i)[\"']?air[-_]?table[-_]?api[-_]?key[\"']?[=:][\"']?.+[\"']""", None),
    (738, ["eyJ"], r"(?i)Bearer[\t\n\f\r ]*eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", None),
]

# The cases that come before those of the keywords (case number, pattern, label), and those of irregular
# rules (case number, rule number, label).
FIRST_CASES = [
    (758, "Bearer", "authorization custom"),
    (760, "AIza", "Google Maps API"),
    (762, "xoxb", "Slack"),
    (764, "[0-9a-f]{32}-us", "Algolia"),
    (766, r"(?i)Bearer[\t\n\f\r ]*eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "Authorization"),
]
IRREGULAR_CASES = [(786, 42, "zendesk"), (2144, 731, "air")]
UNKNOWN = "Unknown Secret"


@dataclass(frozen=True)
class Rule:
    order: int
    anchor: str | None  # of keyword rules: the keyword without separators
    anchors: tuple[str, ...]  # of irregular rules
    java: str
    re2: str


@dataclass(frozen=True)
class Case:
    order: int
    anchor: str | None
    java: str
    re2: str
    label: str


def _java(pattern: str) -> str:
    """Java flags for RE2 behaviour: line feeds alone end lines, and case folding is Unicode's."""
    return "(?diu)" + pattern[4:] if pattern.startswith("(?i)") else "(?d)" + pattern


def keyword_pattern(keyword: str, pack: str, linear: bool = False) -> str:
    """The pattern of a keyword rule. ``linear``: for an engine that backtracks, with equal matches.

    In compat the gaps take separators too, so that a run of them would be tried from each of them. The match is from
    the last separator with a value behind it; one that another follows before any value character cannot be that.
    """
    gap, value = (r"[^\\S\r\n]*", r"[\\w-]+") if pack == "compat" else (r"[\t\f ]*", "[0-9A-Za-z_-]+")
    last = r"(?![^\\S\r\nw=:-]*+[=:])" if linear and pack == "compat" else ""
    return f"(?i)[\"']?{keyword.replace('~', '[_-]?')}[\"']?{gap}[=:]{last}{gap}[\"']?{value}[\"']?"


def norm_keyword(keyword: str) -> str:
    """The keyword as ``norm`` of a text that matches it contains it."""
    return re.sub("[~_-]", "", keyword)


@cache
def keywords(path: Path = KEYWORDS) -> tuple[tuple[int, str, int | None], ...]:
    """(rule, keyword, case) entries of the table, by rule."""
    text = Path(path).read_text(encoding="utf-8")
    found = re.findall(r"(?m)(?:^|\| )(\d+) ([^\s@|]+) @(\d+|-)(?= \||$)", text)
    if not found:
        raise ValueError(f"no keyword entries in {path}")
    return tuple(sorted((int(a), k.replace("␠", " "), None if c == "-" else int(c)) for a, k, c in found))


def rules(pack: str = "compat", path: Path = KEYWORDS) -> list[Rule]:
    """All rules in order."""
    if pack not in PACKS:
        raise ValueError(f"pack {pack!r}")
    out = []
    for order, anchors, compat, intended in IRREGULAR:
        p = compat if pack == "compat" or intended is None else intended
        out.append(Rule(order, None, tuple(anchors), _java(p), p))
    for order, keyword, _ in keywords(path):
        p = keyword_pattern(keyword, pack)
        out.append(Rule(order, norm_keyword(keyword), (), _java(keyword_pattern(keyword, pack, linear=True)), p))
    return sorted(out, key=lambda r: r.order)


def cases(pack: str = "compat", path: Path = KEYWORDS) -> list[Case]:
    """The classifier's cases in order; the first that occurs in a match gives its label."""
    out = [Case(n, None, _java(p), p, label) for n, p, label in FIRST_CASES]
    for number, rule, label in IRREGULAR_CASES:
        p = next((i if pack == "intended" and i else c) for n, _, c, i in IRREGULAR if n == rule)
        out.append(Case(number, None, _java(p), p, label))
    seen = set()
    for _, keyword, case in keywords(path):
        if case is not None and case not in seen:
            seen.add(case)
            p = keyword_pattern(keyword, pack)
            out.append(Case(case, norm_keyword(keyword), _java(keyword_pattern(keyword, pack, linear=True)), p, SPECIAL_LABELS.get(keyword, keyword.split("~")[0])))
    return sorted(out, key=lambda c: c.order)


def beginnings(words: list[str]) -> dict[str, list[str]]:
    """For each word the words that it starts with, itself included: what a longest match stands for."""
    every = set(words)
    return {w: [w[:k] for k in range(1, len(w) + 1) if w[:k] in every] for w in every}
