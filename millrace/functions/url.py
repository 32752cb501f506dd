"""URL functions as Column expressions. Strings are UTF-8; lengths named in bytes use octet_length."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Unicode white space, as a class body that Java and RE2 read alike.
UNICODE_SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
JS_FILE = r"(?d)\.js(\?.*)?\z"


def trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of the words that starts at a place, by shared beginnings.

    An alternation is tried branch by branch; where many characters may come next they
    are looked at in groups first, so a place where no word starts costs few tests.
    """
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node: dict) -> str:
        parts = [(ch, re.escape(ch) + build(child)) for ch, child in sorted(node.items()) if ch]
        if not parts:
            return ""
        if len(parts) > 6:
            step = round(len(parts) ** 0.5)
            groups = [parts[i : i + step] for i in range(0, len(parts), step)]
            branches = [f"(?=[{''.join(re.escape(ch) for ch, _ in g)}])(?:{'|'.join(p for _, p in g)})" for g in groups]
        else:
            branches = [p for _, p in parts]
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in node else body

    return build(root)


def any_of(values: list[str]) -> str:
    """A pattern that finds any of the strings."""
    return trie_pattern(values)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+\z", "")


def clean_url(c: Column) -> Column:
    """Without backslashes at the end, then without white space around; '' if nothing but a scheme is left, or for null."""
    t = trim_space(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\+\z", ""))
    return F.when(t.isin("http://", "https://"), F.lit("")).otherwise(t)


def scheme_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _rest(c: Column) -> Column:
    """What follows the scheme, without fragment and query."""
    return F.regexp_extract(F.substring_index(F.substring_index(c, "#", 1), "?", 1), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?([\s\S]*)", 1)


def authority_of(c: Column) -> Column:
    return F.regexp_extract(_rest(c), r"^//([^/]*)", 1)


def host_port_of(c: Column) -> Column:
    return F.regexp_extract(authority_of(c), r"([^@]*)\z", 1)


def path_of(c: Column) -> Column:
    return F.regexp_replace(_rest(c), r"^//[^/]*", "")


def host_of(c: Column) -> Column:
    """Host without port and brackets."""
    return F.regexp_replace(F.regexp_replace(host_port_of(c), r":[0-9]*\z", ""), r"^\[|\]\z", "")


def _bad_escape(c: Column) -> Column:
    return F.contains(F.regexp_replace(c, "%[0-9A-Fa-f]{2}", ""), F.lit("%"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named there; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_parsable(c: Column) -> Column:
    """Whether a URL parser in the manner of RFC 3986 takes the string; the query is not looked into."""
    return bound(c, _is_parsable)


def _is_parsable(c: Column) -> Column:
    fragment = F.when(F.contains(c, F.lit("#")), F.regexp_extract(c, r"#([\s\S]*)", 1)).otherwise(F.lit(""))
    relative = (scheme_of(c) == "") & ~c.startswith("/")
    host = host_port_of(c)
    return ~(
        c.rlike(r"[\x00-\x1F\x7F]")
        | c.startswith(":")
        | (relative & F.regexp_extract(_rest(c), "^([^/]*)", 1).contains(":"))
        | _bad_escape(path_of(c))
        | _bad_escape(fragment)
        | host.rlike(r"""[^A-Za-z0-9_.~!$&'()*+,;=:<>"\[\]\x{80}-\x{10FFFF}-]""")
        | (~host.startswith("[") & host.rlike(r":[0-9]*[^0-9:][^:]*\z"))
        | (host.startswith("[") & ~host.rlike(r"^\[[^\]]*\](:[0-9]*)?\z"))
    )


def is_http(c: Column) -> Column:
    return bound(c, lambda u: _is_parsable(u) & scheme_of(u).isin("http", "https"))


def is_js_strict(c: Column) -> Column:
    return c.rlike(JS_FILE)


def is_js_loose(c: Column) -> Column:
    low = F.lower(c)
    return low.endswith(".js") | low.contains(".js?") | low.contains("javascript")


def is_absolute(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def resolve_child(base: Column, path: Column) -> Column:
    """The URL of ``path`` found at ``base``; the base's path is taken as a directory and dots are kept."""
    root = F.concat(scheme_of(base), F.lit("://"), host_port_of(base))
    folder = F.regexp_replace(path_of(base), r"/\z", "")
    return F.when(is_absolute(path), path).when(path.startswith("/"), F.concat(root, path)).otherwise(F.concat(root, folder, F.lit("/"), path))


def child_scripts(base: Column, paths: Column) -> Column:
    """Distinct absolute script URLs among the paths of a page, in order."""
    cleaned = F.filter(F.transform(paths, clean_url), lambda p: (p != "") & is_js_strict(p))
    whole = F.transform(cleaned, lambda p: clean_url(resolve_child(base, p)))
    return F.array_distinct(F.filter(whole, lambda u: (u != "") & is_http(u)))


def parse_domains(text: str) -> list[str]:
    """'a.com, b.org' as a list; '' as the empty list, which allows everything."""
    return [d.strip() for d in text.split(",")] if text else []


def is_allowed_domain(c: Column, domains: list[str]) -> Column:
    """Suffix test of the host; relative paths and URLs without a host pass."""
    if not domains:
        return F.lit(True)
    host = host_of(c)
    hit = F.lit(False)
    for d in domains:
        hit = hit | host.endswith(d)
    relative = c.startswith("/") | c.startswith("./") | c.startswith("../")
    return relative | (is_parsable(c) & ((host == "") | hit))


def strip_for_extension(c: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index(c, "?", 1), "#", 1), r"/+\z", "")


def extension_of(c: Column) -> Column:
    """Lower-cased extension, with its dot, of the last element; '' if none."""
    return F.lower(F.regexp_extract(strip_for_extension(c), r"(\.[^./]*)\z", 1))


def has_blocked_extension(c: Column) -> Column:
    return extension_of(c).isin(fixed.FETCH_EXTENSIONS)


def looks_binary(c: Column) -> Column:
    """Whether the URL itself tells of a binary resource."""
    low = F.lower(c)
    return low.rlike("^(?:" + any_of(fixed.DATA_PREFIXES) + ")") | low.rlike(any_of(fixed.BINARY_URL_PARTS)) | low.rlike(any_of(fixed.BINARY_URL_PARAMS))


def output_base(name: str, profile: str = "deep") -> str:
    """Base name of the report files: the head profile takes an extension off."""
    return re.sub(r"\.[^./]*$", "", name) if profile == "head" else name
