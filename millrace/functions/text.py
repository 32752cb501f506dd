"""Predicates on responses and extracted paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .url import any_of, is_absolute, trim_space

# The patterns of literals, binary runs and admitted paths.
#: Quoted absolute URLs and rooted or dotted paths; the quotes need not match.
LITERAL = r"""["'](https?://[^"'\t\n\f\r <>]+|\.{0,2}/[^"'\t\n\f\r <>,;|*()\[\]{}\\]+)["']"""
INLINE_DATA = r"data:[^;]+;base64,[A-Za-z0-9+/=]{100,}"
LONG_BASE64 = r"[A-Za-z0-9+/=]{500,}"
BINARY_RUN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF]{20,}"
HEAD_PATH = r"^(?:https?://[^\t\n\f\r <>]+|\.{0,2}/[^\t\n\f\r <>,;|*()\[\]{}\\]+)\z"
DEEP_PATH = r"^(?:https?://|/)[^\t\n\f\r ]+"


def clean_binary(c: Column) -> Column:
    """Without inline data URLs, long base64 runs and runs of unprintable characters, in that order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, INLINE_DATA, ""), LONG_BASE64, ""), BINARY_RUN, "")


def path_literals(c: Column) -> Column:
    """All path literals of a text, trimmed, in order and with repetitions."""
    return F.transform(F.regexp_extract_all(clean_binary(c), F.lit(LITERAL), F.lit(1)), trim_space)


def is_valid_path(p: Column) -> Column:
    starts = is_absolute(p) | p.startswith("/") | p.startswith("./") | p.startswith("../")
    return F.octet_length(p).between(2, 2000) & starts & p.rlike("[a-zA-Z0-9]")


def has_file_extension(p: Column) -> Column:
    return F.lower(p).rlike("(?:" + any_of(fixed.PATH_EXTENSIONS) + r")(?:\?|\z)")


def has_static_segment(p: Column) -> Column:
    return F.lower(p).rlike(any_of(fixed.STATIC_SEGMENTS))


def has_download_param(p: Column) -> Column:
    return F.lower(p).rlike(any_of(fixed.DOWNLOAD_PARAMS))


def has_inline_base64(p: Column) -> Column:
    return F.lower(p).contains(";base64,") & (F.octet_length(p) > 100)


def is_blocked_path(p: Column) -> Column:
    return has_file_extension(p) | has_inline_base64(p) | has_static_segment(p) | has_download_param(p)


def has_zero_width(p: Column) -> Column:
    return p.rlike(r"[\x00\x{FEFF}\x{200B}-\x{200D}]")


def non_ascii_share(p: Column) -> Column:
    return F.length(F.regexp_replace(p, r"[\x00-\x7F]", "")) / F.length(p)


def has_control(p: Column) -> Column:
    return p.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")


def has_private_use(p: Column) -> Column:
    ends = "".join(rf"\x{{{n:X}FFFE}}\x{{{n:X}FFFF}}" for n in range(1, 17))
    return p.rlike(rf"[\x{{E000}}-\x{{F8FF}}\x{{F0000}}-\x{{FFFFD}}\x{{100000}}-\x{{10FFFD}}\x{{FDD0}}-\x{{FDEF}}\x{{FFFE}}\x{{FFFF}}{ends}]")


def top_char_share(p: Column) -> Column:
    """Share of the most frequent code point."""
    counts = F.transform(F.array_distinct(F.split(p, "")), lambda ch: F.length(p) - F.length(F.replace(p, ch, F.lit(""))))
    return F.array_max(counts) / F.length(p)


def is_repetitive(p: Column) -> Column:
    size = F.octet_length(p)
    one = (top_char_share(p) > 0.4) | p.rlike(any_of(fixed.RUNS))
    return (size >= 10) & (one | ((size > 20) & F.lower(p).rlike(any_of(fixed.ALTERNATIONS))))


def is_unusual(p: Column) -> Column:
    return has_zero_width(p) | (non_ascii_share(p) > 0.3) | has_control(p) | is_repetitive(p) | has_private_use(p)


def is_base64_like(p: Column) -> Column:
    bare = F.regexp_replace(p, "[= \\n\\r\\t]", "")
    n = F.length(bare)
    return (n >= 20) & bare.rlike(r"^[A-Za-z0-9+/]*\z") & (F.least(n, F.lit(100)) % 4 != 1)


def is_binary_like(p: Column) -> Column:
    size = F.octet_length(p)
    return (size >= 10) & (((size > 100) & is_base64_like(p)) | p.rlike(any_of(fixed.PACKED_MARKS)))


def is_wanted_path(p: Column) -> Column:
    """The whole filter chain, cheap tests first."""
    return is_valid_path(p) & ~is_blocked_path(p) & ~is_unusual(p) & ~is_binary_like(p)


def has_signature(body: Column) -> Column:
    """Whether binary content starts with a known signature; needs four bytes."""
    head = F.hex(F.substring(body.cast("binary"), 1, 4))
    return (F.octet_length(body) >= 4) & head.rlike("^(?:" + "|".join(fixed.SIGNATURES) + ")")


def binary_share(body: Column) -> Column:
    """Share of control bytes among the first 2000 bytes; 0 below 100 bytes."""
    head = F.substring(body.cast("binary"), 1, 2000)
    shown = F.decode(head, "ISO-8859-1")
    odd = F.length(F.regexp_replace(shown, r"[^\x00-\x08\x0E-\x1F\x7F]", ""))
    return F.when(F.octet_length(body) < 100, F.lit(0.0)).otherwise(odd / F.octet_length(head))


def is_text(body: Column) -> Column:
    return ~has_signature(body) & ~(binary_share(body) > 0.3)
