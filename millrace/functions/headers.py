"""Request headers and what is shown of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .url import any_of, trim_space


def header_pair(raw: Column) -> Column:
    """struct(name, value) cut at the first colon, both trimmed; null without a colon."""
    at = F.instr(raw, ":")
    pair = F.struct(trim_space(F.substring_index(raw, ":", 1)).alias("name"), trim_space(F.regexp_extract(raw, r"^[^:]*:([\s\S]*)", 1)).alias("value"))
    return F.when(at > 0, pair)


def parse_headers(raw: Column) -> Column:
    """array<string> as a map; of equal names the last value holds."""
    pairs = F.filter(F.transform(raw, header_pair), lambda p: p.isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
    return F.map_from_entries(last)


def mask_header(name: Column, value: Column) -> Column:
    """The value, masked but for four bytes at each end if the name is sensitive."""
    n = F.octet_length(value)
    raw = value.cast("binary")

    def part(start: Column, size: Column) -> Column:
        return F.make_valid_utf8(F.substring(raw, start, size).cast("string"))

    hidden = F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(part(F.lit(1), F.lit(4)), F.repeat(F.lit("*"), n - 8), part(n - 3, F.lit(4))))
    return F.when(F.lower(name).rlike(any_of(fixed.SENSITIVE_HEADERS)), hidden).otherwise(value)


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` bytes, the last three of a cut text being dots; a cut within a character drops it."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), F.lit(1), F.lit(most - 3)).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, "\\x{FFFD}+\\z", ""), F.lit("...")))


def format_secret(rendered: Column) -> Column:
    """'LABEL: value' with the value shortened to 50 bytes."""
    label = F.upper(F.substring_index(rendered, ": ", 1))
    value = F.regexp_extract(rendered, r"^[\s\S]*?: ([\s\S]*)", 1)
    return F.when(F.instr(rendered, ": ") > 0, F.concat(label, F.lit(": "), shorten(value, 50))).otherwise(shorten(rendered, 50))


def format_size(n: Column) -> Column:
    """Bytes as B, KB or MB with one digit, halves to the even digit: ``format_string`` alone would round them up."""

    def shown(unit: int, name: str) -> Column:
        return F.format_string(f"%.1f{name}", F.bround(n / unit, 1))

    return F.when(n > 1024 * 1024, shown(1024 * 1024, "MB")).when(n > 1024, shown(1024, "KB")).otherwise(F.concat(n.cast("string"), F.lit("B")))
