"""Secret extraction and labelling, as expressions in the row.

The 700 patterns are not run on every text. One scan of the normalised text (lower
case, without ``_`` and ``-``) with a single pattern, a trie of all keywords, tells which keywords
occur; only their rules are run on the text. That is a superset of the rules that can
match, as a separator between the parts of a keyword is optional and one character.
Irregular rules run where one of their fixed texts occurs. No row is exploded before
its matches are known, and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections import defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import trie_pattern
from .rules import KEYWORDS, UNKNOWN, beginnings, cases, rules

MATCH = "array<struct<rule_ord:int,match_ord:int,match:string>>"


def norm(text: Column) -> Column:
    """The text as keywords are looked up in it: long s and the Kelvin sign fold as in patterns."""
    return F.translate(F.lower(F.translate(text, "ſK", "sk")), "_-", "")


def _found(text: Column, words: list[str]) -> Column:
    """Distinct keywords in a text, each longest match standing for its beginnings too."""
    hits = F.array_distinct(F.regexp_extract_all(norm(text), F.lit(f"(?=({trie_pattern(words)}))"), F.lit(1)))
    longer = {w: b for w, b in beginnings(words).items() if len(b) > 1}
    table = _lookup(longer, "array<string>")
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.coalesce(F.try_element_at(table, h), F.array(h)))))


def _lookup(entries: dict[str, list], kind: str) -> Column:
    """A constant map; written as JSON it is one literal to the optimiser instead of thousands."""
    return F.from_json(F.lit(json.dumps(entries, ensure_ascii=False, sort_keys=True)), f"map<string,{kind}>")


def _matches(text: Column, order: Column, pattern: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m, i: F.struct(order.cast("int").alias("rule_ord"), i.cast("int").alias("match_ord"), m.alias("match")))


def secret_matches(text: Column, pack: str = "compat", path: Path = KEYWORDS, gate: bool = True, kinds: str = "all") -> Column:
    """array<struct(rule_ord, match_ord, match)> by rule and place. Without the gate every rule is run (for tests)."""
    every = rules(pack, path)
    irregular = [r for r in every if r.anchor is None] if kinds in ("all", "irregular") else []
    keyed = [r for r in every if r.anchor is not None] if kinds in ("all", "keyword") else []
    none = F.array().cast(MATCH)
    parts = []
    for r in irregular:
        hit = F.lit(not r.anchors or not gate)
        for a in r.anchors if gate else ():
            hit = hit | text.contains(a)
        parts.append(F.when(hit, _matches(text, F.lit(r.order), F.lit(r.java))).otherwise(none))
    if keyed and gate:
        table = defaultdict(list)
        for r in keyed:
            table[r.anchor].append({"o": r.order, "p": r.java})
        lookup = _lookup(table, "array<struct<o:int,p:string>>")
        run = F.flatten(F.transform(_found(text, sorted(table)), lambda k: F.element_at(lookup, k)))
        parts.append(F.flatten(F.transform(run, lambda r: _matches(text, r["o"], r["p"]))))
    elif keyed:
        run = F.array(*[F.struct(F.lit(r.order).alias("o"), F.lit(r.java).alias("p")) for r in keyed])
        parts.append(F.flatten(F.transform(run, lambda r: _matches(text, r["o"], r["p"]))))
    return F.array_sort(F.concat(*parts)) if parts else none


def classify(match: Column, pack: str = "compat", path: Path = KEYWORDS) -> Column:
    """The label of the first case that occurs in the match."""
    every = cases(pack, path)
    plain = [F.when(F.rlike(match, F.lit(c.java)), F.struct(F.lit(c.order).alias("o"), F.lit(c.label).alias("l"))) for c in every if c.anchor is None]
    table = defaultdict(list)
    for c in every:
        if c.anchor is not None:
            table[c.anchor].append({"o": c.order, "l": c.label, "p": c.java})
    lookup = _lookup(table, "array<struct<o:int,l:string,p:string>>")
    named = F.flatten(F.transform(_found(match, sorted(table)), lambda k: F.element_at(lookup, k)))
    named = F.transform(F.filter(named, lambda c: F.rlike(match, c["p"])), lambda c: F.struct(c["o"].alias("o"), c["l"].alias("l")))
    first = F.array_min(F.concat(F.filter(F.array(*plain), lambda c: c.isNotNull()), named))
    return F.coalesce(first["l"], F.lit(UNKNOWN))


def render(label: Column, match: Column) -> Column:
    """'label:  match', with one space after the default label."""
    return F.concat(label, F.when(label == UNKNOWN, F.lit(": ")).otherwise(F.lit(":  ")), match)


def is_valid_secret(rendered: Column) -> Column:
    return F.octet_length(rendered).between(5, 1000) & (F.octet_length(F.trim(rendered)) >= 5)


def scan_secrets(df: DataFrame, content: str = "content", pack: str = "compat", path: Path = KEYWORDS, kinds: str = "all", keep: list[str] | None = None) -> DataFrame:
    """One row per match: the kept columns, rule_ord, match_ord, match."""
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    text = F.coalesce(F.col(content), F.lit(""))
    return df.select(*keep, F.explode(secret_matches(text, pack, path, kinds=kinds)).alias("_m")).select(*keep, "_m.rule_ord", "_m.match_ord", "_m.match")


def label_secrets(found: DataFrame, pack: str = "compat", path: Path = KEYWORDS) -> DataFrame:
    """Adds label and rendered to the rows of ``scan_secrets``."""
    named = F.transform(F.array(classify(F.col("match"), pack, path)), lambda n: F.struct(n.alias("label"), render(n, F.col("match")).alias("rendered")))
    return found.select("*", F.inline(named))  # a generator: filters on the label do not classify once more


def distinct_secrets(text: Column, pack: str = "compat", path: Path = KEYWORDS) -> Column:
    """The rendered secrets of a text: valid ones, each once, in the order of their first match."""
    rendered = F.transform(secret_matches(text, pack, path), lambda m: render(classify(m["match"], pack, path), m["match"]))
    return F.array_distinct(F.filter(rendered, is_valid_secret))
