"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A file's headers are its sentences or lines with a licence phrase, and its runs of adjoining comment lines that have one; a
licence file (LICENSE, COPYING, NOTICE and the like) gives its paragraphs and its whole text besides. Headers
become sparse vectors of word counts times the inverse document frequency among the
templates (``licences.txt``), are joined with the template vectors by word, and take the template with the
largest cosine. An SPDX identifier is read as it stands, before all of them, without "-only", "-or-later" or "+". A reservation of
all rights counts only where no licence is near. A file without a licence of its own inherits that of the licence file
in the nearest directory above it, found by joining the paths' ancestors. Only headers,
which are few, leave the row they stand in; texts are never shuffled.

Defined results
---------------
* null or empty text, or no licence phrase: no licence of its own.
* null path: no licence at all. Rows with equal path are one file and get one answer, each.
* very long texts: split in the row; of a licence file all words are shuffled, counted first.
* ties: the identifier or template first in the alphabet; of several licence files in a directory the one with the larger cosine, then the first licence.
* empty table: empty result. Further columns, whatever their names, are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, written

THRESHOLD = 0.6
#: Directories with a licence file up to which they are broadcast (about 80 bytes each).
BROADCAST_ROWS = 200_000
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|public domain|all rights reserved|permission is hereby granted|redistribution and use"
PASSAGES = r"[.!?;][\x20\x09-\x0D]+|\n"
PARAGRAPHS = r"\n[\x20\x09\x0D]*\n"
#: A comment line, and its mark.
COMMENT = r"^[\x20\x09]*(//|#|/\*|\*|--|;|%|<!--)[/#*;%!\x20\x09-]*"
WORD = r"[^a-z0-9]+"
SPDX = r"SPDX-License-Identifier:[\x20\x09]*\(?[\x20\x09]*([A-Za-z0-9.+-]+)"
SPDX_TAIL = r"(-only|-or-later|\+)$"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|copyright|unlicense)([._-].*)?$"
RESERVED = "proprietary"


def read_templates(path: Path = Path(__file__).with_name("licences.txt")) -> list[tuple[str, str]]:
    """(licence, text) of each template of a file."""
    parts = re.split(r"(?m)^== (\S+)\n", path.read_text(encoding="utf-8"))
    return [(name, " ".join(text.split())) for name, text in zip(parts[1::2], parts[2::2], strict=True)]


TEMPLATES = read_templates()


def template_terms(templates: list[tuple[str, str]] | None = None) -> tuple[list[tuple[str, int, float, float]], float]:
    """(word, template, idf, weight in the unit vector) of all templates, and the idf of words that none has."""
    bags = [Counter(w for w in re.split(WORD, t.lower()) if w) for _, t in templates or TEMPLATES]
    n = len(bags)
    seen = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in seen.items()}
    rows = []
    for i, b in enumerate(bags):
        size = math.sqrt(sum((c * idf[w]) ** 2 for w, c in b.items()))
        rows += [(w, i, idf[w], c * idf[w] / size) for w, c in b.items()]
    return rows, math.log(1 + n) + 1


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def passages_of(text: Column, is_license_file: Column) -> Column:
    """The distinct headers of a text."""
    none = F.array().cast("array<string>")
    sentences = F.split(text, PASSAGES)
    # lines that are no comment part the runs of those that are
    marked = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(COMMENT), F.concat(F.lit(" "), F.regexp_replace(x, COMMENT, ""))).otherwise(F.lit("\x00")))
    runs = F.when(text.rlike("(?m)" + COMMENT), F.split(F.array_join(marked, ""), "\x00")).otherwise(none)
    parts = F.filter(F.concat(sentences, runs, F.when(is_license_file, F.split(text, PARAGRAPHS)).otherwise(none)), lambda p: p.rlike(TRIGGER))
    return F.array_distinct(F.concat(F.when(text.rlike(TRIGGER), parts).otherwise(none), F.when(is_license_file, F.array(text)).otherwise(none)))


def _rank(license_: Column) -> Column:
    return F.when(license_ == RESERVED, 2).otherwise(1)


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score) of the files with an SPDX identifier, or a header or whole licence text near a template."""
    chosen = templates or TEMPLATES
    terms, unknown = template_terms(chosen)
    spark = files.sparkSession
    vectors = F.broadcast(spark.createDataFrame(terms, "word string, template int, idf double, weight double"))
    names = F.array(*[F.lit(n) for n, _ in chosen])
    text = F.coalesce(F.col("text"), F.lit(""))
    named = files.where(F.col("path").isNotNull())
    tags = named.select("path", F.explode(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))).alias("id")).select("path", F.lit(1.0).alias("score"), F.regexp_replace("id", SPDX_TAIL, "").alias("license"), F.lit(0).alias("rank"))
    passages = named.select("path", F.explode(passages_of(text, _name(F.col("path")).rlike(LICENSE_FILE))).alias("passage"))
    counts = passages.select("path", "passage", F.explode(F.split(F.lower("passage"), WORD)).alias("word")).where("word != ''")
    # the passage itself is the key: its hash stands for it, as it may be long
    bag = counts.groupBy("path", F.xxhash64("passage").alias("passage"), "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.coalesce("idf", F.lit(unknown))
    known = F.broadcast(spark.createDataFrame(sorted({(w, i) for w, _, i, _ in terms}), "word string, idf double"))
    sized = bag.join(known, "word", "left").groupBy("path", "passage").agg(F.sqrt(F.sum(F.pow(F.col("tf") * idf, F.lit(2.0)))).alias("size"))
    dots = bag.join(vectors, "word").groupBy("path", "passage", "template").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    near = dots.join(sized, ["path", "passage"]).select("path", F.round(F.col("dot") / F.col("size"), 6).alias("score"), F.element_at(names, F.col("template") + 1).alias("license")).where(F.col("score") >= threshold)
    every = near.withColumn("rank", _rank(F.col("license"))).unionByName(tags)
    best = every.groupBy("path").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b"))
    return best.select("path", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"))


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """path, own_license, score, license and inherited_from (directory, null if the licence is the file's own or there is none), a row for each row of ``files`` (path, text)."""
    require(files, "path", "text")
    own = written(own_licenses(files.select("path", "text"), templates, threshold), "licenses")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    above = own.where(_name(F.col("path")).rlike(LICENSE_FILE)).groupBy(parent.alias("dir")).agg(F.min(F.struct(_rank(F.col("license")).alias("r"), (-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b")).select("dir", F.col("b.l").alias("dir_license"))
    above = written(above, "license-dirs")
    if above.count() <= BROADCAST_ROWS:
        above = F.broadcast(above)
    names = files.select("path").where(F.col("path").isNotNull()).distinct()
    bare = names.join(own, "path", "left_anti")
    steps = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    climbed = bare.select("path", F.posexplode(ancestors).alias("depth", "dir")).join(above, "dir")
    nearest = climbed.groupBy("path").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n")).select("path", F.col("n.dir").alias("inherited_from"), F.col("n.dir_license").alias("dir_license"))
    out = files.select("path").join(own, "path", "left").join(nearest, "path", "left")
    return out.select("path", F.col("license").alias("own_license"), "score", F.coalesce("license", "dir_license").alias("license"), "inherited_from")
