"""python -m millrace: scans URLs, or a table of fetched resources, and writes reports."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.url import output_base, parse_domains
from .operators import report
from .operators.crawl import crawl
from .sources import fetched, seeds


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("-u", metavar="URL", default="", help="a URL to scan")
    p.add_argument("-fj", metavar="FILE", default="", help="a file of URLs, one a line")
    p.add_argument("-ad", metavar="DOMAINS", default="", help="allowed domains, separated by commas")
    p.add_argument("-o", metavar="NAME", default="", help="base name of the JSON and text reports")
    p.add_argument("-deep", action="store_true", help="follow links to scripts")
    p.add_argument("-depth", type=int, default=3, help="how many links to follow (3)")
    p.add_argument("-H", metavar="HEADER", action="append", default=[], help="a request header, 'Name: value'; may be repeated")
    p.add_argument("--table", metavar="PARQUET", default="", help="fetched resources (url, status, ...) instead of requests")
    p.add_argument("--profile", choices=("deep", "head"), default="deep")
    p.add_argument("--pack", choices=("compat", "intended"), default="compat")
    return p.parse_args(argv)


def headers_of(lines: list[str]) -> dict[str, str]:
    """'Name: value' lines; those without a colon are passed over, of equal names the last holds."""
    return {k.strip(): v.strip() for k, colon, v in (h.partition(":") for h in lines) if colon}


def main(argv: list[str] | None = None, lines: list[str] | None = None) -> str:
    """Runs the scan; returns what is printed. ``lines`` are further seeds, by default those of a piped standard input."""
    a = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    if lines is None:
        lines = [] if sys.stdin.isatty() else sys.stdin.read().splitlines()
    parts = [seeds.from_lines(spark.createDataFrame([(x,) for x in lines], "value string"), comments=a.profile == "head")]
    if a.fj:
        parts.append(seeds.from_file(spark, a.fj))
    if a.u:
        parts.append(seeds.from_urls(spark, [a.u]))
    source = spark.read.parquet(a.table) if a.table else lambda frontier: fetched.http(frontier, headers_of(a.H))
    results = crawl(seeds.union(*parts), source, a.deep, a.depth, a.profile, a.pack, parse_domains(a.ad)).cache()
    if a.o:
        base = output_base(a.o, a.profile)
        with open(f"{base}.json", "w", encoding="utf-8") as f:
            f.write(report.json_report(results, a.deep, a.depth) + "\n")
        with open(f"{base}.txt", "w", encoding="utf-8") as f:
            if a.profile == "head":
                f.write(report.text_report(results))
            else:
                f.writelines(r.line + "\n" for r in report.listing(results).orderBy("section", "line").toLocalIterator())
    return report.console_report(results, headers=headers_of(a.H))


if __name__ == "__main__":
    print(main(), end="")
