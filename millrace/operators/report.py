"""Summaries of scan results and the report files."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import format_secret, format_size, mask_header, shorten
from ..functions.url import is_absolute, is_js_strict


def summarise(results: DataFrame) -> DataFrame:
    """One row: totals over all results. successful_incl_skipped counts skips as successes, as the deep profile does."""
    error = F.coalesce(F.col("error"), F.lit("")) != ""
    return results.agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(~error & ~F.col("skipped")).alias("successful_scans"),
        F.count_if(error).alias("failed_scans"),
        F.count_if(~error & F.col("skipped")).alias("skipped_scans"),
        F.count_if(~error).alias("successful_incl_skipped"),
        F.coalesce(F.sum("path_count"), F.lit(0)).alias("total_paths"),
        F.coalesce(F.sum("secret_count"), F.lit(0)).alias("total_secrets"),
    )


def listing(results: DataFrame) -> DataFrame:
    """(section, line): distinct URLs (section 0) and rooted paths (section 1) of the results without an error."""
    good = results.where(F.coalesce(F.col("error"), F.lit("")) == "")
    paths = good.select(F.explode("paths").alias("line"))
    urls = good.select(F.col("url").alias("line")).union(paths.where(is_absolute(F.col("line"))))
    rooted = paths.where(F.col("line").startswith("/"))
    return urls.distinct().select(F.lit(0).alias("section"), "line").union(rooted.distinct().select(F.lit(1), "line"))


def write_listing(results: DataFrame, folder: str) -> None:
    """Text files whose lines, read in the order of their names, are the sorted URLs and then the sorted paths."""
    listing(results).orderBy("section", "line").select("line").write.mode("overwrite").text(folder)


def write_results(results: DataFrame, folder: str) -> None:
    """The results as JSON lines; for any number of them."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def json_report(results: DataFrame, deep: bool = False, max_depth: int = 3, most: int = 100_000) -> str:
    """One indented JSON object with totals and all results, for at most ``most`` of them; '<', '>' and '&' are escaped."""
    head = summarise(results).first().asDict()
    if head["total_urls"] > most:
        raise ValueError(f"{head['total_urls']} results; write_results takes any number")
    rows = [json.loads(r[0]) for r in results.orderBy("url").select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"})).collect()]
    for r in rows:
        for name in ("error", "skip_reason", "parent_url"):  # empty ones are left out
            if not r.get(name):
                r.pop(name, None)
        for name in ("paths", "secrets"):
            r[name] = r.get(name) or None
    out = {k: head[k] for k in ("total_urls", "successful_scans", "failed_scans", "skipped_scans", "total_paths", "total_secrets")}
    out |= {"deep_scan_enabled": deep, "max_depth": max_depth, "scan_date": datetime.now(UTC).isoformat(timespec="seconds"), "results": rows}
    text = json.dumps(out, indent=2, ensure_ascii=False)
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def masked_headers(spark: SparkSession, headers: dict[str, str]) -> list[str]:
    """'name: value' of request headers, sensitive values masked."""
    rows = spark.createDataFrame(list(headers.items()), "name string, value string")
    return [f"{r.name}: {r.shown}" for r in rows.select("name", mask_header(F.col("name"), F.col("value")).alias("shown")).collect()]


def console_report(results: DataFrame, most: int = 1000, headers: dict[str, str] | None = None) -> str:
    """What a terminal shows: the request headers, masked; of each result a head with depth and parent, paths with a mark for scripts, secrets, counts, size and duration; then the totals."""
    totals = summarise(results).first()
    if totals["total_urls"] > most:
        raise ValueError(f"{totals['total_urls']} results; show() or the writers take any number")
    for name, value in (("depth", F.lit(0)), ("parent_url", F.lit(""))):
        if name not in results.columns:
            results = results.withColumn(name, value)
    shown = results.orderBy("depth", "url").select(
        "*",
        F.transform("paths", lambda p: F.concat(shorten(p, 70), F.when(is_js_strict(p), F.lit(" [JS]")).otherwise(F.lit("")))).alias("_paths"),
        F.transform("secrets", format_secret).alias("_secrets"),
        format_size(F.coalesce("content_size", F.lit(0))).alias("_size") if "content_size" in results.columns else F.lit("0B").alias("_size"),
    )
    lines = ["headers:", *(f"  {h}" for h in masked_headers(results.sparkSession, headers))] if headers else []
    for r in shown.collect():
        pad = "  " * r["depth"]
        lines += ["-" * 80, f"{pad}{r['url']}" + (f" [JS] (depth: {r['depth']})" if r["depth"] else "")]
        lines += [f"{pad}  from: {r['parent_url']}"] if r["parent_url"] else []
        if r["error"] or r["skipped"]:
            lines.append(f"{pad}  {r['error'] or r['skip_reason']}")
            continue
        lines += [f"{pad}  -> {p}" for p in r["_paths"]] + [f"{pad}  !! {s}" for s in r["_secrets"]]
        lines.append(f"{pad}  paths: {r['path_count']} | secrets: {r['secret_count']}")
        lines.append(f"{pad}  size: {r['_size']}" + (f" | duration: {r['duration']}" if "duration" in r and r["duration"] else ""))
    lines += ["=" * 80, f"URLs: {totals['total_urls']} | ok: {totals['successful_scans']} | skipped: {totals['skipped_scans']} | failed: {totals['failed_scans']} | paths: {totals['total_paths']} | secrets: {totals['total_secrets']}"]
    return "\n".join(lines) + "\n"


def text_report(results: DataFrame, most: int = 100_000) -> str:
    """The head profile's report: every URL with its paths, the secrets by URL, and the totals."""
    totals = summarise(results).first()
    if totals["total_urls"] > most:
        raise ValueError(f"{totals['total_urls']} results; write_listing takes any number")
    rows = results.orderBy("url").select("url", "paths", "secrets", "error", "skipped").collect()
    bar, rule = "=" * 40, "-" * 40
    lines = ["SCAN RESULTS", bar, "", "DISCOVERED URLS AND PATHS:", rule]
    for r in rows:
        lines += [r["url"], *(r["paths"] if not r["error"] and not r["skipped"] else [])]
    lines += ["", bar, "SECRETS FOUND:", rule]
    for r in rows:
        if r["secrets"]:
            lines += ["", f"From: {r['url']}", *(f"  {s}" for s in r["secrets"])]
    lines += ["", bar, "OVERALL SUMMARY:", rule, f"Total URLs Processed: {totals['total_urls']}", f"Successful Scans: {totals['successful_scans']}", f"Skipped URLs: {totals['skipped_scans']}"]
    lines += [f"Failed Scans: {totals['failed_scans']}", f"Total Paths Found: {totals['total_paths']}", f"Total Secrets Found: {totals['total_secrets']}", bar]
    return "\n".join(lines) + "\n"
