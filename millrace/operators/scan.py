"""The scan: admission, paths and secrets of fetched resources, one result per resource."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import clean_url, is_http, is_js_loose, is_js_strict
from .admission import admit
from .paths import admitted_paths, wanted_paths
from .rules import KEYWORDS
from .secrets import distinct_secrets


def normalised_seeds(seeds: DataFrame) -> DataFrame:
    """``seeds`` (url) cleaned; what is no http or https URL is dropped, repetitions stay."""
    return seeds.withColumn("url", clean_url(F.col("url"))).where((F.col("url") != "") & is_http(F.col("url")))


def scan_fetched(fetches: DataFrame, profile: str = "deep", pack: str = "compat", domains: list[str] | None = None, rules_path: Path = KEYWORDS) -> DataFrame:
    """A result for each row of ``fetches``: url, paths, secrets, counts, is_js_file, error, skipped, skip_reason, content_size, scan_time, duration.

    Skipped and failed resources have empty arrays. Nothing is shuffled. ``content_size`` has bytes, ``duration`` the
    seconds of the request where ``fetches`` has them (fetched_at, seconds); else the time is that of the run.
    """
    text = F.coalesce("content", F.lit(""))
    at = F.coalesce("fetched_at", F.current_timestamp()) if "fetched_at" in fetches.columns else F.current_timestamp()
    took = F.col("seconds") if "seconds" in fetches.columns else F.lit(None).cast("double")
    kept = [at.alias("_at"), took.alias("_took")]
    out = admit(fetches, kept).select(
        "url",
        admitted_paths(wanted_paths(text), profile, domains).alias("paths"),
        distinct_secrets(text, pack, rules_path).alias("secrets"),
        "error",
        "skipped",
        "skip_reason",
        F.octet_length(text).cast("long").alias("content_size"),
        F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("scan_time"),
        F.concat(F.round("_took", 3).cast("string"), F.lit("s")).alias("duration"),
    )
    js = is_js_strict(F.col("url")) if profile == "deep" else is_js_loose(F.col("url"))
    return out.select("url", "paths", "secrets", F.size("paths").alias("path_count"), F.size("secrets").alias("secret_count"), js.alias("is_js_file"), "error", "skipped", "skip_reason", "content_size", "scan_time", "duration")
