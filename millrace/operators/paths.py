"""Path extraction: literals of a text through the filter chain, as one expression in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEEP_PATH, HEAD_PATH, is_valid_path, is_wanted_path, path_literals
from ..functions.url import clean_url, is_allowed_domain


def wanted_paths(content: Column) -> Column:
    """Distinct paths of a text that pass the chain, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.array_distinct(path_literals(content)), is_wanted_path)))


def admitted_paths(paths: Column, profile: str = "deep", domains: list[str] | None = None) -> Column:
    """What the output takes of ``wanted_paths``. deep: rooted or absolute, cleaned; head: dotted paths too, as they are."""
    domains = domains or []
    if profile == "deep":
        kept = F.filter(F.transform(paths, clean_url), lambda p: p.rlike(DEEP_PATH) & is_allowed_domain(p, domains))
    elif profile == "head":
        kept = F.filter(paths, lambda p: p.rlike(HEAD_PATH) & is_valid_path(p) & is_allowed_domain(p, domains))
    else:
        raise ValueError(f"profile {profile!r}")
    return F.array_sort(F.array_distinct(kept))


def extract_paths(df: DataFrame, content: str = "content", out: str = "paths", profile: str = "deep", domains: list[str] | None = None) -> DataFrame:
    """``df`` with an array column of the admitted paths of ``content``."""
    return df.withColumn(out, admitted_paths(wanted_paths(F.coalesce(F.col(content), F.lit(""))), profile, domains))
