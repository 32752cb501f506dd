"""Seed URLs from lists, files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import trim_space

SCHEMA = "url string"


def from_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], SCHEMA)


def from_lines(lines: DataFrame, comments: bool = True) -> DataFrame:
    """Lines (value) as seeds: trimmed, without empty lines and, if ``comments``, without those that begin with '#'."""
    out = lines.select(trim_space(F.col("value")).alias("url")).where("url != ''")
    return out.where(~F.col("url").startswith("#")) if comments else out


def from_file(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))


def union(*parts: DataFrame) -> DataFrame:
    """All seeds with their source's number and their place in it; repetitions stay."""
    out = None
    for i, p in enumerate(parts):
        part = p.select(F.lit(i).alias("part"), F.monotonically_increasing_id().alias("place"), "url")
        out = part if out is None else out.unionByName(part)
    return out
