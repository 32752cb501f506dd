"""Crawl along script links, level by level.

A concurrent depth-first search would have depths that depend on timing; here depth is the least number of links and the parent the smallest URL among
the parents at that depth, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import child_scripts
from .lineage import cut
from .rules import KEYWORDS
from .scan import normalised_seeds, scan_fetched


#: URLs of a level up to which they are broadcast (about 100 bytes each), so that bodies stay where they are; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000


def crawl(seeds: DataFrame, fetches: DataFrame | Callable[[DataFrame], DataFrame], deep: bool = True, max_depth: int = 3, profile: str = "deep", pack: str = "compat", domains: list[str] | None = None, rules_path: Path = KEYWORDS) -> DataFrame:
    """Scan results of the seeds (url) and, if ``deep``, of the scripts that they lead to, with depth and parent_url.

    ``fetches`` holds what can be fetched; a URL without a row gives an error result, and of several rows
    with one URL the first by value holds. It may also be a function that fetches a level's table of URLs. Repeated
    seeds are one in a deep crawl; without it each has its result.
    """
    seeds = normalised_seeds(seeds).select("url")
    frontier = cut((seeds.distinct() if deep else seeds).select("url", F.lit("").alias("parent_url")))
    visited, results = None, None
    for depth in range(max_depth + 1 if deep else 1):
        wanted = frontier.select("url").distinct()
        few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        table = cut(fetches(wanted)) if callable(fetches) else fetches
        table = table.join(few, "url", "left_semi").withColumn("error", F.when(F.col("status").isNull() & (F.coalesce("error", F.lit("")) == ""), F.lit("not fetched")).otherwise(F.col("error"))).withColumn("status", F.coalesce("status", F.lit(200)))
        got = scan_fetched(table, profile, pack, domains, rules_path)
        got = got.groupBy("url").agg(F.min(F.struct(*[c for c in got.columns if c != "url"])).alias("r")).select("url", "r.*")
        got = cut(got)
        none = F.lit(None).cast("string")
        lost = wanted.join(got, "url", "left_anti").select("url", F.lit(200).alias("status"), *[none.alias(c) for c in ("content_type", "content_disposition", "content_length")], none.cast("binary").alias("body"), F.lit("not fetched").alias("error"))
        level = got.unionByName(scan_fetched(lost, profile, pack, domains, rules_path)).join(frontier, "url").withColumn("depth", F.lit(depth))
        level = cut(level)
        results = level if results is None else results.unionByName(level)
        if not deep or depth == max_depth:
            break
        seen = level.select("url")
        visited = seen if visited is None else visited.union(seen)
        links = level.where("error = ''").select(F.explode(child_scripts(F.col("url"), F.col("paths"))).alias("child"), F.col("url").alias("parent_url"))
        nearest = links.groupBy(F.col("child").alias("url")).agg(F.min("parent_url").alias("parent_url"))
        frontier = cut(nearest.join(visited, "url", "left_anti"))
        if frontier.isEmpty():
            break
    return results
