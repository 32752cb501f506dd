"""Fetched resources: tables of them, and an HTTP data source."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed

SCHEMA = "url string, status int, content_type string, content_disposition string, content_length string, body binary, error string"
#: What a request adds.
TIMED = SCHEMA + ", fetched_at timestamp, seconds double"
FIELDS = [c.split()[0] for c in TIMED.split(", ")]
AGENT = "Mozilla/5.0 (compatible; millrace)"


def from_table(df: DataFrame, url: str, body: str) -> DataFrame:
    """A table of texts as successful responses."""
    empty = F.lit(None).cast("string")
    return df.select(
        F.col(url).alias("url"), F.lit(200).alias("status"), empty.alias("content_type"), empty.alias("content_disposition"), empty.alias("content_length"), F.col(body).cast("binary").alias("body"), F.lit("").alias("error"),
    )


def save_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """Saves fetched resources as a table bucketed and sorted by url: the joins of a crawl then leave the bodies where they are."""
    df.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").saveAsTable(table)


def refused(url: str) -> bool:
    """Whether a URL is not to be requested at all: its extension or its form tells of a binary resource."""
    bare = re.sub(r"/+\Z", "", url.split("?", 1)[0].split("#", 1)[0])
    extension = re.search(r"\.[^./]*\Z", bare)
    low = url.lower()
    return (extension is not None and extension.group().lower() in fixed.FETCH_EXTENSIONS) or low.startswith(tuple(fixed.DATA_PREFIXES)) or any(x in low for x in [*fixed.BINARY_URL_PARTS, *fixed.BINARY_URL_PARAMS])


def wants_body(status: int, content_type: str | None, disposition: str | None, length: str | None) -> bool:
    """Whether a response passes every test that comes before its body."""
    main = (content_type or "").split(";", 1)[0].strip(" ").lower()
    blocked = not main.startswith(tuple(fixed.ALLOWED_TYPES)) and main.startswith(tuple(fixed.BLOCKED_TYPES))
    low = (disposition or "").lower()
    download = "attachment" in low and not any(x in low for x in fixed.TEXT_ATTACHMENTS)
    return status == 200 and not blocked and not download and len(length or "") <= 8


def _get(url: str, headers: dict, timeout: float, limit: int) -> tuple:
    """One GET without retry, as a row of TIMED; any failure is the resource's result. No request for a refused URL, no body that would not be read."""
    import urllib.error
    import urllib.request

    at, start = datetime.now(UTC), time.perf_counter()

    def row(*values) -> tuple:
        return (url, *values, at, time.perf_counter() - start)

    if refused(url):
        return row(None, None, None, None, None, "")
    try:
        if not url.lower().startswith(("http://", "https://")):
            raise ValueError("unsupported protocol scheme")
        request = urllib.request.Request(url, headers=headers)
        try:
            response = urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            response = e
        with response:
            h = response.headers
            facts = (response.status, h.get("Content-Type"), h.get("Content-Disposition"), h.get("Content-Length"))
            return row(*facts, response.read(limit) if wants_body(*facts) else None, "")
    except Exception as e:
        return row(None, None, None, None, None, str(e) or type(e).__name__)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.parts = int(options.get("partitions", "8"))
        self.timeout = float(options.get("timeout", "30"))
        self.limit = int(options.get("limit", str(50 * 1024 * 1024)))
        self.headers = {"User-Agent": AGENT} | dict(h.split("\t", 1) for h in options.get("headers", "").split("\n") if h)

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i :: self.parts]) for i in range(min(self.parts, len(self.urls)))]

    def read(self, partition: _Urls):
        for url in partition.urls:
            yield _get(url, self.headers, self.timeout, self.limit)


class HttpSource(DataSource):
    """``spark.read.format("millrace_http")``: one GET for each URL of the option ``urls`` (one a line), no retry."""

    @classmethod
    def name(cls) -> str:
        return "millrace_http"

    def schema(self) -> str:
        return TIMED

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))


def http(urls: DataFrame, headers: dict[str, str] | None = None, timeout: float = 30, limit: int = 50 * 1024 * 1024) -> DataFrame:
    """Fetches a table of URLs (url) in its partitions; a row for each, failures too."""
    own = {"User-Agent": AGENT} | (headers or {})

    def run(batches):
        import pandas as pd

        for b in batches:
            for url in b["url"]:  # a row at a time: bodies are large
                row = pd.DataFrame([_get(url, own, timeout, limit)], columns=FIELDS)
                yield row.astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, TIMED)


def fetch(spark: SparkSession, urls: list[str], headers: dict[str, str] | None = None, timeout: float = 30, partitions: int = 8) -> DataFrame:
    """Fetches a list of URLs; each response is a row, and so is each failure."""
    spark.dataSource.register(HttpSource)
    options = {"urls": "\n".join(urls), "headers": "\n".join(f"{k}\t{v}" for k, v in (headers or {}).items()), "timeout": str(timeout), "partitions": str(partitions)}
    return spark.read.format("millrace_http").options(**options).load()
