"""Which fetched resources are analysed: the first test that fails gives the reason."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import binary_share, has_signature
from ..functions.url import any_of, has_blocked_extension, looks_binary

BODY_LIMIT = 50 * 1024 * 1024


def is_blocked_type(content_type: Column) -> Column:
    """Allowed prefixes win over blocked ones; an empty or unknown type passes."""
    main = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (main != "") & ~main.rlike("^(?:" + any_of(fixed.ALLOWED_TYPES) + ")") & main.rlike("^(?:" + any_of(fixed.BLOCKED_TYPES) + ")")


def is_download(disposition: Column) -> Column:
    low = F.lower(F.coalesce(disposition, F.lit("")))
    return low.contains("attachment") & ~low.rlike(any_of(fixed.TEXT_ATTACHMENTS))


def is_too_large(content_length: Column) -> Column:
    """By the number of digits, so from 100,000,000 bytes on."""
    return F.length(F.coalesce(content_length, F.lit(""))) > 8


def skip_reason(url: Column, status: Column, content_type: Column, disposition: Column, content_length: Column, body: Column) -> Column:
    """Why a resource is left out; null if it is analysed or is an error."""
    body = F.coalesce(body, F.lit(""))
    return (
        F.when(has_blocked_extension(url), "skipped: blacklisted file extension")
        .when(looks_binary(url), "skipped: suspicious binary URL pattern")
        .when(is_blocked_type(content_type), F.concat(F.lit("skipped: blacklisted content-type: "), content_type))
        .when(status != 200, F.lit(None).cast("string"))
        .when(is_download(disposition), "skipped: binary file download detected")
        .when(is_too_large(content_length), "skipped: file too large")
        .when(has_signature(body) | (binary_share(body) > 0.3), "skipped: binary content detected")
    )


def fetch_error(url: Column, status: Column, content_type: Column, error: Column) -> Column:
    """The error of a resource that is neither skipped before its status nor 200; '' if none."""
    early = has_blocked_extension(url) | looks_binary(url) | is_blocked_type(content_type)
    phrases = F.create_map(*[x for h in HTTPStatus for x in (F.lit(h.value), F.lit(f" {h.phrase}"))])
    code = F.concat(status.cast("string"), F.lit(": "), status.cast("string"), F.coalesce(F.try_element_at(phrases, status.cast("int")), F.lit("")))
    return F.when(early, F.lit("")).when(F.coalesce(error, F.lit("")) != "", error).when(status != 200, F.concat(F.lit("HTTP "), code)).otherwise(F.lit(""))


def admit(fetches: DataFrame, others: list[Column] | None = None) -> DataFrame:
    """``fetches`` (url, status, content_type, content_disposition, content_length, body, error) with content, error, skipped and skip_reason, and ``others``."""
    c = F.col
    body = F.substring(c("body").cast("binary"), 1, BODY_LIMIT)
    text = F.make_valid_utf8(body.cast("string"))
    out = fetches.withColumn("_e", fetch_error(c("url"), c("status"), c("content_type"), c("error")))
    reason = F.when(c("_e") == "", skip_reason(c("url"), c("status"), c("content_type"), c("content_disposition"), c("content_length"), c("body")))
    out = out.withColumn("skip_reason", reason)
    return out.select(
        "url",
        F.when(c("skip_reason").isNull() & (c("_e") == ""), F.coalesce(text, F.lit(""))).alias("content"),
        c("_e").alias("error"),
        c("skip_reason").isNotNull().alias("skipped"),
        "skip_reason",
        *(others or []),
    )
