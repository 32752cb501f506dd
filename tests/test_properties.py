"""Properties that hold for any input."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import headers as H
from millrace.functions import text as T
from millrace.functions import url as U
from millrace.operators import crawl, paths, secrets
from millrace.sources import fetched, seeds

quiet = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
piece = st.sampled_from(['"', "'", "/", "./", "../", "https://h.ex/", "a", "Z9", ".js", ".png", "?x=1", "é", "​", "\\", " ", "\n", ",", "static", "PK", "----", "api_key", "=", "w", "-", "AKIA" + "A1" * 8, "ſ"])
texts = st.lists(st.lists(piece, max_size=40).map("".join), min_size=1, max_size=40)


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@given(texts)
@quiet
def test_paths_are_quoted_parts(spark, values):
    for profile in ("deep", "head"):
        for text, found in zip(values, column(spark, values, lambda v, p=profile: paths.admitted_paths(paths.wanted_paths(v), p)), strict=True):
            assert found == sorted(set(found))
            quoted = re.findall(r"""(?=["']([^"']*)["'])""", text)
            assert all(any(p in q for q in quoted) for p in found)


@given(texts)
@quiet
def test_gate_and_labels(spark, values):
    for pack in ("compat", "intended"):
        gated = column(spark, values, lambda v, p=pack: secrets.secret_matches(v, p))
        assert gated == column(spark, values, lambda v, p=pack: secrets.secret_matches(v, p, gate=False))
        assert all(m.match in t for t, ms in zip(values, gated, strict=True) for m in ms)


@given(texts)
@quiet
def test_urls_and_display(spark, values):
    assert column(spark, values, lambda v: U.clean_url(v) == F.trim(U.clean_url(v))) == [True] * len(values)
    assert column(spark, values, lambda v: F.octet_length(H.shorten(v, 20)) <= 20) == [True] * len(values)
    assert column(spark, values, lambda v: T.clean_binary(T.clean_binary(v))) == column(spark, values, T.clean_binary)


def test_crawl_visits_once(spark):
    rows = [(f"https://h.ex/{i}.js", 200, None, None, None, bytearray(f'"/{(i * 3) % 11}.js" "/{(i + 1) % 11}.js"'.encode()), "") for i in range(11)]
    out = crawl.crawl(seeds.from_urls(spark, ["https://h.ex/0.js"]), spark.createDataFrame(rows, fetched.SCHEMA), max_depth=4).collect()
    assert len({r.url for r in out}) == len(out) and max(r.depth for r in out) <= 4
    by = {r.url: r for r in out}
    assert all(by[r.parent_url].depth == r.depth - 1 for r in out if r.depth)


def test_bucketed_fetches_join_without_a_shuffle(spark):
    rows = [(f"https://h.ex/{i}.js", 200, None, None, None, bytearray(b"x"), "") for i in range(8)]
    fetched.save_bucketed(spark.createDataFrame(rows, fetched.SCHEMA), "millrace_fetched", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("millrace_fetched").join(spark.table("millrace_fetched").select("url"), "url")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table millrace_fetched")
