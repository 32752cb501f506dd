import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M
from millrace.llm.q_mixing import oracle


def table(docs, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(2, 9) for _ in range(rng.randrange(0, 300))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(n)]
    return docs([*rows, (None, "null id", "en", "a"), (5, rows[5][1], rows[5][2], rows[5][3]), (900, None, "fr", "c"), (901, "", "en", "a")])


def test_against_sql(docs):
    d = table(docs)
    got = sorted(map(tuple, M.mixing_weights(d).collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", d.toPandas().assign(doc_id=lambda x: x.doc_id.astype("Int64")))
    want = con.execute(oracle()).fetchall()
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in sorted(want, key=repr)]
    assert max(abs(a[3] - b[3]) for a, b in zip(got, sorted(want, key=repr), strict=True)) < 1e-6


def test_marginals_meet_targets(spark):
    rng = random.Random(4)
    cells = [(a, b, c, float(rng.randrange(1, 99))) for a in "xyz" for b in "uv" for c in "pq"]
    df = spark.createDataFrame(cells, "_k0 string, _k1 string, _k2 string, tokens double")
    goals = [{"x": 50.0, "y": 30.0, "z": 20.0}, {"u": 60.0, "v": 40.0}, {"p": 10.0, "q": 90.0}]
    targets = [spark.createDataFrame(list(g.items()), f"_k{i} string, goal double").withColumn("full", F.lit(False)) for i, g in enumerate(goals)]
    for x in range(2):
        out = M.rake(df, targets, budget=0.1, tolerance=1e-9).collect()
        for i, g in enumerate(goals):
            sums = defaultdict(float)
            for r in out:
                sums[r[f"_k{i}"]] += r.tokens * min(1.0, r.factor)
            assert all(abs(sums[k] - v) < 1e-6 for k, v in g.items())
        df = df.repartition(3)
        M.ONE_TASK, before = 0, M.ONE_TASK  # the same with exchanges
    M.ONE_TASK = before


def test_report_names_what_cannot_be_met(docs, spark):
    d = table(docs, 1500, 3)
    rows = M.mixing_report(d).collect()
    assert len(rows) > 8
    p = {(r.topic, r.probability) for r in M.mixing_weights(d).collect()}
    assert any(not r.met for r in rows) and any(r.met for r in rows) and max(x for _, x in p) <= 1
    total = sum(r.tokens for r in rows if r.dimension == "lang")
    for dim in M.DIMS:
        own = [r for r in rows if r.dimension == dim]
        assert abs(sum(r.goal for r in own) - M.BUDGET * total) < 1e-6 * total and abs(sum(r.target for r in own) - M.BUDGET * total) < 1e-6 * total
        assert all(r.goal <= r.tokens * (1 + 1e-12) and (r.goal >= r.target * (1 - 1e-12) or r.goal == r.tokens) for r in own)
        assert all(abs(r.reached / r.goal - 1) <= 1.01 * M.TOLERANCE for r in own if r.goal)
    targets = [spark.createDataFrame(x, f"_k{i} string, share double") for i, x in enumerate([[("a", 0.1), ("b", 0.3), ("c", 0.6)], [("en", 0.5), ("de", 0.5)], [("short-mixed", 1.0)]])]
    rows = {(r.dimension, r.category): r for r in M.mixing_report(d, targets).collect()}
    assert rows["source", "c"].goal == rows["source", "c"].tokens < rows["source", "c"].target and not rows["source", "c"].met


def test_draws(docs):
    d = table(docs, 2000, 2).withColumn("probability", F.lit("x")).withColumn("_tokens", F.lit(0))
    out = M.mixing_weights(d).collect()
    assert len(out) == 2004 and all(0 <= r.probability <= 1 for r in out)
    total, kept = sum(r.n_tokens for r in out), sum(r.n_tokens for r in out if r.kept)
    assert abs(kept / total - M.BUDGET) < 0.06
    for r in out[:50]:
        u = int(hashlib.md5(f"{'null' if r.doc_id is None else r.doc_id}#1".encode()).hexdigest()[:13], 16) / 2**52
        assert abs(u - r.probability) < 1e-5 or r.kept == (u < r.probability)
    left = M.mixed(d)
    assert left.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in left.select("doc_id").collect() if r.doc_id is not None) == sorted((False, r.doc_id) for r in out if r.kept and r.doc_id is not None)


def test_topic_and_targets(docs, spark):
    d = docs([(i, "a b c", "en", "s") for i in range(40)]).withColumn("topic", F.when(F.col("doc_id") < 20, "x"))
    one = lambda k, v: spark.createDataFrame([(k, v)], f"{'_k0' if k == 's' else '_k1'} string, share double")
    targets = [one("s", 1.0), one("en", 1.0), spark.createDataFrame([("x", 1.0)], "_k2 string, share double")]
    out = {r.doc_id: r.probability for r in M.mixing_weights(d, targets).collect()}
    assert {out[i] for i in range(20)} == {1.0} and {out[i] for i in range(20, 40)} == {0.0}


def test_empty(docs):
    assert M.mixing_weights(docs([])).count() == 0 and M.mixed(docs([])).count() == 0
    assert {r.probability for r in M.mixing_weights(docs([(1, None), (2, "")])).collect()} == {M.BUDGET}
    with pytest.raises(ValueError):
        M.mixed(docs([]).drop("source"))
