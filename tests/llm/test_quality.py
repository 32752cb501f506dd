import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.quality import FLOORS, Z, base_stats, chi2_quantile, consistency, fit_mcd, quality_filter, quality_rules


def brute(text):
    text = text or ""
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    seen, covered = {}, set()
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    n = len(ws)
    stats = (n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*stats, n < 10 or 100 * stats[4] > 20 * n)


TEXTS = [None, "", " \n\t", "a", "one two three four five", "a b c d e " * 2, "a b c d e f " * 3 + "\nx y\nx y\n \n", "é#ü *|* <b>\n<b>\n<b>", "a b c d e a b c d e f g", "a a a a a a", "x\x0by\x85z w  q", "\n".join(["line one is here"] * 5)]


def test_base_against_brute_force(docs):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)] + ["w " * 20_000]
    out = base_stats(docs(enumerate(texts))).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out] == [brute(t) for t in texts]


def test_base_against_sql(docs, tmp_path):
    docs(enumerate(TEXTS)).write.parquet(str(tmp_path / "d"))
    sql = rf"""select doc_id, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as word_chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_words,
      len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols from '{tmp_path}/d/*.parquet' order by doc_id"""
    got = base_stats(docs(enumerate(TEXTS))).orderBy("doc_id").select("doc_id", "word_chars", "n_words", "n_symbols").collect()
    assert [tuple(r) for r in got] == duckdb.sql(sql).fetchall()


def mcd(x, h=0.75, steps=12):
    floors = np.diag([FLOORS[z] ** 2 for z in Z])
    pick = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    m = np.array([pick(c, 0.5) for c in x.T])
    d = np.array([pick(abs(c - k), 0.5) for c, k in zip(x.T, m, strict=True)])
    found = []
    for m, s in ((m, np.diag((1.4826 * d) ** 2) + floors), (x.mean(axis=0), np.cov(x.T, bias=True) + floors)):
        det = np.inf
        for _ in range(steps):
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            near = x[d2 <= pick(d2, h)]
            m_, s_ = near.mean(axis=0), consistency(h, len(Z)) * np.cov(near.T, bias=True) + floors
            new = np.linalg.slogdet(s_)[1]
            if not new < det - 1e-3:
                break
            m, s, det = m_, s_, new
        found.append((det, m, s))
    return min(found, key=lambda f: f[0])[1:]


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)), rng.normal(9, 1, size=(60, 5))])
    both = [("g", *map(float, r)) for r in x] + [("h", *map(float, r)) for r in x[::-1] * 2 + 1]
    rows = spark.createDataFrame(both, "gkey string, " + ", ".join(f"{z} double" for z in Z))
    got = fit_mcd(rows).where("gkey = 'g'").first()
    m, s = mcd(x)
    low = np.array([[got[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose([got[f"m_{i}"] for i in range(5)], m) and np.allclose(low @ low.T, s)
    assert abs(chi2_quantile(0.75, 5) - 6.6257) < 1e-3


def test_verdicts(docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 9)))
    good = [(i, " ".join(word() for _ in range(rng.randrange(30, 300))), "en", "s") for i in range(400)]
    bad = [(1000 + i, " ".join(word() + "***" for _ in range(100)), "en", "s") for i in range(30)]
    few = [(2000, " ".join(word() for _ in range(50)), None, None), (2001, None, "xx", "s"), (2001, None, "xx", "s")]
    table = docs(good + bad + few).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1))
    out = quality_rules(table, min_group=50).collect()
    assert len(out) == len(good) + len(bad) + len(few)
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {r[0] for r in good} | {2000}
    left = quality_filter(table, min_group=50)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == kept and {r.kept for r in left.collect()} == {"mine"}


def test_small_groups_and_tables_are_judged(docs):
    rng = random.Random(8)
    text = lambda n, mark="": " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 9))) + mark for _ in range(n))
    plain = [(i, text(rng.randrange(30, 300)), "en", "s") for i in range(60)]
    junk = [(100, text(100, "****"), "en", "s")]
    assert {r.doc_id for r in quality_rules(docs(plain + junk)).where("not kept").collect()} == {100}  # 61 rows in all
    hot = [(1000 + i, text(rng.randrange(30, 300)), "en", "hot") for i in range(300)]
    coded = [(2000 + i, text(rng.randrange(30, 300), rng.choice(["**", "*"])), "en", "coded") for i in range(150)]
    out = quality_rules(docs(hot + coded + [(3000, text(100), "en", "one")])).collect()
    assert {r.doc_id for r in out if not r.kept} == set()
    spread = {r.doc_id: r.distance for r in out}
    own = {r.doc_id: r.distance for r in quality_rules(docs(hot + coded), min_group=100).collect()}
    lone = {r.doc_id: r.distance for r in quality_rules(docs(hot + coded), min_group=10**9).collect()}
    mean = lambda d: sum(d[2000 + i] for i in range(150)) / 150
    assert mean(own) < mean(spread) < mean(lone)  # drawn towards the language by the rows that are missing
    assert all(abs(spread[i] - own[i]) < 1e-9 for i in spread if 1000 <= i < 2000)  # enough rows: its own alone


def test_small_and_empty(docs):
    assert quality_rules(docs([])).count() == 0
    assert [r.kept for r in quality_rules(docs([(1, "a b c d e f g h i j k"), (2, "a")])).orderBy("doc_id").collect()] == [True, False]
    with pytest.raises(ValueError):
        quality_rules(docs([]).drop("lang"))
