import random

import duckdb
from pyspark.sql import functions as F

from millrace.llm import decontam as D
from millrace.llm.q_decontam import ORACLES


def brute(docs, items, n=5, t=0.8):
    def grams(text, k):
        w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    out = set()
    for item, text in items:
        size = min(n, grams(text, 1)[1])
        if size:
            want = grams(text, size)[0]
            out |= {(d, item, len(want), len(want & grams(x, size)[0])) for d, x in docs if len(want & grams(x, size)[0]) >= t * len(want) - 1e-12}
    return out


def cases():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 70)))) for i in range(40)] + [(90, None), (91, " "), (92, "Lone")]
    docs = [(0, None), (1, ""), (2, "lone"), (3, "x LONE y")]
    for i in range(60):
        text = [word() for _ in range(rng.randrange(200))]
        if rng.random() < 0.7:
            part = rng.choice(items[:40])[1].upper().split()
            part = [("q" if rng.random() < 0.02 else w) for w in part]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((10 + i, "\n".join(text) if i % 2 else " ".join(text)))
    return docs, items


def test_against_brute_force(spark, docs):
    rows, items = cases()
    table = docs(rows).withColumn("item_id", F.lit(5)).withColumn("hash", F.lit(5))
    out = D.contained_items(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_found) for r in out} == brute(rows, items) and len(out) > 20
    left = D.decontaminate(table, spark.createDataFrame(items, "item_id bigint, text string"))
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {r.doc_id for r in out}


def test_shuffled_join_and_sql(spark, docs, monkeypatch):
    rows, items = cases()
    both = spark.createDataFrame(items, "item_id bigint, text string")
    want = {tuple(r) for r in D.contained_items(docs(rows), both).collect()}
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in D.contained_items(docs(rows), both).collect()} == want
    con = duckdb.connect()
    con.register("documents", docs(rows).toPandas())
    con.register("benchmark", both.toPandas())
    assert {r for r in con.execute(ORACLES["op7_contained_items"]).fetchall()} == want


def test_sketch_is_complete(spark):
    """Any 80 % of an item's shingles hold one of its sketch."""
    text = " ".join(f"w{i}" for i in range(64))
    for n in (5, 6, 20, 35, 64):
        rows = D.item_index(spark.createDataFrame([(1, " ".join(text.split()[:n]))], "item_id bigint, text string")).collect()
        size = len(rows)
        assert sum(r.sketch for r in rows) > size - -(-8 * size // 10)


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contained_items(docs([(1, "a b c d e")]), none).count() == 0
    assert D.contained_items(docs([]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0
    same = docs([(1, "a b c d e"), (1, "f g"), (None, "a b c d e")])
    pairs = D.contained_items(same, spark.createDataFrame([(7, "a b c d e")], "item_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_found) for r in pairs) == [(0, 1), (1, 1)]
    assert [r.doc_id for r in D.decontaminate(same, spark.createDataFrame([(7, "a b c d e")], "item_id bigint, text string")).collect()] == []


def test_candidates_come_from_sketches_alone(spark, docs, monkeypatch):
    """Without its sketch rows a pair is not found, and fewer rows are joined than with whole sets."""
    rows, items = cases()
    table, both = docs(rows), spark.createDataFrame(items, "item_id bigint, text string")
    found = D.contained_items(table, both).collect()
    lost = found[0].item_id
    whole = D.item_index
    index = whole(both)
    assert index.where("sketch").count() < 0.5 * index.count()
    sizes = sorted({r.width for r in index.select("width").distinct().collect()})
    pairs = D.candidates(table, index, sizes)
    assert {(r.doc_id, r.item_id) for r in found} <= {tuple(r) for r in pairs.collect()}
    own = table.select("doc_id", F.explode(D.shingles(F.col("text"), sizes)).alias("hash"))
    assert own.join(index.where("sketch").select("hash"), "hash").count() < 0.5 * own.join(index.select("hash"), "hash").count()
    monkeypatch.setattr(D, "item_index", lambda *a: whole(*a).withColumn("sketch", F.col("sketch") & (F.col("item_id") != lost)))
    assert {tuple(r) for r in D.contained_items(table, both).collect()} == {tuple(r) for r in found if r.item_id != lost}


def test_long_text_and_clashing_columns(spark, docs):
    rng = random.Random(4)
    item = " ".join(f"i{k}" for k in range(30))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000)) + " " + item
    table = docs([(1, long), (2, "short text of few words here")]).withColumn("bad", F.lit(1)).withColumn("_d", F.lit(2)).withColumn("sketch", F.lit(3))
    both = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id bigint, text string").withColumn("size", F.lit(1))
    assert [(r.doc_id, r.item_id, r.containment) for r in D.contained_items(table, both).collect()] == [(1, 7, 1.0)]
    left = D.decontaminate(table, both)
    assert left.columns == table.columns and [r.doc_id for r in left.collect()] == [2]
