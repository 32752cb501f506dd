import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity as X


def arrays(row):
    return np.array(list(row), dtype=np.int64), np.array(list(row.values()), dtype=float)


def test_index_against_brute_force():
    rng = random.Random(2)

    def vector():
        raw = {(rng.randrange(4) if rng.random() < 0.5 else rng.randrange(300)): rng.random() for _ in range(rng.randrange(1, 12))}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {k: v / size for k, v in raw.items()}

    rows = [vector() for _ in range(500)] + [vector()] * 20
    rows += rows[:30]
    rank = np.array(rng.sample(range(len(rows)), len(rows)))
    index = X.BlockMaxIndex([arrays(r) for r in rows], 300, rank, block=16)
    assert 0 < len(index.dense) < 300
    for _ in range(100):
        q, skip = vector(), rng.randrange(500)
        every = sorted((-round(sum(w * r.get(t, 0) for t, w in q.items()), 9), rank[i], i) for i, r in enumerate(rows) if i != skip)
        want = [(i, -s) for s, _, i in every if s < 0][:7]
        got = index.search(*arrays(q), 7, np.array([skip]))
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert X.BlockMaxIndex([], 5).search(*arrays({1: 1.0}), 3) == [] and index.search(*arrays({}), 3) == []


def test_query_against_brute_force(spark, docs):
    """Neighbours, votes, calibration and scores of the whole operator, over all words, by plain dictionaries."""
    table, labels, truth, _ = corpus(spark, docs, 260)
    out = {r.doc_id: r for r in X.toxicity(table, labels, k=5).collect() if r.doc_id is not None}
    rows = [(r.doc_id, r.text) for r in table.collect() if r.doc_id is not None]
    learned = {d: (y, X.word_counts(dict(rows)[d])) for d, y in truth.items() if not out[d].held_out}
    n1, n0 = sum(y for y, _ in learned.values()), sum(not y for y, _ in learned.values())
    df = {}
    for y, words in learned.values():
        for t in {*words, *(b for w in words for b in X.beginnings(w))}:
            df.setdefault(t, [0, 0])[y] += 1
    weight = {t: 1 + X.STRESS * X.evidence(b, a, n1, n0) ** 2 for t, (a, b) in df.items()}

    def terms(words):
        found = Counter(words)
        for w, n in words.items():
            for b in X.beginnings(w):
                if weight.get(b, 1) > 1:
                    found[b] += n
        return found

    seen = Counter(t for _, words in learned.values() for t in terms(words))

    def vector(words):
        raw = {t: (1 + math.log(n)) * math.log(1 + len(learned) / max(seen[t], 1)) * weight.get(t, 1.0) for t, n in terms(words).items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / size for t, w in raw.items()}

    vectors = {d: vector(words) for d, (_, words) in learned.items()}

    def near(query, without=()):
        every = sorted((-round(sum(w * v.get(t, 0) for t, w in query.items()), 9), d) for d, v in vectors.items() if d not in without)
        return [(d, -s) for s, d in every if s < 0][:5]

    def vote(found):
        w = [1 / (1.05 - min(s, 1)) for _, s in found]
        return sum(x * learned[d][0] for x, (d, _) in zip(w, found, strict=True)) / sum(w) if found else 0.0

    at = list(vectors)
    steps = X.isotonic(np.array([vote(near(vectors[d], {e for e in at if vectors[e] == vectors[d]})) for d in at]), np.array([float(learned[d][0]) for d in at]), np.ones(len(at)))
    for d, text in rows:
        found = near(vector(X.word_counts(text))) if X.word_counts(text) else []
        assert [x.doc_id for x in out[d].neighbours] == [x for x, _ in found]
        assert np.allclose([x.similarity for x in out[d].neighbours], [s for _, s in found]) and abs(out[d].score - X.level(steps, vote(found))) < 1e-6


def test_isotonic():
    steps = X.isotonic(np.array([0.0, 0.2, 0.2, 0.5, 1.0]), np.array([0, 1.0, 0, 0, 1.0]), np.ones(5))
    means = [m for _, m in steps]
    assert means == sorted(means) and all(0 < m < 1 for m in means) and X.level(steps, 2.0) == means[-1]


def corpus(spark, docs, n=900):
    rng = random.Random(4)
    words, rude = [f"word{i}" for i in range(400)], ["fiend", "ogre", "grum"]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if bad:
            for _ in range(3):
                w = rng.choice(rude)
                text.insert(rng.randrange(len(text)), w if w != "grum" else "grum" + rng.choice("abcdefgh") * 3)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    extra = [(5000, None), (5001, ""), (5002, "!!!"), (None, "ogre fiend ogre"), (5003, "FIEND ogre"), (5003, "FIEND ogre"), (5004, "word1 " * 20_000)]
    labels += [(None, 1), (3, None), (3, 0)]
    return docs(rows + extra), spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("text", F.lit("clash")), dict(labels[:n]), len(rows) + len(extra)


def test_held_out_quality(spark, docs):
    table, labels, truth, n = corpus(spark, docs)
    out = X.toxicity(table.withColumn("score", F.lit(1)), labels).collect()
    assert len(out) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = Counter((truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth)
    assert held[1, 1] > 20 * (held[1, 0] + held[0, 1]) / 2 and held[0, 0] > 100
    by = {r.doc_id: r for r in out}
    assert by[5003].predicted == 1 and len(by[5003].neighbours) == X.NEIGHBOURS and not by[5000].neighbours
    assert by[5000].score == by[5001].score == by[5002].score < 0.1 and by[5004].predicted == 0


def test_repeated_ids_are_one_example(spark, docs):
    table, labels, _, _ = corpus(spark, docs, 60)
    sample, _ = X.learned_sample(table.union(table).union(table).select("doc_id", "text"), labels, 10**6)
    rows = sample.collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {"doc_id", "toxic", "draw", "text"} == set(sample.columns)


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    table = docs([(1, "a"), (2, None)])
    assert {r.score for r in X.toxicity(table, none).collect()} == {0.0}
    assert X.toxicity(docs([]), none).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id bigint, toxic int")
    assert {r.score for r in X.toxicity(table, one).collect()} == {1.0}
