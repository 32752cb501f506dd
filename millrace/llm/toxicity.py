"""Toxicity by nearest labelled examples: exact TF-IDF cosine on a block-max inverted index.

A text is the TF-IDF vector of all its words, and its norm is that of the whole text. Toxicity shows in a few
words of a text, which would drown among all others; so each word has, beside its inverse document
frequency, a weight 1 + ``STRESS`` x e^2 by what it says of the label: e is the lower bound (``DOUBT`` standard errors
below) of the log ratio of its rates in toxic and clean learned rows, 0 where that is not positive.
Beginnings of words with e > 0 are terms too, as words are inflected. No word is left out.
A text is held against the labelled examples by exact cosine; blocks of examples whose score bound (the sum of the
query weights times the block maxima) cannot reach the k-th best are not opened. The
neighbours vote with weights by distance and class, and the vote is calibrated by
leaving each example out in turn. The neighbours are returned as evidence.

Learning takes bounded samples, chosen by a hash of doc_id: the weights come from ``per_class`` toxic
and three times as many clean labelled texts, the examples from ``examples`` toxic and three times as many clean ones
of these, a text each. Scoring covers every text, whole. ``STRESS``, ``DOUBT`` and ``NEIGHBOURS`` were chosen by
cross-validation among rows that may be learned from (README); held-out rows were not read for it.

Defined results
---------------
* null or empty text, or one without a word of any example: the calibrated score of a vote of 0; no neighbours.
* labels with a null in doc_id or toxic are not learned from; a doc_id with several
  labels is toxic if one of them is. Without labels of both kinds every score is the rate of toxic labels, 0 without any.
* of several texts with one doc_id the one with the least hash is learned.
* very long texts: counted whole; a task holds the distinct words of its longest text.
* ties between neighbours go to the smaller doc_id (cosines equal to 1e-9); all rows are scored by
  themselves, repeated or not; neither an example nor a text with equal terms is its neighbour in calibration.
* empty table: empty result. Further columns, whatever their names, are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, written
from .langid import held_out

#: Toxic texts that weights are learned from, and toxic examples (of both, three times as many clean ones).
PER_CLASS, EXAMPLES = 4000, 500
NEIGHBOURS = 15
BLOCK = 64
#: Lengths of the word beginnings that may be terms.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Steepness of the weights, and how many standard errors a term's evidence must stand out by.
STRESS, DOUBT = 0.1, 2.0
#: A term that one in so many examples has is kept as a whole row.
COMMON = 64
#: Blocks that are opened first; then eight times as many in each step.
OPEN = 8
WORD = re.compile(r"\w+")


def word_counts(text: object) -> Counter:
    return Counter(WORD.findall(text.lower())) if isinstance(text, str) else Counter()


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in BEGINNINGS if len(word) >= k]


def evidence(toxic: float, clean: float, n1: int, n0: int, doubt: float = DOUBT) -> float:
    """The lower bound of the log ratio of a term's rates, at least 0, from the numbers of texts with it and of all."""
    ratio = math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))
    return max(0.0, ratio - doubt * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


class Space:
    """Numbers, inverse document frequencies and weights of terms. A word outside of the examples counts in the norm alone."""

    KEEP = 200_000

    def __init__(self, weights: dict[str, float], rows: list[dict[str, int]]):
        self.weights = {t: w for t, w in weights.items() if w > 1}
        self.stems = {t for t in self.weights if t.endswith("*")}
        self.memo: dict[str, tuple[str, ...]] = {}
        counted = [self.terms(r) for r in rows]
        seen = Counter(t for r in counted for t in r)
        self.ids = {t: i for i, t in enumerate(seen)}
        self.rare = math.log(1 + len(rows))
        self.scale = np.array([math.log(1 + len(rows) / n) * self.weights.get(t, 1.0) for t, n in seen.items()])
        self.loud = {t: w for t, w in self.weights.items() if t not in self.ids}
        self.rows = [self.vector(r, counted=True) for r in counted]

    def terms(self, words: dict[str, int]) -> dict[str, int]:
        """The words with their numbers, and those of the beginnings that are terms."""
        if not self.stems:
            return words
        out, memo = dict(words), self.memo
        for w, n in words.items():
            own = memo.get(w)
            if own is None:
                if len(memo) >= self.KEEP:
                    memo.clear()
                own = memo[w] = tuple(b for b in beginnings(w) if b in self.stems)
            for b in own:
                out[b] = out.get(b, 0) + n
        return out

    def vector(self, words: dict[str, int], counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a unit vector, without the terms that no example has."""
        terms = words if counted else self.terms(words)
        if not terms:
            return np.empty(0, np.int64), np.empty(0)
        get = self.ids.get
        at = np.array([get(t, -1) for t in terms])
        tf = 1 + np.log(np.fromiter(terms.values(), dtype=float, count=len(terms)))
        known = at >= 0
        other = tf[~known] * self.rare
        if self.loud and len(other):
            other = other * np.array([self.loud.get(t, 1.0) for t in terms if t not in self.ids])
        at = at[known]
        raw = tf[known] * self.scale[at]
        size = math.sqrt(float(raw @ raw) + float(other @ other))
        return at, raw / size if size else raw


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start..stop, one after the other."""
    size = stop - start
    if not size.sum():
        return np.empty(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


class BlockMaxIndex:
    """Unit vectors in postings by term, cut into blocks of ``block`` examples with the largest weight of each block."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, rank: np.ndarray | None = None, block: int = BLOCK):
        self.n, self.block = len(rows), block
        self.blocks = -(-self.n // block)
        self.rank = np.arange(self.n) if rank is None else rank
        size = np.array([len(t) for t, _ in rows], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.terms = np.concatenate([t for t, _ in rows] or [np.empty(0)]).astype(np.int32)
        self.values = np.concatenate([w for _, w in rows] or [np.empty(0)])
        example = np.repeat(np.arange(self.n), size)
        order = np.lexsort((example, self.terms))
        self.example, self.weight = example[order].astype(np.int32), self.values[order]
        key = self.terms[order].astype(np.int64) * max(self.blocks, 1) + self.example // block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.top = np.maximum.reduceat(self.weight, first) if len(key) else np.empty(0)
        self.where = (key[first] % max(self.blocks, 1)).astype(np.int32)
        self.first = np.append(first, len(key))
        self.post = np.searchsorted(key[first] // max(self.blocks, 1), np.arange(terms + 1))
        # the postings of very common terms are kept as whole rows: their part of a score is a product with a small matrix
        common = np.flatnonzero(np.diff(self.first[self.post]) * COMMON >= max(self.n, 1))
        self.row = np.full(terms, -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * block))
        own = self.row[self.terms]
        self.dense[own[own >= 0], example[own >= 0]] = self.values[own >= 0]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[tuple[int, float]]:
        """The ``k`` examples with the largest positive products, exactly; ties (to 1e-9) by rank. ``skip``: examples left out."""
        if not len(terms) or not self.n:
            return []
        row = self.row[terms]
        base = np.einsum("i,ij->j", weights[row >= 0], self.dense[row[row >= 0]])
        terms, weights = terms[row < 0], weights[row < 0]
        a, z = self.post[terms], self.post[terms + 1]
        entry = _ranges(a, z)  # a term in a block
        own, where = np.repeat(weights, z - a), self.where[entry]
        bound = np.bincount(where, self.top[entry] * own, self.blocks) + base.reshape(self.blocks, -1).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, least, at, step = np.zeros(self.n), 0.0, 0, OPEN
        while at < len(order):
            part = order[at : at + step]
            part = part[bound[part] >= least - 1e-8]
            if not len(part):
                break
            opened = np.zeros(self.blocks, dtype=bool)
            opened[part] = True
            held = opened[where]
            a, z = self.first[entry[held]], self.first[entry[held] + 1]
            place = _ranges(a, z)
            score += np.bincount(self.example[place], self.weight[place] * np.repeat(own[held], z - a), self.n)
            score += np.where(np.repeat(opened, self.block), base, 0.0)[: self.n]
            if skip is not None:
                score[skip] = 0
            if self.n > k:
                least = float(np.partition(score, -k)[-k])
            at, step = at + step, 8 * step
        found = np.flatnonzero(score > max(0.0, least - 1e-8))
        best = found[np.lexsort((self.rank[found], -np.round(score[found], 9)))[:k]]
        return [(int(i), float(score[i])) for i in best]


class Model:
    """Examples, their index and the calibration; bounded by the samples and so small enough to be broadcast."""

    def __init__(self, weights: dict[str, float], examples: list[tuple[int, int, dict[str, int]]], share: tuple[float, float], k: int = NEIGHBOURS):
        self.k, self.share, self.rate, self.steps = k, share, 0.0, []
        space = Space(weights, [e[2] for e in examples])
        # like examples side by side: first by the term of most weight, then by the word of most use
        heavy = np.array([w > 1 for w in (space.weights.get(t, 1.0) for t in space.ids)], dtype=bool) if space.ids else np.empty(0, bool)

        def place(i: int) -> tuple:
            at, value = space.rows[i]
            marked = at[heavy[at]] if len(at) else at
            most = max(examples[i][2].items(), key=lambda x: (x[1], x[0]))[0] if examples[i][2] else ""
            return (int(marked[np.argmax(value[heavy[at]])]) if len(marked) else -1, most, examples[i][0])

        order = sorted(range(len(examples)), key=place)
        rows = [space.rows[i] for i in order]
        self.doc_ids, self.labels = [examples[i][0] for i in order], np.array([examples[i][1] for i in order], dtype=float)
        rank = np.argsort(np.argsort(self.doc_ids, kind="stable"), kind="stable") if order else np.empty(0, np.int64)
        self.index = BlockMaxIndex(rows, len(space.ids), rank)
        space.rows, space.memo = [], {}
        self.space = space
        equal: dict[bytes, list[int]] = {}
        for i, (t, w) in enumerate(rows):
            at = np.argsort(t)
            equal.setdefault(t[at].tobytes() + np.round(w[at], 9).tobytes(), []).append(i)
        self.twins = {i: np.array(g) for g in equal.values() for i in g}

    def vote(self, found: list[tuple[int, float]]) -> float:
        """Share of toxic neighbours, weighted by nearness and by how many rows of its class an example stands for."""
        total = yes = 0.0
        for i, s in found:
            y = int(self.labels[i])
            w = self.share[y] / (1.05 - min(s, 1.0))
            total, yes = total + w, yes + w * y
        return yes / total if total else 0.0

    def vote_without(self, i: int) -> float:
        """The vote on an example without itself and its equals."""
        s = slice(self.index.start[i], self.index.start[i + 1])
        return self.vote(self.index.search(self.index.terms[s].astype(np.int64), self.index.values[s], self.k, self.twins[i]))

    def calibrate(self, votes: np.ndarray) -> None:
        self.steps = isotonic(votes, self.labels, np.array([self.share[int(y)] for y in self.labels])) if len(votes) else []

    def score(self, text: object) -> tuple[float, list[tuple[int, float]]]:
        found = self.index.search(*self.space.vector(word_counts(text)), self.k) if self.steps else []
        return (level(self.steps, self.vote(found)) if self.steps else self.rate), found


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[float, float]]:
    """Weighted monotone regression by pooling neighbours: (largest x, mean) of each level, ascending; means are drawn towards 1/2 by one row."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            top, a, b = pools.pop()
            pools[-1] = [top, pools[-1][1] + a, pools[-1][2] + b]
    one = float(w.min())
    return [(top, (a + 0.5 * one) / (b + one)) for top, a, b in pools]


def level(steps: list[tuple[float, float]], x: float) -> float:
    for top, mean in steps:
        if x <= top + 1e-12:
            return mean
    return steps[-1][1]


def learned_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, tuple[int, int]]:
    """doc_id, toxic, text and draw of about ``per_class`` toxic and 3 x per_class clean labels that are not held out, a row for each doc_id; and how many there are in all."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.withColumn("draw", draw).where(F.col("draw") < F.when(F.col("toxic") == 1, per_class / max(n1, 1)).otherwise(3 * per_class / max(n0, 1)))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # at most about 4 x per_class ids
    one = text.groupBy("doc_id", "toxic", "draw").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "draw", F.col("t.text").alias("text"))
    return written(one, "toxic-sample"), (n0, n1)


def learn_weights(sample: DataFrame, stress: float = STRESS, doubt: float = DOUBT) -> dict[str, float]:
    """The weight of each word and word beginning that speaks for the label; all others have 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                words = set(word_counts(text))
                for t in words | {x for w in words for x in beginnings(w)}:
                    counts.setdefault(t, [0, 0])[int(y)] += 1
        yield pd.DataFrame([(t, a, b) for t, (a, b) in counts.items()], columns=["term", "clean", "toxic"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {}
    sums = sample.select("text", "toxic").mapInPandas(run, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    bound = ratio - doubt * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    good = sums.where((F.col("toxic") > 0) & (bound > 0)).select("term", "clean", "toxic")
    return {r["term"]: 1 + stress * evidence(r["toxic"], r["clean"], n1, n0, doubt) ** 2 for r in good.collect()}


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Model:
    sample, (n0, n1) = learned_sample(docs, labels, per_class)
    if not n0 or not n1:
        model = Model({}, [], (1.0, 1.0), k)
        model.rate = n1 / max(n1 + n0, 1)
        return model
    weights = learn_weights(sample)
    chosen = sample.where(F.col("draw") < F.when(F.col("toxic") == 1, examples / n1).otherwise(3 * examples / n0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [word_counts(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "words": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    got = chosen.mapInPandas(run, "doc_id bigint, toxic int, words array<string>, n array<int>").collect()
    share = (max(1.0, n0 / (3 * examples)), max(1.0, n1 / examples))
    model = Model(weights, [(r["doc_id"], r["toxic"], dict(zip(r["words"], r["n"], strict=True))) for r in got], share, k)
    if not len(model.labels):
        model.rate = n1 / (n1 + n0)
        return model
    held = spark.sparkContext.broadcast(model)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vote": [held.value.vote_without(int(i)) for i in b["id"]]})

    parts = max(1, len(got) // 100)
    rows = {r["id"]: r["vote"] for r in spark.range(0, len(got), 1, parts).mapInPandas(votes, "id bigint, vote double").collect()}
    model.calibrate(np.array([rows[i] for i in range(len(got))]))
    held.destroy()
    return model


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, examples: int = EXAMPLES, k: int = NEIGHBOURS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and neighbours (doc_id, toxic, similarity) of every row of ``docs`` (doc_id, text)."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(spark, docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), per_class, examples, k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            score, near = [], []
            for text in b["text"]:
                s, found = m.score(text)
                score.append(s)
                near.append([{"doc_id": m.doc_ids[i], "toxic": int(m.labels[i]), "similarity": v} for i, v in found])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score, "predicted": [int(s >= threshold) for s in score], "neighbours": near})

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return wanted.mapInPandas(run, "doc_id bigint, held_out boolean, score double, predicted int, neighbours array<struct<doc_id:bigint,toxic:int,similarity:double>>")
