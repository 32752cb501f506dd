"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector that follows from its code point. A trigram is
the product (binding) of its letters' vectors, each permuted by its place; a text is
the sum (bundle) of its trigram vectors, and so is a language the sum of its learned
texts. A text gets the language whose prototype has the largest cosine with it, after
the mean of all prototypes - what every language has in common - is taken from both.

Learning takes a bounded sample: of each language about ``per_lang`` texts, chosen by a
hash of doc_id. Prototypes are summed inside the tasks, so only one vector for each
task and language is shuffled, and ``languages`` x ``dims`` numbers reach the driver.

Defined results
---------------
* null text, or no letter in it: ``und``, score 0.
* no learned language at all (empty table, no lang): ``und``, score 0.
* a null lang, or a null doc_id, is never learned from; a null doc_id is held out
  nowhere: its held_out is false.
* very long texts: counted whole; a task holds about 40 bytes for each character of its longest text, and its distinct trigrams.
* ties go to the language that comes first in the alphabet. Repeated rows get equal
  answers, each its own. Further columns, whatever their names, are passed over.
  The languages are few by nature; each is a literal of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

DIMS = 512
PER_LANG = 3000
#: Texts whose trigrams are counted together.
BLOCK_CHARS = 1 << 19
UND = "und"
#: Steepness of the softmax that turns cosines into scores.
SHARP = 30.0


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of doc_id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Letters:
    """Trigram vectors, kept as they are met. Code points that are no letters count as one blank."""

    def __init__(self, dims: int):
        self.dims = dims
        self.codes = np.full(0x110000, -1, dtype=np.int32)
        self.known: list[int] = [0]
        self.vectors = [self._random(0)]

    def _random(self, point: int) -> np.ndarray:
        return np.random.default_rng(1_000_003 + point).choice(np.array([-1, 1], dtype=np.int8), self.dims)

    def encode(self, text: str) -> np.ndarray:
        """Small letter codes of a text, 0 for runs of anything else; blanks at both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.codes[points]
        if (codes < 0).any():
            for p in np.unique(points[codes < 0]):
                if chr(p).isalpha():
                    self.codes[p] = len(self.known)
                    self.known.append(int(p))
                    self.vectors.append(self._random(int(p)))
                else:
                    self.codes[p] = 0
            codes = self.codes[points]
        codes = np.concatenate([[0], codes, [0]])
        return codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One vector for each text (rows): the sum of its trigram vectors."""
        counts = []
        for t in texts:
            c = self.encode(t).astype(np.int64)
            counts.append(np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True) if len(c) > 2 else (np.empty(0, np.int64), np.empty(0, np.int64)))
        grams = np.unique(np.concatenate([g for g, _ in counts])) if counts else np.empty(0, np.int64)
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        table = np.stack(self.vectors)
        mask = (1 << 21) - 1
        for at in range(0, len(grams), 8192):
            part = grams[at : at + 8192]
            v = np.roll(table, 2, axis=1)[part >> 42] * np.roll(table, 1, axis=1)[(part >> 21) & mask] * table[part & mask]
            m = np.zeros((len(texts), len(part)), dtype=np.float32)
            for row, (g, n) in enumerate(counts):
                a, b = np.searchsorted(g, [part[0], part[-1] + 1])
                m[row, np.searchsorted(part, g[a:b])] = n[a:b]
            out += m @ v.astype(np.float32)
        return out


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > BLOCK_CHARS or i - start >= 512):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def learn(docs: DataFrame, dims: int = DIMS, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from rows with a lang that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.empty((0, dims))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30)).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = Letters(dims), {}
        for b in batches:
            texts, langs = [t if isinstance(t, str) else "" for t in b["text"]], b["lang"].to_numpy()
            for a, z in _blocks(texts):
                v = letters.bundle(texts[a:z])
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for lang in set(langs[a:z]):
                    sums[lang] = sums.get(lang, 0) + v[langs[a:z] == lang].sum(axis=0, dtype=np.float64)
        yield pd.DataFrame([(k, i, x) for k, v in sums.items() for i, x in enumerate(v)], columns=["lang", "i", "x"])

    parts = drawn.mapInPandas(run, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted(counts)
    at = {k: n for n, k in enumerate(langs)}
    out = np.zeros((len(langs), dims))
    for r in parts:
        out[at[r["lang"]], r["i"]] = r["x"]
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def language_id(docs: DataFrame, dims: int = DIMS, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of ``docs`` (doc_id, text, lang)."""
    require(docs, "doc_id", "text", "lang")
    langs, prototypes = learn(docs.select("doc_id", "text", "lang"), dims, per_lang)
    common = prototypes.mean(axis=0) if langs else np.zeros(dims)
    own = prototypes - common
    own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = Letters(dims)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            pred, score = [], []
            for a, z in _blocks(texts):
                v = letters.bundle(texts[a:z])
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.maximum(size, 1e-9) - common
                cosine = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ own.T
                for t, row in zip(texts[a:z], cosine, strict=True):
                    if not langs or not any(map(str.isalpha, t)):
                        pred.append(UND), score.append(0.0)
                    else:
                        e = np.exp(SHARP * (row - row.max()))
                        pred.append(langs[int(row.argmax())]), score.append(float(e.max() / e.sum()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pred, "score": score})

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return wanted.mapInPandas(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
