import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "ch"], "cc": ["ção", "ão", "lh", "nh"]}


def rows(n=240):
    rng = random.Random(1)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[k]) for _ in range(3)) for _ in range(30)), k, "s") for i in range(n) for k in [rng.choice(sorted(SYLLABLES))]]


def test_held_out_accuracy(docs):
    table = rows()
    odd = [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "12 .,", "aa", "s"), (1003, "x", "aa", "s"), (None, "kalomi tulo", "aa", "s"), (1004, "KALO mitu loka", None, "s"), (1004, "KALO mitu loka", None, "s")]
    d = docs(table + odd).withColumn("score", F.lit("x")).withColumn("held_out", F.lit("x"))
    out = L.language_id(d).collect()
    assert len(out) == len(table) + len(odd) and all(0 <= r.score <= 1 for r in out)
    lang = {i: k for i, _, k, _ in table}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in lang:
            assert r.lang_pred == lang[r.doc_id]
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred in SYLLABLES and by[1004].lang_pred == "aa"


def test_bundle_against_plain_sums():
    letters = L.Letters(64)
    texts = ["Ab, ba", "", "é", "a  b\nc abc"]
    got = letters.bundle(texts)
    for t, v in zip(texts, got, strict=True):
        codes = letters.encode(t)
        want = np.zeros(64)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            want += np.roll(letters.vectors[a], 2).astype(int) * np.roll(letters.vectors[b], 1) * letters.vectors[c]
        assert (v == want).all()
    assert letters.encode("a, b").tolist() == letters.encode("a b").tolist()
    assert (L.Letters(64)._random(97) == letters._random(97)).all()


def test_nothing_learned(docs):
    assert L.language_id(docs([])).count() == 0
    assert {(r.lang_pred, r.score) for r in L.language_id(docs([(1, "abc", None, "s"), (2, "abc", None, "s")])).collect()} == {("und", 0.0)}


def test_query_against_brute_force(docs):
    """Learning, prototypes, cosines and scores of the whole operator, by sums over trigrams in plain Python."""
    table = [r for r in rows(120)] + [(500, "kalo schung", None, "s"), (501, "ei ção 3", "bb", "s")]
    out = {r.doc_id: r for r in L.language_id(docs(table), dims=64, per_lang=10**6).collect()}
    letters = L.Letters(64)

    def vector(text):
        codes = letters.encode(text)
        return sum((np.roll(letters.vectors[a], 2).astype(float) * np.roll(letters.vectors[b], 1) * letters.vectors[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)), np.zeros(64))

    unit = lambda v: v / np.linalg.norm(v)
    learned = [(k, unit(vector(t))) for i, t, k, _ in table if k and zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({k for k, _ in learned})
    prototypes = np.stack([unit(sum(v for k, v in learned if k == lang)) for lang in langs])
    common = prototypes.mean(axis=0)
    own = np.stack([unit(p - common) for p in prototypes])
    for i, t, _, _ in table:
        cosine = own @ unit(unit(vector(t)) - common)
        e = np.exp(L.SHARP * (cosine - cosine.max()))
        assert out[i].lang_pred == langs[int(cosine.argmax())] and abs(out[i].score - e.max() / e.sum()) < 1e-3


def test_long_text():
    letters = L.Letters(32)
    text = "ab cd " * 200_000
    got, one = letters.bundle([text])[0], letters.bundle(["ab cd ab cd "])[0] - letters.bundle(["ab cd "])[0]
    assert np.allclose(got, letters.bundle(["ab cd "])[0] + 199_999 * one, rtol=1e-5)
