import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing as K
from millrace.llm import store


def plain_bfd(lengths, size):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in rows if sum(lengths[j] for j in r) + lengths[i] <= size]
        if fits and lengths[i] < size:
            max(fits, key=lambda r: sum(lengths[j] for j in r)).append(i)
        else:
            rows.append([i])
    return rows


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for size in (1, 7, 64, 100):
        for _ in range(30):
            lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(60))]
            rows = K.best_fit_decreasing(lengths, size)
            assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
            used = Counter(sum(lengths[i] for i in r) for r in rows)
            assert max(used, default=0) <= size
            assert used == Counter(sum(lengths[i] for i in r) for r in plain_bfd(lengths, size))


def corpus():
    rng = random.Random(3)
    words = ["the", " a\n", "é", "日本", "x" * 50, "  ", "1234", "'s", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 400]))) for _ in range(80)]
    return [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, "no id"), (3, texts[3])]


@pytest.mark.parametrize("end_id", [K.END_ID, None])
def test_round_trip(spark, docs, tmp_path, end_id):
    rows = corpus()
    with store.Reader(K.VOCABULARY) as f:
        encode = K.encoder(f.read(0, f.size))
    table = docs(rows).withColumn("row", F.lit(1)).withColumn("ids", F.lit(1)).repartition(3, "doc_id")
    packed = K.packed(table, length=64, end_id=end_id, block_tokens=1500)
    folder = f"file://{tmp_path}/packed"
    places = K.write_matrices(packed, folder, length=64).cache()
    back = K.read_pieces(places).collect()
    assert all(r.sound for r in back)
    held = {}
    for r in places.collect():
        if r.shard is not None:
            ids, positions, cu, splits = K.matrix(spark, r.shard)
            held.setdefault((r.doc_id, r.start, r.shard, r.row, r.offset), ids[r.row, r.offset : r.offset + r.length])
            assert (positions[r.row, r.offset : r.offset + r.length] == np.arange(r.length)).all()
            own = cu[splits[r.row] : splits[r.row + 1]]
            assert own[0] == 0 and r.offset in own and (np.diff(own) > 0).all() and (ids[r.row, own[-1] :] == K.END_ID).all()
    for doc_id, text in rows:
        parts = sorted(((k[1], v) for k, v in held.items() if k[0] == doc_id), key=lambda x: x[0])
        copies = Counter(a for a, _ in parts)
        ids = np.concatenate([v for k, v in parts][:: max(copies.values())]) if parts else np.empty(0, int)
        want = encode.encode_ordinary(text or "")
        assert ids.tolist() == (want + [end_id] if want and end_id is not None else want)
        assert encode.decode([i for i in ids.tolist() if i != K.END_ID]) == (text or "")
    empty = [r for r in back if r.shard is None]
    assert sorted(r.doc_id for r in empty) == [100, 101] and {r.ids_md5 for r in empty} == {hashlib.md5(b"").hexdigest()}
    assert len(back) == places.count()
    assert K.packed(docs([])).count() == 0


@pytest.fixture(scope="module")
def tokens():
    with store.Reader(K.VOCABULARY) as f:
        return K.Tokens(f.read(0, f.size), K.PATTERN, "<u2")


def test_pieces_give_the_encoders_ids(tokens):
    rng = random.Random(5)
    chars = ["a", "s", "'", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u2003", "1", "²", "é", "日", "!", "=", "\ud7ff", "🙂", "\u0301"]
    for _ in range(400):
        text = "".join(rng.choice(chars) * rng.choice([1, 1, 2, 9]) for _ in range(rng.randrange(40)))
        assert tokens.by_pieces(text).tolist() == tokens.encoding.encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", "7", "=", "é", " \n"])
def test_long_runs(tokens, run):
    """Runs of a million characters: lossless, and equal to what short runs give by the period of their ids."""
    for n in (1_000_000, 1_000_001):
        text = "x y" + run * n + "z 'll"
        ids = tokens(text)
        assert tokens.encoding.decode(ids.tolist()) == text
    few = [tokens(f"x y{run * k}z 'll").tolist() for k in (4096, 4096 + 960)]
    assert all(x == tokens.encoding.encode_ordinary(f"x y{run * k}z 'll") for x, k in zip(few, (4096, 4096 + 960)))
    step = len(few[1]) - len(few[0])
    mid = few[0][len(few[0]) // 2]
    many = tokens(f"x y{run * (4096 + 960 * 1000)}z 'll").tolist()
    assert len(many) == len(few[0]) + 1000 * step and many[:20] == few[0][:20] and many[-20:] == few[0][-20:] and many[len(many) // 2] == mid


@pytest.mark.parametrize("run", [" ", "\n", "a", "7"])
def test_ten_million(tokens, run):
    text = run * 10_000_000
    ids = tokens(text)
    assert tokens.encoding.decode_bytes(ids.tolist()) == text.encode()


def test_long_run_is_packed(docs):
    text = "a" + " " * 1_000_000 + "b"
    rows = K.packed(docs([(1, text), (2, "short")])).collect()
    with store.Reader(K.VOCABULARY) as f:
        encoding = K.encoder(f.read(0, f.size))
    got = sorted((p.start, np.frombuffer(r.ids, "<u2")[a : a + p.length].tolist()) for r in rows for p, a in zip(r.pieces, r.cu_seqlens) if p.doc_id == 1)
    ids = [i for _, part in got for i in part]
    assert ids[-1] == K.END_ID and encoding.decode(ids[:-1]) == text and all(r.cu_seqlens[-1] <= K.LENGTH for r in rows)
