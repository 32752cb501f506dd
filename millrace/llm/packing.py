"""Token ids packed into fixed-length rows by best-fit decreasing, and their binary files.

A task tokenises its documents, ends each with ``end_id`` and splits what is longer
than a row into pieces without loss. Pieces are gathered into blocks of about
``block_tokens`` tokens, which bounds a task's memory; in a block they are placed in
descending length, each into the fullest row that still has room, found by a segment
tree over the free capacities. Nothing is shuffled: a block is a part of an input
partition, and a task that is run again makes the same rows.

Files of a shard (little-endian): ``ids`` (rows x length, uint16, or uint32 where
the vocabulary needs it; ``pad_id`` beyond a row's tokens), ``resets`` (rows x
ceil(length / 8), one bit a token, the first token in the highest bit: set where
positions begin again at 0, that is at each piece's first token and at the first pad),
``cu_seqlens`` (int32; for each row 0 and the end of every piece) and ``row_splits``
(int64; where each row's part of ``cu_seqlens`` begins).

Defined results
---------------
* null or empty text: no token and no row; listed with one piece of length 0 and a null row.
* very long texts: split into pieces of ``length`` ids; a task holds the text and its ids, and of the longest run
  that the pattern does not split the encoder's list of ids, about 40 bytes each. Runs of any length are encoded as the pattern says.
* ties: pieces of equal length keep their order; of equally full rows the last one opened takes a piece.
* repeated rows are packed each; a null doc_id is carried as null.
* empty table: no row. Further columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .common import trim

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
LENGTH = 2048
BLOCK_TOKENS = 4_000_000
#: Length of a run of white space from which a text is split outside the encoder, and ids that are held as a list meanwhile.
LONG_RUN, HELD = 20_000, 100_000

SCHEMA = "shard string, row int, ids binary, cu_seqlens array<int>, pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:int>>"


class Capacities:
    """A segment tree over free capacities 0..most: how many open rows have each, and the least that is at least a length."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.base
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(row, capacity) of the fullest row with room for ``length``, taken out; None if there is none."""
        at = length + self.base
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.base
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of at most ``size``, as lists of positions in ``lengths`` (each 1..size); equal lengths keep their order."""
    rows: list[list[int]] = []
    free = Capacities(size)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        if n == size:
            rows.append([i])
            continue
        if found := free.take(n):
            row, room = found
            rows[row].append(i)
        else:
            row, room = len(rows), size
            rows.append([i])
        if room > n:
            free.push(room - n, row)
    return rows


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Token ids of whole texts as arrays, whatever runs of white space they hold.

    The encoder's own splitter backtracks on its stack, one frame for each character of a run of white space, and
    fails on a run of some 100,000. A text with a run of ``LONG_RUN`` or more is therefore split here by the same
    pattern, in an engine that keeps no frame for each character, and its pieces are encoded one by one.
    """

    def __init__(self, vocabulary: bytes, pattern: str, kind: str):
        self.encoding, self.kind = encoder(vocabulary, pattern), kind
        # white space is that of Unicode, as the encoder reads it: regex's own \s has U+001C to U+001F too
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.long = regex.compile(r"\p{White_Space}{%d}" % LONG_RUN)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not self.long.search(text):
            return np.array(self.encoding.encode_ordinary(text), dtype=self.kind)
        return self.by_pieces(text)

    def by_pieces(self, text: str) -> np.ndarray:
        one, parts, held = self.encoding._core_bpe.encode_single_piece, [], []
        for m in self.split.finditer(text):
            held += one(m.group().encode("utf-8", "replace"))
            if len(held) >= HELD:
                parts.append(np.array(held, dtype=self.kind))
                held = []
        return np.concatenate([*parts, np.array(held, dtype=self.kind)])


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end_id: int | None = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text): shard, row, ids, cu_seqlens and the pieces in the row; one row without ids lists the texts without tokens."""
    with store.Reader(vocabulary) as f:
        raw = f.read(0, f.size)
    kind = "<u2" if max(len(raw.splitlines()), end_id or 0) < 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, block = Tokens(raw, pattern, kind), TaskContext.get().partitionId(), 0
        pieces: list[tuple] = []
        empty: list[tuple] = []
        total = 0

        def made() -> pd.DataFrame:
            rows = best_fit_decreasing([len(p[3]) for p in pieces], length)
            shard = f"{part:06d}-{block:05d}"
            out = {"shard": shard, "row": range(len(rows)), "ids": [], "cu_seqlens": [], "pieces": []}
            for row in rows:
                own = [pieces[i] for i in row]
                out["ids"].append(b"".join(p[3].tobytes() for p in own))
                out["cu_seqlens"].append(np.cumsum([0, *(len(p[3]) for p in own)]).tolist())
                out["pieces"].append([{"doc_id": p[0], "piece": p[1], "start": p[2], "length": len(p[3])} for p in own])
            return pd.DataFrame(out)

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ids = encode(text) if isinstance(text, str) else np.empty(0, dtype=kind)
                if not len(ids):
                    empty.append((doc_id, 0, 0, ids))
                    continue
                if end_id is not None:
                    ids = np.append(ids, np.array([end_id], dtype=kind))
                for k, at in enumerate(range(0, len(ids), length)):
                    pieces.append((doc_id, k, at, ids[at : at + length]))
                    total += len(pieces[-1][3])
                    if total >= block_tokens:
                        yield made()
                        pieces, total, block = [], 0, block + 1
        if pieces:
            yield made()
            block += 1
        for at in range(0, len(empty), 10_000):
            listed = [{"doc_id": p[0], "piece": 0, "start": 0, "length": 0} for p in empty[at : at + 10_000]]
            yield pd.DataFrame({"shard": [f"{part:06d}-{block:05d}"], "row": pd.array([None], dtype="Int32"), "ids": [None], "cu_seqlens": [None], "pieces": [listed]})
        del encode
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


def _put_shard(full: pd.DataFrame, name: str, length: int, pad_id: int) -> None:
    """Writes the files of one shard from its rows, in order."""
    kind = "<u2" if pad_id < 1 << 16 else "<u4"
    ids = np.full((len(full), length), pad_id, dtype=kind)
    resets = np.zeros((len(full), length), dtype=bool)
    ends = []
    for k, (raw, cu) in enumerate(zip(full["ids"], full["cu_seqlens"], strict=True)):
        ids[k, : cu[-1]] = np.frombuffer(raw, dtype=kind)
        resets[k, [c for c in cu if c < length]] = True
        ends.append(np.asarray(cu, dtype="<i4"))
    store.put(f"{name}.ids", ids.tobytes())
    store.put(f"{name}.resets", np.packbits(resets, axis=1).tobytes())
    store.put(f"{name}.cu_seqlens", np.concatenate(ends).tobytes())
    store.put(f"{name}.row_splits", np.cumsum([0, *map(len, ends)]).astype("<i8").tobytes())
    meta = {"rows": len(full), "length": length, "ids": kind, "pad_id": pad_id}
    store.put(f"{name}.json", json.dumps(meta).encode())


def write_matrices(rows: DataFrame, folder: str, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """Writes the shards of ``packed`` rows under ``folder`` and gives the pieces with their place: shard, row, offset, doc_id, piece, start, length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # a block is one batch: it was made as one and Arrow batches are not merged
            for shard, own in b.groupby("shard", sort=False):
                full = own[own["row"].notna()].sort_values("row")
                if len(full):
                    name = f"{folder}/{shard}-{int(full['row'].iloc[0]):08d}"
                    _put_shard(full, name, length, pad_id)
                out = []
                for row, cu, pieces in zip(own["row"], own["cu_seqlens"], own["pieces"], strict=True):
                    at = None if pd.isna(row) else int(row - full["row"].iloc[0])
                    for k, p in enumerate(pieces):
                        out.append((None if at is None else f"{name}", at, None if at is None else int(cu[k]), p["doc_id"], p["piece"], p["start"], p["length"]))
                frame = pd.DataFrame(out, columns=["shard", "row", "offset", "doc_id", "piece", "start", "length"])
                yield frame.astype({"row": "Int64", "offset": "Int64", "doc_id": "Int64"})

    return rows.mapInPandas(run, "shard string, row bigint, offset bigint, doc_id bigint, piece int, start bigint, length int")


def write_rows(rows: DataFrame, folder: str, length: int = LENGTH, pad_id: int = END_ID) -> DataFrame:
    """As ``write_matrices``, but a row for each packed row: shard, row and its pieces (doc_id, piece, start, offset, length); texts without tokens have no shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # a block is one batch, as in write_matrices
            for shard, own in b.groupby("shard", sort=False):
                full = own[own["row"].notna()].sort_values("row")
                if len(full):
                    first = int(full["row"].iloc[0])
                    name = f"{folder}/{shard}-{first:08d}"
                    _put_shard(full, name, length, pad_id)
                out = []
                for row, cu, pieces in zip(own["row"], own["cu_seqlens"], own["pieces"], strict=True):
                    held = not pd.isna(row)
                    placed = [{"doc_id": p["doc_id"], "piece": p["piece"], "start": p["start"], "offset": int(cu[k]) if held else None, "length": p["length"]} for k, p in enumerate(pieces)]
                    out.append((name if held else None, int(row) - first if held else None, placed))
                yield pd.DataFrame(out, columns=["shard", "row", "pieces"]).astype({"row": "Int64"})
        trim()

    return rows.mapInPandas(run, "shard string, row bigint, pieces array<struct<doc_id:bigint,piece:int,start:bigint,offset:bigint,length:int>>")


def _positions(raw: bytes, meta: dict) -> np.ndarray:
    """The position of every token, from the bits where positions begin again."""
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(meta["rows"], -1), axis=1, count=meta["length"]).astype(bool)
    at = np.arange(meta["length"])
    return at - np.maximum.accumulate(np.where(bits, at, 0), axis=1)


def read_pieces(places: DataFrame) -> DataFrame:
    """``places`` of ``write_matrices`` with what the files hold there: n_tokens, ids_md5 and whether positions and cu_seqlens agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {"name": None}

        def shard(name: str) -> dict:
            if held["name"] != name:
                held.clear()
                for kind in ("ids", "resets", "cu_seqlens", "row_splits", "json"):
                    with store.Reader(f"{name}.{kind}") as f:
                        held[kind] = f.read(0, f.size)
                meta = json.loads(held["json"])
                held["ids"] = np.frombuffer(held["ids"], dtype=meta["ids"]).reshape(meta["rows"], meta["length"])
                held["positions"] = _positions(held.pop("resets"), meta)
                held["cu_seqlens"], held["row_splits"] = np.frombuffer(held["cu_seqlens"], dtype="<i4"), np.frombuffer(held["row_splits"], dtype="<i8")
                held["name"] = name
            return held

        for b in batches:
            n, digest, sound = [], [], []
            for name, row, offset, length in zip(b["shard"], b["row"], b["offset"], b["length"], strict=True):
                if not isinstance(name, str):
                    n.append(0), digest.append(hashlib.md5(b"").hexdigest()), sound.append(True)
                    continue
                s, row, offset = shard(name), int(row), int(offset)
                cu = s["cu_seqlens"][s["row_splits"][row] : s["row_splits"][row + 1]]
                k = int(np.searchsorted(cu, offset))
                ids = s["ids"][row, offset : int(cu[k + 1])]
                n.append(len(ids)), digest.append(hashlib.md5(ids.tobytes()).hexdigest())
                sound.append(len(ids) == length and bool((s["positions"][row, offset : offset + length] == np.arange(length)).all()))
            yield b.assign(n_tokens=n, ids_md5=digest, sound=sound)[["doc_id", "piece", "start", "shard", "row", "offset", "n_tokens", "ids_md5", "sound"]]

    return places.mapInPandas(run, "doc_id bigint, piece int, start bigint, shard string, row bigint, offset bigint, n_tokens bigint, ids_md5 string, sound boolean")


def matrix(spark: SparkSession, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, positions, cu_seqlens and row_splits of one shard, on the driver."""
    raw = {}
    for kind in ("ids", "resets", "cu_seqlens", "row_splits", "json"):
        with store.Reader(f"{name}.{kind}") as f:
            raw[kind] = f.read(0, f.size)
    meta = json.loads(raw["json"])
    return np.frombuffer(raw["ids"], meta["ids"]).reshape(meta["rows"], meta["length"]), _positions(raw["resets"], meta), np.frombuffer(raw["cu_seqlens"], "<i4"), np.frombuffer(raw["row_splits"], "<i8")
