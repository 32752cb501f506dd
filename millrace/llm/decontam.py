"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are short and documents may be very long, so a sketch of the whole
document would have no power. The sketch is therefore taken of the items: they are
partitioned by the size of their shingle set, and each partition keeps so many of
the smallest hash values (a bottom-k MinHash) that a document which contains the
share ``threshold`` of an item must contain one of them: if it lacks at most s - ceil(s * threshold)
of s shingles, it holds one of any s - ceil(s * threshold) + 1. Documents give all their
shingles, in the row, and meet the sketches alone in one hash join, which yields the candidate pairs.
Only the documents of candidates are read once more, and only against the items of candidates, to count
the shared shingles exactly. Only shingles of test items are shuffled.

Defined results
---------------
* null text, or no word: no shingle, so never a pair.
* an item with fewer words than ``n`` is one shingle of all its words and is sought
  as such in every document.
* rows with the same doc_id (or the same item_id) are read as one document (item)
  whose shingles are united; null ids form one document (item) too.
* very long documents: their shingle hashes are an array of the row, 8 bytes a word; nothing is cut.
* ties: none can arise, every pair over the threshold is returned.
* columns of ``docs`` may have any name; ``decontaminate`` returns them all as they are.
* empty tables: no pair. Further columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, require, words, written

SHINGLE = 5
THRESHOLD = 0.8
#: Index rows up to which the items are broadcast (about 40 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 400_000


def _grams(h: Column, n: int) -> Column:
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + k] for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column, sizes: list[int]) -> Column:
    """The distinct shingle hashes of a text, of every size in ``sizes``."""

    def every(h: Column) -> Column:
        out = _grams(h, sizes[0])
        for n in sizes[1:]:
            out = F.concat(out, _grams(h, n))
        return F.array_distinct(out)

    return let(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)), every)


def item_index(items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """(item_id, size, hash, sketch): the shingles of each item, and which of them are in its sketch."""
    w = items.select("item_id", words(F.lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    short = [F.when(F.size("h") == k, _grams(F.col("h"), k)) for k in range(1, n)]
    own = F.coalesce(F.when(F.size("h") >= n, F.array_distinct(_grams(F.col("h"), n))), *short)
    rows = w.select("item_id", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).select("item_id", F.explode(own).alias("hash"), F.least(F.size("h"), F.lit(n)).alias("width")).distinct()
    sizes = rows.groupBy("item_id").agg(F.collect_set("hash").alias("all"), F.max("width").alias("width"))
    size = F.size("all")
    # size partition c holds sets of 2^c to 2^(c+1)-1 shingles; its sketch length serves its largest set
    top = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) + 1) - 1
    length = F.least(size, (top - F.ceil(top * threshold - 1e-9) + 2).cast("int"))
    mixed = F.sort_array(F.transform("all", lambda h: F.struct(F.xxhash64(h, F.lit(7)).alias("m"), h.alias("h"))))
    laid = sizes.select("item_id", "width", size.alias("size"), length.alias("k"), mixed.alias("m"))
    return laid.select("item_id", "width", "size", "k", F.posexplode("m").alias("at", "x")).select("item_id", "width", "size", F.col("x.h").alias("hash"), (F.col("at") < F.col("k")).alias("sketch"))


def _side(index: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(index) if rows <= BROADCAST_ROWS else index


def candidates(docs: DataFrame, index: DataFrame, sizes: list[int], rows: int | None = None) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a shingle of an item's sketch; every document that contains an item is among them."""
    sketch = index.where("sketch").select("item_id", "hash")
    own = docs.select("doc_id", F.explode(shingles(F.col("text"), sizes)).alias("hash"))
    return own.join(_side(sketch, sketch.count() if rows is None else rows), "hash").select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment) of all pairs where the document contains the share ``threshold`` or more of the item's shingles."""
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    docs = docs.select("doc_id", "text")
    index = written(item_index(items.select("item_id", "text"), threshold, n), "items")
    facts = index.agg(F.count_if("sketch").alias("rows"), F.collect_set("width").alias("widths")).first()
    sizes = sorted(facts["widths"]) or [n]
    pairs = written(candidates(docs, index, sizes, facts["rows"]), "candidates")

    # verification: the candidates' documents are read again, and meet the whole sets of the candidates' items
    few = pairs.select("doc_id").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    texts = docs.join(few.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    sets = written(index.join(pairs.select("item_id").distinct(), index["item_id"].eqNullSafe(pairs["item_id"]), "left_semi").select("item_id", "size", "hash"), "item-sets")
    met = texts.select("doc_id", F.explode(shingles(F.col("text"), sizes)).alias("hash")).join(_side(sets, sets.count()), "hash")
    met = met.groupBy("doc_id", "item_id").agg(F.first("size").alias("n_item"), F.count_distinct("hash").alias("n_found"))
    p = pairs.select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i"))
    met = met.join(p, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("item_id").eqNullSafe(F.col("_i")), "left_semi")
    found = F.col("n_found").cast("double") / F.col("n_item")
    return met.where(found >= threshold - 1e-12).select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_found", F.round(found, 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null doc_id stay only if none of them does."""
    bad = written(contained_items(docs, items, threshold, n).select(F.col("doc_id").alias(free_name(docs, "bad"))).distinct(), "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad.columns[0])), "left_anti")
