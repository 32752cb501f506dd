"""Mixing sources to target weights: iterative proportional fitting of token weights.

Documents are counted into cells of source, language and topic. Each dimension has target
shares of the tokens to be drawn; a category that has fewer tokens than its share asks for gives all it has, and the others
of its dimension share the rest (``goals``). The tokens drawn of a cell are its tokens times min(1, f), and
the factors f are raked: in turn for each dimension they are multiplied by what its categories lack of cells below that bound, until every marginal
is within ``TOLERANCE`` of its goal, or after ``MOST`` sweeps. So no probability exceeds 1 and none is cut afterwards.
``mixing_report`` has goals, what was reached, and which targets could not be met. Draws are by a hash of doc_id, so
a run can be repeated. All of it is aggregations and windows over the cells, whose number is bounded by the
combinations of the dimensions and not by the documents; up to ``ONE_TASK`` cells are raked in one task, without a shuffle.

Defined results
---------------
* null in a dimension: a category of its own. Categories without a target get share 0.
* null or empty text: 0 tokens; the row is drawn with the probability of its cell.
* equal doc_ids are drawn together; null doc_ids too.
* cells without tokens are drawn by their categories' factors; no token at all, or an empty table: all probabilities are the budget share.
* very long texts: only counted. Ties: none, a draw is compared with its own probability.
* further columns, whatever their names, are passed over by ``mixing_weights`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, words, written

DIMS = ("source", "lang", "topic")
#: Largest relative error of a marginal at which the sweeps end, how often it is looked at, and most sweeps.
TOLERANCE, LOOK, MOST = 1e-4, 4, 48
#: Cells up to which one task rakes them.
ONE_TASK = 200_000
#: Default targets: the marginal token shares to this power, so large categories are drawn down and small ones up.
ALPHA = 0.7
#: Share of all tokens that is to be drawn.
BUDGET = 0.5
NULL = "\x00"


def style(n_words: Column, word_chars: Column) -> Column:
    """A stand-in for a topic label where a table has none: the text's length class and word-length class."""
    length = F.when(n_words < 100, "short").when(n_words < 600, "medium").otherwise("long")
    width = F.when(word_chars < 4.5 * n_words, "-plain").when(word_chars < 6 * n_words, "-mixed").otherwise("-dense")
    return F.concat(length, width)


def with_tokens(docs: DataFrame) -> DataFrame:
    """Adds _tokens (words) and, as _topic, the column ``topic`` or else the style class."""
    n = F.size(words(F.col("text"))).cast("long")
    out = docs.withColumn("_tokens", n)
    if "topic" in docs.columns:
        return out.withColumn("_topic", F.col("topic").cast("string"))
    chars = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", ""))
    return out.withColumn("_topic", style(F.col("_tokens"), chars))


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({f"_k{i}": F.coalesce(F.col("_topic" if d == "topic" else d).cast("string"), F.lit(NULL)) for i, d in enumerate(DIMS)})


def goals(cells: DataFrame, i: int, share: DataFrame | None, alpha: float, budget: float) -> DataFrame:
    """(_k<i>, have, target, goal, full) of a dimension: tokens, tokens asked for, what of them can be met, and whether that is all there is; goals add up to the budget."""
    have = cells.groupBy(f"_k{i}").agg(F.sum("tokens").alias("have"))
    if share is None:
        asked = have.withColumn("share", F.pow("have", F.lit(alpha)))
    else:
        asked = have.join(share.select(f"_k{i}", "share"), f"_k{i}", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    every = Window.partitionBy()
    asked = asked.coalesce(1).withColumn("total", F.sum("have").over(every) * budget).withColumn("target", F.col("total") * F.coalesce(F.try_divide(F.col("share"), F.sum("share").over(every)), F.lit(0.0)))
    # the categories that lack most come first; each takes all it has as long as the scale of the rest asks for more
    order = Window.orderBy(F.when(F.col("share") > 0, F.coalesce(F.try_divide("share", "have"), F.lit(float("inf")))).otherwise(0.0).desc(), f"_k{i}")
    before = F.coalesce(F.sum("have").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = asked.withColumn("full", (F.col("share") > 0) & (F.try_divide(F.col("total") - before, rest) * F.col("share") >= F.col("have")))
    scale = F.try_divide(F.col("total") - F.sum(F.when(F.col("full"), F.col("have")).otherwise(0.0)).over(every), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("share"))).over(every))
    return full.withColumn("goal", F.when(F.col("full"), F.col("have")).when(F.col("share") > 0, scale * F.col("share")).otherwise(0.0)).select(f"_k{i}", "have", "target", "goal", "full")


def rake(cells: DataFrame, targets: list[DataFrame], budget: float = BUDGET, most: int = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (_k0.., tokens) with ``factor``: tokens x min(1, factor) have the marginals ``targets`` (_k<i>, goal), as far as they can."""
    now, full, barred = cells, F.lit(False), F.lit(False)
    for i, target in enumerate(targets):
        now = now.join(target.select(f"_k{i}", F.col("goal").alias(f"_g{i}"), F.col("full").alias(f"_f{i}")), f"_k{i}", "left").withColumn(f"_g{i}", F.coalesce(f"_g{i}", F.lit(0.0)))
        full, barred = full | F.coalesce(f"_f{i}", F.lit(False)), barred | (F.col(f"_g{i}") == 0)
    # the cells of a category that gives all it has are drawn whole
    now = now.withColumn("_whole", full & ~barred).withColumn("factor", F.when(F.col("_whole"), 1e6).otherwise(float(budget)))
    now = written(now.drop(*[f"_f{i}" for i in range(len(targets))]), "raked")
    one = now.count() <= ONE_TASK
    drawn = F.col("tokens") * F.least(F.lit(1.0), F.col("factor"))
    for sweep in range(1, most + 1):
        if sweep % LOOK == 1 and one:
            now = now.coalesce(1)  # a single partition needs no exchange for any window
        for i in range(len(targets)):
            part, goal = Window.partitionBy(f"_k{i}"), F.col(f"_g{i}")
            now = now.withColumn("_c", F.sum(F.when(F.col("factor") >= 1, F.col("tokens")).otherwise(0.0)).over(part)).withColumn("_m", F.sum(F.when(F.col("factor") < 1, F.col("tokens") * F.col("factor")).otherwise(0.0)).over(part))
            # only cells below their bound can move a marginal
            lack = F.when((F.col("_m") > 0) & (goal > F.col("_c")), (goal - F.col("_c")) / F.col("_m")).when(F.col("_c") + F.col("_m") > 0, goal / (F.col("_c") + F.col("_m"))).otherwise(1.0)
            now = now.withColumn("factor", F.when(F.col("_whole"), F.col("factor")).otherwise(F.col("factor") * lack)).drop("_c", "_m")
        if sweep % LOOK == 0 or sweep == most:
            off = [F.when(F.col(f"_g{i}") > 0, F.abs(F.sum(drawn).over(Window.partitionBy(f"_k{i}")) / F.col(f"_g{i}") - 1)).otherwise(0.0) for i in range(len(targets))]
            now = written(now.withColumn("_off", F.greatest(*off)), "raked")
            if (now.agg(F.max("_off")).first()[0] or 0.0) <= tolerance:
                break
            now = now.drop("_off")
    return now.drop("_off", "_whole")


def cell_probabilities(keyed: DataFrame, targets: list[DataFrame] | None = None, alpha: float = ALPHA, budget: float = BUDGET) -> tuple[DataFrame, list[DataFrame]]:
    """(_k0, _k1, _k2, tokens, probability) of each cell of ``keyed``, and the goals of each dimension. ``targets``: for each dimension (_k<i>, share)."""
    cells = written(keyed.groupBy("_k0", "_k1", "_k2").agg(F.sum("_tokens").cast("double").alias("tokens")), "cells")
    if (cells.agg(F.sum("tokens")).first()[0] or 0.0) == 0:
        return cells.withColumn("probability", F.lit(budget)), []
    own = [written(goals(cells, i, targets[i] if targets else None, alpha, budget), "goals") for i in range(len(DIMS))]
    return rake(cells, own, budget).select("_k0", "_k1", "_k2", "tokens", F.least(F.lit(1.0), F.col("factor")).alias("probability")), own


def mixing_report(docs: DataFrame, targets: list[DataFrame] | None = None, alpha: float = ALPHA, budget: float = BUDGET) -> DataFrame:
    """dimension, category, tokens, target, goal and reached (expected tokens) of every category; met tells whether the target itself is reached to 0.1 %."""
    p, own = cell_probabilities(_keyed(docs), targets, alpha, budget)
    out = None
    for i, goal in enumerate(own):
        drawn = p.groupBy(f"_k{i}").agg(F.sum(F.col("tokens") * F.col("probability")).alias("reached"))
        part = goal.join(drawn, f"_k{i}").select(F.lit(DIMS[i]).alias("dimension"), F.nullif(F.col(f"_k{i}"), F.lit(NULL)).alias("category"), F.col("have").alias("tokens"), "target", "goal", "reached")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "dimension string, category string, tokens double, target double, goal double, reached double, met boolean")
    return out.withColumn("met", F.abs(F.col("reached") - F.col("target")) <= 1e-3 * F.col("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that hangs on doc_id and seed alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _keyed(docs: DataFrame) -> DataFrame:
    own = [c for c in ("doc_id", "text", "source", "lang", "topic") if c in docs.columns]
    return written(_keys(with_tokens(docs.select(*own)).drop("text")).select("doc_id", "_topic", "_tokens", "_k0", "_k1", "_k2"), "mixing")


def mixing_weights(docs: DataFrame, targets: list[DataFrame] | None = None, alpha: float = ALPHA, budget: float = BUDGET, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n_tokens, topic, probability and kept. ``docs`` has doc_id, text, source, lang and, if known, topic."""
    require(docs, "doc_id", "text", "source", "lang")
    keyed = _keyed(docs)
    p, _ = cell_probabilities(keyed, targets, alpha, budget)
    out = keyed.join(p.drop("tokens"), ["_k0", "_k1", "_k2"])
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), F.round("probability", 6).alias("probability"), (draw(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, targets: list[DataFrame] | None = None, alpha: float = ALPHA, budget: float = BUDGET, seed: int = 1) -> DataFrame:
    """The drawn rows of ``docs``, all columns. The rows are written once beside their counts."""
    require(docs, "doc_id", "text", "source", "lang")
    own = [c for c in ("doc_id", "text", "source", "lang", "topic") if c in docs.columns]
    whole = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = written(_keys(with_tokens(whole)).select("doc_id", "_tokens", "_k0", "_k1", "_k2", "_row"), "mixing-rows")
    p, _ = cell_probabilities(keyed.drop("_row"), targets, alpha, budget)
    out = keyed.join(p.drop("tokens"), ["_k0", "_k1", "_k2"]).where(draw(F.col("doc_id"), seed) < F.col("probability"))
    return out.select("_row.*")
