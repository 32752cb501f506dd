"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Each text is reduced to a statistic vector; per language and source the minimum
covariance determinant (MCD) estimate of centre and scatter is found by
concentration steps from two starts, each until its determinant no longer falls, the least determinant holding; documents whose Mahalanobis distance exceeds a chi-square
quantile are rejected. Everything is DataFrame expressions: the statistics are
computed inside the row, and a concentration step is two aggregations over the
narrow statistics table, so no group is ever gathered into one task.

Defined results
---------------
* null or empty text, and white space only: all statistics 0, ``base_failed`` true.
* null language or source: a group of its own.
* every group has its own estimate. With n < ``min_group`` fitting rows its centre and
  scatter count n / ``min_group``, and the rest is its language's; a language is drawn
  towards the whole table in the same way. The whole table is not drawn anywhere: it is
  used as it is from ``LEAST_ROWS`` fitting rows, with fewer only the base rules decide.
* very long texts: the arrays of a text's words and windows are in its row, about 40 bytes a word; nothing is cut.
* ties: rows at the very distance of the ``h`` quantile all count; of starts with equal determinants the median's holds.
* repeated rows and equal doc_ids: each row is judged by itself.
* empty table: empty result. Further columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, require, words, written

#: The statistic vector and the least standard deviation that a group may have in each.
#: The floors keep a statistic that is constant in a group (no symbols, no repeats) from
#: turning every small deviation into an outlier.
FLOORS = {"z_len": 0.5, "z_word": 0.5, "z_sym": 0.25, "z_line": 0.25, "z_rep": 0.1}
Z = list(FLOORS)
MEANS = [f"m_{i}" for i in range(len(Z))]
WINDOW = 5
#: The level of the cut: of documents that are no outliers one in 10^9 is rejected, if the statistics were normal. It is the value first
#: written down, before any result had been held against quality labels.
LEVEL = 1 - 1e-9
#: Most concentration steps, the change of the log determinant below which an estimate stands still, and the accuracy of quantiles (1 / ACCURACY of the rank).
STEPS, STILL, ACCURACY = 12, 1e-3, 10_000
#: Fitting rows from which the scatter of the statistics is estimated at all: five for each dimension, the usual least for the MCD.
LEAST_ROWS = 5 * len(Z)


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words covered by a window of ``window`` words that occurs twice or more in the array, first occurrence included."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[h[i + k] for k in range(window)]))

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(s: Column) -> Column:
            n = F.size(s)
            hit = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(hit, lambda x: x["p"]))

        def total(p: Column) -> Column:
            start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
            return F.aggregate(p, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

        return let(let(pairs, positions), total)

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    some = let(let(hashes, windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(ws) <= window, F.lit(0)).otherwise(some)


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the exact base statistics of the whole text and ``base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def line_repeats(x: Column) -> Column:
        return F.size(x) - F.size(F.array_distinct(x))

    counted = docs.withColumn(
        "_w", let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    ).select(
        *[c for c in docs.columns if c != text],
        F.col("_w.n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, line_repeats).cast("long").alias("n_dup_lines"),
        F.col("_w.r").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def vector() -> dict[str, Column]:
    """The transformed statistics; rates are put on a log scale."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "z_len": F.log1p(n),
        "z_word": (F.col("word_chars") + 100) / (n + 20),  # 20 words of mean length 5 steady short texts
        "z_sym": F.log1p(20 * F.col("n_symbols") / n),
        "z_line": F.log1p(50 * F.col("n_dup_lines") / n),
        "z_rep": F.col("n_repeat_words") / n,
    }


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(d / 2, mid / 2) < p else (low, mid)
    return low


def consistency(h: float, d: int) -> float:
    """What makes the scatter of the nearest share ``h`` consistent for normal data."""
    return h / _gamma_p(d / 2 + 1, chi2_quantile(h, d) / 2)


def _whiten(prefix: str = "") -> dict[str, Column]:
    """Lower Cholesky factor l_ij of the covariance columns c_ij, as expressions over earlier columns."""
    out: dict[str, Column] = {}
    for i in range(len(Z)):
        for j in range(i + 1):
            s = F.col(f"c_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out[f"l_{i}_{j}"] = F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l_{j}_{j}")
    return out


def _estimate(sums: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Centre m_i and Cholesky factor l_ij of each key from n, s_i and q_ij. Column by column, so that no expression is inlined twice."""
    out = sums
    for i in range(len(Z)):
        out = out.withColumn(f"m_{i}", F.col(f"s_{i}") / F.col("n"))
    for i, name in enumerate(Z):
        for j in range(i + 1):
            c = F.greatest(F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}"), F.lit(0.0)) if i == j else F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")
            out = out.withColumn(f"c_{i}_{j}", factor * c + (FLOORS[name] ** 2 if i == j else 0.0))
    for name, e in _whiten().items():
        out = out.withColumn(name, e)
    return out.select(*(keys or ("gkey",)), *[f"m_{i}" for i in range(len(Z))], *[f"l_{i}_{j}" for i in range(len(Z)) for j in range(i + 1)])


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i, name in enumerate(Z):
        s = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            s = s - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        df = df.withColumn(f"y_{i}", s / F.col(f"l_{i}_{i}"))
    total = F.col("y_0") * F.col("y_0")
    for i in range(1, len(Z)):
        total = total + F.col(f"y_{i}") * F.col(f"y_{i}")
    return df.withColumn("d2", total)


def _moments(df: DataFrame, *keys: str) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(z).alias(f"s_{i}") for i, z in enumerate(Z)]]
    sums += [F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"q_{i}_{j}") for i in range(len(Z)) for j in range(i + 1)]
    return df.groupBy(*keys).agg(*sums)


def _part(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


#: Groups up to which their estimates are broadcast (at most about 300 bytes each); beyond, Spark joins by shuffle and splits hot groups.
BROADCAST_GROUPS = 10_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, a row for each group, to be joined without moving the rows of the groups if its size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates for each ``gkey``: coordinate-wise medians with median absolute deviations, and the mean and covariance of all rows."""
    med = written(rows.groupBy("gkey").agg(*[F.percentile_approx(z, 0.5, ACCURACY).alias(f"m_{i}") for i, z in enumerate(Z)]), "medians")
    mad = rows.join(_small(med), "gkey").groupBy("gkey").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(Z))],
        *[F.percentile_approx(F.abs(F.col(z) - F.col(f"m_{i}")), 0.5, ACCURACY).alias(f"d_{i}") for i, z in enumerate(Z)],
    )
    robust = mad.select(
        "gkey",
        *[f"m_{i}" for i in range(len(Z))],
        *[(F.sqrt(F.pow(1.4826 * F.col(f"d_{i}"), 2) + FLOORS[Z[i]] ** 2) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(len(Z)) for j in range(i + 1)],
    )
    return robust.withColumn("start", F.lit(0)).unionByName(_estimate(_moments(rows, "gkey"), 1.0).withColumn("start", F.lit(1)))


def _log_det() -> Column:
    return 2 * sum((F.log(f"l_{i}_{i}") for i in range(1, len(Z))), F.log("l_0_0"))


def fit_mcd(rows: DataFrame, h: float = 0.75, steps: int = STEPS) -> DataFrame:
    """MCD centre and Cholesky factor for each ``gkey`` of ``rows`` (gkey and the statistic vector).

    From each start concentration steps are taken: the share ``h`` of rows nearest by the present estimate gives the next one. A
    step is taken over only if it lessens the determinant, by ``STILL`` of its logarithm at least; without one the start stands still. It ends when all
    do, or after ``steps``; of each group's starts the one with the least determinant holds.
    """
    start = _starts(rows).withColumn("det", F.lit(float("inf"))).withColumn("moving", F.lit(True))
    params = written(start, "mcd")
    for _ in range(steps):
        now = params.where("moving")
        near = _distance(rows.join(_small(now.drop("det", "moving")), "gkey")).select("gkey", "start", *Z, "d2")
        limit = written(near.groupBy("gkey", "start").agg(F.percentile_approx("d2", h, ACCURACY).alias("limit")), "limits")
        kept = near.join(_small(limit), ["gkey", "start"]).where(F.col("d2") <= F.col("limit"))
        new = _estimate(_moments(kept, "gkey", "start"), consistency(h, len(Z)), "gkey", "start").withColumn("new", _log_det())
        both = params.alias("p").join(new.alias("q"), (F.col("p.gkey") == F.col("q.gkey")) & (F.col("p.start") == F.col("q.start")), "left")
        better = F.coalesce(F.col("q.new") < F.col("p.det") - STILL, F.lit(False))
        cells = [*MEANS, *[f"l_{i}_{j}" for i in range(len(Z)) for j in range(i + 1)]]
        chosen = [F.when(better, F.col(f"q.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in cells]
        params = written(both.select("p.gkey", "p.start", *chosen, F.when(better, F.col("q.new")).otherwise(F.col("p.det")).alias("det"), better.alias("moving")), "mcd")
        if params.where("moving").isEmpty():
            break
    best = params.groupBy("gkey").agg(F.min(F.struct("det", "start")).alias("b")).select("gkey", F.col("b.start").alias("start"))
    return written(params.join(_small(best), ["gkey", "start"]).drop("start", "det", "moving"), "mcd")


CELLS = [f"c_{i}_{j}" for i in range(len(Z)) for j in range(i + 1)]


def _scatter(params: DataFrame) -> DataFrame:
    """Centre m_i and covariance c_ij of each key from its Cholesky factor."""
    cells = [sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(1, j + 1)), F.col(f"l_{i}_0") * F.col(f"l_{j}_0")).alias(f"c_{i}_{j}") for i in range(len(Z)) for j in range(i + 1)]
    return params.select("gkey", *MEANS, *cells)


def _drawn(keys: DataFrame, own: DataFrame, key: str, over: DataFrame, over_key: str, enough: int) -> DataFrame:
    """gkey, m_i and c_ij of each ``key``: its own estimate, with n < ``enough`` rows drawn towards that of ``over_key`` by the share that is missing."""
    above = over.select(F.col("gkey").alias(over_key), *[F.col(c).alias(f"o_{c}") for c in [*MEANS, *CELLS]])
    both = keys.join(_small(own.withColumnRenamed("gkey", key)), key).join(_small(above), over_key, "left")
    w = F.col("n") / F.lit(float(enough))
    return both.select(F.col(key).alias("gkey"), *[F.when(w >= 1, F.col(c)).otherwise(w * F.col(c) + (1 - w) * F.col(f"o_{c}")).alias(c) for c in [*MEANS, *CELLS]])


def quality_rules(docs: DataFrame, h: float = 0.75, steps: int = STEPS, p: float = LEVEL, min_group: int = 200) -> DataFrame:
    """One row per document: the base statistics, ``base_failed``, ``distance`` (squared, null where no estimate exists) and ``kept``.

    ``docs`` has doc_id, text, lang and source. A row is kept if it passes the base
    rules and its squared robust distance is at most the chi-square quantile ``p``.
    """
    require(docs, "doc_id", "text", "lang", "source")
    judged = _judged(docs.select("doc_id", "text", "lang", "source"), h, steps, p, min_group)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance"), "kept")


def quality_filter(docs: DataFrame, h: float = 0.75, steps: int = STEPS, p: float = LEVEL, min_group: int = 200) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns. The texts are written once beside their statistics instead of being joined again."""
    require(docs, "doc_id", "text", "lang", "source")
    whole = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return _judged(whole, h, steps, p, min_group).where("kept").select("_row.*")


def _judged(docs: DataFrame, h: float, steps: int, p: float, min_group: int) -> DataFrame:
    stats = base_stats(docs)
    for name, e in vector().items():
        stats = stats.withColumn(name, e)
    stats = stats.withColumn("k_all", F.lit("*")).withColumn("k_lang", _part("lang")).withColumn("k_group", F.concat(_part("lang"), F.lit("\x01"), _part("source")))
    stats = written(stats.drop("lang", "source"), "quality")

    fit = stats.where(~F.col("base_failed"))
    levels = ["k_group", "k_lang", "k_all"]
    counts = written(fit.groupBy(*levels).agg(F.count(F.lit(1)).alias("n")), "quality-counts")
    groups = counts if (counts.agg(F.sum("n")).first()[0] or 0) >= LEAST_ROWS else counts.limit(0)
    langs = groups.groupBy("k_lang", "k_all").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    langs = written(langs.where(F.col("least") < min_group).drop("least"), "quality-langs")  # those that a group is drawn towards
    top = langs.where(F.col("n") < min_group).select("k_all").distinct()
    used = groups.select(F.col("k_group").alias("gkey")).union(langs.select("k_lang")).union(top)
    rows = fit.select(F.explode(F.array(*levels)).alias("gkey"), *Z).join(_small(written(used, "quality-used")), "gkey", "left_semi")
    fitted = _scatter(fit_mcd(rows, h, steps))
    of_langs = written(_drawn(langs, fitted, "k_lang", fitted, "k_all", min_group), "quality-langs-mcd")
    params = _drawn(groups, fitted, "k_group", of_langs, "k_lang", min_group)
    for name, e in _whiten().items():
        params = params.withColumn(name, e)
    params = written(params.withColumnRenamed("gkey", "k_group").drop(*CELLS), "quality-groups-mcd")

    placed = stats.join(_small(params), "k_group", "left")
    limit = chi2_quantile(p, len(Z))
    verdict = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= limit))
    return _distance(placed).withColumn("kept", verdict)
