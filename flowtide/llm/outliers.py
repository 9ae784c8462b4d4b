"""Quality rules and robust multivariate outliers.

Every text is reduced to counts (words, symbols, repeated lines, words in
repeated windows) and to a vector of transformed statistics. Two plain rules
reject outright. Of the other rows, those whose vector lies far from their
language and source are rejected: the minimum-covariance-determinant estimate of
each group gives centre and covariance, and the Mahalanobis distance decides.

The estimate starts from medians and quartiles and takes STEPS concentration
steps. A step reads the narrow table of vectors once: rows fall into bins of
their distance, each (group, bin) adds up its rows, squares and products, and
the lowest bins that hold at least SHARE of the group's rows give the next
centre and covariance. So a group of any size is a bounded number of sums, added
up before they are shuffled. Then the covariance is scaled to the median
distance, and the rows within the 97.5 % distance give the final estimate.
Variances have floors (a statistic that is constant in the clean rows must not
reject every other value). The matrix is inverted by sweeping, one expression.

Groups of fewer than MIN_ROWS rows are joined with others of their language; if
these are too few, with all that is left; if even that is too few, no row of
them is rejected. Everything is DataFrame functions; all rows count.

Repeated windows are compared by 64-bit hashes of 64-bit word hashes; among n
windows of a text one falsely equal pair has a chance of n^2 / 2^65.

Defined cases: a null, empty or blank text has no words, so it fails the base
rules and takes no part in the estimate; a null language or source is a value of
its own; repeated rows count as often as they occur; a distance equal to the
limit is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.llm.common import free_name
from flowtide.operators.scale import left_join_stats
from flowtide.session import materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SHARE = 0.75
STEPS = 4
MIN_ROWS = 100
TAIL = 1e-9
BINS = 16  # distance bins per factor e
GRID = 0.01  # bin width of single statistics for medians and quartiles
BROADCAST_GROUPS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistic and the smallest standard deviation it is credited with: shares enter as log(1 + 100 share), and one repeated
# line or number more or less must not condemn a short text.
VECTOR = {"words": 0.3, "word_length": 0.05, "symbols": 0.3, "dup_lines": 1.0, "repeats": 1.0, "variety": 0.03, "words_a_line": 0.3, "digits": 0.8}


def chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def chi_square_share(x: float, d: int) -> float:
    return NormalDist().cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / (2 / (9 * d)) ** 0.5)


def text_counts(docs: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """Adds the counts in COUNTS and `lines`, `distinct`, `digits` under the given eight names, in steps that each read what the last one made."""
    taken = [*docs.columns, *names]
    own = [free_name(n, taken) for n in ("_t", "_w", "_h", "_p", "_r")]
    t, w, h, p, r = (F.col(f"`{n}`") for n in own)
    n_words, word_chars, n_symbols, n_dup, n_repeat, lines, distinct, digits = names

    def without(characters: str) -> Column:
        return F.char_length(F.translate(t, characters, ""))

    out = docs.withColumn(own[0], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    spoken = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(own[1], F.transform(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), lambda x: F.xxhash64(x))).withColumn(own[3], spoken)
    last = F.size(w) - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(w).cast("bigint").alias(n_words),
        without(SPACES).cast("bigint").alias(word_chars),
        (F.char_length(t) - without(SYMBOLS)).cast("bigint").alias(n_symbols),
        (F.size(p) - F.size(F.array_distinct(p))).cast("bigint").alias(n_dup),
        F.size(p).cast("bigint").alias(lines),
        F.size(F.array_distinct(w)).cast("bigint").alias(distinct),
        (F.char_length(t) - without("0123456789")).cast("bigint").alias(digits),
        windows.alias(own[2]),
    )
    # only texts with a repeated window are looked at closer: windows in order of hash, equal neighbours
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    out = out.withColumn(own[3], F.when(repeated, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: x["h"].eqNullSafe(F.get(p, i - 1)["h"]) | x["h"].eqNullSafe(F.get(p, i + 1)["h"])
    out = out.withColumn(own[4], F.sort_array(F.array_compact(F.transform(p, lambda x, i: F.when(same(x, i), x["i"])))))
    gaps = F.transform(r, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(r, i + 1) - x, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")
    made = {n_repeat: covered}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[made.get(n, F.col(f"`{n}`")).alias(n) for n in names])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def vector(names: Sequence[str]) -> list[Column]:
    """The transformed statistics in the order of VECTOR, of rows with words."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, lines, distinct, digits = (F.col(f"`{n}`").cast("double") for n in names)

    def share(part: Column, whole: Column) -> Column:
        return F.log1p(100 * part / whole)

    return [
        F.log1p(n_words),
        F.log(word_chars / n_words),
        share(n_symbols, word_chars),
        share(n_dup, lines),
        share(n_repeat, n_words),
        F.log1p(distinct) / F.log1p(n_words),
        F.log(n_words / lines),
        share(digits, word_chars),
    ]


def _swept(matrix: Column, d: int) -> Column:
    """Inverse of a positive definite matrix (rows of an array): every diagonal entry is swept once."""

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(F.get(m, k), k)
        row = F.get(m, k)

        def entry(v: Column, i: Column, j: Column) -> Column:
            other = F.get(F.get(m, i), k)
            return (
                F.when((i == k) & (j == k), -1 / pivot)
                .when(i == k, v / pivot)
                .when(j == k, v / pivot)
                .otherwise(v - other * F.get(row, j) / pivot)
            )

        return F.transform(m, lambda r, i: F.transform(r, lambda v, j: entry(v, i, j)))

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), matrix, step)
    return F.transform(swept, lambda r: F.transform(r, lambda v: -v))


def _sums(d: int) -> list[Column]:
    x = [F.col(f"x{i}") for i in range(d)]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]]


def _sum_names(d: int) -> list[str]:
    return ["n", *[f"s{i}" for i in range(d)], *[f"s{i}_{j}" for i in range(d) for j in range(i, d)]]


def _estimate(sums: DataFrame, floors: Sequence[float], factor: Column, extra: Sequence[str]) -> DataFrame:
    """fit, centre and inverse covariance (times `factor` before the floors) from the sums of each group."""
    d = len(floors)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(d)]

    def cell(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        spread = (F.col(f"s{i}_{j}") / F.col("n") - mean[i] * mean[j]) * factor
        return F.greatest(spread, F.lit(0.0)) + F.lit(floors[i] ** 2) if i == j else spread

    matrix = F.array(*[F.array(*[cell(i, j) for j in range(d)]) for i in range(d)])
    made = sums.select("fit", *extra, F.array(*mean).alias("centre"), matrix.alias("_m"))
    return made.select("fit", *extra, "centre", _swept(F.col("_m"), d).alias("inverse"))


def _with_distance(rows: DataFrame, groups: DataFrame, d: int) -> DataFrame:
    """Adds the columns of the row's group and d2, the squared Mahalanobis distance."""
    n = groups.count()
    joined = left_join_stats(rows, groups, ["fit"], stats_rows=n, broadcast_rows=BROADCAST_GROUPS)
    z = [F.col(f"x{i}") - F.get(F.col("centre"), i) for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + z[i] * z[j] * F.get(F.get(F.col("inverse"), i), j) * (1.0 if i == j else 2.0)
    return joined.withColumn("d2", F.when(total < 0, 0.0).otherwise(total))  # rounding may go below zero


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-9) * BINS).cast("int")


def _start(rows: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Medians and quartile spreads of every statistic and group, from counts on a grid."""
    d = len(floors)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.floor(F.col(f"x{i}") / GRID).cast("bigint").alias("cell")) for i in range(d)]))
    cells = rows.select("fit", one.alias("z")).groupBy("fit", "z.axis", "z.cell").agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy("fit", "axis")
    placed = cells.withColumn("upto", F.sum("n").over(part.orderBy("cell"))).withColumn("all", F.sum("n").over(part))

    def quantile(p: float) -> Column:
        return (F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("cell"))) + 0.5) * GRID

    axes = placed.groupBy("fit", "axis").agg(quantile(0.25).alias("q1"), quantile(0.5).alias("mid"), quantile(0.75).alias("q3"))
    floor = F.get(F.array(*[F.lit(f) for f in floors]), F.col("axis"))
    axes = axes.withColumn("weight", 1 / F.pow(F.greatest((F.col("q3") - F.col("q1")) / 1.349, floor), 2))
    table = F.sort_array(F.collect_list(F.struct("axis", "mid", "weight")))
    wide = axes.groupBy("fit").agg(table.alias("a"))
    diagonal = F.transform("a", lambda r: F.transform("a", lambda c: F.when(r["axis"] == c["axis"], r["weight"]).otherwise(0.0)))
    return wide.select("fit", F.col("a.mid").alias("centre"), diagonal.alias("inverse"))


def concentrate(rows: DataFrame, groups: DataFrame, floors: Sequence[float], share: float) -> DataFrame:
    """One step: the estimate of the rows nearest under the given one, with the median distance and the rows used."""
    d = len(floors)
    cells = _with_distance(rows, groups, d).groupBy("fit", _bin(F.col("d2")).alias("bin")).agg(*_sums(d))
    part = W.partitionBy("fit")
    cells = cells.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("all", F.sum("n").over(part))
    middle = F.min(F.when(F.col("upto") >= 0.5 * F.col("all"), F.col("bin")))
    near = F.col("upto") - F.col("n") < F.ceil(share * F.col("all"))
    sums = cells.groupBy("fit").agg(*[F.sum(F.when(near, F.col(c))).alias(c) for c in _sum_names(d)], F.exp((middle + 0.5) / BINS).alias("median"))
    return _estimate(sums, floors, F.lit(1.0), ["median", "n"])


def fit_groups(rows: DataFrame, floors: Sequence[float], share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """fit, centre, inverse: the reweighted minimum-covariance-determinant estimate of every group of (fit, x0, x1, ...)."""
    d = len(floors)
    groups = materialize(_start(rows, floors), "outlier-start")
    for i in range(steps):
        groups = materialize(concentrate(rows, groups, floors, share), f"outlier-step{i}")
    # the last estimate's own distances tell how far its covariance is too small
    spread = materialize(concentrate(rows, groups.select("fit", "centre", "inverse"), floors, share).select("fit", "median"), "outlier-spread")
    scaled = groups.select("fit", "centre", "inverse").join(spread, "fit")
    scaled = scaled.withColumn("scale", F.greatest(F.col("median") / chi_square(0.5, d), F.lit(1.0)))
    limit = chi_square(0.975, d)
    near = _with_distance(rows, scaled, d).where(F.col("d2") <= limit * F.col("scale"))
    factor = 0.975 / chi_square_share(limit, d + 2)  # rows beyond the limit are missing from the covariance
    return materialize(_estimate(near.groupBy("fit").agg(*_sums(d)), floors, F.lit(factor), []), "outlier-fit")


def _fit_names(rows: DataFrame, min_rows: int) -> DataFrame:
    """(_group, fit): where the rows of a language and source are estimated; NULL where there are too few."""
    sizes = rows.groupBy("_group", "_lang").agg(F.count(F.lit(1)).alias("n"))
    few = F.col("n") < min_rows
    of_lang = F.sum(F.when(few, F.col("n")).otherwise(0)).over(W.partitionBy("_lang"))
    sizes = sizes.withColumn("rest", of_lang).withColumn("left", few & (F.col("rest") < min_rows))
    enough = sizes.agg(F.coalesce(F.sum(F.when(F.col("left"), F.col("n"))) >= min_rows, F.lit(False)).alias("enough"))
    named = F.when(~few, F.concat(F.lit("g:"), "_group")).when(~F.col("left"), F.concat(F.lit("l:"), "_lang")).when(F.col("enough"), F.lit("all"))
    return sizes.join(F.broadcast(enough)).select("_group", named.alias("fit"))  # one row


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep: Sequence[str] = ("doc_id",),
    share: float = SHARE,
    steps: int = STEPS,
    min_rows: int = MIN_ROWS,
    tail: float = TAIL,
) -> DataFrame:
    """Kept columns plus the counts, base_failed, kept and distance (Mahalanobis; NULL where no estimate was asked).

    A row is rejected beyond the distance that a share `tail` of normally distributed vectors would exceed.
    Kept columns named like a result are replaced by it.
    """
    results = [*COUNTS, "base_failed", "kept", "distance"]
    names = [*COUNTS, "lines", "distinct", "digits"]
    kept = [c for c in keep if c.lower() not in results]
    d = len(VECTOR)
    mine = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]
    group = [F.to_json(F.struct(F.col(f"`{lang}`").cast("string").alias("l"))).alias("_lang"), F.to_json(F.struct(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{source}`").cast("string").alias("s"))).alias("_group")]
    rows = text_counts(docs.select(*mine, *group, F.col(f"`{text}`").cast("string").alias("_text")), "_text", names)
    rows = rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    asked = ~F.col("base_failed")
    x = [F.when(asked, c).alias(f"x{i}") for i, c in enumerate(vector(names))]
    rows = materialize(rows.select(*[f"k{i}" for i in range(len(kept))], "_lang", "_group", *COUNTS, "base_failed", *x), "outlier-rows")
    fits = materialize(_fit_names(rows.where(asked), min_rows), "outlier-groups")
    rows = left_join_stats(rows, fits, ["_group"], stats_rows=fits.count())
    rows = rows.withColumn("fit", F.when(asked, F.col("fit")))
    learnt = rows.where(F.col("fit").isNotNull()).select("fit", *[f"x{i}" for i in range(d)])
    judged = _with_distance(rows, fit_groups(learnt, list(VECTOR.values()), share, steps), d)
    limit = chi_square(1 - tail, d)
    verdict = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= limit))
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *COUNTS, "base_failed", verdict.alias("kept"), F.sqrt("d2").alias("distance"))
