"""Second-order gradient boosting on binned features.

Features are cut once into bins; a tree level is then one grouped sum of
gradients and hessians by (node, feature, bin). Cumulative sums over the bins of
a node give every split's gain, with missing values tried on either side, and
only the best split of each node reaches the driver. So what is shuffled and
collected is bounded by nodes x features x bins, whatever the number of rows.

Rows are never moved. A row's node and a tree's value follow from its bins, read
from a narrow table that is written anew every WRITE_EVERY trees so that no more
than these have to be evaluated again. The validation loss is observed in the
pass that sums a round's first level.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.functions.columns import q
from flowtide.operators import explore
from flowtide.session import materialize

MISSING = -1
WRITE_EVERY = 4


@dataclass
class Tree:
    """A complete binary tree as arrays: node k has the children 2k+1 and 2k+2; a leaf has feature -1."""

    feature: list[int]
    bin: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n)


@dataclass
class BoostedTrees:
    """Trees, bin bounds and what is needed to score; can be saved and loaded."""

    features: list[str]
    bounds: list[list[float]]
    depth: int
    trees: list[Tree] = field(default_factory=list)
    best: int = 0
    history: list[tuple[int, float | None]] = field(default_factory=list)

    def margin(self, bins: Column, trees: Sequence[Tree] | None = None) -> Column:
        """Sum of the trees' values for an array of bins."""
        chosen = self.trees[: self.best] if trees is None else list(trees)
        if not chosen:
            return F.lit(0.0)
        return F.aggregate(_literal(chosen), F.lit(0.0), lambda total, t: total + F.get(t["value"], _leaf(t, bins, self.depth)))

    def transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        """Adds the probability and the 0.5-cut `prediction`, as `predict` of the other learners does."""
        binned = with_bins(df, self.features, self.bounds, "_bins")
        p = 1 / (1 + F.exp(-self.margin(F.col("_bins"))))
        scored = binned.withColumn(score, p)
        return scored.select(*[q(c) for c in df.columns if c != score], (q(score) > 0.5).cast("int").alias("prediction"), score)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): each feature's share of the summed gains."""
        gains = dict.fromkeys(self.features, 0.0)
        for t in self.trees[: self.best]:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gains[self.features[f]] += g
        total = sum(gains.values()) or 1.0
        return spark.createDataFrame([(f, g / total) for f, g in gains.items()], "feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        read = json.loads(spark.read.text(path).first()[0])
        read["trees"] = [Tree(**t) for t in read["trees"]]
        read["history"] = [tuple(h) for h in read["history"]]
        return cls(**read)


def _literal(trees: Sequence[Tree]) -> Column:
    """The trees as one array of structs."""

    def array(values, kind):
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    return F.array(
        *[
            F.struct(array(t.feature, "int").alias("feature"), array(t.bin, "int").alias("bin"), array(t.missing_left, "boolean").alias("left"), array(t.value, "double").alias("value"))
            for t in trees
        ]
    )


def _leaf(tree: Column, bins: Column, steps: int) -> Column:
    """Node that an array of bins reaches in `steps` steps, or the leaf before."""

    def step(k: Column, _: Column) -> Column:
        f = F.get(tree["feature"], k)
        b = F.get(bins, f)
        left = F.when(b == MISSING, F.get(tree["left"], k)).otherwise(b <= F.get(tree["bin"], k))
        return F.when(f < 0, k).when(left, 2 * k + 1).otherwise(2 * k + 2)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step) if steps else F.lit(0)


def quantile_bounds(df: DataFrame, features: Sequence[str], bins: int = 256, error: float = 1e-3) -> list[list[float]]:
    """Inner bounds per feature at equal shares of its values, from mergeable sketches in one pass; at most bins - 1 each."""
    values = df.select(*[F.when(~F.isnan(q(f).cast("double")), q(f).cast("double")).alias(f"f{i}") for i, f in enumerate(features)])
    shares = [i / bins for i in range(1, bins)]
    found = values.approxQuantile([f"f{i}" for i in range(len(features))], shares, error)
    return [sorted({b for b in one if math.isfinite(b)}) for one in found]


def with_bins(df: DataFrame, features: Sequence[str], bounds: Sequence[Sequence[float]], out: str) -> DataFrame:
    """Adds an array of bin numbers: how many bounds a value reaches, MISSING for NULL and NaN."""
    names = [f"_b{i}" for i in range(len(features))]
    wide = df.select("*", *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    splits = [[-math.inf, *b, math.inf] for b in bounds]
    cut = Bucketizer(splitsArray=splits, inputCols=[f"_x{i}" for i in range(len(features))], outputCols=names, handleInvalid="keep").transform(wide)
    bins = [F.when(F.col(f"_x{i}").isNull() | F.isnan(f"_x{i}"), MISSING).otherwise(F.col(n).cast("int")) for i, n in enumerate(names)]
    return cut.select(*[q(c) for c in df.columns], F.array(*bins).alias(out))


def best_splits(histogram: DataFrame, reg_lambda: float, gamma: float, min_child_weight: float) -> DataFrame:
    """Per node its totals and best split from (node, feature, bin, g, h) sums.

    Ties go to the first feature, then the first bin, then missing values on the right.
    """
    order = W.partitionBy("node", "feature").orderBy("bin")
    whole = W.partitionBy("node", "feature")
    known = F.col("bin") != MISSING

    def gone(c: str) -> Column:
        return F.sum(F.when(~known, F.col(c)).otherwise(0.0)).over(whole)

    sums = histogram.select(
        "*",
        F.sum(F.when(known, F.col("g")).otherwise(0.0)).over(order).alias("gl"),
        F.sum(F.when(known, F.col("h")).otherwise(0.0)).over(order).alias("hl"),
        F.sum("g").over(whole).alias("gt"),
        F.sum("h").over(whole).alias("ht"),
        gone("g").alias("gm"),
        gone("h").alias("hm"),
    )

    def part(g: Column, h: Column) -> Column:
        return g * g / (h + reg_lambda)

    both = sums.withColumn("left", F.explode(F.array(F.lit(False), F.lit(True))))
    gl = F.col("gl") + F.when(F.col("left"), F.col("gm")).otherwise(0.0)
    hl = F.col("hl") + F.when(F.col("left"), F.col("hm")).otherwise(0.0)
    gr, hr = F.col("gt") - gl, F.col("ht") - hl
    gain = 0.5 * (part(gl, hl) + part(gr, hr) - part(F.col("gt"), F.col("ht"))) - gamma
    least = max(min_child_weight, 1e-12)
    fits = known & (hl >= least) & (hr >= least)
    asked = both.withColumn("gain", F.when(fits, gain))
    ranked = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("left")).alias("right"), gl.alias("gl"), hl.alias("hl"))
    found = asked.groupBy("node").agg(
        F.max(F.when(F.col("gain") > 0, ranked)).alias("s"),
        F.min_by(F.struct("gt", "ht"), "feature").alias("t"),
    )
    split = [F.col("s.gain").alias("gain"), (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), (~F.col("s.right")).alias("missing_left")]
    return found.select("node", F.col("t.gt").alias("g"), F.col("t.ht").alias("h"), *split, F.col("s.gl").alias("gl"), F.col("s.hl").alias("hl"))


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.3,
    reg_lambda: float = 1.0,
    gamma: float = 0.0,
    min_child_weight: float = 1.0,
    subsample: float = 1.0,
    columns_per_tree: float = 1.0,
    positive_weight: float | None = None,
    validation: str | None = None,
    patience: int = 10,
    bins: int = 256,
    bounds: Mapping[str, Sequence[float]] | None = None,
    id_cols: Sequence[str] | None = None,
    seed: int = 42,
) -> BoostedTrees:
    """Boosted trees for a 0/1 label under logistic loss.

    `positive_weight` multiplies gradients and hessians of label 1 (default: negatives over positives).
    `validation` names a 0/1 column; its rows do not train, and `patience` rounds without a smaller loss on
    them end the training. `subsample` needs `id_cols`: a row takes part in a tree by a hash of its id.
    """
    if subsample < 1 and not id_cols:
        raise ValueError("subsample needs id_cols")
    held = F.coalesce(q(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    fit_rows = df.where(~held)
    cuts = [list(bounds[f]) for f in features] if bounds else quantile_bounds(fit_rows, features, bins)
    if positive_weight is None:
        stats = explore.class_stats(fit_rows, label).first()
        positive_weight = stats["neg"] / stats["pos"] if stats["neg"] and stats["pos"] else 1.0
    model = BoostedTrees(list(features), cuts, depth)
    key = F.xxhash64(*[q(c) for c in id_cols]) if id_cols else F.lit(0).cast("bigint")
    slim = with_bins(df.withColumn("_held", held).withColumn("_key", key), features, cuts, "_bins")
    y = q(label).cast("double").alias("y")
    table = materialize(slim.where(q(label).isNotNull()).select("_key", "_held", y, "_bins", F.lit(0.0).alias("margin")), "boost-rows")
    pending: list[Tree] = []
    smallest, model.best = math.inf, 0
    for r in range(rounds + 1):
        current = table.withColumn("margin", F.col("margin") + model.margin(F.col("_bins"), pending)) if pending else table
        if len(pending) >= WRITE_EVERY:
            table, pending = materialize(current, "boost-rows"), []
            current = table
        tree, loss = _grow(current, model, r, depth if r < rounds else 0, step, reg_lambda, gamma, min_child_weight, subsample, columns_per_tree, positive_weight, validation is not None, seed)
        if r:
            model.history.append((r, loss))
            if loss is None:
                model.best = r
            elif loss < smallest:
                smallest, model.best = loss, r
            elif r - model.best >= patience:
                break
        if r == rounds:
            break
        model.trees.append(tree)
        pending.append(tree)
    return model


def _grow(rows, model, r, depth, step, reg_lambda, gamma, least, subsample, share, positive, validate, seed) -> tuple[Tree, float | None]:
    """One tree, level by level, and the validation loss of the margins it starts from."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    weight = F.when(F.col("y") == 1, F.lit(float(positive))).otherwise(1.0)
    losses = F.when(F.col("_held"), F.when(F.col("y") == 1, F.log1p(F.exp(-F.col("margin")))).otherwise(F.log1p(F.exp(F.col("margin")))))
    if not depth:  # only the loss of the last trees is asked
        return Tree.empty(0), rows.agg(F.avg(losses)).first()[0] if validate else None
    watch = Observation() if validate else None
    observed = rows.observe(watch, F.avg(losses).alias("loss")) if validate else rows
    used = observed.where(~F.col("_held"))
    if subsample < 1:
        used = used.where(F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(r)), F.lit(1 << 30)) < int(subsample * (1 << 30)))
    used = used.select("_bins", ((p - F.col("y")) * weight).alias("g"), (F.greatest(p * (1 - p), F.lit(1e-16)) * weight).alias("h"))
    asked = list(range(len(model.features)))
    if share < 1:
        asked = sorted(random.Random(f"{seed}:{r}").sample(asked, max(1, int(share * len(asked)))))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.get("_bins", F.lit(f)).alias("bin")) for f in asked]))
    tree, open_, loss = Tree.empty(depth), {0}, None
    for level in range(depth):
        node = _leaf(_literal([tree])[0], F.col("_bins"), level)
        there = used.withColumn("node", node).where(F.col("node") >= 2**level - 1)  # rows in closed leaves stay behind
        sums = there.select("node", "g", "h", cells.alias("c")).groupBy("node", F.col("c.feature").alias("feature"), F.col("c.bin").alias("bin")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found = {s.node: s for s in best_splits(sums, reg_lambda, gamma, least).collect()}  # at most 2^level rows
        if level == 0 and watch is not None:
            loss = watch.get["loss"]
        following = set()
        for k in open_ & found.keys():
            s = found[k]
            tree.value[k] = -step * s.g / (s.h + reg_lambda)
            if s.gain is not None:
                tree.feature[k], tree.bin[k], tree.missing_left[k], tree.gain[k] = s.feature, s.bin, s.missing_left, s.gain
                tree.value[2 * k + 1] = -step * s.gl / (s.hl + reg_lambda)
                tree.value[2 * k + 2] = -step * (s.g - s.gl) / (s.h - s.hl + reg_lambda)
                following |= {2 * k + 1, 2 * k + 2}
        open_ = following
        if not open_:
            break
    return tree, loss
