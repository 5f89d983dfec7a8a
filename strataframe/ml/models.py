"""Models: MLlib fits behind plain parameter records, scored by column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import clamp, finite, sigmoid
from strataframe.operators.aggregates import column_stats
from strataframe.session import fresh_path, settle

# Features up to which a score is written out as one sum.
WIDE = 16

# Fitting defaults.
L2, LOGISTIC_ITER, PLATT_ITER = 1e-3, 400, 200
ROUNDS, RATE, DEPTH, MIN_LEAF, SUBSAMPLE = 120, 0.08, 3, 60, 0.7
REG_ROUNDS, REG_RATE, REG_DEPTH, REG_MIN_LEAF, REG_BOUNDS = 100, 0.1, 4, 40, (0.0, 168.0)
# Bins of a feature, rows whose values place their borders, and units that a round draws from at least.
BINS, EDGE_ROWS, UNITS = 32, 100_000, 50_000


@dataclass
class Standardizer:
    """Column means and deviations of one training set."""

    features: list[str]
    means: list[float]
    devs: list[float]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> Standardizer:
        stats = {r["feature"]: r for r in column_stats(df, features).collect()}
        return cls(features, [stats[f]["mean"] for f in features], [stats[f]["dev"] for f in features])

    def columns(self) -> list[Column]:
        """Standardised values, 0 where the input is missing."""
        return [F.coalesce((finite(f) - m) / d, F.lit(0.0)) for f, m, d in zip(self.features, self.means, self.devs)]

    def vector(self) -> Column:
        """The same values as one array."""
        return F.array(*self.columns())


@dataclass
class Platt:
    slope: float = 1.0
    bias: float = 0.0
    mean: float = 0.0
    dev: float = 1.0

    def apply(self, score: Column) -> Column:
        return sigmoid(F.lit(self.slope) * ((score - self.mean) / (self.dev or 1.0)) + self.bias)


@dataclass
class LogisticModel:
    features: list[str]
    weights: list[float]
    bias: float
    means: list[float]
    devs: list[float]
    threshold: float = 0.5
    calibrator: Platt | None = None
    feature_version: str = "v1.0.0"
    extra: dict = field(default_factory=dict)

    def contributions(self) -> list[Column]:
        """Weight times standardised value per feature; missing values contribute nothing."""
        return [F.coalesce((finite(f) - F.lit(m)) / F.lit(d), F.lit(0.0)) * F.lit(w)
                for f, w, m, d in zip(self.features, self.weights, self.means, self.devs)]

    def log_odds(self) -> Column:
        """Sum of bias and contributions; wide models fold over one array to keep the generated code small."""
        if len(self.features) <= WIDE:
            return reduce(lambda a, b: a + b, self.contributions(), F.lit(self.bias))
        terms = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(w).alias("w"))
                          for m, d, w in zip(self.means, self.devs, self.weights)])
        parts = F.zip_with(F.array(*[finite(f) for f in self.features]), terms,
                           lambda x, t: F.coalesce((x - t["m"]) / t["d"], F.lit(0.0)) * t["w"])
        return F.aggregate(parts, F.lit(self.bias), lambda a, x: a + x)

    def score(self) -> Column:
        return sigmoid(self.log_odds())

    def calibrated(self) -> Column:
        return self.calibrator.apply(self.score()) if self.calibrator else self.score()


def class_weight(df: DataFrame, label: str, positive_weight: float) -> Column:
    """Weight of a row: positives are scaled to balance the classes, times `positive_weight`."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = r["p"], r["n"]
    scale = (n - p) / p if 0 < p < n else 1.0
    return F.when(F.col(label) == 1, F.lit(float(positive_weight * scale))).otherwise(F.lit(1.0))


def _logistic(df: DataFrame, values: Column, label: str, weight: Column, l2: float, iters: int):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    vec = df.select(F.col(label).cast("double").alias("_y"), weight.alias("_w"), array_to_vector(values).alias("_f"))
    lr = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", regParam=l2, elasticNetParam=0.0,
                            maxIter=iters, standardization=False)
    return lr.fit(vec)


def fit_logistic(df: DataFrame, features: list[str], label: str, positive_weight: float = 1.0, l2: float = L2,
                 iters: int = LOGISTIC_ITER) -> LogisticModel:
    """L2 logistic regression on standardised features, classes balanced."""
    std = Standardizer.fit(df, features)
    m = _logistic(df, std.vector(), label, class_weight(df, label, positive_weight), l2, iters)
    return LogisticModel(features, [float(w) for w in m.coefficients], float(m.intercept), std.means, std.devs)


def fit_platt(df: DataFrame, score: str, label: str, iters: int = PLATT_ITER) -> Platt:
    """One-feature logistic on the score; identity when one class is missing."""
    r = df.agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"), F.min(label).alias("lo"),
               F.max(label).alias("hi")).first()
    if r["lo"] == r["hi"]:
        return Platt()
    mean, dev = float(r["m"]), max(1e-6, float(r["s"]))
    m = _logistic(df, F.array((F.col(score) - mean) / dev), label, class_weight(df, label, 1.0), 0.0, iters)
    return Platt(float(m.coefficients[0]), float(m.intercept), mean, dev)


def assemble(df: DataFrame, features: list[str], out: str = "_features") -> DataFrame:
    """Adds the feature vector, 0 for missing values."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.array(*[F.coalesce(finite(f), F.lit(0.0)) for f in features])))


def fit_boosted(df: DataFrame, features: list[str], label: str, rounds: int = ROUNDS, seed: int = 7):
    from pyspark.ml.classification import GBTClassifier

    gbt = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=rounds, stepSize=RATE, maxDepth=DEPTH,
                        minInstancesPerNode=MIN_LEAF, subsamplingRate=SUBSAMPLE, seed=seed)
    return gbt.fit(assemble(df, features).withColumn("_y", F.col(label).cast("double")))


def score_boosted(df: DataFrame, model, features: list[str], out: str = "score") -> DataFrame:
    """Adds the boosted probability."""
    from pyspark.ml.functions import vector_to_array

    done = model.transform(assemble(df, features))
    prob = vector_to_array(F.col("probability"))[1]
    return done.withColumn(out, prob).drop("_features", "rawPrediction", "probability", "prediction")


@dataclass
class BinnedTrees:
    """Regression trees over the bin numbers of the features, with the inner borders of the bins."""

    edges: list[list[float]]
    trees: object


def bin_edges(df: DataFrame, features: list[str], rows: int) -> list[list[float]]:
    """Up to `BINS - 1` borders per feature, midway between values: between all of few, else at quantiles.

    As in MLlib a bounded draw of the rows places them, here by a hash of the values.
    """
    kept = df.where(F.pmod(F.xxhash64(*features), F.lit(max(1, rows // EDGE_ROWS))) == 0)
    fine = 1024
    found = kept.agg(*[F.percentile_approx(F.coalesce(finite(f), F.lit(0.0)), [i / fine for i in range(fine + 1)]) for f in features]).first()
    out = []
    for values in found:
        values = values or [0.0]
        known = sorted(set(values))
        below = dict(zip(known[1:], known))
        at = known if len(known) <= BINS else sorted({values[i * fine // BINS] for i in range(1, BINS)})
        out.append([(below[v] + v) / 2 for v in at if v in below] or known[:1])
    return out


def binned(df: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """Adds the bin numbers `_b0`, `_b1`, ... of the features, 0 standing for missing values."""
    from pyspark.ml.feature import Bucketizer

    n, inf = range(len(features)), float("inf")
    df = df.withColumns({f"_x{i}": F.coalesce(finite(f), F.lit(0.0)) for i, f in enumerate(features)})
    cut = Bucketizer(splitsArray=[[-inf, *e, inf] for e in edges], inputCols=[f"_x{i}" for i in n], outputCols=[f"_b{i}" for i in n])
    return cut.transform(df).drop(*[f"_x{i}" for i in n])


def fit_boosted_regressor(df: DataFrame, features: list[str], target: str, rounds: int = REG_ROUNDS, seed: int = 7) -> BinnedTrees:
    """Boosted trees on squared error, fitted on cells: all rows with equal bins count as one, with their mean and number.

    Splits and leaves see the same sums as over rows. A round draws units: cells are shared out evenly while they are few.
    """
    from pyspark.ml.regression import GBTRegressor

    bins = [f"_b{i}" for i in range(len(features))]
    y = F.coalesce(F.col(target).cast("double"), F.lit(float("nan")))  # a missing target stops the fit
    edges = bin_edges(df, features, df.count())
    cells = settle(binned(df, features, edges).groupBy(*bins).agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_y")), "cells")
    size = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("_n").alias("rows")).first()
    shares = F.least(F.col("_n"), F.lit(-(-UNITS // max(1, size["cells"]))))
    units = cells.select(*bins, "_y", (F.col("_n") / shares).alias("_w"), F.explode(F.array_repeat(F.lit(0), shares.cast("int"))))
    gbt = GBTRegressor(featuresCol="_features", labelCol="_y", weightCol="_w", maxIter=rounds, stepSize=REG_RATE, maxDepth=REG_DEPTH,
                       minWeightFractionPerNode=min(0.4999, REG_MIN_LEAF / max(1, size["rows"] or 0)), maxBins=BINS,
                       subsamplingRate=SUBSAMPLE, seed=seed)
    return BinnedTrees(edges, gbt.fit(assemble(units.repartition(max(1, max(UNITS, size["cells"]) // 20_000)), bins)))


def score_boosted_regressor(df: DataFrame, model: BinnedTrees, features: list[str], out: str = "predicted") -> DataFrame:
    """Adds the prediction, kept inside the range a target can take."""
    bins = [f"_b{i}" for i in range(len(features))]
    done = model.trees.transform(assemble(binned(df, features, model.edges), bins))
    return done.withColumn(out, clamp("prediction", *REG_BOUNDS)).drop("_features", "prediction", *bins)


def tree_nodes(spark, model) -> DataFrame:
    """Node table of a tree or ensemble: (tree, id, feature, threshold, left, right, prediction, n).

    Read back from MLlib's own saved form; a leaf has feature -1.
    """
    path = fresh_path(spark, "tree-model")
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID") if "treeID" in raw.columns else F.lit(0)
    node = F.col("nodeData") if "nodeData" in raw.columns else F.struct(*raw.columns)
    flat = raw.select(tree.alias("tree"), node.alias("d"))
    return flat.select(
        "tree", F.col("d.id").alias("id"), F.col("d.split.featureIndex").alias("feature"),
        F.get(F.col("d.split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col("d.leftChild").alias("left"), F.col("d.rightChild").alias("right"), F.col("d.prediction").alias("prediction"),
        F.col("d.rawCount").alias("n"))


def tree_rules(nodes: DataFrame, features: list[str], depth: int) -> DataFrame:
    """(tree, condition, prediction, samples) per leaf: the node table joined to its parents `depth` times."""
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    inner = nodes.where("feature >= 0").withColumn("_name", name)
    edge = inner.select(
        F.col("tree").alias("_t"), F.col("id").alias("_parent"),
        F.explode(F.array(
            F.struct(F.col("left").alias("child"), F.concat(F.col("_name"), F.lit(" <= "), F.col("threshold").cast("string")).alias("test")),
            F.struct(F.col("right").alias("child"), F.concat(F.col("_name"), F.lit(" > "), F.col("threshold").cast("string")).alias("test")),
        )).alias("e")).select("_t", "_parent", "e.child", "e.test")
    rules = nodes.where("feature < 0").select("tree", F.col("id").alias("_at"), F.lit("").alias("condition"),
                                              "prediction", F.col("n").alias("samples"))
    for _ in range(depth):
        step = rules.join(edge, (F.col("tree") == F.col("_t")) & (F.col("_at") == F.col("child")), "left")
        grown = F.when(F.col("test").isNull(), F.col("condition")).when(F.col("condition") == "", F.col("test")).otherwise(
            F.concat("test", F.lit(" AND "), "condition"))
        rules = step.select("tree", F.coalesce("_parent", "_at").alias("_at"), grown.alias("condition"), "prediction",
                            "samples")
    return rules.select("tree", F.when(F.col("condition") == "", "(all rows)").otherwise(F.col("condition")).alias("condition"),
                        "prediction", "samples")


def split_usage(nodes: DataFrame, features: list[str]) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    return nodes.where("feature >= 0").groupBy(name.alias("feature")).agg(F.count(F.lit(1)).alias("times_split"))


def tree_shape(nodes: DataFrame) -> DataFrame:
    """Nodes and leaves per tree."""
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"))
