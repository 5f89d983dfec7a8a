"""Isolation forest: small samples drawn by Spark, one tree per group, scores by Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import EULER_GAMMA, finite, round_half_up
from strataframe.operators.windows import nearest_rank, smoothed

# Trees, rows per tree, share of features per tree, split attempts, smoothing rows, flagged share.
TREES, SAMPLE, FEATURE_SHARE, ATTEMPTS, SMOOTHING, FLAG_RATE = 100, 256, 0.6, 4, 5, 0.05


def _path_length(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    features: list[str]
    sample: int
    trees: list[dict]  # arrays per tree: feature, threshold, left, right, length


def _sample_rows(df: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """About `sample` rows for each tree in one pass: every row draws how many times it is taken and for which trees.

    Draws hash the row key, so a retried task draws the same rows. The draw is a little generous and cut per tree.
    """
    n = df.count()
    want = 1.3 * trees * min(sample, n)
    rate = want / max(n, 1)
    whole, part = int(rate), rate - int(rate)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    times = F.lit(whole) + F.when(u < part, 1).otherwise(0)
    drawn = df.withColumn("_k", times).where("_k > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    tree = F.pmod(F.xxhash64(F.col(key), F.col("_j"), F.lit(seed + 1)), F.lit(trees))
    return drawn.withColumn("tree", tree.cast("int")).withColumn(
        "_h", F.xxhash64(F.col(key), F.col("_j"), F.lit(seed + 2)))


def _grow(x: np.ndarray, columns: np.ndarray, limit: int, rng: np.random.Generator) -> dict:
    feature, threshold, left, right, length = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        i = len(feature)
        feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1)
        length.append(depth + _path_length(len(rows)))
        if depth >= limit or len(rows) <= 1:
            return i
        for _ in range(ATTEMPTS):
            c = int(rng.choice(columns))
            v = rows[:, c]
            lo, hi = np.nanmin(v), np.nanmax(v)
            if not np.isfinite(lo) or lo == hi:
                continue
            at = lo + rng.random() * (hi - lo)
            down = v <= at
            if down.all() or not down.any():
                continue
            feature[i], threshold[i] = c, float(at)
            left[i] = node(rows[down], depth + 1)
            right[i] = node(rows[~down], depth + 1)
            break
        return i

    node(x, 0)
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "length": length}


def fit_iforest(df: DataFrame, features: list[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 7
                ) -> IsolationForest:
    """Fit on samples of `sample` rows per tree. Only the trees (at most 2 * sample nodes each) reach the driver."""
    from strataframe.operators.topk import topk

    clean = df.select(key, *[F.coalesce(finite(f), F.lit(0.0)).alias(f) for f in features])
    rows = topk(_sample_rows(clean, key, trees, sample, seed), ["tree"], ["_h", "_j", key], sample, "_r")
    share = max(1, int(len(features) * FEATURE_SHARE))
    depth = max(1, math.ceil(math.log2(max(2, sample))))

    def build(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(k[0])])
        x = pdf.sort_values("_r")[features].to_numpy(dtype=float)
        columns = np.sort(rng.choice(len(features), size=share, replace=False))
        t = _grow(x, columns, depth, rng)
        return pd.DataFrame([{"tree": int(k[0]), **t}])

    schema = ("tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
              "length array<double>")
    grown = rows.groupBy("tree").applyInPandas(build, schema).orderBy("tree").collect()
    effective = min(sample, df.count())
    return IsolationForest(features, effective, [r.asDict() for r in grown])


def score_iforest(df: DataFrame, model: IsolationForest, out: str = "raw_score") -> DataFrame:
    """Adds 2^(-mean path / expected path), in (0, 1]."""
    shared = df.sparkSession.sparkContext.broadcast(
        [{k: np.asarray(v) for k, v in t.items() if k != "tree"} for t in model.trees])
    norm = _path_length(model.sample) or 1.0

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = t["feature"][at]
                live = f >= 0
                if not live.any():
                    break
                down = x[rows, np.where(live, f, 0)] <= t["threshold"][at]
                at = np.where(live, np.where(down, t["left"][at], t["right"][at]), at)
            total += t["length"][at]
        return pd.Series(np.clip(2.0 ** (-(total / len(shared.value)) / norm), 0, 1))

    return df.withColumn(out, score(*[F.coalesce(finite(f), F.lit(0.0)) for f in model.features]))


def smoothed_scores(df: DataFrame, by: list[str], order: list[str], raw: str = "raw_score", out: str = "score",
                    back: int = SMOOTHING) -> DataFrame:
    """Mean over the current and the `back` rows before, within each series."""
    return smoothed(df, by, order, raw, back, out)


def anomaly_threshold(df: DataFrame, score: str, rate: float = FLAG_RATE) -> DataFrame:
    """One row: the score above which the top `rate` share lies."""
    return nearest_rank(df, [], score, 1 - rate, "threshold").select(round_half_up("threshold", 4).alias("threshold"))
