"""Grouped cross-validation, model choice and the one-row reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.ml import metrics as M
from strataframe.ml.folds import group_kfold
from strataframe.ml.models import (
    LogisticModel, fit_boosted, fit_boosted_regressor, fit_logistic, fit_platt, score_boosted, score_boosted_regressor,
)
from strataframe.operators.aggregates import spread
from strataframe.operators.joins import exists_within
from strataframe.operators.windows import percentile_table, top_fraction
from strataframe.session import settle

MIN_POSITIVES = 10

# A candidate fits a training frame and returns a function that adds `score` to any frame.
Candidate = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def logistic_candidate(features: list[str], label: str, positive_weight: float = 1.0, iters: int = 400) -> Candidate:
    def fit(train: DataFrame):
        m = fit_logistic(train, features, label, positive_weight, iters=iters)
        return lambda df: df.withColumn("score", m.score())

    return fit


def boosted_candidate(features: list[str], label: str, rounds: int = 120) -> Candidate:
    def fit(train: DataFrame):
        m = fit_boosted(train, features, label, rounds)
        return lambda df: score_boosted(df, m, features)

    return fit


def out_of_fold(df: DataFrame, group: str, label: str, k: int, candidate: Candidate, calibrate: bool = True) -> DataFrame:
    """Every row scored by a model that never saw its group: adds fold, score and calibrated.

    The folded rows are written once to the shared folder, so k fits do not recompute them.
    """
    data = settle(group_kfold(df, group, k), "folds")
    parts = []
    for f in range(k):
        train, test = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        score = candidate(train)
        scored = score(test)
        if calibrate:
            platt = fit_platt(score(train), "score", label)
            scored = scored.withColumn("calibrated", platt.apply(F.col("score")))
        parts.append(scored)
    return reduce(DataFrame.unionByName, parts)


def classifier_report(oof: DataFrame, label: str, group: str, tie: str, min_precision: float = M.MIN_PRECISION) -> DataFrame:
    """One row: sizes, pooled metrics on held-out scores, operating point, flag-all baseline and gate."""
    base = oof.agg(
        F.count(F.lit(1)).alias("rows_scored"), F.countDistinct(group).alias("groups"),
        F.count_if(F.col(label) == 1).alias("positives"), F.countDistinct("fold").alias("folds"))
    rate = F.col("positives") / F.col("rows_scored")
    best = M.best_threshold(oof, "calibrated", label, min_precision=min_precision)
    out = base.withColumns({
        "positive_rate": round_half_up(rate, 4),
        "roc_auc": round_half_up(M.roc_auc(oof, "score", label).scalar(), 4),
        "average_precision": round_half_up(M.average_precision(oof, "calibrated", label, tie).scalar(), 4),
        "brier": M.brier(oof, "calibrated", label).scalar(),
        "ece": M.calibration_error(oof, "calibrated", label).scalar(),
        "operating": best.select(F.struct("*")).scalar(),
        "base_precision": round_half_up(rate, 4),
    })
    flat = out.select("*", "operating.threshold", "operating.precision", "operating.recall", "operating.f1",
                      "operating.tp").drop("operating")
    return M.deployment_gate(flat)


def fold_report(oof: DataFrame, label: str, tie: str) -> DataFrame:
    """Per fold: rows, positives, base rate, AUC and average precision."""
    sizes = oof.groupBy("fold").agg(F.count(F.lit(1)).alias("test_rows"),
                                    F.count_if(F.col(label) == 1).alias("test_positives"))
    sizes = sizes.withColumn("base_rate", round_half_up(F.col("test_positives") / F.col("test_rows"), 4))
    return sizes.join(M.roc_auc(oof, "score", label, ["fold"]), "fold").join(
        M.average_precision(oof, "calibrated", label, tie, ["fold"]), "fold")


def fold_spread(report: DataFrame, col: str = "roc_auc") -> DataFrame:
    return spread(report.where(F.col(col).isNotNull()), col)


def evaluate_classifier(df: DataFrame, features: list[str], label: str, group: str, tie: str, k: int = 5,
                        candidates: dict[str, Candidate] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(one report row per candidate, best first; out-of-fold frames by candidate)."""
    candidates = candidates or {"logistic_regression": logistic_candidate(features, label),
                                "gradient_boosted_trees": boosted_candidate(features, label)}
    oofs = {n: settle(out_of_fold(df, group, label, k, c).select(tie, group, label, "fold", "score", "calibrated"), "oof")
            for n, c in candidates.items()}
    rows = [classifier_report(o, label, group, tie).withColumn("algorithm", F.lit(n)) for n, o in oofs.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(
        F.col("roc_auc").desc(), F.col("average_precision").desc(), "algorithm"), oofs


def evaluate_regressor(df: DataFrame, features: list[str], target: str, group: str, tie: str, k: int = 5,
                       rounds: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report row against the mean predictor, percentile table, out-of-fold predictions). The folds are fitted side by side."""
    data = settle(group_kfold(df.select(*dict.fromkeys([tie, group, target, *features])), group, k), "folds")

    def held_out(f: int) -> DataFrame:
        m = fit_boosted_regressor(data.where(F.col("fold") != f), features, target, rounds)
        return score_boosted_regressor(data.where(F.col("fold") == f), m, features).select(tie, group, "fold", target, "predicted")

    with ThreadPool(k) as pool:
        parts = pool.map(inheritable_thread_target(data.sparkSession)(held_out), range(k))
    oof = settle(reduce(DataFrame.unionByName, parts), "oof")
    report = M.regression_metrics(oof, "predicted", target)
    stats = oof.agg(round_half_up(F.avg(target), 4).alias("mean_target"),
                    round_half_up(F.avg("predicted"), 4).alias("predicted_mean"),
                    round_half_up(F.stddev_pop("predicted"), 4).alias("predicted_std"),
                    round_half_up(F.stddev_pop(target), 4).alias("target_std"))
    report = report.withColumn("_s", stats.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
    report = report.withColumn("beats_baseline", F.col("rmse") < F.col("baseline_rmse"))
    return report, percentile_table(oof, target, "predicted", tie=tie), oof


def anomaly_enrichment(scored: DataFrame, events: DataFrame, by: list[str], depth: str, at: str, score: str, tie: str,
                       margin: float = 60.0, fraction: float = 0.01) -> DataFrame:
    """How many of each series' top-scoring rows lie within `margin` of a recorded event.

    Reports hits over flagged rows and hits over recorded events, under their own names.
    """
    top = top_fraction(scored, by, [f"-{score}", tie], fraction)
    hit = exists_within(top, events, by, depth, at, margin, "near")
    out = hit.agg(F.count(F.lit(1)).alias("top_rows"), F.sum("near").alias("hits"))
    out = out.withColumn("recorded", events.agg(F.count(F.lit(1))).scalar())
    return out.select("top_rows", "hits", "recorded",
                      round_half_up(F.col("hits") / F.col("top_rows"), 4).alias("hit_share"),
                      F.when(F.col("recorded") > 0, round_half_up(F.col("hits") / F.col("recorded"), 4)).alias(
                          "hits_per_recorded"))


def anomaly_report(scored: DataFrame, score: str, flag_at: float = 0.6) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows_scored"), round_half_up(F.min(score), 4).alias("min_score"),
        round_half_up(F.max(score), 4).alias("max_score"), round_half_up(F.avg(score), 4).alias("mean_score"),
        round_half_up(F.count_if(F.col(score) >= flag_at) / F.count(F.lit(1)), 4).alias("flag_rate"))


def train_classifier(df: DataFrame, features: list[str], label: str, group: str, tie: str, k: int = 5,
                     positive_weight: float = 1.0, rounds: int = 120, iters: int = 400
                     ) -> tuple[dict, LogisticModel | None]:
    """Compare candidates on held-out groups, pick by AUC then average precision, refit on everything.

    Returns the winner's report (with `skipped` instead when positives are too few) and the refitted logistic model with
    calibrator and threshold, or None when the boosted trees win.
    """
    positives = df.where(F.col(label) == 1).limit(MIN_POSITIVES).count()
    if positives < MIN_POSITIVES:
        return {"skipped": f"only {positives} positive examples"}, None
    report, _ = evaluate_classifier(df, features, label, group, tie, k, {
        "logistic_regression": logistic_candidate(features, label, positive_weight, iters),
        "gradient_boosted_trees": boosted_candidate(features, label, rounds)})
    ranked = report.collect()
    best = ranked[0].asDict(recursive=True)
    best["runner_up"] = ranked[1]["algorithm"]
    best["runner_up_auc"] = ranked[1]["roc_auc"]
    best["activated"] = bool(best["usable"])
    if best["algorithm"] != "logistic_regression":
        return best, None
    model = fit_logistic(df, features, label, positive_weight, iters=iters)
    model.calibrator = fit_platt(df.withColumn("score", model.score()), "score", label)
    model.threshold = best["threshold"]
    return best, model
