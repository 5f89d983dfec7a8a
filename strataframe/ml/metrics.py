"""Exact model metrics. All take `by` columns, so one job yields pooled, per-fold or per-model values.

Ranking metrics first count labels per distinct score; sorting then runs over distinct scores, and `running` cuts that
axis into ranges when it is long, so nothing is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.operators.series import join_keyed, position, running
from strataframe.operators.topk import topk

# Defaults of the evaluation.
MIN_PRECISION, GRID, BINS, RESAMPLES, ALPHA = 0.3, 200, 10, 400, 0.05


def score_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, score, pos, n): one row per distinct score."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))


def auc_from_counts(counts: DataFrame, by: list[str], out: str = "roc_auc", limit: float | None = None) -> DataFrame:
    run = running(counts, by, ["score"], {"_upto": ("sum", F.col("n"))}, limit=limit)
    mean_rank = F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2
    agg = run.groupBy(*by).agg(
        F.sum(F.col("pos") * mean_rank).alias("_r"), F.sum("pos").cast("double").alias("_p"),
        F.sum(F.col("n") - F.col("pos")).cast("double").alias("_q"))
    value = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))
    return agg.select(*by, F.when((F.col("_p") > 0) & (F.col("_q") > 0), value).alias(out))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area, ties counted half; null when one class is empty."""
    by = by or []
    return auc_from_counts(score_counts(df, score, label, by), by)


def average_precision(df: DataFrame, score: str, label: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Mean precision at each positive, rows ordered by falling score then `tie`; null without positives."""
    by = by or []
    hit = (F.col(label) == 1).cast("bigint")
    run = running(df.select(*by, score, tie, label), by, [f"-{score}", tie],
                  {"_tp": ("sum", hit), "_i": ("count", F.lit(1))})
    part = F.when(F.col(label) == 1, F.col("_tp") / F.col("_i"))
    agg = run.groupBy(*by).agg(F.sum(part).alias("_s"), F.sum(hit).alias("_p"))
    return agg.select(*by, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("average_precision"))


def _rates(tp, fp, fn) -> dict[str, Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"precision": round_half_up(precision, 4), "recall": round_half_up(recall, 4), "f1": round_half_up(f1, 4)}


def confusion_at(df: DataFrame, score: str, label: str, threshold, by: list[str] | None = None) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    up, yes = F.col(score) >= t, F.col(label) == 1
    agg = df.groupBy(*(by or [])).agg(
        F.count_if(up & yes).alias("tp"), F.count_if(up & ~yes).alias("fp"), F.count_if(~up & ~yes).alias("tn"),
        F.count_if(~up & yes).alias("fn"))
    return agg.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(df: DataFrame, score: str, label: str, by: list[str] | None = None,
                   min_precision: float = MIN_PRECISION, grid: int = GRID) -> DataFrame:
    """Best F1 over a grid from the lowest to the highest score, under a precision floor.

    Ties go to the higher recall, then the lower threshold. Points under the floor are passed over unless their F1 is
    0. When nothing is left, the values at 0.5 are given with a note; a note also marks a threshold without hits.
    """
    by = by or []
    counts = score_counts(df, score, label, by)
    ends = counts.groupBy(*by).agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.sum("pos").alias("_pos"), F.sum("n").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("score") >= 0.5, F.col("pos"))), F.lit(0)).alias("_tp5"),
        F.coalesce(F.sum(F.when(F.col("score") >= 0.5, F.col("n"))), F.lit(0)).alias("_n5"))

    def mark(g: Column) -> Column:
        return F.col("_lo") + (F.col("_hi") - F.col("_lo")) * g / grid

    joined = join_keyed(counts, ends, by, "inner") if by else counts.withColumns(
        {"_lo": ends.select("_lo").scalar(), "_hi": ends.select("_hi").scalar()})
    span = F.col("_hi") - F.col("_lo")
    guess = F.when(span > 0, F.floor((F.col("score") - F.col("_lo")) * grid / span)).otherwise(grid)
    fixed = F.when(mark(guess + 1) <= F.col("score"), guess + 1).when(mark(guess) > F.col("score"), guess - 1)
    bin_ = F.least(F.lit(grid), F.greatest(F.lit(0), fixed.otherwise(guess))).cast("bigint")
    binned = joined.groupBy(*by, bin_.alias("g")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    points = ends.select(*by, "_lo", "_hi", "_pos", "_all", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("g"))
    points = points.withColumn("g", F.col("g").cast("bigint"))
    full = join_keyed(points, binned, [*by, "g"])
    run = running(full, by, ["-g"], {"tp": ("sum", F.coalesce("pos", F.lit(0))),
                                     "_up": ("sum", F.coalesce("n", F.lit(0)))})
    tp, fp = F.col("tp"), F.col("_up") - F.col("tp")
    rated = run.withColumns({"threshold": mark(F.col("g")), "fp": fp, "fn": F.col("_pos") - tp,
                             "tn": F.col("_all") - F.col("_up") - (F.col("_pos") - tp)})
    rated = rated.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))
    usable = ~((F.col("precision") < min_precision) & (F.col("f1") > 0))
    cols = ["threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1"]
    best = rated.groupBy(*by).agg(
        F.max_by(F.struct(*cols), F.when(usable, F.struct("f1", "recall", -F.col("g")))).alias("_b"))
    tp5, n5 = F.col("_tp5"), F.col("_n5")
    at5 = ends.select(*by, F.lit(0.5).alias("threshold"), tp5.alias("tp"), (n5 - tp5).alias("fp"),
                      (F.col("_all") - n5 - (F.col("_pos") - tp5)).alias("tn"), (F.col("_pos") - tp5).alias("fn"))
    at5 = at5.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn"))).select(*by, F.struct(*cols).alias("_f"))
    out = join_keyed(best, at5, by, "inner") if by else best.withColumn("_f", at5.scalar())
    note = (F.when(F.col("_b").isNull(), "no threshold reached the precision floor")
            .when(F.col("_b.tp") == 0, "the threshold never fires on a positive"))
    return out.withColumn("_r", F.coalesce("_b", "_f")).select(*by, "_r.*", note.alias("note"))


def regression_metrics(df: DataFrame, predicted: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R2 (null on a constant target) and the RMSE of predicting the mean."""
    err = F.col(predicted) - F.col(actual)
    agg = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(err * err).alias("_sq"), F.sum(F.abs(err)).alias("_abs"),
        F.var_pop(actual).alias("_var"))
    r2 = F.when(F.col("_var") > 0, round_half_up(1 - F.col("_sq") / (F.col("_var") * F.col("_n")), 4))
    return agg.select(
        *(by or []), round_half_up(F.sqrt(F.col("_sq") / F.col("_n")), 4).alias("rmse"),
        round_half_up(F.col("_abs") / F.col("_n"), 4).alias("mae"), r2.alias("r2"),
        round_half_up(F.sqrt("_var"), 4).alias("baseline_rmse"))


def calibration(df: DataFrame, prob: str, label: str, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """Per bin: rows, mean prediction and observed share."""
    clamped = F.least(F.lit(0.999999), F.greatest(F.lit(0.0), F.col(prob)))
    b = F.least(F.lit(bins - 1), F.floor(clamped * bins)).cast("int")
    agg = df.groupBy(*(by or []), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("_p"), F.avg(F.col(label).cast("double")).alias("_y"))
    return agg.select(*(by or []), "bin", "n", round_half_up("_p", 4).alias("mean_predicted"),
                      round_half_up("_y", 4).alias("observed"), (F.abs(F.col("_p") - F.col("_y")) * F.col("n")).alias("_e"))


def calibration_error(df: DataFrame, prob: str, label: str, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    return calibration(df, prob, label, by, bins).groupBy(*(by or [])).agg(
        round_half_up(F.sum("_e") / F.sum("n"), 4).alias("ece"))


def brier(df: DataFrame, prob: str, label: str, by: list[str] | None = None) -> DataFrame:
    e = F.col(prob) - F.col(label)
    return df.groupBy(*(by or [])).agg(round_half_up(F.avg(e * e), 4).alias("brier"))


def recall_at_k(df: DataFrame, score: str, label: str, tie: str, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """(by, k, recall): share of all positives among the k highest scores; null without positives."""
    by, most = by or [], max(ks)
    src = df.select(*by, score, tie, label)
    if by:
        best = topk(src, by, [f"-{score}", tie], most, "_n")
    else:
        best = position(src.orderBy(F.col(score).desc(), F.col(tie)).limit(most), [], [f"-{score}", tie], "_n",
                        limit=most)
    spec = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hits = best.select("*", spec).where(F.col("_n") <= F.col("k")).groupBy(*by, "k").agg(
        F.count_if(F.col(label) == 1).alias("_h"))
    total = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_p"))
    out = join_keyed(hits, total, by, "inner") if by else hits.withColumn("_p", total.scalar())
    return out.select(*by, "k", F.when(F.col("_p") > 0, round_half_up(F.col("_h") / F.col("_p"), 4)).alias("recall"))


def bootstrap_ci(df: DataFrame, score: str, label: str, resamples: int = RESAMPLES, alpha: float = ALPHA,
                 seed: int = 7) -> DataFrame:
    """Interval of the ROC AUC over resampled row counts.

    Rows are counted per (score, label); each replicate redraws every count as a Poisson variable, the
    standard distributed form of resampling with replacement. Work grows with distinct scores, not with rows.
    """
    cells = df.groupBy(F.col(score).cast("double").alias("score"), (F.col(label) == 1).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("c"))

    @F.pandas_udf("bigint")
    def redraw(c: pd.Series, h: pd.Series) -> pd.Series:
        mean, bits = c.to_numpy(np.float64), h.to_numpy(np.int64).view(np.uint64)
        u, out = (bits >> np.uint64(11)) * 2.0**-53, np.zeros(len(mean), np.int64)
        part = np.exp(-np.minimum(mean, 30))
        upto = part.copy()
        left = (mean <= 30) & (u >= upto)  # inverse distribution function for small counts
        for k in range(1, 200):
            if not left.any():
                break
            out[left] = k
            part = part * mean / k
            upto += part
            left &= u >= upto
        for i in np.flatnonzero(mean > 30):
            out[i] = np.random.default_rng(int(bits[i])).poisson(mean[i])
        return pd.Series(out)

    reps = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("rep"))
    drawn = reps.withColumn("w", redraw("c", F.xxhash64("score", "y", "rep", F.lit(seed)))).where("w > 0")
    counts = drawn.groupBy("rep", "score").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum("w").alias("n"))
    auc = auc_from_counts(counts, ["rep"], "auc").where("auc is not null")
    ranked = position(auc, [], ["auc", "rep"], "_i")
    ranked = ranked.withColumn("_n", auc.agg(F.count(F.lit(1))).scalar())
    at = [F.floor(F.lit(alpha / 2) * F.col("_n")) + 1, F.floor(F.lit(1 - alpha / 2) * F.col("_n")) + 1]
    out = ranked.agg(F.max(F.when(F.col("_i") == at[0], F.col("auc"))).alias("lower"),
                     F.max(F.when(F.col("_i") == at[1], F.col("auc"))).alias("upper"),
                     F.count(F.lit(1)).alias("resamples"))
    ok = F.col("resamples") >= 10
    return out.select(F.when(ok, round_half_up("lower", 4)).alias("lower"),
                      F.when(ok, round_half_up("upper", 4)).alias("upper"), "resamples")


# Fixed value: rows an evaluation needs before an interval is worth giving.
MIN_ROWS = 10


def deployment_gate(df: DataFrame) -> DataFrame:
    """Adds usable, beats_flag_all, not_inverted and reasons to rows with precision, base_precision, roc_auc, tp."""
    gain = round_half_up(F.col("precision") - F.col("base_precision"), 4)
    inverted = F.col("roc_auc").isNotNull() & (F.col("roc_auc") < 0.5)
    pct = lambda c: F.format_string("%.1f", F.col(c) * 100)
    reasons = F.array_compact(F.array(
        F.when(gain <= 0, F.concat(F.lit("precision "), pct("precision"), F.lit("% is no better than the "), pct("base_precision"),
                                   F.lit("% of alarming everywhere"))),
        F.when(inverted, F.concat(F.lit("unseen groups are ranked backwards (ROC AUC "), F.format_string("%.3f", round_half_up("roc_auc", 3)), F.lit(")"))),
        F.when(F.col("tp") == 0, F.lit("no true alarm at the chosen threshold")),
    ))
    return df.withColumns({"gain": gain, "usable": (gain > 0) & ~inverted, "beats_flag_all": gain > 0,
                           "not_inverted": ~inverted, "reasons": reasons})
