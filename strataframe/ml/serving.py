"""Scoring intervals with active models, behind a feature-version gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.ml.models import LogisticModel

DEFAULT_THRESHOLD = 0.5


def version_gate(model_version: str, name: str):
    """Reason not to score rows of another feature version; null when versions agree."""
    return F.when(F.col("feature_version") != model_version, F.concat(
        F.lit(f"model {name} was trained on feature set {model_version}, but these intervals carry "),
        F.col("feature_version"), F.lit(". Refusing to score across versions.")))


def score_intervals(df: DataFrame, models: dict[str, LogisticModel]) -> DataFrame:
    """Rows repeated per risk model with available, reason, raw_score, score, threshold and flagged.

    Scores are column expressions, so a batch of any size is one narrow stage.
    """
    parts = []
    for risk, m in models.items():
        t = m.threshold if m.threshold is not None else DEFAULT_THRESHOLD
        out = df.withColumns({"risk_type": F.lit(risk), "reason": version_gate(m.feature_version, risk)})
        ok = F.col("reason").isNull()
        parts.append(out.withColumns({
            "available": ok,
            "raw_score": F.when(ok, round_half_up(m.score(), 4)),
            "score": F.when(ok, round_half_up(m.calibrated(), 4)),
            "threshold": F.lit(float(t)),
            "flagged": F.when(ok, m.calibrated() >= t),
        }))
    return reduce(DataFrame.unionByName, parts)


def unavailable(spark, wanted: list[str], models: dict[str, LogisticModel]) -> DataFrame:
    """Risks asked for that have no active model."""
    rows = [(r, False, f"no active model for {r}") for r in wanted if r not in models]
    return spark.createDataFrame(rows, "risk_type string, available boolean, reason string")


def interval_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.where("available").groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.col("flagged")).alias("flagged"),
        round_half_up(F.max("score"), 4).alias("max_score"), round_half_up(F.avg("score"), 4).alias("mean_score"))
