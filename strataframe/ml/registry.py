"""Model registry as a table: version bumps, one active version per model, history, freshness, headlines."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators.series import position, row_frames, running


def next_version(version: Column, previous_at: Column, trained_at: Column) -> Column:
    """Another month bumps the first number, another day the second, the same day the third; first is 1.0.0."""
    p = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    month = F.date_format(trained_at, "yyyy-MM") != F.date_format(previous_at, "yyyy-MM")
    day = F.to_date(trained_at) != F.to_date(previous_at)
    bumped = (F.when(month, F.format_string("%d.0.0", p[0] + 1))
              .when(day, F.format_string("%d.%d.0", p[0], p[1] + 1))
              .otherwise(F.format_string("%d.%d.%d", p[0], p[1], p[2] + 1)))
    return F.when(version.isNull(), F.lit("1.0.0")).otherwise(bumped)


def version_history(df: DataFrame, name: str, trained_at: str, tie: list[str]) -> DataFrame:
    """Versions for a whole training history at once: the same bumps as `next_version`, by running counts."""
    order = [trained_at, *tie]

    def flags(w):
        prev = F.lag(trained_at).over(w)
        month = prev.isNull() | (F.date_format(trained_at, "yyyy-MM") != F.date_format(prev, "yyyy-MM"))
        return {"_m": month.cast("bigint"), "_d": (~month & (F.to_date(trained_at) != F.to_date(prev))).cast("bigint")}

    out = row_frames(df, [name], order, flags, before=1)
    out = running(out, [name], order, {"major": ("sum", F.col("_m"))})
    out = running(out, [name, "major"], order, {"minor": ("sum", F.coalesce("_d", F.lit(0)))})
    out = position(out, [name, "major", "minor"], order, "_p")
    return out.withColumn("version", F.concat_ws(".", "major", "minor", F.col("_p") - 1)).drop(
        "_m", "_d", "_p", "major", "minor")


def register_model(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry with the new rows appended under their next version.

    registry and new have (id, name, risk_type, trained_at, activate, ...); `is_active` ends up on one version per
    (name, risk_type): the newest row that asked to be activated.
    """
    latest = registry.groupBy("name").agg(F.max_by(F.struct("version", "trained_at"), "id").alias("_l"))
    joined = new.join(latest, "name", "left")
    version = next_version(F.col("_l.version"), F.col("_l.trained_at"), F.col("trained_at"))
    rows = joined.withColumn("version", version).drop("_l")
    return single_active(registry.unionByName(rows, allowMissingColumns=True))


def single_active(registry: DataFrame) -> DataFrame:
    top = registry.where("activate").groupBy("name", "risk_type").agg(F.max("id").alias("_top"))
    out = registry.join(top, ["name", "risk_type"], "left")
    return out.withColumn("is_active", F.coalesce(F.col("id") == F.col("_top"), F.lit(False))).drop("_top")


def set_active(registry: DataFrame, name: str, version: str) -> DataFrame:
    """Make one version the active one of its name and risk."""
    chosen = (F.col("name") == name) & (F.col("version") == version)
    risk = registry.where(chosen).select("risk_type").limit(1).scalar()
    same = (F.col("name") == name) & (F.col("risk_type") == risk)
    return registry.withColumn("is_active", F.when(same, chosen).otherwise(F.col("is_active")))


def history(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") == name).orderBy(F.col("id").desc())


def freshness(training: DataFrame, row: str, loaded: str) -> DataFrame:
    """Feature version of the newest training row against the loaded one."""
    out = training.agg(F.max_by("feature_version", row).alias("current_version"))
    stale = F.col("current_version").isNotNull() & (F.col("current_version") != loaded)
    why = F.concat(F.lit("training rows are at "), F.col("current_version"), F.lit(f" but the extractor emits {loaded}"))
    return out.withColumns({"loaded_version": F.lit(loaded), "stale": stale, "stale_reason": F.when(stale, why)})


def describe_models(registry: DataFrame) -> DataFrame:
    """Headline per model: AUC on unseen groups, RMSE against the baseline, or the stored verdict."""
    headline = (
        F.when(F.col("roc_auc").isNotNull(), F.concat(
            F.lit("held-out ROC AUC "), F.format_string("%.4f", "roc_auc"), F.lit(" on "),
            F.col("groups").cast("string"), F.lit(" unseen wells")))
        .when(F.col("kind") == "regressor", F.concat(
            F.lit("held-out RMSE "), F.format_string("%.4f", "rmse"), F.lit("h vs "),
            F.format_string("%.4f", "baseline_rmse"), F.lit("h baseline")))
        .otherwise(F.col("verdict")))
    return registry.withColumn("headline", headline)


def model_json(model) -> str:
    return json.dumps(asdict(model))


def model_from_json(text: str):
    from strataframe.ml.models import LogisticModel, Platt

    d = json.loads(text)
    cal = d.pop("calibrator")
    return LogisticModel(**d, calibrator=Platt(**cal) if cal else None)
