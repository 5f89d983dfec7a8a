"""Risk catalogue and training rows derived from recorded events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.operators.joins import interval_join
from strataframe.operators.series import running

# Risk, kind, look-ahead m, trigger score, severity, least evidence, label margin m, positive weight.
RISKS = [
    ("MUD_LOSS", "classifier", 300.0, 0.45, "HIGH", 1, 90.0, 1.4),
    ("KICK", "classifier", 250.0, 0.5, "CRITICAL", 1, 75.0, 1.8),
    ("STUCK_PIPE", "classifier", 250.0, 0.4, "HIGH", 1, 70.0, 1.3),
    ("TORQUE_SPIKE", "classifier", 200.0, 0.45, "MEDIUM", 1, 50.0, 0.7),
    ("NPT", "regressor", 250.0, 0.5, "MEDIUM", 1, 60.0, None),
    ("FORMATION_RISK", "anomaly", 300.0, 0.6, "MEDIUM", 1, 60.0, None),
]
SECTION_RISK = ("CEMENTING_ISSUE", "classifier", 0.0, 0.45, "HIGH", 1, None, None)
RISK_COLUMNS = ("risk_type string, kind string, look_ahead double, trigger_score double, severity_level string, "
                "min_evidence int, margin double, positive_weight double")
NEGATIVE_RATIO = 0.15


def risk_table(spark: SparkSession, with_section: bool = False) -> DataFrame:
    return F.broadcast(spark.createDataFrame(RISKS + ([SECTION_RISK] if with_section else []), RISK_COLUMNS))


def per_risk(df: DataFrame, kinds: tuple[str, ...] = ("classifier", "regressor", "anomaly")) -> DataFrame:
    """Rows repeated for each catalogued risk of the given kinds, with risk_type, kind and margin."""
    risks = [F.struct(F.lit(r[0]).alias("risk_type"), F.lit(r[1]).alias("kind"), F.lit(r[6]).alias("margin"))
             for r in RISKS if r[1] in kinds]
    return df.select("*", F.explode(F.array(*risks)).alias("_risk")).select(*df.columns, "_risk.*")


def flagged_samples(samples: DataFrame, events: DataFrame) -> DataFrame:
    """(well_id, depth, risk_type, kind, hit, covered): is the depth in a window of the risk's own category, or of any.

    Samples and widened event windows of all risks go through one running maximum of window ends per (well, risk).
    """
    p = per_risk(samples.select("well_id", "depth")).select(
        "well_id", "risk_type", "kind", F.col("depth").alias("_at"), F.lit(1).alias("_side"), "depth")
    w = per_risk(events).select(
        "well_id", "risk_type", (F.col("start_md") - F.col("margin")).alias("_at"), F.lit(0).alias("_side"),
        (F.col("end_md") + F.col("margin")).alias("_any"),
        F.when(F.col("category") == F.col("risk_type"), F.col("end_md") + F.col("margin")).alias("_own"))
    run = running(p.unionByName(w, allowMissingColumns=True), ["well_id", "risk_type"], ["_at", "_side"],
                  {"_any_end": ("max", F.col("_any")), "_own_end": ("max", F.col("_own"))})
    return run.where(F.col("depth").isNotNull()).select(
        "well_id", "depth", "risk_type", "kind",
        F.coalesce(F.col("_own_end") >= F.col("depth"), F.lit(False)).alias("hit"),
        F.coalesce(F.col("_any_end") >= F.col("depth"), F.lit(False)).alias("covered"))


def training_rows(samples: DataFrame, events: DataFrame, ratio: float = NEGATIVE_RATIO, width: float = 250.0
                  ) -> DataFrame:
    """(well_id, depth, risk_type, label, target_value).

    Classifiers keep every hit and every n-th quiet depth; the regressor keeps all hits of any category with the hours
    of the first window that holds them and all quiet depths; the anomaly set keeps everything. events (well_id,
    event_id, category, start_md, end_md, npt_hours).
    """
    f = flagged_samples(samples, events)
    stride = 1 if ratio >= 1 else max(1, int(1 / ratio + 0.5))
    classifier, anomaly = F.col("kind") == "classifier", F.col("kind") == "anomaly"
    quiet = ~F.col("covered") & ~anomaly
    # Counting quiet depths in the same window layout spares a pass per kind of row.
    f = running(f, ["well_id", "risk_type"], ["depth"], {"_p": ("count", F.when(quiet, 1))})
    keep = (anomaly | (classifier & F.col("hit")) | ((F.col("kind") == "regressor") & F.col("covered"))
            | (quiet & (~classifier | ((F.col("_p") - 1) % stride == 0))))
    wide = per_risk(events, ("regressor",)).select(
        "well_id", "risk_type", "event_id", "npt_hours", (F.col("start_md") - F.col("margin")).alias("_lo"),
        (F.col("end_md") + F.col("margin")).alias("_hi"))
    key = ["well_id", "depth", "risk_type"]
    points = per_risk(samples.select("well_id", "depth"), ("regressor",)).select(*key)
    hours = interval_join(points, wide, ["well_id", "risk_type"], "depth", "_lo", "_hi", width).groupBy(*key).agg(
        F.min_by("npt_hours", "event_id").alias("_npt"))
    rows = f.where(keep).join(hours, key, "left")
    target = (F.when(quiet, 0.0)
              .when(F.col("kind") == "regressor", round_half_up(F.coalesce("_npt", F.lit(0.0)), 2)))
    label = F.when(anomaly, F.col("covered").cast("int")).when(quiet, 0).otherwise(1)
    return rows.select(*key, label.alias("label"), target.alias("target_value"))
