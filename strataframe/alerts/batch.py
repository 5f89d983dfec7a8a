"""Batch alerting. The streaming module reuses these rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.features.labels import RISKS, SECTION_RISK
from strataframe.functions.numeric import round_half_up
from strataframe.operators.episodes import cooldown
from strataframe.operators.joins import exists_within
from strataframe.operators.series import row_frames
from strataframe.operators.windows import islands

# Minutes between alerts of one key, seconds until a silent series counts as stale, allowed moves.
COOLDOWN_MIN, STALE_SECONDS = 180, 180
MOVES = {"OPEN": ["ACKNOWLEDGED", "RESOLVED", "DISMISSED"], "ACKNOWLEDGED": ["RESOLVED", "DISMISSED"],
         "RESOLVED": [], "DISMISSED": []}


def default_rules(spark: SparkSession) -> DataFrame:
    """One enabled look-ahead rule per catalogued risk."""
    rows = [(f"{r[0]} look-ahead", r[0], r[2], r[3], r[4], r[5], COOLDOWN_MIN, True, None, None)
            for r in [*RISKS, SECTION_RISK]]
    return F.broadcast(spark.createDataFrame(
        rows, "rule string, risk_type string, look_ahead double, trigger_score double, severity_level string, "
              "min_evidence int, cooldown_min int, enabled boolean, field string, formation string"))


def rule_alerts(scores: DataFrame, rules: DataFrame, field: str = "field", formation: str = "formation") -> DataFrame:
    """Scores that trip an enabled rule of their risk: score and evidence reach the rule's limits, and the rule's field
    and formation, when set, match."""
    r = rules.where("enabled").withColumnsRenamed({"field": "_rf", "formation": "_rg"})
    place = (F.col("_rf").isNull() | (F.col("_rf") == F.col(field))) & (
        F.col("_rg").isNull() | (F.col("_rg") == F.col(formation)))
    on = scores.join(r, "risk_type").where(
        (F.col("score") >= F.col("trigger_score")) & (F.col("evidence_n") >= F.col("min_evidence")) & place)
    return on.drop("_rf", "_rg")


def dedupe_key(well: str, risk: str, window: Column) -> Column:
    return F.concat_ws("+", F.col(well).cast("string"), F.col(risk), window.cast("string"))


def suppress(alerts: DataFrame, key: list[str], ts: str, tie: list[str], minutes: float = COOLDOWN_MIN) -> DataFrame:
    """Adds `opened`: an alert opens unless one of its key opened within the cooldown."""
    return cooldown(alerts, key, ts, minutes, tie)


def consolidate(alerts: DataFrame, key: list[str], ts: str, tie: list[str], gap_minutes: float) -> DataFrame:
    """Runs of alerts with pauses of at most `gap_minutes` as one finding: first, last, count, top score."""
    gap = gap_minutes * 60_000_000
    run = islands(alerts, key, [ts, *tie],
                  lambda w: F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) > gap, "finding")
    return run.groupBy(*key, "finding").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                                            F.count(F.lit(1)).alias("alerts"), F.max("score").alias("top_score"))


def staleness(samples: DataFrame, key: str, ts: str, now: Column, seconds: float = STALE_SECONDS) -> DataFrame:
    """Seconds since the last sample per key and whether that makes it stale; alerts of stale keys are held back."""
    last = samples.groupBy(key).agg(F.max(ts).alias("last_ts"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_ts"))) / F.lit(1e6)
    return last.withColumn("age_seconds", age).withColumn("stale", F.col("age_seconds") > seconds)


def hold_stale(alerts: DataFrame, stale: DataFrame, key: str) -> DataFrame:
    return alerts.join(stale.where("stale").select(key), key, "left_anti")


def downsample(samples: DataFrame, key: str, ts: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Window averages per key: tumbling history, or a sliding live view with `slide`."""
    win = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    out = samples.groupBy(key, win.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("_a"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                      round_half_up("_a", 6).alias("mean_value"), "min_value", "max_value")


def _allowed(before: Column, after: Column) -> Column:
    ok = F.lit(False)
    for src, dst in MOVES.items():
        ok = ok | ((before == src) & after.isin(dst)) if dst else ok
    return F.when(before.isNull(), after == "OPEN").otherwise(ok)


def lifecycle(log: DataFrame, key: str, ts: str, status: str, tie: list[str]) -> DataFrame:
    """Transition log with `previous` and `legal`: may this status follow the one logged before it."""
    out = row_frames(log, [key], [ts, *tie], lambda w: {"previous": F.lag(status).over(w)}, before=1)
    return out.withColumn("legal", _allowed(F.col("previous"), F.col(status)))


def latest_state(log: DataFrame, key: str, ts: str, status: str, tie: list[str]) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(status, F.struct(ts, *tie)).alias("status"), F.max(ts).alias("since"),
                                F.count(F.lit(1)).alias("transitions"))


def effectiveness(alerts: DataFrame, events: DataFrame, by: list[str], at: str, event_at: str, event_id: str,
                  ahead: float, rule: str) -> DataFrame:
    """Per rule: alerts, alerts followed by an event within `ahead`, precision, and events announced by an alert.

    Recall counts all of `events` for each rule, also those of places where the rule never fired.
    """
    half = ahead / 2
    a = alerts.withColumn("_mid", F.col(at) + half)
    hit = exists_within(a, events, by, "_mid", event_at, half, "useful")
    per = hit.groupBy(rule).agg(F.count(F.lit(1)).alias("alerts"), F.sum("useful").alias("useful_alerts"))
    reach = alerts.select(rule, *by).distinct().join(events, by)
    told = exists_within(reach.withColumn("_back", F.col(event_at) - half), alerts.select(rule, *by, at), [rule, *by],
                         "_back", at, half, "announced")
    ev = told.groupBy(rule).agg(F.sum("announced").alias("events_announced"))
    out = per.join(ev, rule, "left").fillna(0, ["events_announced"])
    out = out.withColumn("events_n", events.agg(F.count(F.lit(1))).scalar())
    return out.withColumns({
        "precision": round_half_up(F.col("useful_alerts") / F.col("alerts"), 4),
        "recall": F.when(F.col("events_n") > 0, round_half_up(F.col("events_announced") / F.col("events_n"), 4)),
    })


def rate_alerts(scores: DataFrame, by: list[str], order: list[str], score: str, rise: float) -> DataFrame:
    """Rows whose score rose by at least `rise` since the row before."""
    out = row_frames(scores, by, order, lambda w: {"delta": F.col(score) - F.lag(score).over(w)}, before=1)
    return out.where(F.col("delta") >= rise)


def agreement_alerts(scores: DataFrame, by: list[str], model: str, score: str, trigger: float, least: int) -> DataFrame:
    """Keys on which at least `least` different models reach `trigger`."""
    up = scores.where(F.col(score) >= trigger).groupBy(*by, model).agg(F.max(score).alias("_s"))
    out = up.groupBy(*by).agg(F.count(F.lit(1)).alias("models"), F.max("_s").alias("top_score"))
    return out.where(F.col("models") >= least)


def project_ahead(df: DataFrame, at: str, target: str, rate: str) -> DataFrame:
    """Metres and hours until a boundary ahead at the current rate; hours are null when nothing moves."""
    ahead = F.greatest(F.lit(0.0), F.col(target) - F.col(at))
    return df.withColumns({"metres_ahead": ahead, "hours_ahead": F.when(F.col(rate) > 0, ahead / F.col(rate))})
