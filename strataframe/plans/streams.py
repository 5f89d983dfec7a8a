"""Streaming jobs over the event table in several deliveries, out of order; results equal their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.plans import alerting as A
from strataframe.plans.frames import CATEGORIES, half_up_sql, pick
from strataframe.plans.registry import query
from strataframe.session import fresh_path
from strataframe.sources.replay import record_deliveries, replay_stream
from strataframe.sources.tables import read_table, schema_of
from strataframe.streaming import jobs as J

DELIVERIES, DELAY, DELAY_MS = 6, "6 days", 6 * 86_400_000  # a delivery spans five days of the recorded thirty
ROWS_PER_FILE = 2_000_000
_RECORDED: dict[tuple, tuple[str, int]] = {}


def recorded(spark, sf, late: bool) -> tuple[str, int]:
    """Folder of the event table in six deliveries by time, and the files of a delivery; written once per application.

    Every eleventh event comes one delivery after its time, inside the delay; with `late` every hundred-and-first three after.
    """
    key = (spark.sparkContext.applicationId, sf, late)
    if key not in _RECORDED:
        events = read_table(spark, sf, "events")
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        low, high, n = events.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
        slot = F.floor((us - F.lit(low)) * F.lit(DELIVERIES) / F.lit(high - low + 1)) if n else F.lit(0)
        behind = F.when(F.lit(late) & (F.col("event_id") % 101 == 0), 3).when(F.col("event_id") % 11 == 0, 1).otherwise(0)
        path, files = fresh_path(spark, "deliveries"), max(1, -(-n // (DELIVERIES * ROWS_PER_FILE)))
        record_deliveries(events, F.least(F.lit(DELIVERIES - 1), slot + behind), DELIVERIES, path, files)
        _RECORDED[key] = path, files
    return _RECORDED[key]


# `closed` is the instant at which the watermark of a whole replay ends: what is later stays in state.
CLOSED = f"closed AS (SELECT (max(epoch_ms(ts)) - {DELAY_MS}) * 1000 AS us FROM events)"


def live(spark, sf, late: bool = False):
    path, files = recorded(spark, sf, late)
    return replay_stream(spark, path, schema_of("events"), files_per_trigger=files).select(
        F.col("user_id").alias("well_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


def live_scores(spark, sf):
    return live(spark, sf).select(
        "event_id", "well_id", "ts", (F.col("value") / 500).alias("score"), pick(CATEGORIES, F.col("event_id") % 4).alias("risk_type"),
        (F.col("event_id") % 3).alias("evidence_n"), F.concat(F.lit("F"), F.col("well_id") % 3).alias("field"),
        F.concat(F.lit("G"), F.col("well_id") % 5).alias("formation"))


def live_alerts(spark, sf):
    return J.alert_stream(live_scores(spark, sf), A.rules(spark)).select("event_id", "well_id", "ts", "score", "risk_type", "rule")


@query("t1_stream_dedupe", "SELECT DISTINCT user_id AS well_id, event_type FROM events")
def t1(spark, sf):
    s = J.dedupe_stream(live(spark, sf), ["well_id", "event_type"], "ts", "40 days")
    return J.drain(s, "dedupe").select("well_id", "event_type")


@query("t1_late_split", f"""WITH span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
delivered AS MATERIALIZED (SELECT event_id, epoch_us(ts) AS us, CAST(least({DELIVERIES - 1}, floor((epoch_us(ts) - lo) * {DELIVERIES} / (hi - lo + 1)::DOUBLE) +
  CASE WHEN event_id % 101 = 0 THEN 3 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS INT) AS delivery FROM events, span),
newest AS (SELECT a.delivery, max(b.us) AS us FROM (SELECT DISTINCT delivery FROM delivered) a JOIN delivered b ON b.delivery < a.delivery GROUP BY 1)
SELECT CASE WHEN d.us < n.us - {DELAY_MS * 1000} THEN 'late' ELSE 'accepted' END AS side, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM delivered d LEFT JOIN newest n USING (delivery) GROUP BY 1""")
def t1b(spark, sf):
    out = fresh_path(spark, "late")
    side = lambda name: lambda b, e: b.write.mode("overwrite").parquet(f"{out}/side={name}/epoch={e}")
    J.split_late(live(spark, sf, late=True), "ts", fresh_path(spark, "late-state"), side("accepted"), side("late"), DELAY_MS / 1000)
    return spark.read.parquet(out).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("t2_stream_gaps", f"""WITH {CLOSED} SELECT well_id, epoch_us(p) AS from_us, epoch_us(ts) AS to_us FROM (
 SELECT user_id AS well_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE (epoch_us(ts)-epoch_us(p))/1e6 > 21600 AND epoch_us(ts) < (SELECT us FROM closed)""")
def t2(spark, sf):
    return J.drain(J.gap_stream(live(spark, sf), ["well_id"], "ts", "event_id", 21_600, DELAY), "gaps").select(
        "well_id", F.unix_micros("gap_from").alias("from_us"), F.unix_micros("gap_to").alias("to_us"))


@query("t3_stream_staleness", f"""WITH {CLOSED}, s AS (
 SELECT user_id AS well_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
SELECT well_id, s.us AS last_us FROM s, closed c WHERE (later IS NULL OR later - s.us > 3600000000) AND s.us + 3600000000 < c.us""")
def t3(spark, sf):
    return J.drain(J.stale_stream(live(spark, sf), ["well_id"], "ts", DELAY, 3600), "stale").select("well_id", "last_us")


@query("t4_stream_history", f"""WITH {CLOSED} SELECT * FROM (
 SELECT user_id AS well_id, epoch_us(ts)//21600000000 AS w, count(*) AS n, {half_up_sql('avg(value)', 6)} AS mean_value FROM events GROUP BY 1, 2)
WHERE (w + 1)*21600000000 <= (SELECT us FROM closed)""")
def t4(spark, sf):
    d = J.drain(J.window_stream(live(spark, sf), "well_id", "ts", "value", "6 hours", watermark=DELAY), "history")
    return d.select("well_id", (F.unix_micros("window_start") / 21_600_000_000).cast("bigint").alias("w"), "n", "mean_value")


@query("t5_stream_alerts", f"WITH {A.ALERTS} SELECT event_id, rule, score FROM al")
def t5(spark, sf):
    return J.drain(live_alerts(spark, sf).select("event_id", "rule", "score"), "alerts")


@query("t6_stream_suppression", A.SUPPRESSED.replace("__MIN__", "4320")
       + f" SELECT event_id FROM opened JOIN al USING (event_id) WHERE al.us < (SELECT (max(epoch_ms(ts)) - {DELAY_MS}) * 1000 FROM al)")
def t6(spark, sf):
    s = J.suppress_stream(live_alerts(spark, sf), ["well_id", "risk_type"], "ts", "event_id", 4320, DELAY)
    return J.drain(s, "suppress").select("event_id")


@query("t7_stream_findings", f"""WITH {A.ALERTS} {A.FINDINGS.replace('us - lag(us) OVER w > 86400000000', 'us - lag(us) OVER w >= 86400000000')}
SELECT * FROM (SELECT well_id, min(us) AS first_us, count(*) AS alerts, max(score) AS top_score FROM g GROUP BY well_id, finding
 HAVING max(us) + 86400000000 <= (SELECT (max(epoch_ms(ts)) - {DELAY_MS}) * 1000 FROM al))""")
def t7(spark, sf):
    f = J.drain(J.findings_stream(live_alerts(spark, sf), "well_id", "ts", "24 hours", DELAY), "findings")
    return f.select("well_id", F.unix_micros("first_ts").alias("first_us"), "alerts", "top_score")


@query("t12_subscription", "SELECT user_id AS well_id, count(*) AS n FROM events WHERE user_id IN (3, 8, 46) GROUP BY 1")
def t12(spark, sf):
    out = fresh_path(spark, "subscription")
    J.subscribe(live(spark, sf), "well_id", [3, 8, 46], lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}"))
    return spark.read.parquet(out).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"))


_RATIO = half_up_sql("CASE WHEN count(value) OVER w >= 3 AND abs(median(value) OVER w) >= 1e-6 THEN value/(median(value) OVER w) ELSE 1 END", 4)


@query("t13_online_features", f"""WITH {CLOSED}, r AS (SELECT event_id, ts, {_RATIO} AS value_ratio
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT event_id, value_ratio FROM r WHERE epoch_us(ts) < (SELECT us FROM closed)""")
def t13(spark, sf):
    rows = J.online_features(live(spark, sf), ["well_id"], "ts", ["event_id"], ["value"], 20, J.trailing_ratios(["value"]),
                             "event_id bigint, value_ratio double", DELAY)
    return J.drain(rows, "online").select("event_id", round_half_up("value_ratio", 4).alias("value_ratio"))
