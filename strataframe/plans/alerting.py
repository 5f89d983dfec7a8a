"""Batch alerts over the event table: users are wells, values are scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.alerts import batch as B
from strataframe.functions.numeric import round_half_up
from strataframe.plans.frames import CATEGORIES, half_up_sql, pick, samples
from strataframe.plans.registry import query
from strataframe.sources.keyed import gaps

R4 = lambda e: half_up_sql(e, 4)


def scores(spark, sf):
    """Event values as scores in [0, 1] with a risk, a field and some evidence."""
    s = samples(spark, sf)
    return s.select(
        "event_id", "well_id", "ts", (F.col("value") / 500).alias("score"), pick(CATEGORIES, F.col("event_id") % 4).alias("risk_type"),
        (F.col("event_id") % 3).alias("evidence_n"), F.concat(F.lit("F"), F.col("well_id") % 3).alias("field"),
        F.concat(F.lit("G"), F.col("well_id") % 5).alias("formation"))


def rules(spark):
    return spark.createDataFrame(
        [("r1", "KICK", 0.2, 1, True, None, None), ("r2", "MUD_LOSS", 0.25, 0, True, "F1", None), ("r3", "STUCK_PIPE", 0.1, 1, True, None, "G2"),
         ("r4", "TORQUE_SPIKE", 0.0, 0, False, None, None)],
        "rule string, risk_type string, trigger_score double, min_evidence int, enabled boolean, field string, formation string")


def alerts(spark, sf):
    return B.rule_alerts(scores(spark, sf), rules(spark)).select("event_id", "well_id", "ts", "score", "risk_type", "rule")


SCORES = """s AS (SELECT event_id, user_id AS well_id, ts, value/500 AS score, CASE event_id % 4 WHEN 0 THEN 'MUD_LOSS' WHEN 1 THEN 'KICK' WHEN 2 THEN 'STUCK_PIPE' ELSE 'TORQUE_SPIKE' END AS risk_type,
 event_id % 3 AS evidence_n, user_id % 3 AS fld, user_id % 5 AS frm FROM events)"""
ALERTS = SCORES + """, al AS MATERIALIZED (SELECT event_id, well_id, ts, epoch_us(ts) AS us, score, risk_type, CASE risk_type WHEN 'KICK' THEN 'r1' WHEN 'MUD_LOSS' THEN 'r2' ELSE 'r3' END AS rule FROM s
 WHERE (risk_type='KICK' AND score >= 0.2 AND evidence_n >= 1) OR (risk_type='MUD_LOSS' AND score >= 0.25 AND fld=1) OR (risk_type='STUCK_PIPE' AND score >= 0.1 AND evidence_n >= 1 AND frm=2))"""


@query("t2_gap_report", """SELECT user_id AS well_id, epoch_us(p) AS from_us, epoch_us(ts) AS to_us FROM (
 SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE (epoch_us(ts)-epoch_us(p))/1e6 > 21600""")
def t2(spark, sf):
    return gaps(samples(spark, sf), ["well_id"], "ts", ["event_id"], 21_600).select(
        "well_id", F.unix_micros("gap_from").alias("from_us"), F.unix_micros("gap_to").alias("to_us"))


@query("t3_staleness", """SELECT user_id AS well_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)))/1e6 AS age_seconds,
 (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)))/1e6 > 18000 AS stale FROM events GROUP BY 1""")
def t3(spark, sf):
    s = samples(spark, sf)
    now = s.agg(F.max("ts")).scalar()
    return B.staleness(s, "well_id", "ts", now, 18_000).drop("last_ts")


@query("t3_hold_stale_alerts", f"""WITH {ALERTS} SELECT event_id FROM al WHERE well_id NOT IN (SELECT user_id FROM events GROUP BY 1
 HAVING (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)))/1e6 > 18000)""")
def t3b(spark, sf):
    s = samples(spark, sf)
    stale = B.staleness(s, "well_id", "ts", s.agg(F.max("ts")).scalar(), 18_000)
    return B.hold_stale(alerts(spark, sf), stale, "well_id").select("event_id")


@query("t4_tumbling_history", f"""SELECT user_id AS well_id, epoch_us(ts)//21600000000 AS w, count(*) AS n, {half_up_sql('avg(value)', 6)} AS mean_value, min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY 1, 2""")
def t4(spark, sf):
    d = B.downsample(samples(spark, sf), "well_id", "ts", "value", "6 hours")
    w = (F.unix_micros("window_start") / 21_600_000_000).cast("bigint")
    return d.select("well_id", w.alias("w"), "n", "mean_value", "min_value", "max_value")


@query("t4_sliding_window", f"""SELECT user_id AS well_id, epoch_us(ts)//10800000000 - k AS w, count(*) AS n, {half_up_sql('avg(value)', 6)} AS mean_value
FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2""")
def t4b(spark, sf):
    d = B.downsample(samples(spark, sf), "well_id", "ts", "value", "6 hours", "3 hours")
    w = (F.unix_micros("window_start") / 10_800_000_000).cast("bigint")
    return d.select("well_id", w.alias("w"), "n", "mean_value")


@query("t5_rule_alerts", f"WITH {ALERTS} SELECT event_id, rule, risk_type, score FROM al")
def t5(spark, sf):
    return alerts(spark, sf).select("event_id", "rule", "risk_type", "score")


SUPPRESSED = f"""WITH RECURSIVE {ALERTS},
ky AS MATERIALIZED (SELECT well_id, risk_type, us, min(event_id) AS event_id FROM al GROUP BY ALL),
nx AS MATERIALIZED (SELECT a.well_id, a.risk_type, a.us, b.us AS nxt FROM ky a ASOF JOIN ky b ON a.well_id=b.well_id AND a.risk_type=b.risk_type AND b.us >= a.us + CAST(__MIN__ AS BIGINT)*60000000),
ch AS (SELECT well_id, risk_type, min(us) AS us FROM ky GROUP BY 1, 2 UNION ALL SELECT ch.well_id, ch.risk_type, nx.nxt FROM ch JOIN nx ON nx.well_id=ch.well_id AND nx.risk_type=ch.risk_type AND nx.us=ch.us),
opened AS (SELECT event_id FROM ch JOIN ky USING (well_id, risk_type, us))"""


@query("t6_suppression", SUPPRESSED.replace("__MIN__", "4320") + " SELECT event_id, event_id IN (SELECT event_id FROM opened) AS opened FROM al")
def t6(spark, sf):
    return B.suppress(alerts(spark, sf), ["well_id", "risk_type"], "ts", ["event_id"], 4320).select("event_id", "opened")


FINDINGS = """, f AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 86400000000 THEN 1 ELSE 0 END AS st FROM al WINDOW w AS (PARTITION BY well_id ORDER BY us, event_id)),
g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY well_id ORDER BY us, event_id) AS BIGINT) AS finding FROM f)"""


@query("t7_consolidation", f"WITH {ALERTS} {FINDINGS} SELECT well_id, finding, min(us) AS first_us, max(us) AS last_us, count(*) AS alerts, max(score) AS top_score FROM g GROUP BY 1, 2")
def t7(spark, sf):
    c = B.consolidate(alerts(spark, sf), ["well_id"], "ts", ["event_id"], 1440)
    return c.select("well_id", "finding", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "alerts", "top_score")


_STATUS = ["OPEN", "ACKNOWLEDGED", "RESOLVED", "DISMISSED"]
_LOG = """l AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE event_id % 7 % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'RESOLVED' ELSE 'DISMISSED' END AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY us, event_id) AS previous FROM l)"""


def _log(spark, sf):
    return samples(spark, sf).select("well_id", "ts", "event_id", pick(_STATUS, F.col("event_id") % 7 % 4).alias("status"))


@query("t8_lifecycle", f"""WITH {_LOG} SELECT event_id, previous, status, CASE WHEN previous IS NULL THEN status='OPEN' WHEN previous='OPEN' THEN status IN ('ACKNOWLEDGED','RESOLVED','DISMISSED')
 WHEN previous='ACKNOWLEDGED' THEN status IN ('RESOLVED','DISMISSED') ELSE false END AS legal FROM p""")
def t8(spark, sf):
    return B.lifecycle(_log(spark, sf), "well_id", "ts", "status", ["event_id"]).select("event_id", "previous", "status", "legal")


@query("t8_latest_state", f"WITH {_LOG} SELECT user_id AS well_id, arg_max(status, us) AS status, max(us) AS since_us, count(*) AS transitions FROM l GROUP BY 1")
def t8b(spark, sf):
    s = B.latest_state(_log(spark, sf), "well_id", "ts", "status", ["event_id"])
    return s.select("well_id", "status", F.unix_micros("since").alias("since_us"), "transitions")


@query("t9_effectiveness", f"""WITH {ALERTS}, ev AS (SELECT event_id AS eid, user_id AS well_id, epoch_us(ts)/1e6 AS at FROM events WHERE event_type='error'),
a AS (SELECT rule, well_id, us/1e6 AS at FROM al),
x AS (SELECT rule, count(*) AS alerts, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ev WHERE ev.well_id=a.well_id AND ev.at BETWEEN a.at AND a.at + 86400)) AS useful FROM a GROUP BY rule),
y AS (SELECT rule, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM a WHERE a.rule=r.rule AND a.well_id=ev.well_id AND ev.at BETWEEN a.at AND a.at + 86400)) AS told
  FROM (SELECT DISTINCT rule FROM a) r, ev GROUP BY rule)
SELECT rule, alerts, useful AS useful_alerts, n AS events_n, told AS events_announced, {R4('useful/alerts')} AS precision, {R4('told/n')} AS recall FROM x JOIN y USING (rule)""")
def t9(spark, sf):
    sec = (F.unix_micros("ts") / 1e6).alias("at")
    a = alerts(spark, sf).select("event_id", "rule", "well_id", sec)
    ev = samples(spark, sf).where("event_type = 'error'").select(F.col("event_id").alias("eid"), "well_id", sec.alias("event_at"))
    return B.effectiveness(a, ev, ["well_id"], "at", "event_at", "eid", 86_400.0, "rule")


@query("t10_rate_of_change", f"""WITH {SCORES} SELECT event_id, {half_up_sql('delta', 6)} AS delta FROM (
 SELECT event_id, score - lag(score) OVER (PARTITION BY well_id ORDER BY ts, event_id) AS delta FROM s) WHERE delta >= 0.3""")
def t10(spark, sf):
    r = B.rate_alerts(scores(spark, sf), ["well_id"], ["ts", "event_id"], "score", 0.3)
    return r.select("event_id", round_half_up("delta", 6).alias("delta"))


@query("t10_cross_model_agreement", f"""WITH {SCORES} SELECT well_id, epoch_us(ts)//86400000000 AS day, count(DISTINCT risk_type) AS models, max(score) AS top_score FROM s WHERE score >= 0.1
GROUP BY 1, 2 HAVING count(DISTINCT risk_type) >= 2""")
def t10b(spark, sf):
    s = scores(spark, sf).withColumn("day", F.floor(F.unix_micros("ts") / 86_400_000_000))
    return B.agreement_alerts(s, ["well_id", "day"], "risk_type", "score", 0.1, 2)


@query("t11_look_ahead_projection", f"""SELECT event_id, greatest(0e0, 300 - value) AS metres_ahead, CASE WHEN k > 0 THEN {half_up_sql('greatest(0e0, 300 - value)/k', 6)} END AS hours_ahead
FROM (SELECT *, CAST(event_id % 20 AS DOUBLE) AS k FROM events)""")
def t11(spark, sf):
    s = samples(spark, sf).select("event_id", "value", F.lit(300.0).alias("target"), (F.col("event_id") % 20).cast("double").alias("rate"))
    return B.project_ahead(s, "value", "target", "rate").select("event_id", "metres_ahead", round_half_up("hours_ahead", 6).alias("hours_ahead"))


@query("t5_default_rules", """SELECT CASE WHEN score >= 0.45 THEN 'MUD_LOSS' ELSE '' END AS risk_type, count(*) AS n FROM (SELECT value/500 AS score FROM events) WHERE score >= 0.45 GROUP BY 1""")
def t5b(spark, sf):
    s = scores(spark, sf).withColumns({"risk_type": F.lit("MUD_LOSS"), "evidence_n": F.lit(1)})
    return B.rule_alerts(s, B.default_rules(spark)).groupBy("risk_type").agg(F.count(F.lit(1)).alias("n"))
