"""Series windows over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.operators import windows as W
from strataframe.operators.episodes import detect_episodes
from strataframe.operators.series import row_frames
from strataframe.plans.frames import half_up_sql, incidents, samples, scored, series, with_sql
from strataframe.plans.registry import query
from strataframe.sources.tables import read_table

R4 = lambda e: half_up_sql(e, 4)
KEY, ORDER = ["well_id"], ["pos"]
_TRAIL = "OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


def ratio_sql(col: str, frame: str = _TRAIL) -> str:
    return (f"CASE WHEN count({col}) {frame} >= 3 AND abs(median({col}) {frame}) >= 1e-6 "
            f"THEN {col}/(median({col}) {frame}) ELSE 1e0 END")


@query("w1_trailing_window", with_sql("series", f"""SELECT well_id, pos, count(quantity) {_TRAIL} AS n, {R4(f'avg(quantity) {_TRAIL}')} AS mean
FROM series"""))
def w1(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "quantity")
    out = row_frames(s, KEY, ORDER, lambda w: {
        "n": F.count("quantity").over(W.trailing(w)), "mean": round_half_up(F.avg("quantity").over(W.trailing(w)), 4)}, before=20)
    return out.select("well_id", "pos", "n", "mean")


@query("w2_local_ratio", with_sql("series", f"""SELECT well_id, pos, {R4(ratio_sql('quantity'))} AS quantity_ratio, {R4(ratio_sql('price'))} AS price_ratio,
 {R4(ratio_sql('discount'))} AS discount_ratio FROM series"""))
def w2(spark, sf):
    cols = ["quantity", "price", "discount"]
    out = W.local_ratios(series(spark, sf).select("well_id", "pos", *cols), KEY, ORDER, cols)
    return out.select("well_id", "pos", *[round_half_up(f"{c}_ratio", 4).alias(f"{c}_ratio") for c in cols])


_S12 = "OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@query("w3_trailing_slope", with_sql("series", f"""SELECT well_id, pos, CASE WHEN n12 >= 3 THEN {R4('s12*20')} ELSE 0 END AS trend,
 CASE WHEN n20 >= 4 THEN {R4('s20')} ELSE 0 END AS pit FROM (SELECT well_id, pos, count(quantity) {_S12} AS n12, count(quantity) {_TRAIL} AS n20,
 regr_slope(quantity, pos::DOUBLE) {_S12} AS s12, regr_slope(quantity, pos::DOUBLE) {_TRAIL} AS s20 FROM series)"""))
def w3(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "quantity")
    out = W.slopes(s, KEY, ORDER, {"trend": ("quantity", 12, 3, 20), "pit": ("quantity", 20, 4, 1)})
    return out.select("well_id", "pos", round_half_up("trend", 4).alias("trend"), round_half_up("pit", 4).alias("pit"))


@query("w4_trailing_deficit", with_sql("series", f"""SELECT well_id, pos, CASE WHEN count(quantity) {_TRAIL} >= 3 THEN median(quantity) {_TRAIL} - quantity ELSE 0 END AS deficit
FROM series"""))
def w4(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "quantity")
    return W.deficits(s, KEY, ORDER, ["quantity"]).select("well_id", "pos", F.col("quantity_deficit").alias("deficit"))


@query("w5_smoothing", with_sql("series", f"""SELECT well_id, pos, {R4('avg(quantity) OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS smoothed
FROM series"""))
def w5(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "quantity")
    return W.smoothed(s, KEY, ORDER, "quantity").select("well_id", "pos", round_half_up("smoothed", 4).alias("smoothed"))


@query("w6_forward_peak", with_sql("series", """SELECT well_id, pos, greatest(0, max(quantity) OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS peak
FROM series"""))
def w6(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "quantity")
    return W.forward_peaks(s, KEY, ORDER, "quantity", 16).drop("quantity")


@query("w7_stride_sample", with_sql("series", """SELECT well_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY pos) AS r FROM series WHERE flag <> 'R')
WHERE (r-1) % 7 = 0"""))
def w7(spark, sf):
    return W.stride_sample(series(spark, sf).where("flag <> 'R'").select("well_id", "pos"), KEY, ORDER, 0.15)


@query("w8_gap_cluster", with_sql("incidents", """, f AS (SELECT *, CASE WHEN start_md - lag(start_md) OVER w >= 220 OR lag(start_md) OVER w IS NULL THEN 1 ELSE 0 END AS s
 FROM incidents WINDOW w AS (PARTITION BY well_id ORDER BY start_md, event_id)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY well_id ORDER BY start_md, event_id) AS BIGINT) AS island FROM f)
SELECT event_id, well_id, island, CAST(floor((row_number() OVER (PARTITION BY well_id, island ORDER BY start_md, event_id) - 1)/4) AS BIGINT) AS bucket FROM i"""))
def w8(spark, sf):
    ev = incidents(spark, sf).select("event_id", "well_id", "start_md")
    return W.gap_cluster(ev, KEY, "start_md", ["event_id"], 220, 4).select("event_id", "well_id", "island", "bucket")


@query("w9_merge_intervals", with_sql("incidents", """, w AS (SELECT well_id, event_id, start_md - 60 AS lo, end_md + 60 AS hi FROM incidents),
b AS (SELECT *, max(hi) OVER (PARTITION BY well_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM w),
i AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR lo > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY well_id ORDER BY lo, event_id) AS BIGINT) AS island FROM b)
SELECT well_id, island, min(lo) AS lo, max(hi) AS hi, count(*) AS members FROM i GROUP BY 1, 2"""))
def w9(spark, sf):
    w = incidents(spark, sf).select("well_id", "event_id", (F.col("start_md") - 60).alias("lo"), (F.col("end_md") + 60).alias("hi"))
    return W.merge_intervals(w, KEY, "lo", "hi", ["event_id"])




@query("w10_episodes_fixed_hold", with_sql("series", """, c AS MATERIALIZED (SELECT well_id, pos, quantity FROM series WHERE quantity >= 45),
nx AS MATERIALIZED (SELECT a.well_id, a.pos, b.pos AS nxt FROM c a ASOF JOIN c b ON a.well_id=b.well_id AND b.pos >= a.pos + 9),
ch AS (SELECT well_id, min(pos) AS pos FROM c GROUP BY 1 UNION ALL SELECT ch.well_id, nx.nxt FROM ch JOIN nx ON nx.well_id=ch.well_id AND nx.pos=ch.pos)
SELECT well_id, pos, quantity FROM ch JOIN c USING (well_id, pos)""", recursive=True))
def w10(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "quantity")
    return detect_episodes(s, KEY, ORDER, "quantity", 45, 9, 9).select("well_id", "pos", "quantity")


@query("w10_episodes_variable_hold", with_sql("series", """, c AS MATERIALIZED (SELECT well_id, pos, quantity, CAST(floor(8 + quantity/50e0*34 + 0.5e0) AS BIGINT) AS hold FROM series WHERE quantity >= 40),
nx AS MATERIALIZED (SELECT a.well_id, a.pos, b.pos AS nxt FROM c a ASOF JOIN c b ON a.well_id=b.well_id AND b.pos >= a.pos + a.hold),
ch AS (SELECT well_id, min(pos) AS pos FROM c GROUP BY 1 UNION ALL SELECT ch.well_id, nx.nxt FROM ch JOIN nx ON nx.well_id=ch.well_id AND nx.pos=ch.pos)
SELECT well_id, pos, hold FROM ch JOIN c USING (well_id, pos)""", recursive=True))
def w10b(spark, sf):
    hold = F.floor(8 + F.col("quantity") / 50.0 * 34 + 0.5)
    s = series(spark, sf).select("well_id", "pos", "quantity", hold.alias("hold"))
    return detect_episodes(s, KEY, ORDER, "quantity", 40, F.col("hold"), 42).select("well_id", "pos", "hold")


@query("w11_survey_path", with_sql("series", f"""SELECT well_id, pos, {R4('sum(15*sin(radians(quantity))*cos(radians(a))) OVER w')} AS north_m,
 {R4('sum(15*sin(radians(quantity))*sin(radians(a))) OVER w')} AS east_m, {R4('depth*cos(radians(quantity))')} AS tvd_m,
 abs(quantity - coalesce(lag(quantity) OVER w, 0)) AS dogleg_deg FROM (SELECT *, CAST(order_id % 360 AS DOUBLE) AS a FROM series)
 WINDOW w AS (PARTITION BY well_id ORDER BY depth)"""))
def w11(spark, sf):
    s = series(spark, sf).select("well_id", "pos", F.col("depth").alias("md_m"), F.col("quantity").alias("inclination_deg"),
                                 (F.col("order_id") % 360).cast("double").alias("azimuth_deg"))
    return W.survey_path(s, KEY).select("well_id", "pos", *[round_half_up(c, 4).alias(c) for c in ("north_m", "east_m", "tvd_m")], "dogleg_deg")


@query("w12_average_rank", with_sql("scored", """SELECT doc_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2e0 AS avg_rank FROM scored"""))
def w12(spark, sf):
    return W.average_rank(scored(spark, sf), "score").select("doc_id", "avg_rank")


@query("w13_latest_n", """SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 31""")
def w13(spark, sf):
    return W.latest_n(samples(spark, sf), ["-ts", "-event_id"], 31).orderBy("ts", "event_id").select("event_id", "value")


@query("w13_latest_n_per_key", """SELECT user_id AS well_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""")
def w13b(spark, sf):
    return W.latest_n(samples(spark, sf).select("well_id", "ts", "event_id"), ["-ts", "-event_id"], 5, ["well_id"]).drop("ts")


@query("w14_latest_version", """WITH v AS (SELECT DISTINCT p_brand AS name, p_size % 3 AS a, p_size AS b, p_partkey % 12 AS c FROM part)
SELECT name, a || '.' || b || '.' || c AS version, row_number() OVER (PARTITION BY name ORDER BY a DESC, b DESC, c DESC) = 1 AS is_latest FROM v""")
def w14(spark, sf):
    v = read_table(spark, sf, "part").select(
        F.col("p_brand").alias("name"), F.concat_ws(".", F.col("p_size") % 3, "p_size", F.col("p_partkey") % 12).alias("version")).distinct()
    return W.latest_version(v)


@query("w15_top_fraction", with_sql("series", """SELECT well_id, pos, price FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY price DESC, pos) AS r,
 count(*) OVER (PARTITION BY well_id) AS n FROM series) WHERE r <= greatest(1, CAST(floor(n*0.01e0) AS BIGINT))"""))
def w15(spark, sf):
    return W.top_fraction(series(spark, sf).select("well_id", "pos", "price"), KEY, ["-price", "pos"], 0.01)


@query("w16_index_time", with_sql("series", """SELECT well_id, pos, epoch(TIMESTAMP '2026-01-01 00:00:00') + (row_number() OVER (PARTITION BY well_id ORDER BY pos) - 1)*90 AS epoch_s FROM series"""))
def w16(spark, sf):
    out = W.index_time(series(spark, sf).select("well_id", "pos"), KEY, ORDER, F.lit("2026-01-01 00:00:00").cast("timestamp"), 90)
    return out.select("well_id", "pos", F.unix_timestamp("ts").cast("double").alias("epoch_s"))
