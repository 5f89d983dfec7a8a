"""Neighbour ranking, similarity, clusters and fixed-weight risk scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.correlation import offsets as O
from strataframe.correlation import scoring as C
from strataframe.functions.numeric import round_half_up
from strataframe.plans.frames import half_up_sql, incidents, places, series, tops, with_sql
from strataframe.plans.registry import query
from strataframe.plans.scalars import along_sql, bearing_sql, cross_sql, hav_sql

R4 = lambda e: half_up_sql(e, 4)


def _targets(spark, sf):
    return places(spark, sf).select("place_id", "lat", "lng", ((F.col("place_id") * 53) % 2500 + 200).cast("double").alias("depth"))


def _rank(spark, sf, strategy):
    t = tops(spark, sf).withColumnRenamed("well_id", "place_id")
    ev = incidents(spark, sf).select(F.col("well_id").alias("place_id"), "event_id", F.col("start_md").alias("event_depth"))
    spec = O.OffsetSpec(strategy=strategy, radius_km=2500.0, limit=12, tolerance=120.0)
    out = O.rank_offsets(_targets(spark, sf), places(spark, sf), t, ev, spec)
    near = F.transform("nearby_events", lambda e: e["event_id"].cast("string"))
    return out.drop("depth").withColumn("nearby_events", F.coalesce(F.array_join(near, ","), F.lit("")))


def rank_sql(strategy: str) -> str:
    w = O.STRATEGY[strategy]
    sim = ("CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CASE WHEN greatest(abs({a}), abs({b})) = 0 THEN 1 "
           "ELSE greatest(0, 1 - abs({a}-{b})/greatest(abs({a}), abs({b}))) END END")
    pp, fg = sim.format(a="tm.pp_gradient", b="om.pp_gradient"), sim.format(a="tm.fg_gradient", b="om.fg_gradient")
    pick = """(SELECT t.place_id, t.{o} AS who, arg_max(p.formation, p.base_md) FILTER (WHERE p.base_md <= t.depth) AS f1, arg_min(p.formation, p.base_md) AS f0,
 arg_max(p, p.base_md) FILTER (WHERE p.base_md <= t.depth) AS r1, arg_min(p, p.base_md) AS r0 FROM {src} t JOIN tops p ON p.well_id=t.{o} GROUP BY ALL)"""
    return with_sql("places tops incidents", f""", targets AS (SELECT place_id, lat, lng, CAST((place_id*53) % 2500 + 200 AS DOUBLE) AS depth FROM places),
pairs AS (SELECT a.place_id, a.depth, b.place_id AS offset_id, {hav_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS km,
  {bearing_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS brg FROM targets a JOIN places b ON a.place_id <> b.place_id
  AND {hav_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 2500),
own AS (SELECT place_id, coalesce(r1, r0) AS m FROM {pick.format(o='place_id', src='targets')}),
away AS (SELECT place_id, who AS offset_id, coalesce(r1, r0) AS m FROM {pick.format(o='offset_id', src='pairs')}),
near AS (SELECT p.place_id, p.offset_id, i.event_id, abs(i.start_md - p.depth) AS d FROM pairs p JOIN incidents i ON i.well_id=p.offset_id
  AND abs(i.start_md - p.depth) <= 360),
trouble AS (SELECT place_id, offset_id, count(*) FILTER (WHERE d <= 240) AS n,
  array_to_string(list_slice(list(CAST(event_id AS VARCHAR) ORDER BY d, event_id), 1, 6), ',') AS evs FROM near GROUP BY 1, 2),
s AS (SELECT p.place_id, p.offset_id, km, brg, tm.formation AS tf, om.formation AS cf, coalesce(n, 0) AS n, coalesce(evs, '') AS evs,
  CASE WHEN abs(tm.base_md - om.base_md) > 120 THEN 0 ELSE 1 - abs(tm.base_md - om.base_md)/120 END AS deep,
  CASE WHEN {pp} IS NULL AND {fg} IS NULL THEN NULL ELSE (coalesce({pp}, 0) + coalesce({fg}, 0))
    /(CASE WHEN {pp} IS NULL THEN 0 ELSE 1 END + CASE WHEN {fg} IS NULL THEN 0 ELSE 1 END) END AS press
  FROM pairs p JOIN (SELECT place_id, m AS tm FROM own) USING (place_id) JOIN (SELECT place_id, offset_id, m AS om FROM away) USING (place_id, offset_id)
  LEFT JOIN trouble USING (place_id, offset_id)),
z AS (SELECT *, CASE WHEN tf = cf THEN 0.5e0 ELSE 0e0 END + coalesce(press, 0)*{w['pressure']}e0 + coalesce(deep, 0)*{w['depth']}e0 AS score0 FROM s),
o AS (SELECT place_id, offset_id, {half_up_sql('km', 2)} AS distance_km, {half_up_sql('brg', 1)} AS bearing_deg,
  {R4('least(1e0, score0 + least(0.15e0, n*0.05e0))')} AS score, {R4('score0')} AS geology_score, tf = cf AS same_formation,
  tf AS target_formation, cf AS offset_formation, {R4('deep')} AS depth_match, {R4('press')} AS pressure_match, n AS trouble_nearby, evs AS nearby_events FROM z)
SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, distance_km, offset_id) AS rank FROM o
QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY score DESC, distance_km, offset_id) <= 12""")


@query("c1_rank_offsets_pressure", rank_sql("pressure"))
def c1(spark, sf):
    return _rank(spark, sf, "pressure")


@query("c1_rank_offsets_depth", rank_sql("depth"))
def c1b(spark, sf):
    return _rank(spark, sf, "depth")


_PATHS = ["Directional build", "Hold tangent", "S-shaped", "Vertical"]


def _similar(spark, sf):
    n = incidents(spark, sf).groupBy(F.col("well_id").alias("place_id")).agg(F.count(F.lit(1)).alias("events_n"))
    p, x = places(spark, sf), F.col("place_id")
    path = F.element_at(F.array(*[F.lit(v) for v in _PATHS]), (x % 4 + 1).cast("int"))
    return p.join(n, "place_id", "left").select(
        "place_id", (x * 13 % 80 / 10.0).alias("distance_km"), F.concat(F.lit("Formation "), F.when(x % 3 == 0, "X").otherwise("Y")).alias("formation"),
        path.alias("trajectory_text"), (x * 17 % 3000).cast("double").alias("current_depth"), (x * 17 % 3000 + 500).cast("double").alias("total_depth"),
        (x * 7 % 100).cast("double").alias("similarity"), "events_n")


_SIM = ["incidents", "places"]
_SIM_CTE = """, sim AS (SELECT place_id, (place_id*13 % 80)/10e0 AS km, place_id % 3 = 0 AS isx, coalesce(n, 0) AS n,
 CASE place_id % 4 WHEN 0 THEN 0.8e0 WHEN 1 THEN 0.65e0 WHEN 2 THEN 0.65e0 ELSE 0.3e0 END AS tr FROM places LEFT JOIN
 (SELECT well_id, count(*) AS n FROM incidents GROUP BY 1) i ON i.well_id=place_id),
f AS (SELECT *, greatest(0, least(1, 1 - km/5)) AS f1, CASE WHEN isx THEN 1e0 ELSE 0e0 END AS f2, tr AS f3, (place_id*17 % 3000)/4000e0 AS f4,
 (place_id*17 % 3000 + 500)/4000e0 AS f5, (place_id*7 % 100)/100e0 AS f6, greatest(0, least(1, n/5e0)) AS f7 FROM sim)"""
_DIST = "sqrt(" + " + ".join(f"(f.f{i}-{{c}}.f{i})*(f.f{i}-{{c}}.f{i})" for i in range(1, 8)) + ")"


@query("c2_similarity_rank", with_sql(_SIM, _SIM_CTE + f""", a AS (SELECT * FROM f WHERE place_id = 5)
SELECT f.place_id, floor(greatest(0, least(100, (1 - {_DIST.format(c='a')}/2.2e0)*100)) + 0.5e0) AS model_similarity,
 CASE WHEN f.isx = a.isx THEN 'same formation' ELSE 'nearby correlated formation' END || ' | ' || printf('%.1f', f.km) || ' km from active well | ' ||
 f.n || ' indexed operational events | trajectory score ' || printf('%.2f', f.tr) AS explanation FROM f, a WHERE f.place_id <> 5"""))
def c2(spark, sf):
    return C.similarity_rank(_similar(spark, sf), 5).withColumn("explanation", F.array_join("explanation", " | "))


def kmeans_sql(k: int, iters: int) -> str:
    dist = _DIST
    avg = ", ".join(f"avg(f{i}) AS f{i}" for i in range(1, 8))
    cols = ", ".join(f"f{i}" for i in range(1, 8))
    sql = f", c0 AS (SELECT row_number() OVER (ORDER BY km, place_id) AS cl, {cols} FROM f QUALIFY row_number() OVER (ORDER BY km, place_id) <= {k})"
    for i in range(iters):
        c = f"c{i}"
        sql += f""", a{i} AS (SELECT f.*, arg_min({c}.cl, {{k: {dist.format(c=c)}, c: {c}.cl}}) AS cl, min({dist.format(c=c)}) AS d FROM f, {c} GROUP BY ALL)"""
        prior = ", ".join(f"coalesce(n.f{j}, o.f{j}) AS f{j}" for j in range(1, 8))
        sql += f", c{i+1} AS (SELECT o.cl, {prior} FROM {c} o LEFT JOIN (SELECT cl, {avg} FROM a{i} GROUP BY cl) n USING (cl))"
    return with_sql(_SIM, _SIM_CTE + sql + f" SELECT place_id, cl AS cluster, {half_up_sql('d', 6)} AS distance FROM a{iters-1}")


@query("c3_kmeans_fixed", kmeans_sql(3, 4))
def c3(spark, sf):
    pts = C.place_features(_similar(spark, sf))
    out = C.kmeans_fixed(pts, "place_id", C.FEATURES, 3, 4, ["distance_km", "place_id"])
    return out.withColumn("distance", round_half_up("distance", 6))


def _points(spark, sf):
    """Every line item is a point to score, its channels standing in for live telemetry."""
    return series(spark, sf).select(
        (F.col("well_id") * 10_000_000 + F.col("pos")).alias("point_id"), "well_id", "depth",
        F.concat(F.lit("Formation "), F.when(F.col("line_no") % 2 == 0, "X").otherwise("Y")).alias("formation"),
        (17 + F.col("discount") * 80).alias("torque"), (21 - F.col("tax") * 100).alias("rop"),
        (2850 + F.col("price") / 200).alias("pressure"), (1.1 + F.col("discount") / 2).alias("mud_weight"))


def _risk_events(spark, sf):
    sev = F.when(F.col("severity") <= 1, "Low").when(F.col("severity") <= 3, "Medium").when(F.col("severity") <= 4, "High").otherwise("None")
    return incidents(spark, sf).select("well_id", "event_id", "event_type", sev.alias("severity"), F.col("start_md").alias("event_depth"))


_CLAMP = lambda e, hi: f"greatest(0e0, least({hi}e0, {e}))"


def risk_sql(tail: str) -> str:
    vals = {
        "eventDensity": _CLAMP("coalesce(w, 0)/100e0/2.5e0", 1.5), "torque": _CLAMP("(torque-17)/8", 1.6),
        "ropDrop": _CLAMP("(21-rop)/8", 1.4), "pressureRise": _CLAMP("(pressure-2850)/420", 1.4),
        "mudWeight": _CLAMP("(mud_weight-1.1e0)/0.08e0", 1.4), "trajectory": "0.65e0",
        "formationX": "CASE WHEN isx THEN 1e0 ELSE 0e0 END", "proximity": f"coalesce({_CLAMP('1 - nearest/160', 1)}, 0)"}
    z = "CASE r " + " ".join(
        f"WHEN '{r}' THEN {C.INTERCEPTS[r]}e0 + " + " + ".join(f"({vals[f]})*({w}e0)" for f, w in C.WEIGHTS[r].items())
        for r in C.INTERCEPTS) + " END"
    types = ", ".join(f"('{r}', '{e}')" for r, es in C.EVIDENCE.items() for e in es)
    risks = "[" + ", ".join(f"'{r}'" for r in C.INTERCEPTS) + "]"
    return with_sql("series incidents", f""", pts AS (SELECT well_id*10000000+pos AS point_id, well_id, depth, line_no % 2 = 0 AS isx, 17 + discount*80 AS torque,
 21 - tax*100 AS rop, 2850 + price/200 AS pressure, 1.1e0 + discount/2 AS mud_weight FROM series),
g AS (SELECT *, unnest({risks}) AS r FROM pts),
ei AS (SELECT i.*, r FROM incidents i JOIN (VALUES {types}) t(r, kind) ON kind=event_type),
n AS (SELECT point_id, g.r, abs(i.start_md - depth) AS d, CASE WHEN severity <= 1 THEN 25 WHEN severity <= 3 THEN 55 WHEN severity <= 4 THEN 90 ELSE 35 END AS w
 FROM g JOIN ei i ON i.well_id=g.well_id AND i.r=g.r AND i.start_md BETWEEN depth-120 AND depth+160
 QUALIFY row_number() OVER (PARTITION BY point_id, g.r ORDER BY abs(i.start_md - depth),
   CASE WHEN severity <= 1 THEN 'Low' WHEN severity <= 3 THEN 'Medium' WHEN severity <= 4 THEN 'High' ELSE 'None' END DESC, event_id) <= 6),
e AS (SELECT point_id, r, sum(w) AS w, min(d) AS nearest, count(*) AS evidence_n FROM n GROUP BY 1, 2),
zz AS (SELECT g.*, coalesce(evidence_n, 0) AS evidence_n, {half_up_sql(z, 9)} AS z FROM g LEFT JOIN e USING (point_id, r)),
sc AS (SELECT point_id, r AS risk_type, floor(1/(1+exp(-z))*100 + 0.5e0) AS score, evidence_n, greatest(0e0, depth-25) AS from_m, depth+125 AS to_m FROM zz),
risk AS (SELECT *, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS level FROM sc) {tail}""")


def scores(spark, sf):
    return C.heuristic_risk(_points(spark, sf), _risk_events(spark, sf), "point_id", ["well_id"])


@query("c4_heuristic_risk", risk_sql("SELECT point_id, risk_type, score, level, evidence_n, from_m, to_m FROM risk"))
def c4(spark, sf):
    return scores(spark, sf)


@query("c5_top_alert", risk_sql("""SELECT point_id, risk_type, score, level, score >= 40 AS active, risk_type || ' risk ' || CAST(score AS BIGINT) || '% near ' ||
 CAST(to_m - 125 AS BIGINT) || '-' || CAST(to_m AS BIGINT) || ' m' AS message FROM risk
 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY score DESC, risk_type) = 1"""))
def c5(spark, sf):
    return C.top_alert(scores(spark, sf), "point_id").select("point_id", "risk_type", "score", "level", "active", "message")


_ADVICE = "CASE risk_type " + " ".join(f"WHEN '{r}' THEN '{a[0]}'" for r, a in C.ADVICE.items()) + " END"


@query("c5_current_alerts", risk_sql(f"SELECT point_id, risk_type, score, CAST(3 AS INTEGER) AS n_advice, {_ADVICE} AS first_advice FROM risk WHERE score >= 40"))
def c5b(spark, sf):
    return C.current_alerts(scores(spark, sf)).select("point_id", "risk_type", "score", F.size("recommendations").alias("n_advice"),
                                                      F.get("recommendations", F.lit(0)).alias("first_advice"))


@query("c6_evidence_map", with_sql("incidents", "SELECT event_id, r AS risk_type FROM incidents, unnest([" + ", ".join(f"'{r}'" for r in C.EVIDENCE) + "]) t(r) WHERE "
       + " OR ".join(f"(r='{r}' AND event_type IN ({', '.join(repr(e) for e in es)}))" for r, es in C.EVIDENCE.items())))
def c6(spark, sf):
    return C.evidence(incidents(spark, sf)).select("event_id", "risk_type")


@query("c7_compare_programs", with_sql("tops", f"""SELECT a.well_id AS place_id, b.well_id AS offset_id, a.formation, b.base_md - a.base_md AS diff_base_md, {R4('b.pp_ppg - a.pp_ppg')} AS diff_pp_ppg
FROM tops a JOIN tops b ON a.formation=b.formation AND a.well_id=5 AND b.well_id <> 5"""))
def c7(spark, sf):
    t = tops(spark, sf).withColumnRenamed("well_id", "place_id").select("place_id", "formation", "base_md", "pp_ppg")
    out = O.compare_programs(t.where("place_id = 5"), t, ["formation"], ["base_md", "pp_ppg"])
    return out.select("place_id", "offset_id", "formation", "diff_base_md", round_half_up("diff_pp_ppg", 4).alias("diff_pp_ppg"))


_LINE = ("-20e0", "-60e0", "30e0", "80e0")


@query("c8_section_view", with_sql("places", f"""SELECT place_id, {R4(along_sql('lat', 'lng', *_LINE))} AS along_km, {R4(cross_sql('lat', 'lng', *_LINE))} AS across_km
FROM places WHERE abs({cross_sql('lat', 'lng', *_LINE)}) <= 2000"""))
def c8(spark, sf):
    out = O.section_view(places(spark, sf), (-20.0, -60.0, 30.0, 80.0), 2000.0)
    return out.select("place_id", round_half_up("along_km", 4).alias("along_km"), round_half_up("across_km", 4).alias("across_km"))


