"""Feature rows and labelled training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.features.extract import FEATURE_NAMES, build_features, section_rows
from strataframe.features.labels import RISKS, training_rows
from strataframe.plans.frames import half_up_sql as h
from strataframe.plans.frames import incidents, places, series, tops, with_sql
from strataframe.plans.registry import query
from strataframe.plans.summarising import PRIORS_SQL, priors
from strataframe.plans.windowing import ratio_sql


def channels(spark, sf):
    """Line items dressed as drilling telemetry; some mud weights and circulating densities are missing."""
    s = series(spark, sf)
    q, p, o = F.col("quantity"), F.col("part_id"), F.col("order_id")
    d = lambda c: c.cast("double")
    return s.select(
        "well_id", "depth", q.alias("torque_knm"), (F.col("price") / 1000).alias("drag_knm"), (50 - q).alias("rop_mhr"),
        (F.col("discount") * 100).alias("wob_ton"), (150 + F.col("tax") * 100).alias("hook_load_ton"),
        (2000 + q * 10).alias("spp_psi"), d(2500 + o % 100).alias("flow_out_lpm"), d(50 + p % 20).alias("pit_volume_m3"),
        F.when(F.col("line_no") != 3, 9 + q / 25).alias("mud_weight_ppg"), F.when(F.col("line_no") != 2, 9.4 + q / 25).alias("ecd_ppg"),
        d(o % 300).alias("gas_ratio_ppm"), (1 + F.col("discount") * 5).alias("d_exponent"), (1 + F.col("tax")).alias("normalised_d"),
        d(F.col("pos") % 90).alias("inclination_deg"), d(o % 360).alias("azimuth_deg"), (F.col("discount") * 10).alias("dogleg_deg_per_30m"))


def _sections(spark, sf):
    p, i = F.col("place_id"), F.col("i")
    return places(spark, sf).select(p, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select(
        p.alias("well_id"), i.cast("bigint").alias("section_no"), F.element_at(F.array(F.lit(17.5), F.lit(12.25), F.lit(8.5)), i).alias("hole_size_in"),
        ((i - 1) * 1000 + p % 50).cast("double").alias("top_md"), F.when(i < 3, F.lit(13.375)).alias("casing_size_in"),
        (i * 1000 + p % 50).cast("double").alias("shoe_md"), (i * 900 + p % 50).cast("double").alias("shoe_tvd"), (10 + i).cast("double").alias("design_ecd"))


def _mud(spark, sf):
    p, i = F.col("place_id"), F.col("i")
    return places(spark, sf).select(p, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        p.alias("well_id"), (i * 700).cast("double").alias("from_md"), (i * 700 + 650).cast("double").alias("to_md"), (9 + i * 0.5).alias("density_ppg"),
        F.element_at(F.array(*[F.lit(x) for x in ("WBM", "OBM", "PBM", "WBM")]), i + 1).alias("system"),
        F.when(i % 2 == 1, "CaCO3").alias("lcm_type"), F.when(i > 0, i * 5.0).alias("lcm_ppb"))


def _wells(spark, sf):
    return places(spark, sf).select(F.col("place_id").alias("well_id"), (3000 + F.col("place_id") % 7 * 100).cast("double").alias("td_md"))


def features(spark, sf):
    pr = priors(spark, sf)
    return build_features(channels(spark, sf), _wells(spark, sf), _sections(spark, sf), _mud(spark, sf), tops(spark, sf), pr)


_CH = """, ch AS MATERIALIZED (SELECT well_id, pos, depth, quantity AS torque_knm, price/1000 AS drag_knm, 50 - quantity AS rop_mhr, discount*100 AS wob_ton, 150 + tax*100 AS hook_load_ton,
 2000 + quantity*10 AS spp_psi, CAST(2500 + order_id % 100 AS DOUBLE) AS flow_out_lpm, CAST(50 + part_id % 20 AS DOUBLE) AS pit_volume_m3,
 CASE WHEN line_no <> 3 THEN 9 + quantity/25 END AS mud_weight_ppg, CASE WHEN line_no <> 2 THEN 9.4e0 + quantity/25 END AS ecd_ppg,
 CAST(order_id % 300 AS DOUBLE) AS gas_ratio_ppm, 1 + discount*5 AS d_exponent, 1 + tax AS normalised_d, CAST(pos % 90 AS DOUBLE) AS inclination_deg,
 CAST(order_id % 360 AS DOUBLE) AS azimuth_deg, discount*10 AS dogleg_deg_per_30m FROM series),
sec AS (SELECT s_suppkey AS well_id, i AS section_no, [17.5e0, 12.25e0, 8.5e0][i] AS hole_size_in, CAST((i-1)*1000 + s_suppkey % 50 AS DOUBLE) AS top_md FROM supplier, range(1, 4) r(i)),
mudp AS (SELECT s_suppkey AS well_id, i*700e0 AS from_md, i*700e0 + 650 AS to_md, 9 + i*0.5e0 AS density_ppg, ['WBM','OBM','PBM','WBM'][i+1] AS system,
 CASE WHEN i % 2 = 1 THEN 'CaCO3' END AS lcm_type, CASE WHEN i > 0 THEN i*5e0 END AS lcm_ppb FROM supplier, range(0, 4) r(i)),
pri AS MATERIALIZED (__PRIORS__),
w AS MATERIALIZED (SELECT well_id, depth, __WINDOWS__ FROM ch WINDOW t20 AS (PARTITION BY well_id ORDER BY depth ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
 t12 AS (PARTITION BY well_id ORDER BY depth ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
c1 AS (SELECT ch.*, s.section_no, s.hole_size_in FROM ch ASOF JOIN sec s ON s.well_id=ch.well_id AND s.top_md <= ch.depth),
c1b AS (SELECT ch.*, 1 AS section_no, 17.5e0 AS hole_size_in FROM ch WHERE depth < well_id % 50),
c2 AS (SELECT * FROM c1 UNION ALL SELECT * FROM c1b),
nt AS (SELECT c2.well_id, c2.depth, t.formation_no FROM c2 ASOF JOIN tops t ON t.well_id=c2.well_id AND t.base_md >= c2.depth),
c3 AS (SELECT c2.*, tt.formation, tt.top_md AS formation_top, tt.pp_ppg, tt.fg_ppg, tt.pp_gradient, tt.fg_gradient, tt.instability
 FROM c2 LEFT JOIN nt USING (well_id, depth) JOIN tops tt ON tt.well_id=c2.well_id AND tt.formation_no = coalesce(nt.formation_no, 5)),
c4 AS (SELECT c3.*, m.density_ppg, m.system, m.lcm_type, m.lcm_ppb FROM c3 LEFT JOIN mudp mm ON mm.well_id=c3.well_id AND c3.depth BETWEEN mm.from_md AND mm.to_md
 JOIN mudp m ON m.well_id=c3.well_id AND m.from_md = coalesce(mm.from_md, 2100)),
x AS (SELECT c4.*, w.* EXCLUDE (well_id, depth), coalesce(mud_weight_ppg, density_ppg, 0) AS mud, coalesce(ecd_ppg, mud_weight_ppg, density_ppg, 0) AS ecd,
 3000 + well_id % 7 * 100 AS td, p.* EXCLUDE (well_id, formation) FROM c4 JOIN w USING (well_id, depth) LEFT JOIN pri p ON p.well_id=c4.well_id AND p.formation=c4.formation)
"""
_F20 = "OVER t20"
_WIN = ", ".join([
    *[f"{ratio_sql(c, _F20)} AS {o}" for o, c in [
        ("torque_ratio_local", "torque_knm"), ("drag_ratio_local", "drag_knm"), ("rop_ratio_local", "rop_mhr"),
        ("hook_load_ratio_local", "hook_load_ton"), ("gas_ratio_ratio_local", "gas_ratio_ppm")]],
    "CASE WHEN count(flow_out_lpm) OVER t20 >= 3 THEN median(flow_out_lpm) OVER t20 - flow_out_lpm ELSE 0 END AS flow_deficit_lpm",
    "CASE WHEN count(d_exponent) OVER t12 >= 3 THEN 20*regr_slope(d_exponent, pos::DOUBLE) OVER t12 ELSE 0 END AS d_exponent_trend",
    "CASE WHEN count(pit_volume_m3) OVER t20 >= 4 THEN regr_slope(pit_volume_m3, pos::DOUBLE) OVER t20 ELSE 0 END AS pit_trend_m3_per_m"])
_CH = _CH.replace("__PRIORS__", PRIORS_SQL).replace("__WINDOWS__", _WIN)
_EXPR = {
    "depth_m": h("depth", 1), "depth_fraction_of_td": h("depth/td", 4), "inclination_deg": h("inclination_deg", 2),
    "dogleg_deg_per_30m": h("dogleg_deg_per_30m", 2), "azimuth_sin": h("sin(azimuth_deg*pi()/180)", 4), "azimuth_cos": h("cos(azimuth_deg*pi()/180)", 4),
    "hole_size_in": "hole_size_in", "section_no": "CAST(section_no AS DOUBLE)", "metres_into_formation": h("depth-formation_top", 1),
    "metres_to_formation_top": h("-(depth-formation_top)", 1), "mud_weight_ppg": h("mud", 3), "ecd_ppg": h("ecd", 3),
    "pore_pressure_gradient_ppg": h("pp_ppg", 3), "fracture_gradient_ppg": h("fg_ppg", 3), "overbalance_ppg": h("mud-pp_ppg", 3),
    "fracture_margin_ppg": h("fg_ppg-ecd", 3), "is_underbalanced": "CASE WHEN mud-pp_ppg < 0.2e0 THEN 1e0 ELSE 0e0 END",
    "is_overbalanced_ecd": "CASE WHEN ecd > fg_ppg-0.4e0 THEN 1e0 ELSE 0e0 END",
    "mud_system_oil_based": "CASE WHEN system IN ('OBM','PBM') THEN 1e0 ELSE 0e0 END", "lcm_present": "CASE WHEN lcm_type IS NOT NULL THEN 1e0 ELSE 0e0 END",
    "lcm_ppb": h("coalesce(lcm_ppb, 0)", 2), "d_exponent": h("d_exponent", 3), "normalised_d_exponent": h("normalised_d", 3),
    "d_exponent_trend": h("d_exponent_trend", 5), "lithology_index": h("instability", 3),
    "formation_pore_risk": h("instability*(coalesce(fg_gradient, 0) - coalesce(pp_gradient, 0))", 3),
    "torque_knm": h("torque_knm", 3), "drag_knm": h("drag_knm", 3), "rop_mhr": h("rop_mhr", 3), "wob_ton": h("wob_ton", 3),
    "hook_load_ton": h("hook_load_ton", 3), "spp_psi": h("spp_psi", 1), "torque_drag_ratio": h("torque_knm/greatest(1e-6, drag_knm)", 4),
    "flow_out_lpm": h("flow_out_lpm", 2), "flow_deficit_lpm": h("flow_deficit_lpm", 2), "pit_volume_m3": h("pit_volume_m3", 3),
    "pit_trend_m3_per_m": h("pit_trend_m3_per_m", 5), "gas_ratio_ppm": h("gas_ratio_ppm", 1),
    **{o: h(o, 4) for o in ("torque_ratio_local", "drag_ratio_local", "rop_ratio_local", "hook_load_ratio_local", "gas_ratio_ratio_local")},
    "prior_event_rate": h("coalesce(event_rate, 0)", 4), "prior_loss_rate": h("coalesce(loss_rate, 0)", 4), "prior_kick_rate": h("coalesce(kick_rate, 0)", 4),
    "prior_stuck_rate": h("coalesce(stuck_rate, 0)", 4), "prior_severity_p90": h("coalesce(severity_p90, 0)", 3),
    "prior_offset_wells_with_events": h("coalesce(other_entities_hit, 0)", 2),
}


@query("m1_build_features", with_sql("series tops incidents", _CH + " SELECT well_id, depth, formation, " + ", ".join(
    f"{_EXPR[n]} AS {n}" for n in FEATURE_NAMES) + " FROM x"))
def m1(spark, sf):
    return features(spark, sf)


_RISK_VALUES = ", ".join(f"('{r[0]}', '{r[1]}', {r[6]}e0)" for r in RISKS)


@query("m2_training_rows", with_sql("series incidents", f""", r AS (SELECT * FROM (VALUES {_RISK_VALUES}) v(risk_type, kind, margin)),
f AS MATERIALIZED (SELECT s.well_id, s.depth, r.risk_type, r.kind, count(i.event_id) > 0 AS cov, coalesce(bool_or(i.category = r.risk_type), false) AS hit,
  arg_min(i.npt_hours, i.event_id) AS npt FROM series s CROSS JOIN r LEFT JOIN incidents i ON i.well_id=s.well_id
  AND s.depth BETWEEN i.start_md - r.margin AND i.end_md + r.margin GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY well_id, risk_type ORDER BY depth) - 1 AS k FROM f WHERE NOT cov AND kind <> 'anomaly')
SELECT well_id, depth, risk_type, 1 AS label, CAST(NULL AS DOUBLE) AS target_value FROM f WHERE kind='classifier' AND hit
UNION ALL SELECT well_id, depth, risk_type, 1, {h('coalesce(npt, 0)', 2)} FROM f WHERE kind='regressor' AND cov
UNION ALL SELECT well_id, depth, risk_type, 0, 0e0 FROM q WHERE kind <> 'classifier' OR k % 7 = 0
UNION ALL SELECT well_id, depth, risk_type, CAST(cov AS INTEGER), NULL FROM f WHERE kind='anomaly'"""))
def m2(spark, sf):
    return training_rows(series(spark, sf).select("well_id", "depth"), incidents(spark, sf))


def _jobs(spark, sf):
    p = F.col("well_id")
    return _sections(spark, sf).select(
        "well_id", "section_no", (p * 10 + F.col("section_no")).alias("job_id"), F.when(p % 9 == 0, 1).otherwise(0).alias("squeeze_required"),
        F.when(p % 5 == 0, "FAILED").otherwise("GOOD").alias("outcome"), F.when(p % 4 != 0, p * 1.5).alias("annular_capacity"))


@query("m3_section_rows", with_sql("tops", f"""SELECT s.well_id, s.section_no, shoe_md AS depth_m, CASE WHEN s.well_id % 9 = 0 OR s.well_id % 5 = 0 THEN 1 ELSE 0 END AS label,
 {h('shoe_md/(3000 + s.well_id % 7 * 100)', 4)} AS depth_fraction_of_td, {h('degrees(cos(shoe_tvd/shoe_md*pi()/2))', 2)} AS inclination_deg, hole_size_in,
 {h('shoe_md - t.top_md', 1)} AS metres_into_formation, {h('-(shoe_md - t.top_md)', 1)} AS metres_to_formation_top, t.pp_ppg AS mud_weight_ppg, design_ecd AS ecd_ppg,
 t.instability AS lithology_index, {h('t.instability*(coalesce(t.fg_gradient, 0) - coalesce(t.pp_gradient, 0))', 3)} AS formation_pore_risk,
 {h('CASE WHEN s.well_id % 4 <> 0 THEN s.well_id*1.5e0 ELSE 0 END', 2)} AS target_value
FROM (SELECT s_suppkey AS well_id, i AS section_no, [17.5e0, 12.25e0][i] AS hole_size_in, CAST(i*1000 + s_suppkey % 50 AS DOUBLE) AS shoe_md,
  CAST(i*900 + s_suppkey % 50 AS DOUBLE) AS shoe_tvd, CAST(10 + i AS DOUBLE) AS design_ecd FROM supplier, range(1, 3) r(i)) s
LEFT JOIN tops c ON c.well_id=s.well_id AND s.shoe_md BETWEEN c.top_md AND c.base_md
JOIN tops t ON t.well_id=s.well_id AND t.formation_no = coalesce(c.formation_no, 5)"""))
def m3(spark, sf):
    return section_rows(_sections(spark, sf), _jobs(spark, sf), _wells(spark, sf), tops(spark, sf))
