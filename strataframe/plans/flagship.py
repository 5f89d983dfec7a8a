"""The end-to-end query: local ratios, nearby recorded events, a logistic score, the riskiest intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.numeric import clamp, round_half_up, sigmoid
from strataframe.operators.joins import band_totals
from strataframe.operators.topk import topk
from strataframe.operators.windows import local_ratios
from strataframe.plans.frames import half_up_sql, incidents, series, with_sql
from strataframe.plans.registry import query
from strataframe.plans.windowing import ratio_sql

_Z = "-2.9e0 + 1.2e0*least(1.5e0, w/100e0/2.5e0) + 1.35e0*greatest(0e0, least(1.6e0, quantity_ratio - 1)) + 0.9e0*greatest(0e0, least(1.4e0, 1 - price_ratio))"


@query("flagship_risk_intervals", with_sql("series incidents", f""", r AS (SELECT well_id, pos, depth, {half_up_sql(ratio_sql('quantity'), 6)} AS quantity_ratio, {half_up_sql(ratio_sql('price'), 6)} AS price_ratio FROM series),
e AS (SELECT s.well_id, s.pos, count(i.event_id) AS nearby, coalesce(sum(CASE WHEN severity <= 1 THEN 25 WHEN severity <= 3 THEN 55 ELSE 90 END), 0) AS w FROM series s
 JOIN incidents i ON i.well_id=s.well_id AND i.start_md BETWEEN s.depth-120 AND s.depth+160 GROUP BY 1, 2),
z AS (SELECT well_id, depth, quantity_ratio, price_ratio, coalesce(nearby, 0) AS nearby, {half_up_sql('1/(1+exp(-(' + _Z.replace('w/100', 'coalesce(w, 0)/100') + ')))', 6)} AS score FROM r LEFT JOIN e USING (well_id, pos))
SELECT well_id, depth, quantity_ratio, price_ratio, nearby, score, row_number() OVER (PARTITION BY well_id ORDER BY score DESC, depth) AS rank FROM z
QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY score DESC, depth) <= 10"""))
def flagship(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth", "quantity", "price")
    r = local_ratios(s, ["well_id"], ["pos"], ["quantity", "price"]).select(
        "well_id", "pos", "depth", *[round_half_up(f"{c}_ratio", 6).alias(f"{c}_ratio") for c in ("quantity", "price")])
    sev = F.col("severity")
    weight = F.when(sev <= 1, 25).when(sev <= 3, 55).otherwise(90)
    e = band_totals(r, incidents(spark, sf), ["well_id"], "depth", "start_md", 120, 160, {"nearby": F.lit(1), "w": weight})
    z = (F.lit(-2.9) + 1.2 * F.least(F.lit(1.5), F.col("w") / 100.0 / 2.5) + 1.35 * clamp(F.col("quantity_ratio") - 1, 0, 1.6)
         + 0.9 * clamp(1 - F.col("price_ratio"), 0, 1.4))
    scored = e.withColumn("score", round_half_up(sigmoid(z), 6)).drop("w", "pos")
    return topk(scored, ["well_id"], ["-score", "depth"], 10)
