"""Joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.operators import joins as J
from strataframe.plans.frames import half_up_sql, incidents, places, series, tops, with_sql
from strataframe.plans.registry import query
from strataframe.plans.scalars import hav_sql
from strataframe.sources.tables import read_table


@query("j1_equi_join", """SELECT o_orderpriority AS tag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag='R' GROUP BY 1""")
def j1(spark, sf):
    li = read_table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    o = read_table(spark, sf, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("tag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("j2_hydrate_hits", """SELECT e.event_id, l.quality, s.s_name AS place_name FROM events e
LEFT JOIN labels l ON l.doc_id = e.user_id LEFT JOIN supplier s ON s.s_suppkey = e.user_id WHERE e.event_type='error'""")
def j2(spark, sf):
    hits = read_table(spark, sf, "events").where("event_type = 'error'").select(
        "event_id", F.col("user_id").alias("doc_id"), F.col("user_id").alias("s_suppkey"))
    items = read_table(spark, sf, "labels").select("doc_id", "quality")
    names = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("place_name"))
    return J.hydrate(hits, items, names, "doc_id", "s_suppkey").select("event_id", "quality", "place_name")


@query("j3_dictionary_lookup", """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey=c_nationkey AND n_nationkey < 20
LEFT JOIN region ON r_regionkey=n_regionkey""")
def j3(spark, sf):
    n = read_table(spark, sf, "nation").where("n_nationkey < 20")
    c = read_table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        "c_custkey", "n_name", "r_name")


@query("j4_first_match", """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (
SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON o_custkey=c_custkey""")
def j4(spark, sf):
    left = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    out = J.first_match_join(left, read_table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                             ["o_orderkey", "o_totalprice"])
    return out.withColumnRenamed("o_custkey", "c_custkey")


def _sections(spark, sf):
    t = tops(spark, sf)
    return t.select("well_id", F.col("formation_no").alias("section_no"), F.col("base_md").alias("start_md"))


@query("j5_asof_backward", with_sql("series tops", """SELECT s.well_id, s.pos, coalesce(m.formation_no, f.formation_no) AS section_no
FROM series s ASOF LEFT JOIN tops m ON m.well_id=s.well_id AND m.base_md <= s.depth
LEFT JOIN (SELECT well_id, min(formation_no) AS formation_no FROM tops GROUP BY 1) f ON f.well_id=s.well_id"""))
def j5(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    return J.asof_join(s, _sections(spark, sf), ["well_id"], "depth", "start_md", ["section_no"], "backward", "first").drop("depth")


@query("j6_asof_forward", with_sql("series tops", """SELECT s.well_id, s.pos, coalesce(m.formation_no, f.formation_no) AS station_no
FROM series s ASOF LEFT JOIN tops m ON m.well_id=s.well_id AND m.top_md >= s.depth
LEFT JOIN (SELECT well_id, max(formation_no) AS formation_no FROM tops GROUP BY 1) f ON f.well_id=s.well_id"""))
def j6(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    st = tops(spark, sf).select("well_id", "top_md", F.col("formation_no").alias("station_no"))
    return J.asof_join(s, st, ["well_id"], "depth", "top_md", ["station_no"], "forward", "last").drop("depth")


@query("j7_interval_containment", with_sql("series tops", """SELECT s.well_id, s.pos, t.formation FROM series s
LEFT JOIN tops t ON t.well_id=s.well_id AND s.depth BETWEEN t.top_md AND t.base_md"""))
def j7(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    out = J.interval_lookup(s, tops(spark, sf), ["well_id"], "depth", "top_md", "base_md", ["formation"], ["formation_no"], 500.0)
    return out.drop("depth")


@query("j8_interval_fallback", with_sql("series tops", """SELECT s.well_id, s.pos, coalesce(t.formation_no, n.formation_no, 5) AS formation_no
FROM series s LEFT JOIN tops t ON t.well_id=s.well_id AND s.depth BETWEEN t.top_md AND t.base_md
ASOF LEFT JOIN tops n ON n.well_id=s.well_id AND n.base_md >= s.depth"""))
def j8(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    out = J.interval_lookup(s, tops(spark, sf), ["well_id"], "depth", "top_md", "base_md", ["formation_no"], ["formation_no"],
                            500.0, fallback=True)
    return out.drop("depth")


@query("j9_band_join", with_sql("series incidents", """SELECT s.well_id, s.pos, count(*) AS n, CAST(sum(i.severity) AS BIGINT) AS severity,
 min(abs(i.start_md - s.depth)) AS nearest FROM series s JOIN incidents i ON i.well_id=s.well_id
 AND i.start_md BETWEEN s.depth - 120 AND s.depth + 160 GROUP BY s.well_id, s.pos"""))
def j9(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    ev = incidents(spark, sf).select("well_id", "start_md", "severity")
    near = J.band_nearest(s, ev, ["well_id"], "depth", "start_md", 120, 160)
    out = J.band_totals(near, ev, ["well_id"], "depth", "start_md", 120, 160, {"n": F.lit(1), "severity": F.col("severity")})
    return out.where("n > 0").select("well_id", "pos", "n", "severity", "nearest")


@query("j9_band_extremes", with_sql("series incidents", """SELECT s.well_id, s.pos, min(i.severity) AS mildest, max(i.severity) AS worst,
 min(i.start_md) AS first_md, max(i.end_md) AS last_md FROM series s LEFT JOIN incidents i ON i.well_id=s.well_id
 AND i.start_md BETWEEN s.depth - 120 AND s.depth + 160 GROUP BY s.well_id, s.pos"""))
def j9_extremes(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    out = J.band_extremes(s, incidents(spark, sf), ["well_id"], "depth", "start_md", 120, 160,
                          {"mildest": F.col("severity"), "first_md": F.col("start_md")},
                          {"worst": F.col("severity"), "last_md": F.col("end_md")})
    return out.drop("depth")


@query("j10_label_windows", with_sql("series incidents", """SELECT s.well_id, s.pos FROM series s WHERE EXISTS (SELECT 1 FROM incidents i
 WHERE i.well_id=s.well_id AND i.category='KICK' AND s.depth BETWEEN i.start_md - 75 AND i.end_md + 75)"""))
def j10(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    ev = incidents(spark, sf).where("category = 'KICK'")
    return J.label_windows(s, ev, ["well_id"], "depth", "start_md", "end_md", 75).drop("depth")


@query("j11_quiet_samples", with_sql("series incidents", """SELECT s.well_id, s.pos FROM series s WHERE NOT EXISTS (SELECT 1 FROM incidents i
 WHERE i.well_id=s.well_id AND s.depth BETWEEN i.start_md - 2 AND i.end_md + 2)"""))
def j11(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    return J.quiet_samples(s, incidents(spark, sf), ["well_id"], "depth", "start_md", "end_md", 2).drop("depth")


@query("j12_geo_neighbors", with_sql("places", f"""SELECT a.place_id, b.place_id AS near_place_id, {half_up_sql(hav_sql('a.lat', 'a.lng', 'b.lat', 'b.lng'), 3)} AS distance_km
FROM places a JOIN places b ON a.place_id <> b.place_id AND {hav_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 1500"""))
def j12(spark, sf):
    p = places(spark, sf)
    return J.geo_neighbors(p, p.select("place_id", "lat", "lng"), 1500.0).select(
        "place_id", "near_place_id", round_half_up("distance_km", 3).alias("distance_km"))


@query("j13_exists_within", with_sql("series incidents", """SELECT s.well_id, s.pos, CASE WHEN EXISTS (SELECT 1 FROM incidents i
 WHERE i.well_id=s.well_id AND abs(i.start_md - s.depth) <= 60) THEN 1 ELSE 0 END AS near FROM series s WHERE s.quantity >= 40"""))
def j13(spark, sf):
    s = series(spark, sf).where("quantity >= 40").select("well_id", "pos", "depth")
    return J.exists_within(s, incidents(spark, sf), ["well_id"], "depth", "start_md", 60).drop("depth")


@query("j16_attach_provenance", with_sql("incidents", """SELECT event_id, CASE WHEN d.doc_id IS NOT NULL THEN 'document' ELSE 'telemetry' END AS source_type,
 CASE WHEN d.doc_id IS NOT NULL THEN d.source || '-' || lpad(CAST(i.severity AS VARCHAR), 2, '0') END AS source_label
FROM (SELECT event_id, severity FROM incidents UNION ALL SELECT -page_id - 1, 1 FROM pages) i LEFT JOIN documents d ON d.doc_id = i.event_id % 1000 AND i.severity < 4 AND i.event_id >= 0"""))
def j16(spark, sf):
    ev = incidents(spark, sf).select("event_id", "severity")
    placed = ev.where("severity < 4").select("event_id", (F.col("event_id") % 1000).alias("doc_id"), F.col("severity").alias("page_no"))
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("doc_type"))
    extra = read_table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("event_id"))
    return J.attach_provenance(ev, placed, docs, "event_id", extra).select("event_id", "source_type", "source_label")


@query("a6_event_density", with_sql("series incidents", """SELECT s.well_id, s.pos, coalesce(sum(w), 0)/100e0 AS density,
 CASE WHEN coalesce(max(i.severity), 0) >= 4 OR coalesce(sum(w), 0) >= 120 THEN 1 ELSE 0 END AS label
FROM series s LEFT JOIN (SELECT *, CASE WHEN severity <= 1 THEN 25 WHEN severity <= 3 THEN 55 ELSE 90 END AS w FROM incidents) i
 ON i.well_id=s.well_id AND i.start_md BETWEEN s.depth-65 AND s.depth+65 GROUP BY s.well_id, s.pos"""))
def a6(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth")
    sev = F.col("severity")
    w = F.when(sev <= 1, 25).when(sev <= 3, 55).otherwise(90)
    t = J.band_totals(s, incidents(spark, sf), ["well_id"], "depth", "start_md", 65, 65,
                      {"hundredths": w, "high": (sev >= 4).cast("int")})
    return t.select("well_id", "pos", (F.col("hundredths") / 100.0).alias("density"),
                    F.when((F.col("high") > 0) | (F.col("hundredths") >= 120), 1).otherwise(0).alias("label"))
