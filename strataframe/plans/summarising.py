"""Aggregations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.functions.text import token_rows, tokenize
from strataframe.operators import aggregates as A
from strataframe.operators import windows as W
from strataframe.plans.frames import CATEGORIES, half_up_sql, incidents, samples, scored, tops, with_sql
from strataframe.plans.registry import query
from strataframe.plans.text_sql import TOKENS_SQL
from strataframe.sources.tables import read_table

R4 = lambda e: half_up_sql(e, 4)


@query("a1_group_count", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def a1(spark, sf):
    return read_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a2_category_counts", with_sql("incidents", "SELECT formation, " + ", ".join(
    f"count(*) FILTER (WHERE category='{c}') AS n_{c.lower()}" for c in CATEGORIES) + ", count(*) AS n_all FROM incidents GROUP BY 1"))
def a2(spark, sf):
    return A.category_counts(incidents(spark, sf), ["formation"], "category", CATEGORIES)


@query("a3_exposure", with_sql("incidents", """SELECT formation, count(*) AS entries, count(DISTINCT well_id) AS entities
FROM incidents GROUP BY 1"""))
def a3(spark, sf):
    return A.exposure(incidents(spark, sf), ["formation"], "well_id")


RATES = {"loss_rate": "MUD_LOSS", "kick_rate": "KICK", "stuck_rate": "STUCK_PIPE", "torque_rate": "TORQUE_SPIKE"}


def priors(spark, sf):
    return A.loo_priors(incidents(spark, sf), tops(spark, sf), "formation", "well_id", "category", "severity", RATES)


PRIORS_SQL = """SELECT p.formation, p.well_id, {er} AS event_rate, """ + ", ".join(
    f"floor(count(*) FILTER (WHERE e.category='{c}' AND e.well_id <> p.well_id)/greatest(1, p.wells-1)::DOUBLE*1e4+0.5)/1e4 AS {n}"
    for n, c in RATES.items()) + """,
 count(DISTINCT e.well_id) FILTER (WHERE e.well_id <> p.well_id) AS other_entities_hit, greatest(1, p.wells-1) AS exposure_entities,
 coalesce(list_sort(list(e.severity) FILTER (WHERE e.well_id <> p.well_id))[least(count(*) FILTER (WHERE e.well_id <> p.well_id) - 1,
   CAST(floor(count(*) FILTER (WHERE e.well_id <> p.well_id)*0.9) AS BIGINT)) + 1], 0)::DOUBLE AS severity_p90
FROM (SELECT formation, well_id, count(*) OVER (PARTITION BY formation) AS wells FROM tops) p
LEFT JOIN incidents e ON e.formation = p.formation GROUP BY p.formation, p.well_id, p.wells"""
PRIORS_SQL = PRIORS_SQL.replace("{er}", "floor(count(*) FILTER (WHERE e.well_id <> p.well_id)/greatest(1, p.wells-1)::DOUBLE*1e4+0.5)/1e4")


@query("a4_leave_one_out_priors", with_sql("incidents tops", PRIORS_SQL))
def a4(spark, sf):
    return priors(spark, sf)


@query("j14_exclusion_join", with_sql("incidents", """SELECT a.well_id, a.formation, t.n - a.n AS others FROM
 (SELECT well_id, formation, count(*) AS n FROM incidents GROUP BY ALL) a JOIN (SELECT formation, count(*) AS n FROM incidents GROUP BY 1) t
 ON t.formation = a.formation"""))
def j14(spark, sf):
    own = incidents(spark, sf).groupBy("well_id", "formation").agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy("formation").agg(F.sum("n").alias("t"))
    return own.join(total, "formation").select("well_id", "formation", (F.col("t") - F.col("n")).alias("others"))


@query("a5_nearest_rank", """SELECT l_suppkey, l_quantity AS p90 FROM (SELECT l_suppkey, l_quantity,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
 WHERE i = least(n - 1, CAST(floor(n*0.9e0) AS BIGINT))""")
def a5(spark, sf):
    return W.nearest_rank(read_table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", 0.9, "p90")


@query("a7_document_rollup", f"""SELECT *, page_count - image_pages AS text_pages,
 CASE WHEN image_pages = page_count THEN 'partial' ELSE 'text' END AS ocr_status, CASE WHEN image_pages > 0 THEN 'mixed' ELSE 'pdf_text_layer' END AS text_source
FROM (SELECT conv_id, count(*) AS page_count, count(*) FILTER (WHERE role='user') AS image_pages,
 {R4("avg(CASE WHEN role <> 'user' THEN 0.9e0 + (turn % 10)/100e0 END)")} AS ocr_confidence, CAST(sum(length(text))*3 AS BIGINT) AS size_bytes
 FROM conversations GROUP BY 1)""")
def a7(spark, sf):
    c = read_table(spark, sf, "conversations").select(
        "conv_id", "text", F.when(F.col("role") == "user", "none").otherwise("pdf_text_layer").alias("src"),
        F.when(F.col("role") != "user", 0.9 + (F.col("turn") % 10) / 100.0).alias("conf"))
    return A.document_rollup(c, "conv_id", "src", "conf", "text")


@query("a8_document_frequency", f"""SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL('text')}) AS term FROM documents) GROUP BY 1""")
def a8(spark, sf):
    t = token_rows(read_table(spark, sf, "documents"), ["doc_id"], "text")
    return A.document_frequency(t, "doc_id", "term")


@query("a9_update_df", f"""WITH t AS (SELECT DISTINCT conv_id, turn, unnest({TOKENS_SQL('text')}) AS term FROM conversations),
d AS (SELECT term, count(*) AS df FROM t WHERE turn > 0 GROUP BY 1)
SELECT term, greatest(0, CAST(sum(v) AS BIGINT)) AS df FROM (SELECT term, df AS v FROM d
 UNION ALL SELECT term, -1 FROM t WHERE turn = 1 UNION ALL SELECT term, 1 FROM t WHERE turn = 0) GROUP BY 1""")
def a9(spark, sf):
    t = read_table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("ref"), "turn",
                                                      F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    df = A.document_frequency(t.where("turn > 0"), "ref", "term")
    return A.update_df(df, t.where("turn = 1").select("ref", "term"), t.where("turn = 0").select("ref", "term"))


@query("a10_column_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, {R4(f'avg({c})')} AS mean, {half_up_sql(f'greatest(1e-6, stddev_pop({c}))', 3)} AS dev FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def a10(spark, sf):
    s = A.column_stats(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return s.select("feature", "n", round_half_up("mean", 4).alias("mean"), round_half_up("dev", 3).alias("dev"))


@query("a11_score_summary", with_sql("scored", f"""SELECT count(*) AS scored, count(*) FILTER (WHERE score >= 0.1) AS flagged,
 {R4('max(score)')} AS max_score, {R4('avg(score)')} AS mean_score FROM scored"""))
def a11(spark, sf):
    return A.score_summary(scored(spark, sf).withColumn("f", F.col("score") >= 0.1), "score", "f")


@query("a12_spread", f"""SELECT event_type, {R4('avg(value)')} AS mean, {R4('stddev_pop(value)')} AS std_dev, {R4('min(value)')} AS min,
 {R4('max(value)')} AS max FROM events GROUP BY 1""")
def a12(spark, sf):
    return A.spread(read_table(spark, sf, "events"), "value", ["event_type"])


@query("a13_percentile_table", """WITH r AS (SELECT value AS a, value*0.9e0 + 1 AS p, row_number() OVER (ORDER BY value, event_id) AS i,
 count(*) OVER () AS n FROM events),
m AS (SELECT CAST(q AS INTEGER) AS percentile, least(max(n) - 1, CAST(floor(q*max(n)/100e0) AS BIGINT)) + 1 AS rows_in FROM r, (VALUES (50), (75), (90), (95), (99)) v(q) GROUP BY q)
SELECT percentile, rows_in, floor(avg(a)*1e2+0.5)/1e2 AS mean_actual, floor(avg(p)*1e2+0.5)/1e2 AS mean_predicted FROM m JOIN r ON r.i <= m.rows_in GROUP BY 1, 2""")
def a13(spark, sf):
    ev = samples(spark, sf).select("event_id", F.col("value").alias("a"), (F.col("value") * 0.9 + 1).alias("p"))
    t = W.percentile_table(ev, "a", "p", tie="event_id")
    return t.select("percentile", "rows_in", round_half_up("mean_actual", 2).alias("mean_actual"),
                    round_half_up("mean_predicted", 2).alias("mean_predicted"))


@query("a14_mean_by_label", with_sql("scored", f"SELECT label, {R4('avg(score)')} AS mean_score FROM scored GROUP BY 1"))
def a14(spark, sf):
    return scored(spark, sf).groupBy("label").agg(round_half_up(F.avg("score"), 4).alias("mean_score"))


@query("a15_corpus_summary", with_sql("incidents tops", """SELECT (SELECT count(*) FROM supplier) AS wells, (SELECT count(*) FROM lineitem) AS telemetry_samples,
 (SELECT count(*) FROM tops) AS formations, (SELECT count(*) FROM documents) AS documents,
 (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM incidents GROUP BY 1)) AS by_category"""))
def a15(spark, sf):
    out = A.corpus_summary({
        "wells": read_table(spark, sf, "supplier"), "telemetry_samples": read_table(spark, sf, "lineitem"),
        "formations": tops(spark, sf), "documents": read_table(spark, sf, "documents")}, incidents(spark, sf), "category")
    pairs = F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("by_category", F.array_join(pairs, ","))


@query("a16_npt_by_category", with_sql("incidents", """SELECT category, CAST(sum(CAST(round(npt_hours*10) AS BIGINT)) AS BIGINT) AS npt_total, count(*) AS n
FROM incidents GROUP BY 1"""))
def a16(spark, sf):
    tenths = incidents(spark, sf).withColumn("tenths", F.round(F.col("npt_hours") * 10).cast("bigint"))
    return A.npt_by(tenths, ["category"], "tenths")


