"""Filters, validation, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.encode import band, encode_contains, severity_weight, trajectory_weight
from strataframe.functions.numeric import round_half_up
from strataframe.functions.text import term_overlap, tokenize
from strataframe.operators import filters as Q
from strataframe.operators.series import row_frames
from strataframe.operators.sets import knowledge_union, missing_keys
from strataframe.operators.topk import nearest_k, over_fetch, topk_list
from strataframe.plans.frames import half_up_sql, incidents, places, samples, scored, tops, with_sql
from strataframe.plans.registry import query
from strataframe.plans.text_sql import TOKENS_SQL
from strataframe.sources.tables import read_table


@query("q1_within_distance", """
SELECT s_suppkey AS place_id, s_name AS name, (s_suppkey*13 % 500)/10e0 AS distance_km FROM supplier
WHERE (s_suppkey*13 % 500)/10e0 <= 25""")
def q1(spark, sf):
    p = places(spark, sf).select("place_id", "name", ((F.col("place_id") * 13) % 500 / 10.0).alias("distance_km"))
    return Q.within_distance(p, "distance_km", 25.0, ["place_id"])


@query("q2_faceted_filter", with_sql("incidents", """
SELECT event_id, well_id, category, formation, severity, start_md FROM incidents
WHERE category='KICK' AND start_md >= 500 AND start_md <= 2000
  AND (lower(event_type) LIKE '%kick%' OR lower(formation) LIKE '%kick%')"""))
def q2(spark, sf):
    out = Q.faceted_filter(incidents(spark, sf), {"category": "KICK", "formation": None}, {"start_md": (500, 2000)},
                           (["event_type", "formation"], "KICK"))
    return out.select("event_id", "well_id", "category", "formation", "severity", "start_md")


@query("q3_document_filter", """
SELECT doc_id, source, lang, n_chars FROM documents
WHERE source='src15' AND (lower(lang) LIKE '%en%' OR lower(text) LIKE '%en%')""")
def q3(spark, sf):
    d = Q.faceted_filter(read_table(spark, sf, "documents"), {"source": "src15"}, None, (["lang", "text"], "EN"))
    return d.select("doc_id", "source", "lang", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id")


@query("q4_multi_search", """
SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS ref, source AS title FROM documents WHERE lower(text) LIKE '%the%'
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part
  WHERE lower(p_name) LIKE '%the%' OR lower(p_type) LIKE '%the%'
UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), url FROM pages WHERE lower(url) LIKE '%the%' OR lower(html) LIKE '%the%'""")
def q4(spark, sf):
    return Q.multi_search({
        "document": (read_table(spark, sf, "documents"), "doc_id", "source", ["text"]),
        "part": (read_table(spark, sf, "part"), "p_partkey", "p_name", ["p_name", "p_type"]),
        "page": (read_table(spark, sf, "pages"), "page_id", "url", ["url", "html"]),
    }, "the")


@query("q5_retrieval_filter", """
SELECT event_id, event_type, user_id FROM events
WHERE event_type IN ('error', 'view') AND CAST(props->>'k' AS DOUBLE) >= 20 AND CAST(props->>'k' AS DOUBLE) <= 60
  AND user_id IN (8, 46, 3, 7, 11, 99)""")
def q5(spark, sf):
    ev = read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    out = Q.retrieval_filter(ev, None, ["error", "view"], (20, 60), [8, 46, 3, 7, 11, 99], "user_id", "event_type", k)
    return out.select("event_id", "event_type", "user_id")


@query("q6_facets", with_sql("incidents", """
SELECT 'category' AS facet, category AS option, count(*) AS n FROM incidents GROUP BY category
UNION ALL SELECT 'formation', formation, count(*) FROM incidents GROUP BY formation
UNION ALL SELECT 'severity', CAST(severity AS VARCHAR), count(*) FROM incidents GROUP BY severity"""))
def q6(spark, sf):
    return Q.facets(incidents(spark, sf), ["category", "formation", "severity"])


@query("q6_register_filter", with_sql("incidents", """
SELECT event_id, event_type, formation, start_md FROM incidents
WHERE start_md BETWEEN 300 AND 2500 AND severity=3
  AND lower(concat_ws(' ', event_type, formation, category)) LIKE '%torque formation%'"""))
def q6b(spark, sf):
    out = Q.register_filter(incidents(spark, sf), ["event_type", "formation", "category"], "Torque Formation",
                            "start_md", (300, 2500), {"severity": 3})
    return out.select("event_id", "event_type", "formation", "start_md")


_RULES = dict(required=["user_id", "kind"], enums={"kind": ["click", "view", "error", "purchase"]},
              ranges={"value": (1.0, 400.0)})


def _checked(spark, sf):
    return samples(spark, sf).select(
        "event_id", F.when(F.col("value") < 450, F.col("well_id")).alias("user_id"), F.col("event_type").alias("kind"),
        "value")


_REASONS = """list_filter([CASE WHEN NOT value < 450 THEN 'missing user_id' END,
  CASE WHEN event_type NOT IN ('click','view','error','purchase') THEN 'unknown kind' END,
  CASE WHEN value < 1 OR value > 400 THEN 'value out of range' END], lambda x: x IS NOT NULL)"""


@query("q7_valid_rows", f"SELECT event_id, value FROM events WHERE len({_REASONS}) = 0")
def q7(spark, sf):
    return Q.validate(_checked(spark, sf), **_RULES)[0].select("event_id", "value")


@query("q7_rejects", f"""SELECT reason, count(*) AS n, min(event_id) AS first_id FROM (
SELECT event_id, unnest({_REASONS}) AS reason FROM events) GROUP BY reason""")
def q7b(spark, sf):
    bad = Q.validate(_checked(spark, sf), **_RULES)[1]
    return bad.select("event_id", F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("q7_depth_reference", """
SELECT l_linestatus AS ref_a, CASE WHEN l_returnflag='N' THEN 'O' ELSE 'F' END AS ref_b, count(*) AS n
FROM lineitem WHERE l_linestatus <> CASE WHEN l_returnflag='N' THEN 'O' ELSE 'F' END GROUP BY 1, 2""")
def q7c(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("ref_a"), F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("ref_b"))
    return Q.same_reference(li, "ref_a", "ref_b")[1].groupBy("ref_a", "ref_b").agg(F.count(F.lit(1)).alias("n"))


@query("q8_encode", """
SELECT p_partkey, CASE WHEN contains(p_name,'widget') THEN 3 WHEN contains(p_name,'ring') THEN 2
    WHEN contains(p_name,'bolt') THEN 1 ELSE 0 END AS formation_code,
  CASE WHEN p_size < 15 THEN 0.25e0 WHEN p_size < 30 THEN 0.55e0 WHEN p_size < 45 THEN 0.9e0 ELSE 0.35e0 END AS weight,
  CASE WHEN contains(lower(t), 'directional') THEN 0.8e0 WHEN contains(lower(t), 'tangent') THEN 0.65e0
    WHEN contains(lower(t), 's-shaped') THEN 0.65e0 ELSE 0.3e0 END AS trajectory
FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'Directional build' WHEN 1 THEN 'Hold tangent' WHEN 2 THEN 'S-shaped'
  ELSE 'Vertical' END AS t FROM part)""")
def q8(spark, sf):
    size = F.col("p_size")
    sev = F.when(size < 15, "Low").when(size < 30, "Medium").when(size < 45, "High").otherwise("None")
    path = F.element_at(F.array(*[F.lit(x) for x in ("Directional build", "Hold tangent", "S-shaped", "Vertical")]),
                        size % 4 + 1)
    return read_table(spark, sf, "part").select(
        "p_partkey", encode_contains("p_name", [("widget", 3), ("ring", 2), ("bolt", 1)], 0).alias("formation_code"),
        severity_weight(sev).alias("weight"), trajectory_weight(path).alias("trajectory"))


@query("q9_bands", with_sql("scored", """
SELECT level, count(*) AS n, count(*) FILTER (WHERE s >= 40) AS actionable FROM (
  SELECT score*100 AS s, CASE WHEN score*100 >= 70 THEN 'High' WHEN score*100 >= 40 THEN 'Medium' ELSE 'Low' END AS level
  FROM scored) GROUP BY level"""))
def q9(spark, sf):
    s = scored(spark, sf).withColumn("s", F.col("score") * 100)
    return s.groupBy(band("s").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") >= 40).alias("actionable"))


@query("q10_look_ahead", with_sql("incidents", """
SELECT event_id, start_md, category FROM incidents WHERE start_md BETWEEN 1000 AND 1250
ORDER BY start_md, event_id LIMIT 6"""))
def q10(spark, sf):
    return Q.look_ahead(incidents(spark, sf), "start_md", 1000, 250, 6, ["event_id"]).select(
        "event_id", "start_md", "category")


@query("q11_detail_view", """
SELECT c_custkey, c_name, coalesce(n, 0) AS children_count, o_orderkey, o_orderstatus FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN orders o ON o.o_custkey = c_custkey""")
def q11(spark, sf):
    parent = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    orders = read_table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return Q.with_children(parent, orders, "c_custkey", ["o_orderkey", "o_orderstatus"])


_NOTES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.APPLICABILITY.items())


@query("q12_derive_lessons", with_sql("incidents", f"""
SELECT event_id, event_type || ' in ' || formation || ' at ' || CAST(CAST(floor(start_md+0.5e0) AS BIGINT) AS VARCHAR) || ' m' AS title,
  category, start_md AS depth_md, CASE WHEN category IN ('MUD_LOSS','STUCK_PIPE','KICK') THEN 1 ELSE 0 END AS transferable,
  CASE category {_NOTES} END AS applicability_note, lower(category) || ',formation' AS tags
FROM incidents WHERE severity >= 3 AND npt_hours > 2"""))
def q12(spark, sf):
    ev = incidents(spark, sf).withColumn("action_taken", F.when(F.col("npt_hours") > 2, F.lit("Reduced ROP")))
    return Q.derive_lessons(ev)


@query("k1_nearest_k", with_sql("incidents", """
SELECT event_id, start_md, severity, abs(start_md-1500) AS distance FROM incidents
ORDER BY abs(start_md-1500), severity DESC, event_id LIMIT 6"""))
def k1(spark, sf):
    return nearest_k(incidents(spark, sf), "start_md", 1500, 6, [F.col("severity").desc(), "event_id"]).select(
        "event_id", "start_md", "severity", "distance")


@query("k2_two_key_ranking", with_sql("places", """
SELECT place_id, score, distance_km FROM (
  SELECT place_id, (place_id*7 % 10)/10e0 AS score, (place_id*13 % 500)/10e0 AS distance_km FROM places)
ORDER BY score DESC, distance_km, place_id LIMIT 12"""))
def k2(spark, sf):
    p = places(spark, sf).select("place_id", ((F.col("place_id") * 7) % 10 / 10.0).alias("score"),
                                 ((F.col("place_id") * 13) % 500 / 10.0).alias("distance_km"))
    return p.orderBy(F.col("score").desc(), "distance_km", "place_id").limit(12)


@query("k3_topk_list", with_sql("incidents", """
SELECT well_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY d, event_id) AS nearest FROM (
  SELECT *, abs(start_md-1500) AS d FROM incidents
  QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY abs(start_md-1500), event_id) <= 6) GROUP BY well_id"""))
def k3(spark, sf):
    ev = incidents(spark, sf).withColumn("d", F.abs(F.col("start_md") - 1500))
    out = topk_list(ev, ["well_id"], ["d", "event_id"], 6, ["event_id"], "nearest")
    return out.select("well_id", F.array_join(F.transform("nearest", lambda s: s["event_id"].cast("string")), ",").alias("nearest"))


@query("k5_over_fetch", with_sql("scored", """
SELECT grp, doc_id, score, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS rank FROM scored
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) <= 15"""))
def k5(spark, sf):
    return over_fetch(scored(spark, sf).select("grp", "doc_id", "score"), ["grp"], ["-score", "doc_id"], 5)


def item_parts(spark, sf):
    """Documents, incidents, lessons, depth intervals and mud rows as typed projections."""
    docs = read_table(spark, sf, "documents").select(
        F.lit("document_chunk").alias("kind"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("ref"),
        F.col("source").alias("title"), F.col("text").alias("body"))
    ev = incidents(spark, sf)
    events = ev.select(
        F.lit("event").alias("kind"), F.concat(F.lit("event:"), F.col("event_id")).alias("ref"), F.col("well_id").alias("place_id"),
        F.concat_ws(" ", "event_type", "formation").alias("title"), F.col("category").alias("body"), F.col("start_md").alias("depth"))
    lessons = Q.derive_lessons(ev.withColumn("action_taken", F.lit("x"))).select(
        F.lit("lesson").alias("kind"), F.concat(F.lit("lesson:"), F.col("event_id")).alias("ref"), "title",
        F.col("applicability_note").alias("body"), F.col("depth_md").alias("depth"))
    t = tops(spark, sf)
    sections = t.select(
        F.lit("well_section").alias("kind"), F.concat(F.lit("section:"), F.concat_ws(":", "well_id", "formation_no")).alias("ref"),
        F.col("well_id").alias("place_id"), F.col("formation").alias("title"), F.lit("cased").alias("body"), F.col("base_md").alias("depth"))
    mud = t.select(
        F.lit("mud_program").alias("kind"), F.concat(F.lit("mud:"), F.concat_ws(":", "well_id", "formation_no")).alias("ref"),
        F.col("well_id").alias("place_id"), F.col("formation").alias("title"), F.col("top_md").alias("depth"))
    return [docs, events, lessons, sections, mud]


@query("u1_corpus_union", with_sql("incidents tops", """
SELECT 'document_chunk' AS kind, count(*) AS n, CAST(NULL AS DOUBLE) AS deepest, count(*) AS with_body FROM documents
UNION ALL SELECT 'event', count(*), max(start_md), count(*) FROM incidents
UNION ALL SELECT 'lesson', count(*), max(start_md), count(*) FROM incidents WHERE severity >= 3
UNION ALL SELECT 'well_section', count(*), max(base_md), count(*) FROM tops
UNION ALL SELECT 'mud_program', count(*), max(top_md), 0 FROM tops"""))
def u1(spark, sf):
    return knowledge_union(item_parts(spark, sf)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), F.count("body").alias("with_body"))


@query("u2_positives_and_negatives", """
SELECT label, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (
  SELECT doc_id, 1 AS label FROM labels WHERE quality=1
  UNION ALL SELECT doc_id, 0 FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM labels WHERE quality=0)
    WHERE (r-1) % 3 = 0) GROUP BY label""")
def u2(spark, sf):
    from strataframe.operators.windows import stride_sample

    lab = read_table(spark, sf, "labels")
    pos = lab.where("quality = 1").select("doc_id", F.lit(1).alias("label"))
    neg = stride_sample(lab.where("quality = 0").select("doc_id"), [], ["doc_id"], 1 / 3).withColumn("label", F.lit(0))
    return pos.unionByName(neg).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("u3_distinct_values", "SELECT DISTINCT event_type, user_id FROM events")
def u3(spark, sf):
    return read_table(spark, sf, "events").select("event_type", "user_id").distinct()


@query("u4_missing_keys", """
SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 40)""")
def u4(spark, sf):
    active = read_table(spark, sf, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return missing_keys(read_table(spark, sf, "part"), active, "p_partkey")


@query("u5_term_overlap", f"""WITH t AS (
  SELECT conv_id, turn, list_distinct({TOKENS_SQL('text')}) AS a FROM conversations),
p AS (SELECT conv_id, turn, a, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, {half_up_sql('CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))/least(len(a), len(b)) ELSE 0 END', 6)} AS overlap
FROM p WHERE b IS NOT NULL""")
def u5(spark, sf):
    t = read_table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(tokenize("text")).alias("a"))
    p = row_frames(t, ["conv_id"], ["turn"], lambda w: {"b": F.lag("a").over(w)}, before=1).where("b is not null")
    return p.select("conv_id", "turn", round_half_up(term_overlap("a", "b"), 6).alias("overlap"))


