"""Column functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions import numeric as N
from strataframe.functions import text as T
from strataframe.functions.geo import along_track_km, bearing_deg, cross_track_km, haversine_km, register_geo
from strataframe.features.extract import FEATURE_NAMES, to_vector, vector_to_object
from strataframe.operators import extraction as X
from strataframe.plans.frames import half_up_sql, incidents, places, series, with_sql
from strataframe.plans.registry import query
from strataframe.plans.text_sql import QUERY_TOKENS_SQL, STEM_SQL, TOKENS_SQL
from strataframe.sources.tables import read_table

R4 = lambda e: half_up_sql(e, 4)
R6 = lambda e: half_up_sql(e, 6)


@query("f1_tokenize", f"""SELECT doc_id, len(a) AS n_tokens, array_to_string(a, ' ') AS tokens FROM (
SELECT doc_id, {TOKENS_SQL('text')} AS a FROM documents)""")
def f1(spark, sf):
    t = read_table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("a"))
    return t.select("doc_id", F.size("a").cast("bigint").alias("n_tokens"), F.array_join("a", " ").alias("tokens"))


@query("f2_stem", f"""SELECT word, {STEM_SQL('word')} AS stem, count(*) AS n FROM (
SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word""")
def f2(spark, sf):
    w = read_table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return w.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", T.stem("word").alias("stem"), "n")


def _walk_sql(units: str, joint: int, slack: int, again: str) -> str:
    """Fold over the lengths of `units`: `heads` holds the number and offset of the first unit of every group."""
    full = f"a.i > 0 AND a.held + x.n + {slack} > 900"
    gap = f"CASE WHEN a.i = 0 THEN 0 WHEN {full} THEN 1 ELSE {joint} END"
    state = "{{'i': {}, 'n': {}, 'total': {}, 'held': {}, 'heads': {}}}"
    none = state.format("0::BIGINT", "0::BIGINT", "0::BIGINT", "0::BIGINT", "[{'unit': 0::BIGINT, 'at': 0::BIGINT}]")
    one = state.format("0::BIGINT", "length(u)::BIGINT", "0::BIGINT", "0::BIGINT", "[{'unit': 0::BIGINT, 'at': 0::BIGINT}]")
    new = state.format("a.i + 1", "x.n", f"a.total + {gap} + x.n", f"CASE WHEN {full} THEN {again} ELSE a.held + {gap} + x.n END",
                       f"CASE WHEN {full} THEN list_append(a.heads, {{'unit': a.i, 'at': a.total + 1}}) ELSE a.heads END")
    return f"list_reduce(list_transform({units}, lambda u: {one}), lambda a, x: {new}, {none}).heads"


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("f3_chunk_text", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda t: {_STRIP.format('t')}), lambda t: t <> '') AS ps FROM documents),
h AS (SELECT *, {_walk_sql('ps', 2, 2, 'least(140, a.total) + 1 + x.n')} AS hs FROM p WHERE len(ps) > 0),
j AS (SELECT *, array_to_string(list_transform(ps, lambda t, i: CASE WHEN i = 1 THEN '' WHEN list_contains(list_transform(hs, lambda z: z.unit), i - 1)
  THEN chr(10) ELSE chr(10) || chr(10) END || t), '') AS f FROM h),
c AS (SELECT doc_id, unnest(range(1, len(hs) + 1)) AS k, hs, f FROM j),
d AS (SELECT doc_id, k, greatest(0, hs[k].at - 141) AS b, coalesce(hs[k+1].at - 1, length(f)) AS e, f FROM c),
t AS (SELECT doc_id, k, {_STRIP.format("substring(f, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))")} AS chunk FROM d),
s AS (SELECT *, CASE WHEN length(chunk) <= 1620 THEN [chunk] ELSE string_split(regexp_replace(chunk, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS ss FROM t),
g AS (SELECT *, {_walk_sql('ss', 1, 0, 'x.n')} AS gs FROM s),
u AS (SELECT doc_id, k, unnest(range(1, len(gs) + 1)) AS m, gs, ss FROM g),
o AS (SELECT doc_id, k, m, array_to_string(ss[gs[m].unit + 1 : coalesce(gs[m+1].unit, len(ss))], ' ') AS chunk FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, m) AS chunk_no, length(chunk) AS n_chars, md5(chunk) AS chunk_md5,
 len(list_filter(regexp_split_to_array(chunk, '\\s+'), lambda w: w <> '')) AS token_count FROM o""")
def f3(spark, sf):
    c = T.chunk_text(read_table(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("chunk_md5"),
                    F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).cast("bigint").alias("token_count"))


@query("f4_snippet", """
WITH q AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, 'the Ention ouaile' AS query FROM documents),
h AS (SELECT *, list_transform(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) >= 3),
  lambda w: instr(lower(t), w) - 1) AS hits FROM q),
b AS (SELECT *, coalesce(list_min(list_filter(hits, lambda i: i >= 0)), 0) AS best FROM h),
s AS (SELECT *, greatest(0, best - 106) AS st FROM b)
SELECT doc_id, CASE WHEN length(t) <= 320 THEN t ELSE
  CASE WHEN st > 0 THEN '…' ELSE '' END || substring(t, st + 1, 320) || CASE WHEN st + 320 < length(t) THEN '…' ELSE '' END
  END AS snippet FROM s""")
def f4(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.snippet("text", F.lit("the Ention ouaile")).alias("snippet"))


@query("f5_query_tokens", f"""SELECT item_id, len(a) AS n, array_to_string(a, ' ') AS tokens FROM (
SELECT item_id, {QUERY_TOKENS_SQL("text || ' AND (near) \"x\"'", 24)} AS a FROM benchmark)""")
def f5(spark, sf):
    q = F.concat("text", F.lit(' AND (near) "x"'))
    t = read_table(spark, sf, "benchmark").select("item_id", T.query_tokens(q).alias("a"))
    return t.select("item_id", F.size("a").cast("bigint").alias("n"), F.array_join("a", " ").alias("tokens"))


_HEADS = ["Daily Drilling Report", "Formation test", "Directional Survey", "Mud programme summary", "Well completion note",
          "Bit and BHA record", "General remarks"]
_HEAD_SQL = "CASE e % 7 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS)) + " END"
_SECTION_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(head, '{p}') THEN '{n}'" for p, n in T.SECTION_PATTERNS) + f" ELSE '{T.SECTION_DEFAULT}' END"


@query("f6_section_type", with_sql("incidents", f"""
SELECT section, count(*) AS n FROM (SELECT {_SECTION_SQL} AS section FROM (
  SELECT lower(left({_HEAD_SQL.replace('e % 7', 'event_id % 7')} || ': ' || event_type || ' in ' || formation, 400)) AS head FROM incidents))
GROUP BY section"""))
def f6(spark, sf):
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("event_id") % 7 + 1).cast("int"))
    t = incidents(spark, sf).select(F.concat(head, F.lit(": "), "event_type", F.lit(" in "), "formation").alias("t"))
    return t.groupBy(T.section_type("t").alias("section")).agg(F.count(F.lit(1)).alias("n"))


_REPORT_SQL = """'Losses at ' || CAST(1 + order_id % 8 AS VARCHAR) || ',' || lpad(CAST(part_id % 1000 AS VARCHAR), 3, '0') ||
 ' m and ' || CAST(1 + part_id % 7 AS VARCHAR) || ',' || lpad(CAST(order_id % 1000 AS VARCHAR), 3, '0') || ' m in Formation ' ||
 CASE WHEN line_no % 2 = 0 THEN 'X' ELSE 'Y' END || CASE WHEN quantity > 25 THEN ' then Kick' ELSE '' END"""


def _reports(spark, sf):
    def num(a, b):
        return F.concat((1 + a).cast("string"), F.lit(","), F.lpad((b % 1000).cast("string"), 3, "0"))

    o, p = F.col("order_id"), F.col("part_id")
    return series(spark, sf).select("well_id", "pos", F.concat(
        F.lit("Losses at "), num(o % 8, p), F.lit(" m and "), num(p % 7, o), F.lit(" m in Formation "),
        F.when(F.col("line_no") % 2 == 0, "X").otherwise("Y"), F.when(F.col("quantity") > 25, " then Kick").otherwise("")).alias("t"))


@query("f7_mentions", with_sql("series", f"""
SELECT well_id, pos, d[1] AS first_depth, d[2] AS second_depth,
  array_to_string(list_filter(['Kick','Stuck Pipe','Losses'], lambda n: contains(t, n)), ',') AS events,
  array_to_string(list_filter(['Formation X','Formation Y'], lambda n: contains(t, n)), ',') AS formations FROM (
  SELECT well_id, pos, t, list_transform(regexp_extract_all(t, '(\\d,\\d{{3}}) m', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT)) AS d
  FROM (SELECT well_id, pos, {_REPORT_SQL} AS t FROM series))"""))
def f7(spark, sf):
    d = T.depth_mentions("t")
    return _reports(spark, sf).select(
        "well_id", "pos", F.get(d, F.lit(0)).alias("first_depth"), F.get(d, F.lit(1)).alias("second_depth"),
        F.array_join(T.mentions("t", ["Kick", "Stuck Pipe", "Losses"]), ",").alias("events"),
        F.array_join(T.mentions("t", ["Formation X", "Formation Y"]), ",").alias("formations"))


@query("f8_parse_fraction", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3
  WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity + (l_partkey % 8)/8e0 END AS inches FROM lineitem""")
def f8(spark, sf):
    whole = F.col("l_quantity").cast("int").cast("string")
    text = (F.when(F.col("l_linenumber") % 3 == 0, whole)
            .when(F.col("l_linenumber") % 3 == 1, F.concat(whole, F.lit(" "), (F.col("l_partkey") % 8).cast("string"), F.lit("/8")))
            .otherwise("casing"))
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                    N.parse_fraction(text).alias("inches"))


@query("f9_units", with_sql("series", f"""SELECT well_id, pos, {R6('g/0.0518894e0')} AS ppg, {R6('quantity*0.0518894e0')} AS gradient,
 {R6('g/0.433e0')} AS sg_ft, {R6('quantity*0.0518894e0*depth')} AS psi, {R6('g/(0.0518894e0*depth)')} AS back_ppg, {R6('quantity/8.345e0')} AS sg,
 {R6('quantity*8.345e0')} AS sg_ppg, {R6('depth*3.28084e0')} AS feet, {R6('depth/3.28084e0')} AS metres, {R6('price*0.0689476e0')} AS bar,
 {R4('quantity*737.56e0')} AS lbft, {R4('quantity*0.0518894e0*(depth*3.28084e0)')} AS psi_at FROM (SELECT *, tax + 0.4e0 AS g FROM series)"""))
def f9(spark, sf):
    s = series(spark, sf).withColumn("g", F.col("tax") + 0.4)
    r = lambda c, d=6: N.round_half_up(c, d)
    return s.select(
        "well_id", "pos", r(N.gradient_to_ppg("g")).alias("ppg"), r(N.ppg_to_gradient("quantity")).alias("gradient"),
        r(N.gradient_to_sg("g")).alias("sg_ft"), r(N.ppg_to_psi("quantity", "depth")).alias("psi"),
        r(N.psi_to_ppg("g", "depth")).alias("back_ppg"), r(N.ppg_to_sg("quantity")).alias("sg"),
        r(N.sg_to_ppg("quantity")).alias("sg_ppg"), r(N.metres_to_feet("depth")).alias("feet"),
        r(N.feet_to_metres("depth")).alias("metres"), r(N.psi_to_bar("price")).alias("bar"),
        r(N.knm_to_lbft("quantity"), 4).alias("lbft"), r(N.psi_at_depth("quantity", "depth"), 4).alias("psi_at"))


def hav_sql(lat1, lng1, lat2, lng2, r="6371e0"):
    return (f"(2*{r}*asin(least(1e0, sqrt(pow(sin(radians({lat2}-({lat1}))/2), 2) + cos(radians({lat1}))*cos(radians({lat2}))"
            f"*pow(sin(radians({lng2}-({lng1}))/2), 2)))))")


def course_sql(lat1, lng1, lat2, lng2):
    d = f"radians({lng2}-({lng1}))"
    return (f"atan2(sin({d})*cos(radians({lat2})), cos(radians({lat1}))*sin(radians({lat2})) - "
            f"sin(radians({lat1}))*cos(radians({lat2}))*cos({d}))")


def bearing_sql(*a):
    return f"fmod(degrees({course_sql(*a)}) + 360, 360e0)"


def cross_sql(lat, lng, lat1, lng1, lat2, lng2):
    d = f"({hav_sql(lat1, lng1, lat, lng)}/6371e0)"
    return f"(asin(sin({d})*sin({course_sql(lat1, lng1, lat, lng)} - {course_sql(lat1, lng1, lat2, lng2)}))*6371e0)"


def along_sql(lat, lng, lat1, lng1, lat2, lng2):
    d = f"({hav_sql(lat1, lng1, lat, lng)}/6371e0)"
    return f"(atan2(sin({d})*cos({course_sql(lat1, lng1, lat, lng)} - {course_sql(lat1, lng1, lat2, lng2)}), cos({d}))*6371e0)"


@query("f10_haversine", with_sql("places", f"""SELECT place_id, {R4(hav_sql('10e0', '20e0', 'lat', 'lng'))} AS km,
 {R4(hav_sql('10e0', '20e0', 'lat', 'lng', '6371.0088e0'))} AS mean_km FROM places"""))
def f10(spark, sf):
    a = (F.lit(10.0), F.lit(20.0), "lat", "lng")
    register_geo(spark)
    return places(spark, sf).select("place_id", N.round_half_up(haversine_km(*a), 4).alias("km"),
                                    N.round_half_up(F.expr("haversine_km(10D, 20D, lat, lng)"), 4).alias("mean_km"))


@query("f11_bearing", with_sql("places", f"""SELECT place_id, {R4(bearing_sql('10e0', '20e0', 'lat', 'lng'))} AS deg,
 {R4(bearing_sql('10e0', '20e0', 'lat', 'lng'))} AS sql_deg FROM places"""))
def f11(spark, sf):
    register_geo(spark)
    return places(spark, sf).select(
        "place_id", N.round_half_up(bearing_deg(F.lit(10.0), F.lit(20.0), "lat", "lng"), 4).alias("deg"),
        N.round_half_up(F.expr("bearing_deg(10D, 20D, lat, lng)"), 4).alias("sql_deg"))


@query("f12_cross_track", with_sql("places", f"""SELECT place_id,
 {R4(cross_sql('lat', 'lng', '-50e0', '-100e0', '45e0', '60e0'))} AS across, {R4(along_sql('lat', 'lng', '-50e0', '-100e0', '45e0', '60e0'))} AS along
 FROM places"""))
def f12(spark, sf):
    line = [F.lit(v) for v in (-50.0, -100.0, 45.0, 60.0)]
    return places(spark, sf).select("place_id", N.round_half_up(cross_track_km("lat", "lng", *line), 4).alias("across"),
                                    N.round_half_up(along_track_km("lat", "lng", *line), 4).alias("along"))


@query("f13_sigmoid_clamp_loss", with_sql("series", f"""SELECT well_id, pos, {R6('1/(1+exp(-z))')} AS p, greatest(0e0, least(1e0, z)) AS c,
 {R6("CASE WHEN flag='R' THEN -ln(1/(1+exp(-z))) ELSE -ln(1-1/(1+exp(-z))) END")} AS loss FROM (
 SELECT *, (quantity-25)/10e0 AS z FROM series)"""))
def f13(spark, sf):
    s = series(spark, sf).withColumn("z", (F.col("quantity") - 25) / 10.0)
    p = N.sigmoid("z")
    return s.select("well_id", "pos", N.round_half_up(p, 6).alias("p"), N.clamp("z", 0, 1).alias("c"),
                    N.round_half_up(N.log_loss(p, (F.col("flag") == "R").cast("int")), 6).alias("loss"))


@query("f14_round_half_up", with_sql("series", f"""SELECT well_id, pos, {half_up_sql('(pos-100)/2e0', 0)} AS r0, {half_up_sql('price/8e0', 2)} AS r2,
 {half_up_sql('-price/8e0', 1)} AS r1 FROM series"""))
def f14(spark, sf):
    return series(spark, sf).select("well_id", "pos", N.round_half_up((F.col("pos") - 100) / 2.0, 0).alias("r0"),
                                    N.round_half_up(F.col("price") / 8.0, 2).alias("r2"),
                                    N.round_half_up(-F.col("price") / 8.0, 1).alias("r1"))


@query("f15_circular", with_sql("series", f"""SELECT well_id, pos, {R4('sin(a*pi()/180)')} AS s, {R4('cos(a*pi()/180)')} AS c
 FROM (SELECT *, CAST(order_id % 360 AS DOUBLE) AS a FROM series)"""))
def f15(spark, sf):
    s, c = N.circular(F.col("order_id") % 360)
    return series(spark, sf).select("well_id", "pos", N.round_half_up(s, 4).alias("s"), N.round_half_up(c, 4).alias("c"))


@query("f16_margins", with_sql("series", f"""SELECT well_id, pos, {half_up_sql('mud-pp', 3)} AS overbalance_ppg, {half_up_sql('fg-ecd', 3)} AS fracture_margin_ppg,
 CASE WHEN mud-pp < 0.2e0 THEN 1 ELSE 0 END AS is_underbalanced, CASE WHEN ecd > fg-0.4e0 THEN 1 ELSE 0 END AS is_overbalanced_ecd
 FROM (SELECT *, 8e0+quantity/10 AS mud, 8.3e0+quantity/10+discount*5 AS ecd, 9e0+tax*20 AS pp, 12e0+discount*10 AS fg FROM series)"""))
def f16(spark, sf):
    from strataframe.features.extract import margin_features

    q = F.col("quantity") / 10
    cols = margin_features(8.0 + q, 8.3 + q + F.col("discount") * 5, 9.0 + F.col("tax") * 20, 12.0 + F.col("discount") * 10)
    return series(spark, sf).select("well_id", "pos", *[c.alias(n) for n, c in cols.items()])


@query("f17_dates", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS VARCHAR) AS shifted,
 CAST(year(o_orderdate) AS INTEGER) AS y, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso FROM orders""")
def f17(spark, sf):
    d = F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd")
    return read_table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(d, (F.col("o_orderkey") % 30).cast("int")).cast("string").alias("shifted"),
        F.year("o_orderdate").alias("y"), d.cast("string").alias("iso"))


@query("f18_join_present", """SELECT event_id, concat_ws(' ', nullif(CASE WHEN value > 100 THEN event_type END, ''),
 CASE WHEN user_id % 2 = 0 THEN 'Outcome: ' || user_id || '.' END, 'end') AS body FROM events""")
def f18(spark, sf):
    return read_table(spark, sf, "events").select("event_id", T.join_present(
        " ", F.when(F.col("value") > 100, F.col("event_type")),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Outcome: "), F.col("user_id").cast("string"), F.lit("."))), F.lit("end")).alias("body"))


@query("f20_vector_roundtrip", with_sql("series", f"""SELECT well_id, pos, quantity AS torque, 0e0 AS gap, CAST({len(FEATURE_NAMES)} AS INTEGER) AS width FROM series"""))
def f20(spark, sf):
    s = series(spark, sf).withColumns({n: F.lit(None).cast("double") for n in FEATURE_NAMES}).withColumn("torque_knm", F.col("quantity"))
    v = s.select("well_id", "pos", to_vector().alias("v"))
    o = v.select("well_id", "pos", "v", vector_to_object("v").alias("o"))
    return o.select("well_id", "pos", F.col("o")["torque_knm"].alias("torque"), F.col("o")["spp_psi"].alias("gap"),
                    F.size("v").alias("width"))


@query("f21_average_path_length", with_sql("series", f"""SELECT n, {R6('CASE WHEN n <= 1 THEN 0e0 WHEN n = 2 THEN 1e0 ELSE 2*(ln(n-1)+0.5772156649e0) - 2*(n-1)/n::DOUBLE END')} AS c
 FROM (SELECT DISTINCT pos AS n FROM series)"""))
def f21(spark, sf):
    return series(spark, sf).select(F.col("pos").alias("n")).distinct().select(
        "n", N.round_half_up(N.average_path_length("n"), 6).alias("c"))


@query("f23_number_or", """SELECT event_id, CASE WHEN event_type = 'view' THEN 7e0 WHEN event_type='error' THEN 7e0 ELSE value END AS x FROM events""")
def f23(spark, sf):
    raw = F.when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return read_table(spark, sf, "events").select("event_id", N.number_or(raw, 7.0).alias("x"))


# Report sentences written by Spark from the incidents, then read back by the extractor.
_WORDS = ["minor", "slight", "moderate", "severe", "major"]
_PHRASES = ["Mud Loss", "Influx", "Differential Sticking", "Torque Spike"]


def _narratives(spark, sf):
    ev = incidents(spark, sf)
    m = F.col("start_md").cast("bigint")
    comma = F.concat(F.floor(m / 1000).cast("string"), F.lit(","), F.lpad((m % 1000).cast("string"), 3, "0"))
    shown = F.when((F.col("event_id") % 3 == 0) & (m >= 1000), F.concat(comma, F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit(" m")))
    opener = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("While drilling ahead at "), shown)).otherwise(
        F.concat(F.lit("Between "), m.cast("string"), F.lit(" m and "), F.col("end_md").cast("bigint").cast("string"), F.lit(" M")))
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]),
                          (F.array_position(F.array(*[F.lit(c) for c in ["MUD_LOSS", "KICK", "STUCK_PIPE", "TORQUE_SPIKE"]]), F.col("category"))).cast("int"))
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), F.col("severity").cast("int"))
    text = F.concat(opener, F.lit(" a "), F.lower(phrase), F.lit(" was encountered. The incident was "), word,
                    F.lit(". NPT for this event was booked at "), F.format_string("%.1f", "npt_hours"), F.lit(" hours."))
    name = F.element_at(F.array(F.concat(F.lit("W-"), F.col("well_id").cast("string")), F.concat(F.lit("w "), F.col("well_id").cast("string")),
                                F.concat(F.lit("W"), F.col("well_id").cast("string"))), (F.col("event_id") % 3 + 1).cast("int"))
    return ev.withColumns({"text": text, "spoken": name})


@query("f22_extract_facts", with_sql("incidents", """SELECT event_id, category,
 CASE severity WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 5 END AS severity, CAST(start_md AS BIGINT) AS from_m,
 CASE WHEN event_id % 2 = 0 THEN CAST(start_md AS BIGINT) ELSE CAST(end_md AS BIGINT) END AS to_m, npt_hours, well_id FROM incidents"""))
def f22(spark, sf):
    told = _narratives(spark, sf).select("event_id", "text", "spoken")
    wells = places(spark, sf).select(F.concat(F.lit("W-"), F.col("place_id").cast("string")).alias("well_name"), F.col("place_id").alias("well_id"))
    got = X.resolve_names(X.extract_facts(told, "text"), "spoken", wells, "well_name", "well_id")
    return got.select("event_id", "category", "severity", "from_m", "to_m", "npt_hours", "well_id")


@query("f22_entity_scores", with_sql("incidents", """
SELECT entity, tp, fp, fn, CASE WHEN tp+fp > 0 THEN floor(tp/(tp+fp)::DOUBLE*1e4+0.5)/1e4 ELSE 0 END AS precision,
 CASE WHEN tp+fn > 0 THEN floor(tp/(tp+fn)::DOUBLE*1e4+0.5)/1e4 ELSE 0 END AS recall,
 CASE WHEN tp > 0 THEN floor(2*tp/(2*tp+fp+fn)::DOUBLE*1e4+0.5)/1e4 ELSE 0 END AS f1 FROM (
 SELECT 'category' AS entity, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM incidents
 UNION ALL SELECT 'severity', count(*) FILTER (WHERE severity IN (1, 3, 5)), count(*) FILTER (WHERE severity NOT IN (1, 3, 5)),
   count(*) FILTER (WHERE severity NOT IN (1, 3, 5)) FROM incidents
 UNION ALL SELECT 'npt', count(*), 0, 0 FROM incidents)"""))
def f22b(spark, sf):
    told = _narratives(spark, sf)
    got = X.extract_facts(told.select("event_id", "text"), "text")
    def long(df, cat, sev, npt):
        return df.select("event_id", F.explode(F.array(
            F.struct(F.lit("category").alias("entity"), cat.alias("value")),
            F.struct(F.lit("severity").alias("entity"), sev.cast("string").alias("value")),
            F.struct(F.lit("npt").alias("entity"), npt.cast("string").alias("value")))).alias("e")).select("event_id", "e.*")

    cols = (F.col("category"), F.col("severity").cast("bigint"), F.col("npt_hours"))
    return X.entity_scores(long(got, *cols), long(told, *cols), ["event_id"])


@query("f22_fuzzy_names", with_sql("places", """SELECT place_id AS well_id, place_id AS found, CASE WHEN place_id % 2 = 0 THEN 'W-A' ELSE 'W-Z' END ||
 CAST(place_id*1000+777 AS VARCHAR) AS asked FROM places"""))
def f22c(spark, sf):
    p = places(spark, sf).select("place_id", (F.col("place_id") * 1000 + 777).cast("string").alias("no"))
    wells = p.select(F.concat(F.lit("W-A"), "no").alias("well_name"), F.col("place_id").alias("found"))
    asked = p.select(F.col("place_id").alias("well_id"), F.concat(F.when(F.col("place_id") % 2 == 0, "W-A").otherwise("W-Z"), "no").alias("asked"))
    return X.fuzzy_names(asked, "asked", wells, "well_name", "found")


