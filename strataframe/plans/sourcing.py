"""Sources, sinks and keyed maintenance over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.plans.frames import samples
from strataframe.plans.registry import query
from strataframe.session import fresh_path
from strataframe.sources.bundles import active_bundles, export_bundle, manifest, missing_files, read_bundles
from strataframe.sources.keyed import delete_keys, gaps, ingest_batch, insert_new, upsert
from strataframe.sources.replay import replay_table
from strataframe.sources.tables import append_validated, load_training, parse_json_cols, read_table, table_counts

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


@query("s1_read_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier")


@query("s2_parse_json", "SELECT event_id, event_type, CAST(props->>'k' AS BIGINT) AS k FROM events")
def s2(spark, sf):
    ev = parse_json_cols(read_table(spark, sf, "events"), {"props": "k bigint"})
    return ev.select("event_id", "event_type", F.col("props.k").alias("k"))


def _training(spark, sf):
    """Line items as training rows: risk from the line status, version from the return flag."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("well_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("split_group"),
        F.col("l_quantity").alias("depth"), F.xxhash64(*li.columns).alias("row_id"),
        F.when(F.col("l_linestatus") == "O", "MUD_LOSS").otherwise("KICK").alias("risk_type"),
        F.when(F.col("l_returnflag") == "N", "v0.9.0").otherwise("v1.0.0").alias("feature_version"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("target_value"), "l_extendedprice", "l_discount")


@query("s3_load_training", """
SELECT s_name AS well_name, 'S' || CAST(l_suppkey AS VARCHAR) AS split_group, l_quantity AS depth,
  CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS label, CASE WHEN l_tax > 0 THEN l_tax ELSE 0e0 END AS target_value,
  l_extendedprice, l_discount
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE l_linestatus='O' AND l_returnflag <> 'N'""")
def s3(spark, sf):
    wells = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_name").alias("well_name"))
    out = load_training(_training(spark, sf), wells, "MUD_LOSS", "v1.0.0")
    return out.select("well_name", "split_group", "depth", "label", "target_value", "l_extendedprice", "l_discount")


def _balances(spark, sf):
    base = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"),
                                                    F.col("c_mktsegment").alias("tag"))
    new = read_table(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("tag"),
        F.col("o_orderkey").alias("seq"))
    return base, new


_BASE = "base AS (SELECT c_custkey AS id, c_acctbal AS amount, c_mktsegment AS tag FROM customer)"
_NEW = """news AS (SELECT o_custkey*2 AS id, o_totalprice AS amount, o_orderstatus AS tag, o_orderkey AS seq FROM orders)"""


@query("s4_upsert", f"""WITH {_BASE}, {_NEW},
last AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, amount, tag FROM base WHERE id NOT IN (SELECT id FROM last)
UNION ALL SELECT id, amount, tag FROM last""")
def s4(spark, sf):
    base, new = _balances(spark, sf)
    return upsert(base, new, ["id"], ["seq"])


@query("s5_insert_new", f"""WITH {_BASE}, {_NEW},
fst AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)
SELECT id, amount, tag FROM base
UNION ALL SELECT id, amount, tag FROM fst WHERE id NOT IN (SELECT id FROM base)""")
def s5(spark, sf):
    base, new = _balances(spark, sf)
    return insert_new(base, new, ["id"], ["seq"])


@query("s6_delete_keys", """
SELECT o_orderpriority AS tag, count(*) AS n, CAST(sum(CAST(o_totalprice*100 AS BIGINT)) AS BIGINT) AS cents FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R') GROUP BY 1""")
def s6(spark, sf):
    gone = read_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = delete_keys(read_table(spark, sf, "orders"), gone, ["o_orderkey"])
    return left.groupBy(F.col("o_orderpriority").alias("tag")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query("s8_append_validated", """
SELECT event_id, user_id, event_type, coalesce(CASE WHEN value >= 250 THEN value END, 0e0) AS npt_hours
FROM events WHERE event_type <> 'signup'""")
def s8(spark, sf):
    ev = samples(spark, sf).select(
        "event_id", F.col("well_id").alias("user_id"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("event_type"),
        F.when(F.col("value") >= 250, F.col("value")).alias("npt_hours"))
    good, _ = append_validated(ev, ["event_id", "user_id", "event_type"], {"npt_hours": 0.0})
    return good


def _bundles(spark, sf):
    """Model records from the running totals of event types, one version per weekday."""
    s = samples(spark, sf)
    return s.groupBy("event_type", F.dayofweek("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("training_rows"), F.avg("value").alias("mean"), F.max("ts").alias("trained_at")).select(
        F.concat(F.lit("risk_"), F.col("event_type")).alias("name"), F.concat(F.lit("1."), F.col("d") + 5, F.lit(".0")).alias("version"),
        F.col("event_type").alias("risk_type"), F.lit("classifier").alias("kind"), F.lit("logistic_regression").alias("algorithm"),
        F.lit("v1.0.0").alias("feature_version"), "training_rows", "trained_at",
        F.to_json(F.struct("mean")).alias("metrics"), F.lit("{}").alias("card"), F.lit("{}").alias("artifact"))


@query("s9_export_bundle", """
SELECT 'risk_' || event_type AS name, '1.' || CAST(dayofweek(ts)+6 AS VARCHAR) || '.0' AS version,
  count(*) AS training_rows, dayofweek(ts) = max(dayofweek(max(ts))) OVER (PARTITION BY event_type) AS is_latest
FROM events GROUP BY event_type, dayofweek(ts)""")
def s9(spark, sf):
    path = fresh_path(spark, "bundles")
    export_bundle(_bundles(spark, sf), path)
    back = read_bundles(spark, path)
    return manifest(back).join(back.select("name", "version", "training_rows"), ["name", "version"]).select(
        "name", "version", "training_rows", "is_latest")


@query("s10_read_active_bundles", """
SELECT 'risk_' || event_type AS name, '1.12.0' AS version, count(*) AS training_rows
FROM events WHERE dayofweek(ts) = 6 GROUP BY event_type""")
def s10(spark, sf):
    path = fresh_path(spark, "bundles")
    b = _bundles(spark, sf)
    export_bundle(b, path)
    # Broken and foreign records beside the bundles are skipped.
    b.select(F.concat(F.lit("{broken "), F.col("name")).alias("value")).write.text(f"{path}/model=broken")
    b.select(F.lit("other/1").alias("schema"), "name").write.json(f"{path}/model=foreign")
    listed = manifest(read_bundles(spark, path)).where("is_latest").select("name", "version")
    active = active_bundles(read_bundles(spark, path))
    present = active.join(missing_files(listed, active), ["name", "version"], "left_anti")
    return present.select("name", "version", "training_rows")


@query("s11_table_counts", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES]
    + ["SELECT 'absent' AS table_name, CAST(NULL AS BIGINT) AS n"]))
def s11(spark, sf):
    return table_counts(spark, sf, [*TABLES, "absent"])


def _ingest(spark, sf):
    s = samples(spark, sf).select("well_id", F.date_trunc("hour", "ts").alias("ts"), "event_id", "value", "event_type")
    base = s.where("event_type = 'signup'").groupBy("well_id", "ts").agg(F.min("event_id").alias("event_id"))
    batch = s.where("event_type <> 'signup'").select("well_id", "ts", "event_id", "value")
    return ingest_batch(base, batch, "well_id", "ts", ["event_id"], ["well_id", "ts", "value"], {"value": (0.0, 200.0)},
                        86_400)


_INGEST = """WITH s AS (SELECT user_id AS well_id, date_trunc('hour', ts) AS ts, event_id, value, event_type FROM events),
base AS (SELECT DISTINCT well_id, ts FROM s WHERE event_type = 'signup'),
batch AS (SELECT * FROM s WHERE event_type <> 'signup'),
good AS (SELECT * FROM batch WHERE value BETWEEN 0 AND 200),
firsts AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY well_id, ts ORDER BY event_id) = 1),
accepted AS (SELECT f.* FROM firsts f LEFT JOIN base b ON b.well_id=f.well_id AND b.ts=f.ts WHERE b.well_id IS NULL)
"""


@query("s12_ingest_accepted", _INGEST + "SELECT well_id, epoch_us(ts) AS ts_us, event_id, value FROM accepted")
def s12(spark, sf):
    acc, _, _ = _ingest(spark, sf)
    return acc.select("well_id", F.unix_micros("ts").alias("ts_us"), "event_id", "value")


@query("s12_ingest_report", _INGEST + """
SELECT (SELECT count(*) FROM accepted) AS accepted, (SELECT count(*) FROM good) - (SELECT count(*) FROM accepted) AS duplicates,
  (SELECT count(*) FROM batch) - (SELECT count(*) FROM good) AS rejected""")
def s12_report(spark, sf):
    return _ingest(spark, sf)[1]


@query("s12_ingest_gaps", _INGEST + """
SELECT well_id, epoch_us(prev) AS from_us, epoch_us(ts) AS to_us, (epoch_us(ts)-epoch_us(prev))/1e6 AS gap_seconds FROM (
  SELECT well_id, ts, lag(ts) OVER (PARTITION BY well_id ORDER BY ts) AS prev FROM accepted)
WHERE (epoch_us(ts)-epoch_us(prev))/1e6 > 86400""")
def s12_gaps(spark, sf):
    return _ingest(spark, sf)[2].select("well_id", F.unix_micros("gap_from").alias("from_us"),
                                        F.unix_micros("gap_to").alias("to_us"), "gap_seconds")


@query("s13_replay_stream", """
SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type""")
def s13(spark, sf):
    from strataframe.streaming.jobs import drain

    back = drain(replay_table(spark, sf, "events").select("event_id", "event_type"), "replay")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("s12_gap_report", """
SELECT user_id AS well_id, count(*) AS gaps_n, max(sec) AS longest FROM (
  SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))/1e6 AS sec
  FROM events) WHERE sec > 43200 GROUP BY user_id""")
def gap_report(spark, sf):
    g = gaps(samples(spark, sf), ["well_id"], "ts", ["event_id"], 43_200)
    return g.groupBy("well_id").agg(F.count(F.lit(1)).alias("gaps_n"), F.max("gap_seconds").alias("longest"))
