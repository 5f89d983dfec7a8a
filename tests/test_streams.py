"""Streams over several files, out of order, agree with one batch over all of them, through restarts too."""

import os
import shutil

from pyspark.sql import functions as F

from strataframe.alerts.batch import suppress
from strataframe.operators.windows import local_ratios
from strataframe.session import fresh_path
from strataframe.sources.keyed import gaps
from strataframe.sources.replay import record_deliveries, replay_stream, replay_table
from strataframe.streaming import jobs as J

SCHEMA = "k bigint, ts timestamp, id bigint, v double"
DELAY = "9 hours"  # a file spans 6.7


def base_rows(spark, n=160):
    return spark.range(n).select(
        (F.col("id") % 3).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 600 + F.pmod(F.hash("id"), F.lit(9000))).alias("ts"), "id",
        F.when(F.col("id") % 17 != 0, F.pmod(F.hash("id"), F.lit(40)).cast("double")).alias("v"))


def recorded(spark, files=4, n=160):
    """Files by time, every fifth row one file behind."""
    path = fresh_path(spark, "recording")
    base = base_rows(spark, n)
    slot = F.floor(F.col("id") / (n // files)) + F.when(F.col("id") % 5 == 0, 1).otherwise(0)
    record_deliveries(base, F.least(F.lit(files - 1), slot), files, path)
    closed = base.agg(F.max("ts")).first()[0].timestamp() - 9 * 3600
    return path, base, closed


def read(spark, path):
    return replay_stream(spark, path, SCHEMA)


def before(rows, closed, *cols):
    return sorted(tuple(r[c] for c in cols) for r in rows if r["ts"].timestamp() < closed - 1)


def test_gaps_and_suppression_equal_batch(spark):
    path, base, closed = recorded(spark)
    got = J.drain(J.gap_stream(read(spark, path), ["k"], "ts", "id", 2400, DELAY)).withColumnRenamed("gap_to", "ts").collect()
    want = gaps(base, ["k"], "ts", ["id"], 2400).withColumnRenamed("gap_to", "ts").collect()
    assert before(got, closed, "k", "gap_from", "ts") == before(want, closed, "k", "gap_from", "ts") != []
    got = J.drain(J.suppress_stream(read(spark, path), ["k"], "ts", "id", 100, DELAY)).collect()
    want = suppress(base, ["k"], "ts", ["id"], 100).where("opened").collect()
    assert before(got, closed, "k", "id") == before(want, closed, "k", "id") != []


def test_online_features_equal_batch(spark):
    path, base, closed = recorded(spark)
    make = J.online_features(read(spark, path), ["k"], "ts", ["id"], ["v"], 20, J.trailing_ratios(["v"]), "id bigint, v_ratio double", DELAY)
    got = {r["id"]: r["v_ratio"] for r in J.drain(make).collect()}
    want = {r["id"]: r["v_ratio"] for r in local_ratios(base, ["k"], ["ts", "id"], ["v"]).collect() if r["ts"].timestamp() < closed}
    assert got == want and len(got) > 90


def test_every_silence_is_told_once(spark):
    path, base, closed = recorded(spark)
    got = sorted((r["k"], r["last_us"]) for r in J.drain(J.stale_stream(read(spark, path), ["k"], "ts", DELAY, 1800)).collect())
    at = {}
    for r in base.collect():
        at.setdefault(r["k"], []).append(round(r["ts"].timestamp() * 1e6))
    want = [(k, a) for k, x in at.items() for a, b in zip(sorted(x), sorted(x)[1:] + [10**18]) if b - a > 1800e6 and a + 1800e6 < closed * 1e6]
    assert got == sorted(want) != []


def test_a_restart_goes_on_where_it_ended(spark):
    path, base, closed = recorded(spark)
    part, out, checkpoint = (fresh_path(spark, x) for x in ("part", "out", "checkpoint"))
    files = sorted((f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
    os.makedirs(part)
    for half in (files[:2], files[2:]):
        for f in half:
            shutil.copy2(f, part)
        J.drain(J.suppress_stream(read(spark, part), ["k"], "ts", "id", 100, DELAY), out=out, checkpoint=checkpoint)
    got = spark.read.parquet(out).collect()
    want = suppress(base, ["k"], "ts", ["id"], 100).where("opened").collect()
    assert before(got, closed, "k", "id") == before(want, closed, "k", "id") != []


def test_rows_behind_the_watermark_change_nothing(spark):
    path, base, closed = recorded(spark)
    late = base.limit(1).select("k", "ts", F.lit(999).cast("bigint").alias("id"), F.lit(1.0).alias("v"))
    late.coalesce(1).write.mode("append").parquet(path)
    got = {r["id"] for r in J.drain(J.suppress_stream(read(spark, path), ["k"], "ts", "id", 0.0001, DELAY)).collect()}
    assert 999 not in got and len(got) > 90


def test_late_rows_go_to_the_side_and_a_replayed_epoch_splits_alike(spark):
    path = fresh_path(spark, "recording")
    base = base_rows(spark)
    record_deliveries(base.unionByName(base.where("id = 3").withColumn("id", F.lit(999).cast("bigint"))),
                      F.when(F.col("id") == 999, 2).otherwise(F.floor(F.col("id") / 80)), 3, path)
    state, out = fresh_path(spark, "late-state"), fresh_path(spark, "late")
    side = lambda name: lambda b, e: b.write.mode("overwrite").parquet(f"{out}/{name}/epoch={e}")

    def run():
        J.split_late(read(spark, path), "ts", state, side("ok"), side("late"), 3 * 3600)
        return [sorted(r["id"] for r in spark.read.parquet(f"{out}/{s}").collect()) for s in ("ok", "late")]

    assert run() == [list(range(160)), [999]]
    commits = f"{state}/checkpoint/commits".removeprefix("file:")
    os.replace(f"{commits}/2", f"{commits}/../taken")  # as if it had stopped before the commit
    if os.path.exists(f"{commits}/.2.crc"):
        os.replace(f"{commits}/.2.crc", f"{commits}/../.taken.crc")
    assert run() == [list(range(160)), [999]]
    base.where("id = 4").withColumn("id", F.lit(998).cast("bigint")).coalesce(1).write.mode("append").parquet(path)
    assert run() == [list(range(160)), [998, 999]]  # a restart still knows the newest instant


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(30).select(F.col("id").alias("event_id"), F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
                           F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).repartition(3).write.parquet(f"{folder}/events.parquet")
    assert J.drain(replay_table(spark, folder, "events").select("event_id")).count() == 30
    assert J.drain(replay_table(spark, "/root/testdata/sf0.001", "events").select("event_id")).count() == 1000
