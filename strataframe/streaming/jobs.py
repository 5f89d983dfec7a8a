"""Stream forms of ingest, gaps, staleness, history windows, alerts and features.

Watermark policy: ten minutes by default, as an argument everywhere. Rows later than the watermark do not reach
stateful results; `split_late` sends them to a side output.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.alerts.batch import COOLDOWN_MIN, STALE_SECONDS, rule_alerts
from strataframe.functions.numeric import round_half_up
from strataframe.operators.windows import EPS, MIN_HISTORY, ROLLING_ROWS
from strataframe.session import fresh_path
from strataframe.streaming.ordered import Rows, in_order, keyed_state

WATERMARK = "10 minutes"


def drain(stream: DataFrame, label: str = "stream", mode: str = "append", out: str | None = None,
          checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything available now into a parquet folder of the shared directory and read it back.

    With the `out` and `checkpoint` of an earlier run it goes on where that one ended.
    """
    spark = stream.sparkSession
    out = out or fresh_path(spark, label)
    with keyed_state(spark):
        q = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint or fresh_path(spark, f"{label}-checkpoint")).outputMode(mode)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], label: str = "batches") -> None:
    """Run `fn` on each micro-batch until everything available now is done."""
    q = (stream.writeStream.foreachBatch(fn).trigger(availableNow=True)
         .option("checkpointLocation", fresh_path(stream.sparkSession, f"{label}-checkpoint")).start())
    q.awaitTermination()


def dedupe_stream(stream: DataFrame, key: list[str], ts: str, watermark: str = WATERMARK) -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)


def window_stream(stream: DataFrame, key: str, ts: str, value: str, size: str, slide: str | None = None,
                  watermark: str = WATERMARK) -> DataFrame:
    """Window averages per key, each emitted once its window is past the watermark."""
    win = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    out = stream.withWatermark(ts, watermark).groupBy(win.alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("_a"))
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                      round_half_up("_a", 6).alias("mean_value"))


def alert_stream(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """Scores that trip a rule; the rules are a small static side."""
    return rule_alerts(scores, rules)


def findings_stream(alerts: DataFrame, key: str, ts: str, gap: str, watermark: str = WATERMARK) -> DataFrame:
    """Alerts of a key with pauses under `gap` as one finding."""
    out = alerts.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("alerts"), F.max("score").alias("top_score"))
    return out.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("window_end"), "alerts", "top_score")


def suppress_stream(alerts: DataFrame, key: list[str], ts: str, tie: str, minutes: float = COOLDOWN_MIN,
                    watermark: str = WATERMARK) -> DataFrame:
    """(key, ts, tie) of the alerts that open; what is kept of a key is the instant of its last open alert."""
    limit = int(minutes * 60_000_000)

    def step(kept: Rows, rows: Rows) -> tuple[Rows, Rows]:
        us = rows["at_us"]
        opened, at = [], int(np.searchsorted(us, kept["last_us"][0] + limit)) if kept else 0
        while at < len(us):  # from one open alert to the next
            opened.append(at)
            at = max(at + 1, int(np.searchsorted(us, us[at] + limit)))
        made = {c: rows[c][opened] for c in ("at_us", tie)}
        return ({"last_us": made["at_us"][-1:]} if opened else kept), made

    kind = alerts.schema[tie].dataType.simpleString()
    out = in_order(alerts, key, ts, [tie], [], step, f"at_us bigint, {tie} {kind}", watermark)
    return out.select(*key, F.timestamp_micros("at_us").alias(ts), tie)


def gap_stream(stream: DataFrame, key: list[str], ts: str, tie: str, gap_seconds: float, watermark: str = WATERMARK) -> DataFrame:
    """(key, gap_from, gap_to, gap_seconds) for steps over `gap_seconds`; the last instant of a key is kept."""
    limit = gap_seconds * 1e6

    def step(kept: Rows, rows: Rows) -> tuple[Rows, Rows]:
        us = np.concatenate((kept["last_us"], rows["at_us"])) if kept else rows["at_us"]
        wide = np.flatnonzero(np.diff(us) > limit)
        return {"last_us": us[-1:]}, {"from_us": us[wide], "to_us": us[wide + 1]}

    out = in_order(stream, key, ts, [tie], [], step, "from_us bigint, to_us bigint", watermark)
    return out.select(*key, F.timestamp_micros("from_us").alias("gap_from"), F.timestamp_micros("to_us").alias("gap_to"),
                      ((F.col("to_us") - F.col("from_us")) / F.lit(1e6)).alias("gap_seconds"))


def stale_stream(stream: DataFrame, key: list[str], ts: str, watermark: str = WATERMARK, seconds: float = STALE_SECONDS) -> DataFrame:
    """(key, last_us, stale_us): every silence over `seconds`, told once, at the latest when the watermark has passed it.

    A silence that goes on is told by a timer; one that a later sample ends is told with that sample, if it was not yet.
    """
    limit = int(seconds * 1e6)

    def told(last: np.ndarray) -> Rows:
        return {"last_us": last, "stale_us": last + limit}

    def step(kept: Rows, rows: Rows) -> tuple[Rows, Rows]:
        us = np.concatenate((kept["last_us"], rows["at_us"])) if kept else rows["at_us"]
        silent = np.flatnonzero(np.diff(us) > limit)
        if kept and kept["told"][0]:
            silent = silent[silent > 0]
        return {"last_us": us[-1:], "told": np.zeros(1, bool)}, told(us[silent])

    def look(kept: Rows, passed: int) -> tuple[Rows, Rows]:
        due = kept and not kept["told"][0] and kept["last_us"][0] + limit < passed
        return (kept | {"told": np.ones(1, bool)}, told(kept["last_us"])) if due else (kept, {})

    def again(kept: Rows) -> int | None:
        return None if not kept or kept["told"][0] else int(kept["last_us"][0]) + limit

    return in_order(stream, key, ts, [], [], step, "last_us bigint, stale_us bigint", watermark, (look, again))


def split_late(stream: DataFrame, ts: str, state: str, accept: Callable[[DataFrame, int], None],
               late: Callable[[DataFrame, int], None], delay_seconds: float = 600) -> None:
    """Route rows older than the newest instant of earlier batches minus the delay to `late`, the rest to `accept`.

    The newest instant after each epoch is written below `state`, the query's own folder, before its outputs. A restart
    goes on from there, and a replayed epoch is split as the first time; sinks get the epoch and should overwrite by it.
    """
    spark: SparkSession = stream.sparkSession
    us = F.unix_micros(F.col(ts))

    def step(batch: DataFrame, epoch: int) -> None:
        newest = None if epoch == 0 else spark.read.schema("newest bigint").parquet(f"{state}/newest/{epoch - 1}").first()[0]
        here = batch.agg(F.max(us).alias("newest")).withColumn("newest", F.greatest("newest", F.lit(newest).cast("bigint")))
        here.write.mode("overwrite").parquet(f"{state}/newest/{epoch}")
        old = F.lit(False) if newest is None else F.coalesce(us < F.lit(newest - int(delay_seconds * 1e6)), F.lit(False))
        accept(batch.where(~old), epoch)
        late(batch.where(old), epoch)

    q = (stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{state}/checkpoint").start())
    q.awaitTermination()


def subscribe(stream: DataFrame, well: str, wells: list, sink: Callable[[DataFrame, int], None]) -> None:
    """Deliver only the chosen wells, batch by batch."""
    drain_batches(stream.where(F.col(well).isin(wells)), sink, "subscription")


def trailing_ratios(cols: list[str], history: int = ROLLING_ROWS, least: int = MIN_HISTORY) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Each value over the median of up to `history` values before it, as `local_ratios` has it in batch."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for c in cols:
            value = rows[c].astype(float)
            base = value.where(np.isfinite(value)).shift(1).rolling(history, min_periods=least).median()
            out[f"{c}_ratio"] = (value.fillna(0.0) / base).where(base.abs() >= EPS, 1.0)
        return rows.assign(**out)

    return make


def online_features(stream: DataFrame, key: list[str], ts: str, tie: list[str], values: list[str], history: int,
                    features: Callable[[pd.DataFrame], pd.DataFrame], out: str, watermark: str = WATERMARK) -> DataFrame:
    """`key` and the columns `out` (DDL) that `features` adds to or keeps of a key's rows, as over its whole series.

    A key keeps its last `history` rows in list state; features see them in front of the new rows. A batch or a replayed
    epoch touches the state of its own buckets of keys only.
    """
    names = T.StructType.fromDDL(out).names
    columns = ["at_us", *dict.fromkeys([*tie, *values])]

    def step(past: Rows, rows: Rows) -> tuple[Rows, Rows]:
        both = {c: np.concatenate((past[c], rows[c])) if past else rows[c] for c in columns}
        made, old = features(pd.DataFrame(both)), len(past["at_us"]) if past else 0
        return {c: v[-history:] for c, v in both.items()}, {c: made[c].to_numpy()[old:] for c in names}

    return in_order(stream, key, ts, tie, values, step, out, watermark)
