"""Keyed maintenance: upsert, insert-or-ignore, delete, idempotent batch ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.filters import reasons
from strataframe.operators.series import row_frames


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key by `order`; a partial aggregate, so hot keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def upsert(base: DataFrame, updates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Base with updates replacing or joining it; within the updates the last by `order` wins."""
    new = latest_per_key(updates, key, order).select(*base.columns)
    return base.join(new, key, "left_anti").unionByName(new)


def insert_new(base: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Base plus rows whose key is new; the first of several new rows by `order` is taken."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    new = first.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in base.columns])
    return base.unionByName(new.join(base.select(*key), key, "left_anti"))


def delete_keys(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def ingest_batch(base: DataFrame, batch: DataFrame, well: str, ts: str, tie: list[str], required: list[str],
                 ranges: dict[str, tuple], gap_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, one-row report, gaps).

    Idempotent on (well, ts): a key already stored or repeated inside the batch counts as duplicate, broken rows count
    as rejected. Gaps are steps over `gap_seconds` between accepted samples of a well.
    """
    key = [well, ts]
    checked = batch.withColumn("_bad", F.size(reasons(required, None, ranges)) > 0)
    bad, good = checked.where("_bad").drop("_bad"), checked.where(~F.col("_bad")).drop("_bad")
    rest = [c for c in batch.columns if c not in key]
    first = good.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*tie)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    fresh = first.join(base.select(*key), key, "left_anti")
    accepted = fresh.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in batch.columns])
    report = (
        good.agg(F.count(F.lit(1)).alias("valid"))
        .withColumn("accepted", fresh.agg(F.count(F.lit(1))).scalar())
        .withColumn("rejected", bad.agg(F.count(F.lit(1))).scalar())
        .select("accepted", (F.col("valid") - F.col("accepted")).alias("duplicates"), "rejected")
    )
    return accepted, report, gaps(accepted, [well], ts, [], gap_seconds)


def gaps(df: DataFrame, by: list[str], ts: str, tie: list[str], gap_seconds: float) -> DataFrame:
    """Steps between consecutive samples of a key longer than `gap_seconds`."""
    stepped = row_frames(df, by, [ts, *tie], lambda w: {"gap_from": F.lag(ts).over(w)}, before=1)
    secs = (F.unix_micros(F.col(ts)) - F.unix_micros(F.col("gap_from"))) / F.lit(1e6)
    return stepped.withColumn("gap_seconds", secs).where(F.col("gap_seconds") > gap_seconds).select(
        *by, "gap_from", F.col(ts).alias("gap_to"), "gap_seconds"
    )


