"""Nearest, ranked and nested top-k. Every ordering ends in an explicit tie-break."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.series import keyed


def nearest_k(df: DataFrame, col: str, at: float, k: int, then: list) -> DataFrame:
    """The k rows closest to `at`; `then` are the order columns after distance."""
    return df.withColumn("distance", F.abs(F.col(col) - at)).orderBy("distance", *then).limit(k)


def topk(df: DataFrame, by: list[str], order: list[str], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key with their rank. Spark trims each group to k rows before the shuffle."""
    n = F.row_number().over(keyed(by, order))
    return df.withColumn(rank, n).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def topk_list(df: DataFrame, by: list[str], order: list[str], k: int, fields: list[str], out: str) -> DataFrame:
    """Per key the first k rows as a list of structs in rank order."""
    best = topk(df, by, order, k, "_rank")
    packed = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_rank", *fields))).alias("_l"))
    return packed.select(*by, F.transform("_l", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(out))


def over_fetch(df: DataFrame, by: list[str], order: list[str], limit: int, factor: int = 3) -> DataFrame:
    """Candidates for fusing: `factor` times what will be shown."""
    return topk(df, by, order, limit * factor)


