"""Ordered-series primitives that stay exact when one key holds a large share of all rows.

A plain keyed window sorts a whole key in one task. That is the right plan until some key outgrows a task, so every
primitive here first checks key sizes. Below `spark.strataframe.hotRows` rows per key (default 4 million) the plain
window is used: one shuffle, one sort. Above it rows are cut into ranges of the key and all order columns, of any type;
ranges are processed in parallel and joined up by a prefix over per-range summaries (`running`) or by repeating a few
border rows (`row_frames`). Where the cuts fall changes no result but the last digits of running sums of doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strataframe.session import settle

HOT_ROWS = 4_000_000
NEVER_HOT = float("inf")


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.strataframe.hotRows", str(HOT_ROWS)))


def _name(o: str) -> tuple[str, bool]:
    return (o[1:], True) if o.startswith("-") else (o, False)


def order_cols(order: list[str]) -> list[Column]:
    """`["a", "-b"]` -> a ascending, b descending."""
    return [F.col(n).desc() if d else F.col(n).asc() for n, d in map(_name, order)]


def keyed(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order_cols(order))


def same_key(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & left[c].eqNullSafe(right[c])
    return out


def join_keyed(left: DataFrame, right: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Equi join on `cols` with null keys matching each other; the right key copies are dropped."""
    r = right.select(*[F.col(c).alias(f"_k_{c}") if c in cols else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in cols:
        on = on & left[c].eqNullSafe(r[f"_k_{c}"])
    return left.join(r, on, how).drop(*[f"_k_{c}" for c in cols])


def over_limit(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Keys with more than `limit` rows: at most rows/limit of them."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")


def has_hot_key(df: DataFrame, by: list[str], limit: float) -> bool:
    """Two cheap jobs at most: the row count alone already rules out most tables. None for an infinite limit."""
    if limit == NEVER_HOT or df.count() <= limit:
        return False
    return not over_limit(df.select(*by), by, limit).isEmpty() if by else True


def checked_limit(df: DataFrame, by: list[str]) -> float:
    """The hot limit when `df` has a hot key, else infinity: lets one check serve several operators in a row."""
    limit = hot_limit(df)
    return limit if has_hot_key(df, by, limit) else NEVER_HOT


def with_segments(df: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Adds `_seg`: ranges of the rows in order of key and `order`, of about half of `limit` rows, numbered in that order.

    Rows that tie on the key and all order columns share a range. The numbers are written, so later jobs see the same.
    """
    written = settle(df, "series")
    ranges = max(2, -(-2 * written.count() // int(limit)))
    dealt = written.repartitionByRange(ranges, *[F.col(b) for b in by], *order_cols(order))
    return settle(dealt.withColumn("_seg", F.spark_partition_id()), "ranges")


_MERGE = {
    "count": lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
    "sum": lambda here, before: F.coalesce(here + before, here, before),
    "max": lambda here, before: F.greatest(here, before),
    "min": lambda here, before: F.least(here, before),
    "last": lambda here, before: F.coalesce(here, before),
}


def _apply(kind: str, col: Column) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True)
    return {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}[kind](col)


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    include_current: bool = True,
    limit: float | None = None,
) -> DataFrame:
    """Cumulative `count | sum | max | min | last` (last = last non-null) per key.

    `order` must be unique within a key, or rows that tie must agree on the values folded.
    """
    limit = hot_limit(df) if limit is None else limit
    end = 0 if include_current else -1
    split = has_hot_key(df, by, limit)
    if not split:
        w = keyed(by, order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({o: _apply(k, c).over(w) for o, (k, c) in aggs.items()})

    cut = with_segments(df, by, order, limit).withColumns({f"_v_{o}": c for o, (_, c) in aggs.items()})
    parts = [*by, "_seg"]
    w = keyed(parts, order).rowsBetween(Window.unboundedPreceding, end)
    here = cut.withColumns({f"_h_{o}": _apply(k, F.col(f"_v_{o}")).over(w) for o, (k, _) in aggs.items()})
    ranked = cut.withColumn("_row", F.row_number().over(keyed(parts, order)))

    def total(o, kind):
        v = F.col(f"_v_{o}")
        return F.max_by(v, F.when(v.isNotNull(), F.col("_row"))) if kind == "last" else _apply(kind, v)

    totals = ranked.groupBy(*parts).agg(*[total(o, k).alias(f"_t_{o}") for o, (k, _) in aggs.items()])
    before = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *parts, *[_apply("sum" if k == "count" else k, F.col(f"_t_{o}")).over(before).alias(f"_b_{o}")
                  for o, (k, _) in aggs.items()]
    )
    out = join_keyed(here, carry, parts)
    out = out.withColumns({o: _MERGE[k](F.col(f"_h_{o}"), F.col(f"_b_{o}")) for o, (k, _) in aggs.items()})
    return out.drop("_seg", *[f"_{p}_{o}" for p in "vhb" for o in aggs])


def position(df: DataFrame, by: list[str], order: list[str], out: str = "pos", limit: float | None = None) -> DataFrame:
    """Exact 1-based row number per key."""
    return running(df, by, order, {out: ("count", F.lit(1))}, limit=limit)


def bordered(df: DataFrame, by: list[str], order: list[str], before: int, after: int = 0, limit: float | None = None
             ) -> tuple[DataFrame, list[str]]:
    """Rows with what they look back and ahead to, and the columns that part them: `by`, or blocks of hot keys as well.

    Rows copied into a neighbouring block go again with `inside`.
    """
    limit = hot_limit(df) if limit is None else limit
    if not has_hot_key(df, by, limit):
        return df, by
    size = max(limit, before, after, 1)
    at = F.col("_pos") - 1
    own = F.floor(at / size)
    blocks = F.array_compact(
        F.array(
            own,
            F.when(at % size >= size - before, own + 1) if before else F.lit(None).cast("bigint"),
            F.when((at % size < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    cut = position(df, by, order, "_pos", limit).withColumn("_own", own).withColumn("_blk", F.explode(blocks))
    return cut, [*by, "_blk"]


def inside(df: DataFrame) -> DataFrame:
    """Rows of `bordered` without the copies."""
    return df.where(F.col("_own") == F.col("_blk")).drop("_pos", "_own", "_blk") if "_blk" in df.columns else df


def row_frames(
    df: DataFrame,
    by: list[str],
    order: list[str],
    exprs: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    limit: float | None = None,
) -> DataFrame:
    """Evaluate window expressions that look at most `before` rows back and `after` rows ahead.

    `exprs` receives the ordered window and returns {name: column}. Keys over the limit are cut into blocks of `limit`
    rows; border rows are copied into the neighbouring block for the evaluation and dropped again.
    """
    cut, parts = bordered(df, by, order, before, after, limit)
    return inside(cut.withColumns(exprs(keyed(parts, order))))
