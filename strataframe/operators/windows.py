"""Series windows: trailing baselines, slopes, smoothing, islands, covers, episodes, ranks, versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from strataframe.functions.numeric import finite
from strataframe.operators.series import (
    NEVER_HOT, bordered, inside, join_keyed, keyed, order_cols, position, row_frames, running,
)

# Trailing windows in rows, history needed, and the smallest usable baseline.
ROLLING_ROWS = 20
SLOPE_ROWS = 12
SLOPE_SCALE = 20
MIN_HISTORY = 3
MIN_PIT_HISTORY = 4
EPS = 1e-6


def trailing(w: WindowSpec, n: int = ROLLING_ROWS) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def _middle(held: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Median of the values marked `ok` in every row, NaN without any."""
    counts = ok.sum(axis=1)
    ranked = np.sort(np.where(ok, held, np.inf), axis=1)
    rows = np.arange(len(held))
    low, high = ranked[rows, np.maximum(counts - 1, 0) // 2], ranked[rows, counts // 2]
    return np.where(counts == 0, np.nan, np.where(low == high, low, 0.5 * low + 0.5 * high))


def _slope(held: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Least-squares slope of the values marked `ok` against their place in the row, NaN below two of them."""
    counts = ok.sum(axis=1)
    n = np.maximum(counts, 1)[:, None]
    place, value = np.where(ok, np.arange(held.shape[1], dtype=float), 0.0), np.where(ok, held, 0.0)
    off = np.where(ok, place - place.sum(axis=1, keepdims=True) / n, 0.0)
    up = np.where(ok, value - value.sum(axis=1, keepdims=True) / n, 0.0)
    return np.divide((off * up).sum(axis=1), (off * off).sum(axis=1), out=np.full(len(held), np.nan), where=counts > 1)


def trailing_frames(df: DataFrame, by: list[str], order: list[str], medians: list[str] = [], slopes: dict[str, tuple[str, int]] = {},  # noqa: B006
                    n: int = ROLLING_ROWS, limit: float | None = None) -> DataFrame:
    """Medians and slopes over the rows before the current one, and the counts of finite values behind them.

    `medians` lists columns (`_w_med_c`, `_w_cnt_c`, over `n` rows), `slopes` is {name: (column, rows)} (`_w_slope_name`,
    `_w_have_name`, against the row index). A sliding frame in Spark folds its rows anew for every row; here sorted rows come
    in Arrow batches, and each batch keeps the last rows of the one before it.
    """
    back = max([n] * bool(medians) + [k for _, k in slopes.values()])
    cut, parts = bordered(df, by, order, back, limit=limit)
    placed = position(cut, parts, order, "_w_row", NEVER_HOT)  # the rows of a part come one after another
    used = sorted({*medians, *(c for c, _ in slopes.values())})
    asked = [(f"_w_med_{c}", f"_w_cnt_{c}", used.index(c), n, _middle) for c in medians]
    asked += [(f"_w_slope_{o}", f"_w_have_{o}", used.index(c), k, _slope) for o, (c, k) in slopes.items()]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        tails, last = [np.full(back, np.nan) for _ in used], -1
        for place, *values in batches:
            row = place.to_numpy(zero_copy_only=False)
            if ((row != 1) & (row != np.append(last, row)[:-1] + 1)).any():
                raise RuntimeError("rows of a key do not follow one another")
            last, earlier, views, out = row[-1] if len(row) else last, row[:, None] - 1, [], []
            for i, v in enumerate(values):
                full = np.concatenate([tails[i], v.to_numpy(zero_copy_only=False).astype(float)])
                tails[i] = full[len(full) - back:]
                views.append(np.lib.stride_tricks.sliding_window_view(full, back)[:len(row)])
            for _, _, i, k, measure in asked:
                held = views[i][:, back - k:]
                ok = (np.arange(k) >= k - earlier) & ~np.isnan(held)
                out += [pa.array(measure(held, ok), from_pandas=True), pa.array(ok.sum(axis=1))]
            yield pa.StructArray.from_arrays(out, [name for a in asked for name in a[:2]])

    found = F.arrow_udf(run, ", ".join(f"`{value}` double, `{count}` long" for value, count, *_ in asked)).asNondeterministic()
    return inside(placed.withColumn("_w", found("_w_row", *[finite(c) for c in used])).select("*", "_w.*").drop("_w", "_w_row"))


def local_ratio(col: str) -> Column:
    """Value over its trailing median; 1 with under three earlier values or a median near zero."""
    med = F.col(f"_w_med_{col}")
    usable = (F.col(f"_w_cnt_{col}") >= MIN_HISTORY) & (F.abs(med) >= EPS)
    return F.when(usable, F.coalesce(F.col(col), F.lit(0.0)) / med).otherwise(F.lit(1.0))


def trailing_deficit(col: str) -> Column:
    """Trailing median minus the value; 0 with under three earlier values (the value is its own baseline)."""
    base = F.when(F.col(f"_w_cnt_{col}") >= MIN_HISTORY, F.col(f"_w_med_{col}")).otherwise(F.col(col))
    return base - F.coalesce(F.col(col), F.lit(0.0))


def trailing_slope(name: str, least: int = MIN_HISTORY, scale: float = SLOPE_SCALE) -> Column:
    """The slope of `trailing_frames` times `scale`; 0 below `least` values."""
    return F.when(F.col(f"_w_have_{name}") >= least, F.col(f"_w_slope_{name}") * scale).otherwise(F.lit(0.0))


def smooth(w: WindowSpec, col: str, back: int = 5) -> Column:
    return F.avg(col).over(w.rowsBetween(-back, 0))


def forward_peak(w: WindowSpec, col: str, k: int) -> Column:
    """Highest value over the current and the next k-1 rows, at least 0."""
    return F.greatest(F.lit(0.0), F.max(F.col(col).cast("double")).over(w.rowsBetween(0, k - 1)))


def _trailed(framed: DataFrame, then: dict[str, Column]) -> DataFrame:
    """Columns over what `trailing_frames` found, without that."""
    out = framed.withColumns(then)
    return out.drop(*[c for c in out.columns if c.startswith("_w_")])


def local_ratios(df: DataFrame, by: list[str], order: list[str], cols: list[str], n: int = ROLLING_ROWS) -> DataFrame:
    return _trailed(trailing_frames(df, by, order, cols, n=n), {f"{c}_ratio": local_ratio(c) for c in cols})


def deficits(df: DataFrame, by: list[str], order: list[str], cols: list[str], n: int = ROLLING_ROWS) -> DataFrame:
    return _trailed(trailing_frames(df, by, order, cols, n=n), {f"{c}_deficit": trailing_deficit(c) for c in cols})


def slopes(df: DataFrame, by: list[str], order: list[str], specs: dict[str, tuple],
           limit: float | None = None) -> DataFrame:
    """specs: {out: (column, rows, least, scale)}."""
    framed = trailing_frames(df, by, order, slopes={o: (c, n) for o, (c, n, _, _) in specs.items()}, limit=limit)
    return _trailed(framed, {o: trailing_slope(o, least, scale) for o, (_, _, least, scale) in specs.items()})


def smoothed(df: DataFrame, by: list[str], order: list[str], col: str, back: int = 5, out: str = "smoothed") -> DataFrame:
    return row_frames(df, by, order, lambda w: {out: smooth(w, col, back)}, before=back)


def forward_peaks(df: DataFrame, by: list[str], order: list[str], col: str, k: int, out: str = "peak") -> DataFrame:
    return row_frames(df, by, order, lambda w: {out: forward_peak(w, col, k)}, after=k - 1)


def stride_sample(df: DataFrame, by: list[str], order: list[str], ratio: float) -> DataFrame:
    """Every n-th row of the ordered key, starting with the first, with n = round(1 / ratio)."""
    stride = 1 if ratio >= 1 else max(1, int(1 / ratio + 0.5))
    return position(df, by, order, "_p").where((F.col("_p") - 1) % stride == 0).drop("_p")


def islands(df: DataFrame, by: list[str], order: list[str], starts, out: str = "island", look_back: int = 1) -> DataFrame:
    """Number runs of rows: `starts(window)` is true on the first row of a run. Islands count from 1 per key."""
    flagged = row_frames(df, by, order, lambda w: {"_start": F.coalesce(starts(w).cast("int"), F.lit(1))},
                         before=look_back)
    return running(flagged, by, order, {out: ("sum", F.col("_start").cast("bigint"))}).drop("_start")


def gap_cluster(df: DataFrame, by: list[str], at: str, tie: list[str], gap: float, cap: int) -> DataFrame:
    """Clusters broken at gaps of `gap` or more and after every `cap` members; adds `island` and `bucket`."""
    order = [at, *tie]
    isl = islands(df, by, order, lambda w: F.col(at) - F.lag(at).over(w) >= gap)
    seq = position(isl, [*by, "island"], order, "_n")
    return seq.withColumn("bucket", F.floor((F.col("_n") - 1) / cap)).drop("_n")


def merge_intervals(df: DataFrame, by: list[str], lo: str, hi: str, tie: list[str], tol: float = 1.0) -> DataFrame:
    """Disjoint cover per key: windows whose start is within `tol` of the cover so far are merged."""
    order = [lo, *tie]
    run = running(df, by, order, {"_before": ("max", F.col(hi))}, include_current=False)
    flag = F.when(F.col("_before").isNull() | (F.col(lo) > F.col("_before") + tol), 1).otherwise(0)
    run = running(run, by, order, {"island": ("sum", flag.cast("bigint"))})
    return run.groupBy(*by, "island").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("members")
    )


def survey_path(df: DataFrame, by: list[str], md: str = "md_m", inc: str = "inclination_deg",
                azi: str = "azimuth_deg", step: float = 30.0) -> DataFrame:
    """Stations with their displacement north and east of the head, vertical depth and dogleg.

    Each station moves half a step along its own direction; dogleg is the change of inclination from the one before,
    the first station counting from vertical.
    """
    i, a = F.radians(F.col(inc)), F.radians(F.col(azi))
    move = F.sin(i) * (step / 2)
    out = running(df, by, [md], {"north_m": ("sum", move * F.cos(a)), "east_m": ("sum", move * F.sin(a))})
    return row_frames(
        out.withColumn("tvd_m", F.col(md) * F.cos(i)), by, [md],
        lambda w: {"dogleg_deg": F.abs(F.col(inc) - F.coalesce(F.lag(inc).over(w), F.lit(0.0)))}, before=1,
    )


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "avg_rank") -> DataFrame:
    """1-based rank with ties sharing their mean rank. Ranks run over distinct values, so heavy ties stay cheap."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running(counts, by, [value], {"_upto": ("sum", F.col("_n"))})
    ranks = run.select(*by, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return join_keyed(df, ranks, [*by, value], "inner")


def latest_n(df: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """The newest n rows by `order` (listed newest-first); sort the result ascending to read them in time order.

    Keyed form relies on Spark's per-group limit, which trims groups before the shuffle.
    """
    if not by:
        return df.orderBy(*order_cols(order)).limit(n)
    return df.withColumn("_n", F.row_number().over(keyed(by, order))).where(F.col("_n") <= n).drop("_n")


def version_parts(col: str = "version") -> Column:
    return F.transform(F.split(F.col(col), r"\."), lambda x: x.cast("int"))


def latest_version(df: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Adds `is_latest` per name, versions compared number by number."""
    top = df.groupBy(name).agg(F.max_by(version, version_parts(version)).alias("_top"))
    out = join_keyed(df, top, [name])
    return out.withColumn("is_latest", F.col(version) == F.col("_top")).drop("_top")


def top_fraction(df: DataFrame, by: list[str], order: list[str], fraction: float) -> DataFrame:
    """The first `max(1, floor(fraction * n))` rows of each key in `order`."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    ranked = join_keyed(position(df, by, order, "_n"), sizes, by, "inner")
    keep = F.greatest(F.lit(1), F.floor(F.col("_size") * fraction))
    return ranked.where(F.col("_n") <= keep).drop("_n", "_size")


def index_time(df: DataFrame, by: list[str], order: list[str], start: Column, step_seconds: int,
               out: str = "ts") -> DataFrame:
    """Timestamps from the row index: start + (row - 1) * step."""
    pos = position(df, by, order, "_p")
    seconds = (F.col("_p") - 1) * step_seconds
    return pos.withColumn(out, F.timestamp_seconds(F.unix_timestamp(start) + seconds)).drop("_p")


def nearest_rank(df: DataFrame, by: list[str], value: str, p: float, out: str) -> DataFrame:
    """Per key the element at `min(n-1, floor(n*p))` of the sorted values.

    Counts per distinct value replace the sorted list, so a key with many rows costs its distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running(counts, by, [value], {"_upto": ("sum", F.col("_n"))})
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size")) if by else None
    if by:
        run = join_keyed(run, sizes, by, "inner")
    else:
        run = run.withColumn("_size", counts.agg(F.sum("_n").alias("_size")).scalar())
    at = F.least(F.col("_size") - 1, F.floor(F.col("_size") * p))
    hit = run.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at))
    return hit.select(*by, F.col(value).alias(out))


def percentile_table(df: DataFrame, actual: str, predicted: str, percents=(50, 75, 90, 95, 99),
                     tie: str = "row_id") -> DataFrame:
    """Mean actual and predicted over the lowest p percent of actual values, for each p."""
    order = [actual, tie]
    run = running(df, [], order, {
        "_n": ("count", F.lit(1)), "_a": ("sum", F.col(actual).cast("double")),
        "_p": ("sum", F.col(predicted).cast("double")),
    })
    total = df.agg(F.count(F.lit(1)).alias("_size"))
    spec = F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("percentile")
    marks = total.select(spec, "_size").select(
        "percentile",
        (F.least(F.col("_size") - 1, F.floor(F.col("percentile") * F.col("_size") / 100)) + 1).alias("rows_in"),
    )
    return marks.join(run, marks.rows_in == run._n).select(
        "percentile", "rows_in",
        (F.col("_a") / F.col("rows_in")).alias("mean_actual"),
        (F.col("_p") / F.col("rows_in")).alias("mean_predicted"),
    )

