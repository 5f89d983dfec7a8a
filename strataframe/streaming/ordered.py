"""Keyed rules over rows in time order, whatever order they arrive in.

Rows of a bucket of keys wait in list state until the watermark has passed them; a timer then hands them on, key by key and
sorted, to a step that also gets what it kept of earlier rows. Micro-batches may be cut anywhere: the rule sees one sorted
series per key. State holds the rows of one watermark delay and the few rows the step keeps; rows later than the watermark
are dropped (`split_late` shows them).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Buckets that share out the keys; a bucket is a group of the state.
BUCKETS = 256

# Rows of a key by column, {} for none.
Rows = dict[str, np.ndarray]
# (kept rows, rows in order) -> (rows to keep, output without the key)
Step = Callable[[Rows, Rows], tuple[Rows, Rows]]
# (kept rows, watermark in microseconds) -> (rows to keep, output); and when to look again, in microseconds
Idle = tuple[Callable[[Rows, int], tuple[Rows, Rows]], Callable[[Rows], int | None]]


@contextmanager
def keyed_state(spark: SparkSession):
    """List state and timers need the RocksDB store; queries started inside use it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _size(rows: Rows) -> int:
    return len(next(iter(rows.values()))) if rows else 0


def _order(rows: Rows, group: np.ndarray, by: list[str]) -> np.ndarray:
    """Places of the rows in order of their group and the columns `by`."""
    if any(rows[c].dtype == object for c in by):
        frame = pd.DataFrame({"_g": group, **{c: rows[c] for c in by}})
        return frame.sort_values(["_g", *by], kind="stable").index.to_numpy()
    return np.lexsort([*[rows[c] for c in reversed(by)], group])


class InOrder(StatefulProcessor):
    """Buffer, timer and kept rows of the keys of one bucket.

    Every call to the state and every group costs milliseconds, whatever its size, so keys share buckets, the rows of one
    micro-batch wait as one packed value, and the timer stands beside the kept rows.
    """

    def __init__(self, columns: list[str], sort: list[str], step: Step, key: list[str], idle: Idle | None):
        self.columns, self.sort, self.step, self.key, self.idle = columns, sort, step, key, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.mark = handle.getValueState("mark", "due bigint, kept binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, passed = None, max(0, timerValues.getCurrentWatermarkInMs())
        for pdf in rows:
            new = {c: pdf[c].to_numpy() for c in self.columns}
            if (old := new["at_us"] < passed * 1000).any():  # rows before these were handed on already
                new = {c: v[~old] for c, v in new.items()}
            if _size(new):
                self.waiting.appendValue((pickle.dumps(new),))
                first = min(x for x in (first, int(new["at_us"].min()) // 1000) if x is not None)
        if first is not None:
            due, kept = self.mark.get() or (None, None)
            at = max(first, passed + 1)
            if due is None or at < due:  # one timer per key, at the earliest instant that matters
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(at)
                self.mark.update((at, kept))
        yield from ()

    def _ready(self, passed: int) -> tuple[Iterator[tuple[tuple, Rows]], int | None]:
        """The rows that the watermark has passed, key by key, and the instant of the first that still waits."""
        if not self.waiting.exists():
            return iter(()), None
        parts = [pickle.loads(r[0]) for r in self.waiting.get()]
        held = {c: np.concatenate([p[c] for p in parts]) for c in self.columns}
        past = held["at_us"] < passed * 1000
        rest = {c: v[~past] for c, v in held.items()}
        self.waiting.put([(pickle.dumps(rest),)]) if _size(rest) else self.waiting.clear()
        now = {c: v[past] for c, v in held.items()}
        group = pd.DataFrame({k: now[k] for k in self.key}).groupby(self.key, dropna=False, sort=False).ngroup().to_numpy()
        at = _order(now, group, self.sort)
        now, cuts = {c: v[at] for c, v in now.items()}, np.flatnonzero(np.diff(group[at], prepend=-1, append=-1)) if len(at) else []
        one = (({c: v[a:b] for c, v in now.items()}) for a, b in zip(cuts, cuts[1:]))
        return ((tuple(r[k][0] for k in self.key), r) for r in one), int(rest["at_us"].min()) // 1000 if _size(rest) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        packed = (self.mark.get() or (None, None))[1]
        kept, out, wake = pickle.loads(packed) if packed else {}, [], []
        ready, first = self._ready(passed)
        for k, rows in ready:
            kept[k], made = self.step(kept.get(k, {}), rows)
            out.append((k, made))
        wake += [first] if first is not None else []
        if self.idle:
            for k in kept:
                kept[k], made = self.idle[0](kept[k], passed * 1000)
                out.append((k, made))
                later = self.idle[1](kept[k])
                wake += [later // 1000 + 1] if later is not None else []
        kept = {k: rows for k, rows in kept.items() if _size(rows)}
        due = max(min(wake), passed + 1) if wake else None
        if due is not None:
            self.handle.registerTimer(due)  # the timer that fired is gone
        if due is not None or kept:
            self.mark.update((due, pickle.dumps(kept) if kept else None))
        else:
            self.mark.clear()
        out = [(k, made) for k, made in out if _size(made)]
        if out:
            times = [_size(made) for _, made in out]
            keys = {c: np.repeat(np.array([k[i] for k, _ in out], dtype=object), times) for i, c in enumerate(self.key)}
            yield pd.DataFrame({**keys, **{c: np.concatenate([made[c] for _, made in out]) for c in out[0][1]}})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: list[str], ts: str, tie: list[str], values: list[str], step: Step, out: str,
             watermark: str, idle: Idle | None = None) -> DataFrame:
    """`key` and the columns `out` (DDL) that `step` gives for each key's rows in order of time and `tie`.

    The step gets `at_us` (microseconds), `tie` and `values` of rows that the watermark has passed, and the rows it kept
    before, all by column. Rows with a null time never pass and are left out. Output comes once the watermark is past, so what lies
    within the delay of the newest row stays in state when a bounded stream ends.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("state_bucket")
    src = stream.where(F.col(ts).isNotNull()).withWatermark(ts, watermark).select(
        bucket, *[F.col(k).cast("string").alias(f"key_{k}") for k in key], ts, F.unix_micros(F.col(ts)).alias("at_us"),
        *dict.fromkeys([*tie, *values]))  # keys as text: a whole number beside nulls would come as a double
    names = [f"key_{k}" for k in key]
    processor = InOrder(src.drop("state_bucket", ts).columns, ["at_us", *tie], step, names, idle)
    shape = T.StructType.fromDDL(", ".join([*[f"{k} string" for k in names], out]))
    made = src.groupBy("state_bucket").transformWithStateInPandas(processor, shape, "Append", "EventTime")
    return made.select(*[F.col(f"key_{k}").cast(stream.schema[k].dataType).alias(k) for k in key],
                       *[c for c in shape.names if c not in names])
