"""Rule episodes and cooldowns: a crossing opens an episode that claims what follows, so it cannot reopen at once.

Whether a crossing opens depends on the claim before it: the open ones are a chain, each the first at or after the end of
the claim before. Rows below the threshold are dropped first, and each key is cut into islands at gaps that no claim spans.
Chains are followed by pointer doubling, in numpy over the rows of a batch. An island over the hot limit is cut into blocks
of that many rows: every block reports where a chain that reaches one of its rows leaves it, the places where chains can
enter blocks are joined up by pointer doubling over tables, and then all blocks run in parallel with their true entry. No
task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.joins import asof_join
from strataframe.operators.series import has_hot_key, hot_limit, join_keyed, position
from strataframe.operators.windows import islands
from strataframe.session import settle

NEVER = float("-inf")


def _opened(new: np.ndarray, at: np.ndarray, length: np.ndarray, entry: np.ndarray, until: float) -> tuple[np.ndarray, float]:
    """Which rows of a batch open, and the end of the last claim. Rows are in order of group and time; `new` marks the first
    row of a group, `entry` the time from which a new group may open, `until` that of a group begun in an earlier batch.

    Rows without a time open nothing.
    """
    bound = np.concatenate([[until], entry[new]])
    fine = np.flatnonzero(~np.isnan(at))
    group, ends = np.cumsum(new)[fine], (at + length)[fine]
    n, m = len(fine), len(new)
    values, rank = np.unique(np.concatenate([at[fine], ends, bound]), return_inverse=True)
    place = group * len(values) + rank[:n]  # ascending
    first = np.searchsorted(place, np.arange(len(bound)) * len(values) + rank[2 * n:])
    jump = np.maximum(np.searchsorted(place, group * len(values) + rank[n: 2 * n]), np.arange(n) + 1)
    within = np.append(group, -1)  # a chain ends with its group
    jump = np.append(np.where(within[jump] == group, jump, n), n)
    mark = np.zeros(n + 1, dtype=bool)
    mark[first[within[first] == np.arange(len(bound))]] = True
    while (jump < n).any():
        mark[jump[mark]] = True
        jump = jump[jump]
    chosen = np.flatnonzero(mark[:n])
    opened = np.zeros(m, dtype=bool)
    opened[fine[chosen]] = True
    own = len(bound) - 1
    if len(chosen) and group[chosen[-1]] == own:
        return opened, ends[chosen[-1]]
    return opened, bound[own]


def _with_opens(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One streaming pass per partition over rows sorted by group and time; state is the end of the last claim.

    The window marks the first row of each group, null keys included, and leaves the rows in the order of the pass.
    """
    cols = df.columns
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    marked = df.withColumn("_first", first)

    def run(batches):
        until = NEVER
        for pdf in batches:
            if len(pdf):
                at, length, entry = (pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in ("_at", "_len", "_entry"))
                opened, until = _opened(pdf["_first"].to_numpy(dtype=bool), at, length, entry, until)
                yield pdf.assign(opened=opened)

    schema = marked.select("*", F.lit(True).alias("opened")).schema
    return marked.mapInPandas(run, schema).select(*cols, "opened")


def _exits(df: DataFrame, block: list[str]) -> DataFrame:
    """Per row the end of the last claim in its block of a chain through the row."""
    schema = df.select(*block, "_pos", F.col("_at").alias("_out")).schema

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        at = pdf["_at"].to_numpy(dtype="float64", na_value=np.nan)
        ends, own = at + pdf["_len"].to_numpy(dtype="float64", na_value=np.nan), np.arange(len(at))
        jump = np.maximum(np.searchsorted(at, ends), own + 1)
        jump = np.where(jump < len(at), jump, own)
        while (jump[jump] != jump).any():
            jump = jump[jump]
        return pdf.assign(_out=ends[jump])[[*block, "_pos", "_out"]]

    return df.groupBy(*block).applyInPandas(run, schema)


def _entries(cut: DataFrame, island: list[str], limit: float) -> DataFrame:
    """(island, _blk, _entry): the time of the row at which the chain from the island's first row enters a later block.

    Exits are few, as chains that meet stay together. The exit that follows each exit is known from the row it leads to; the
    exits on the chain from the first row are found in as many rounds as the number of blocks has binary digits.
    """
    rows = join_keyed(cut.where(F.col("_at").isNotNull()), cut.where("_blk = 1").select(*island).distinct(), island, "inner")
    exits = settle(_exits(rows.select(*island, "_blk", "_pos", "_at", "_len"), [*island, "_blk"]), "exits")
    places = rows.select(*island, F.col("_at").alias("_to_at"), F.col("_pos").alias("_to"), F.col("_blk").alias("_to_blk"))
    led = asof_join(exits.select(*island, "_out").distinct(), places.withColumn("_when", F.col("_to_at")), island, "_out",
                    "_when", ["_to", "_to_blk", "_to_at"], "forward", limit=limit)
    after = exits.select(*island, F.col("_pos").alias("_to"), F.col("_out").alias("_next"))
    step = settle(join_keyed(led, after, [*island, "_to"], "inner"), "steps")
    jump = step.select(*island, "_out", "_next")
    roots = exits.groupBy(*island).agg(F.min_by("_out", "_pos").alias("_out"))
    chain, blocks = roots, (exits.agg(F.max("_blk")).first()[0] or 0) + 1
    for _ in range(int(blocks).bit_length()):
        reached = join_keyed(chain, jump, [*island, "_out"], "inner").select(*island, F.col("_next").alias("_out"))
        chain = settle(chain.unionByName(reached).distinct(), "chain")
        second = jump.select(*island, F.col("_out").alias("_next"), F.col("_next").alias("_far"))
        jump = settle(join_keyed(jump, second, [*island, "_next"], "inner").select(
            *island, "_out", F.col("_far").alias("_next")), "jumps")
    on = join_keyed(step, chain, [*island, "_out"], "inner")
    return on.select(*island, F.col("_to_blk").alias("_blk"), F.col("_to_at").alias("_entry"))


def claim(df: DataFrame, by: list[str], at: str, length, tie: list[str], longest: float,
          limit: int | None = None) -> DataFrame:
    """Adds `opened` to crossings: true when no earlier open crossing of the key has claimed `at`.

    An open crossing claims `[at, at + length)`; `longest` is an upper bound on `length`. Crossings at one instant
    are taken in `tie` order and lengths must be positive.
    """
    limit = hot_limit(df) if limit is None else limit
    length = length if isinstance(length, Column) else F.lit(float(length))
    num = df.withColumn("_at", F.col(at).cast("double")).withColumn("_len", length.cast("double"))
    order = ["_at", *tie]
    isl = islands(num, by, order, lambda w: F.col("_at") - F.lag("_at").over(w) >= longest, "_isl")
    group = [*by, "_isl"]
    if not has_hot_key(isl, group, limit):
        out = _with_opens(isl.withColumn("_entry", F.lit(NEVER)), group, order)
        return out.drop("_at", "_len", "_entry", "_isl")
    cut = position(isl, group, order, "_pos").withColumn("_blk", F.floor((F.col("_pos") - 1) / limit))
    cut = settle(cut, "blocks")  # rows that tie on all of the order keep their numbers
    block = [*group, "_blk"]
    entered = join_keyed(cut, _entries(cut, group, limit), block)
    first = F.when(F.col("_blk") == 0, NEVER).otherwise(-NEVER)  # a block that no chain enters opens nothing
    out = _with_opens(entered.withColumn("_entry", F.coalesce("_entry", first)), block, ["_pos"])
    return out.drop("_at", "_len", "_entry", "_isl", "_pos", "_blk")


def detect_episodes(df: DataFrame, by: list[str], order: list[str], col: str, threshold: float, hold,
                    longest: int) -> DataFrame:
    """Rows that open an episode: `col` at or over `threshold` and not inside the `hold` rows claimed before."""
    rows = position(df, by, order, "row_no").where(F.col(col) >= threshold)
    return claim(rows, by, "row_no", hold, [], longest).where("opened").drop("opened")


def cooldown(df: DataFrame, by: list[str], ts: str, minutes: float, tie: list[str]) -> DataFrame:
    """Adds `opened`: the first alert of a key opens, later ones within `minutes` of the last open one are suppressed."""
    sec = df.withColumn("_ts", F.unix_micros(F.col(ts)) / F.lit(1e6))
    return claim(sec, by, "_ts", minutes * 60.0, tie, minutes * 60.0).drop("_ts")
