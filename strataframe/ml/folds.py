"""Folds and holdouts that keep all rows of a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators.series import join_keyed, position
from strataframe.session import settle


def turns_of_size(load: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """How `count` groups of one size go to the emptiest fold, as (first position, folds that take turns from there).

    The emptiest fold takes groups until the next one is as empty, then both take turns, and so on: at most one entry per
    fold, whatever the count. `load` is brought up to date. Ties go to the lower fold.
    """
    key = lambda f: (load[f], f)
    waiting, active, out, at = sorted(range(len(load)), key=key), [], [], 0
    while at < count:
        active = sorted([*active, waiting.pop(0)], key=key)
        turns = count - at
        if waiting:
            f = waiting[0]
            gaps = [(load[f] - load[a], a) for a in active]
            turns = min(turns, sum(gap // size + (1 if gap % size or a < f else 0) for gap, a in gaps if gap >= 0))
        if turns:
            out.append((at, list(active)))
            for i, a in enumerate(active):
                load[a] += size * (turns // len(active) + (i < turns % len(active)))
            at += turns
    return out


def fold_of_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): the largest group goes to the emptiest fold, size ties by key. A null group is a group.

    The driver walks the distinct sizes, of which n rows have at most sqrt(2n); groups find their fold by position.
    """
    sizes = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    load, plan = [0] * k, []
    for r in sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("_n")).collect():
        plan.append((r["_n"], turns_of_size(load, r["_n"], r["c"])))
    turns = df.sparkSession.createDataFrame(plan, "_n long, _turns array<struct<start: long, folds: array<int>>>")
    placed = position(sizes, ["_n"], [group], "_p").join(turns, "_n")
    at = F.col("_p") - 1
    mine = F.element_at(F.filter("_turns", lambda t: t["start"] <= at), -1)
    fold = F.get(mine["folds"], ((at - mine["start"]) % F.size(mine["folds"])).cast("int"))
    return placed.select(group, fold.alias("fold"))


def deal_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups are dealt out back and forth in order of size, size ties by key."""
    ranked = position(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), [], ["-_n", group], "_p")
    turn = (F.col("_p") - 1) % (2 * k)
    return ranked.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    return join_keyed(df, fold_of_groups(df, group, k), [group], "inner")


def group_holdout(df: DataFrame, group: str, fraction: float = 0.25, seed: int = 7) -> DataFrame:
    """Adds `holdout`: true for `max(1, round(groups * fraction))` groups in the order of a seeded hash."""
    groups = df.select(group).distinct()
    hashed = groups.withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", F.col(group).cast("string"),
                               F.lit(str(seed)))), 1, 12), 16, 10).cast("double"))
    ranked = position(hashed, [], ["_h", group], "_p")
    take = F.greatest(F.lit(1), F.floor(groups.agg(F.count(F.lit(1))).scalar() * F.lit(fraction) + 0.5))
    flags = ranked.select(group, (F.col("_p") <= take).alias("holdout"))
    return join_keyed(df, flags, [group], "inner")
