"""Which offsets can be among the first of a target. All pairs are scored in numpy, block by block; none is written."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.functions.geo import RADIUS_KM, unit_xyz
from strataframe.operators.joins import asof_steps, grid_cell, sphere_cells
from strataframe.operators.series import keyed, row_frames
from strataframe.session import settle

CANDIDATES, ASKED = 2048, 8192  # the most places of either side that a block is meant to hold
BLOCKS = 16  # blocks of a task
CELLS = 2**16  # pairs looked at in one step
SLACK_KM = 1e-3  # distances in Spark and numpy differ by far less
NEVER = 2**62  # the worst key of a pair that counts for nothing


def level_steps(events: DataFrame, by: list[str], at: str, reach: float, levels: int) -> DataFrame:
    """How many events lie within `reach` of a place, up to `levels`, as steps: (by, at, lo, hi), to be summed up to a place.

    Of n events in a row all are within reach from the last less `reach` to the first plus `reach`. Where such stretches
    overlap they are one, and only its ends become steps, however dense the events are. At the very ends `lo` may be too
    small and `hi` too large.
    """
    e = F.col("_e")
    known = events.select(*by, F.col(at).cast("double").alias("_e")).where(F.abs(e) < float("inf"))

    def around(w):
        return {"_before": F.lag("_e").over(w), **{f"_after{n}": F.lead("_e", n).over(w) for n in range(1, levels + 1)}}

    rows = row_frames(known, by, ["_e"], around, before=1, after=levels)
    slack = lambda c: (F.abs(c) + F.lit(float(reach))) * 1e-12
    steps = []
    for sign, lo, hi in ((1, 1, 0), (-1, 0, 1)):
        low = lambda c, s=sign: c - float(reach) + slack(c) * s
        high = lambda c, s=sign: c + float(reach) - slack(c) * s
        for n in range(1, levels + 1):
            a, b = low(F.col(f"_after{n - 1}") if n > 1 else e), high(e)
            begins = (a <= b) & (F.col("_before").isNull() | (a > high(F.col("_before"))))
            ends = (a <= b) & (F.col(f"_after{n}").isNull() | (low(F.col(f"_after{n}")) > b))
            steps += [(begins, a, lo, hi), (ends, b, -lo, -hi)]
    # Rows of dense stretches hold no end of any level; they are known by two differences.
    wide = 2 * float(reach) - (F.abs(e) + float(reach)) * 1e-9
    back, ahead = F.col("_before"), F.col(f"_after{levels}")
    rows = rows.where(back.isNull() | ahead.isNull() | (ahead - e > wide) | ((F.col(f"_after{levels - 1}") if levels > 1 else e) - back > wide))
    made = [F.when(c, F.struct(x.alias("at"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for c, x, lo, hi in steps]
    return rows.select(*by, F.explode(F.array_compact(F.array(*made))).alias("_s")).select(*by, "_s.*")


def _odd(cols: list[str]) -> Column:
    """NaN or infinite: such values are not bounded."""
    return reduce(or_, [F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
                        for v in (F.col(c).cast("double") for c in cols)])


def _profiles(places: DataFrame, tops: DataFrame, events: DataFrame, marker: str, reach: float, levels: int) -> DataFrame:
    """Candidates (offset_id, lat, lng, copies) with `steps`: their top and number of events as functions of the depth."""
    numbers = [marker, "pp_gradient", "fg_gradient"]
    top = asof_steps(tops, ["offset_id"], marker, ["formation", *numbers], "first").select(
        "offset_id", F.coalesce("_at", F.lit(float("-inf"))).alias("at"), F.lit(True).alias("top"), "formation",
        *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(numbers)], _odd(numbers).alias("odd"))
    level = level_steps(events, ["offset_id"], "event_depth", reach, levels).withColumn("top", F.lit(False))
    steps = top.unionByName(level, allowMissingColumns=True)
    steps = steps.groupBy("offset_id").agg(F.collect_list(F.struct(*[c for c in steps.columns if c != "offset_id"])).alias("steps"))
    spots = places.groupBy(F.col("place_id").alias("offset_id")).agg(
        F.count(F.lit(1)).alias("copies"), F.explode(F.collect_set(F.struct("lat", "lng"))).alias("_s"))
    return spots.select("offset_id", "copies", "_s.*").join(steps, "offset_id")


def _asked(targets: DataFrame, own: DataFrame, marker: str) -> DataFrame:
    """Targets (place_id, lat, lng, depth) once each, with their own top; `loose` where a place has several depths."""
    numbers = [f"t_{marker}", "t_pp_gradient", "t_fg_gradient"]
    many = (F.min("depth") != F.max("depth")) | (F.count("depth") != F.count(F.lit(1)))
    spots = targets.groupBy("place_id").agg(F.count(F.lit(1)).alias("copies"), F.coalesce(many, F.lit(True)).alias("loose"),
                                            F.explode(F.collect_set(F.struct("lat", "lng", "depth"))).alias("_s"))
    own = own.where(F.col("t_formation").isNotNull()).select(
        "place_id", "depth", "t_formation", *[F.col(c).cast("double").alias(f"t{i}") for i, c in enumerate(numbers)],
        _odd(["depth", *numbers]).alias("odd")).distinct()
    return spots.select("place_id", "copies", "loose", "_s.*").join(own, ["place_id", "depth"])


def shortlist(targets: DataFrame, places: DataFrame, own: DataFrame, tops: DataFrame, events: DataFrame, spec, marker: str,
              weights: dict[str, float], same: float, step: float, cap: float) -> DataFrame:
    """Pairs (place_id, near_place_id) with all that can be among the first `spec.limit` of a target, and few others.

    Places of a cell of the sphere meet the targets of the 27 cells around it in blocks of bounded size. Every pair has a
    best and a worst rank key (score, distance, as rounded); what is worse at its best than the k-th at its worst is left
    out, first in its block, then among all blocks. Pairs whose numbers cannot be bounded stay.
    """
    spark, levels = targets.sparkSession, math.ceil(round(cap / step, 9))
    cell = sphere_cells(spec.radius_km + SLACK_KM)
    place = ["_cx", "_cy", "_cz"]

    def on_grid(df, *shift):
        cells = grid_cell("lat", "lng", cell, shift or (0, 0, 0))
        return df.withColumns({**dict(zip(place, cells)), **dict(zip("xyz", unit_xyz("lat", "lng")))}).dropna(subset=place)

    found = settle(on_grid(_profiles(places, tops, events, marker, spec.tolerance * 2, levels)), "profiles")
    shifts = [F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias(f"_d{n}") for n in "xyz"]
    asked = reduce(lambda df, s: df.select("*", s), shifts, _asked(targets, own, marker))
    asked = on_grid(asked, *[F.col(f"_d{n}") for n in "xyz"]).drop("_dx", "_dy", "_dz")
    full = found.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).alias("_of"))
    asked = settle(asked.join(full, place), "asked")
    tiles = settle(asked.groupBy(*place, "_of").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("_by")), "tiles")
    blocks = tiles.agg(F.sum(F.col("_of") * F.col("_by"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // BLOCKS))

    def dealt(df, own_id, own_n, other, other_n):
        df = df.withColumns({own_id[0]: F.pmod(F.xxhash64(own_id[1]), F.col(own_n)), other: F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))})
        return df.drop("_of", "_by").repartition(parts, *place, "_c", "_a").groupBy(*place, "_c", "_a")

    left = dealt(asked.join(tiles.drop("_of"), place), ("_a", "place_id"), "_by", "_c", "_of")
    right = dealt(found.join(tiles, place), ("_c", "offset_id"), "_of", "_a", "_by")
    out = T.StructType([targets.schema["place_id"], T.StructField("offset_id", places.schema["place_id"].dataType),
                        T.StructField("_best", T.LongType()), T.StructField("_worst", T.LongType())])
    run = _scorer(spec, weights, same, np.minimum(cap, step * np.arange(levels + 1)))
    near = left.cogroup(right).applyInArrow(run, out)

    first = F.row_number().over(keyed(["place_id"], ["_worst", "offset_id"]))
    last = F.max(F.when(F.col("_n") == spec.limit, F.struct("_worst", "offset_id"))).over(Window.partitionBy("place_id"))
    near = near.withColumn("_n", first).withColumn("_last", last)
    kept = F.col("_last").isNull() | (F.struct(F.col("_best"), F.col("offset_id")) <= F.col("_last"))
    return near.where(kept).select("place_id", F.col("offset_id").alias("near_place_id")).distinct()


def _pieces(lists, owners: int):
    """Steps of all candidates by candidate and depth, each with what holds from there on, and their candidates."""
    flat = lists.flatten()
    steps = dict(zip((f.name for f in flat.type), (c.to_numpy(zero_copy_only=False) for c in flat.flatten())))
    owner = np.repeat(np.arange(owners), lists.value_lengths().to_numpy())
    order = np.lexsort((steps["at"], owner))
    steps, owner = {c: v[order] for c, v in steps.items()}, owner[order]
    begin = np.searchsorted(owner, owner)
    is_top = steps["top"].astype(bool)
    seen = np.maximum.accumulate(np.where(is_top, np.arange(len(owner)), -1))
    known = seen >= begin
    out = {"at": steps["at"], "formation": np.where(known, steps["formation"][seen], None),
           "odd": known & np.where(is_top, steps["odd"], False).astype(bool)[seen]}
    out.update({c: steps[c][seen].astype(float) for c in ("v0", "v1", "v2")})
    for c in ("lo", "hi"):
        total = np.cumsum(np.where(is_top, 0, steps[c]).astype(np.int64))
        out[c] = total - np.where(begin > 0, total[begin - 1], 0)
    return out, owner


def _scorer(spec, weights, same, bonus):
    """Function of a block's targets and candidates that returns the pairs that can be among the first of a target."""
    radius, tolerance, k, top, earth = spec.radius_km, spec.tolerance, spec.limit, len(bonus) - 1, RADIUS_KM
    reach = (2 * math.sin(min((radius + SLACK_KM) / (2 * earth), math.pi / 2))) ** 2 * (1 + 1e-12)

    def closeness(a, b):
        spread = np.maximum(np.abs(a), np.abs(b))
        return np.where(spread == 0, 1.0, np.maximum(0.0, 1 - np.abs(a - b) / spread))

    def scores(asked, t, steps, s):
        total, known = 0.0, 0
        for n in (1, 2):
            v = closeness(asked[f"t{n}"][t], steps[f"v{n}"][s])
            known = known + ~np.isnan(v)
            total = total + np.nan_to_num(v)
        press = np.where(known > 0, total / np.maximum(known, 1), 0.0)
        delta = np.abs(asked["t0"][t] - steps["v0"][s])
        deep = np.where(delta > tolerance, 0.0, 1 - delta / tolerance)
        return np.where(steps["form"][s] == asked["form"][t], same, 0.0) + press * weights["pressure"] + deep * weights["depth"]

    def first(t, c, best, worst, ids, rows, width):
        """Pairs at their best not behind the k-th of their target at its worst, where the id is the last to decide."""
        table = np.full((rows, max(width, k)), NEVER)
        table[t, c] = worst
        last = np.partition(table, k - 1, axis=1)[:, k - 1]
        held = np.flatnonzero(best <= last[t])
        order = held[np.lexsort((ids[c[held]], worst[held], t[held]))]
        begin = np.searchsorted(t[order], np.arange(rows))
        kth = np.minimum(begin + k - 1, len(order) - 1)
        most = np.where(last < NEVER, ids[c[order[kth]]], -1) if len(order) else last
        return held[(best[held] < last[t[held]]) | (ids[c[held]] <= most[t[held]])]

    def run(left, right):
        import pandas as pd
        import pyarrow as pa

        picked = [np.zeros((4, 0), np.int64)]
        if left.num_rows and right.num_rows:
            n = right.num_rows
            asked = {c: left[c].to_numpy() for c in left.column_names}
            order = np.argsort(asked["depth"], kind="stable")
            asked = {c: v[order] for c, v in asked.items()}
            steps, owner = _pieces(right["steps"].combine_chunks(), n)
            codes, _ = pd.factorize(np.concatenate([steps["formation"], asked["t_formation"]]))
            steps["form"], asked["form"] = codes[: len(owner)], codes[len(owner):]
            _, ids = np.unique(np.concatenate([right["offset_id"].to_numpy(), asked["place_id"]]), return_inverse=True)
            ids, asked["id"] = ids[:n], ids[n:]
            xyz, copies = [right[c].to_numpy() for c in "xyz"], right["copies"].to_numpy()
            turns = np.argsort(steps["at"], kind="stable")
            upto = np.searchsorted(steps["at"][turns], asked["depth"], "right")
            step, now, size = 0, np.full(n, -1), max(1, CELLS // n)
            for begin in range(0, len(order), size):
                seen = upto[begin:begin + size]
                s = turns[step:seen[-1]]
                held = np.full((len(seen), n), -1)
                held[0] = now
                held[np.searchsorted(seen, np.arange(step, seen[-1]), "right"), owner[s]] = s  # of equal places the last holds
                np.maximum.accumulate(held, axis=0, out=held)
                step, now = seen[-1], held[-1].copy()
                chord = sum((x - asked[a][begin:begin + size, None]) ** 2 for x, a in zip(xyz, "xyz"))
                t, c = np.nonzero((chord <= reach) & (held >= 0))
                s, i = held[t, c], t + begin
                ok = (ids[c] != asked["id"][i]) & ((steps["form"][s] >= 0) | asked["odd"][i])
                t, c, s, i = t[ok], c[ok], s[ok], i[ok]
                km = 2 * earth * np.arcsin(np.minimum(1.0, np.sqrt(chord[t, c]) / 2))
                score = scores(asked, i, steps, s)
                loose, unknown = asked["loose"][i], steps["odd"][s] | asked["odd"][i]
                low = bonus[np.where(loose, 0, np.minimum(steps["lo"][s], top))]
                high = bonus[np.where(loose, top, np.minimum(steps["hi"][s] * copies[c] * asked["copies"][i], top))]
                best = np.where(unknown, -1, _key(score + high, 1e-6, km, -0.02))
                worst = np.where(unknown | (km > radius - SLACK_KM), NEVER, _key(score + low, -1e-6, km, 0.02))
                keep = first(t, c, best, worst, ids, len(seen), n)
                picked.append(np.stack([order[i[keep]], c[keep], best[keep], worst[keep]]))
        t, c, best, worst = np.concatenate(picked, axis=1)
        return pa.table({"place_id": left["place_id"].take(pa.array(t)), "offset_id": right["offset_id"].take(pa.array(c)),
                         "_best": pa.array(best), "_worst": pa.array(worst)})

    return run


def _key(score, more, km, less):
    """Rank as one number, small first: score to four places downwards, then kilometres to two places, both rounded half up."""
    s = np.floor(np.minimum(1.0, np.nan_to_num(score)) * 10_000 + 0.5 + more)
    return (10_000 - s).astype(np.int64) * 2**32 + np.floor(km * 100 + 0.5 + less).astype(np.int64)
