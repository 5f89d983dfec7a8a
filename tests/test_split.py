"""Keys over the hot limit take another path; results must not change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import joins as J
from strataframe.operators import series as S
from strataframe.operators import windows as W
from strataframe.operators.episodes import claim


@pytest.fixture(scope="module")
def skewed(spark):
    """300 rows of one key among 600; several rows share an instant."""
    r = spark.range(600)
    k = F.when(F.col("id") < 300, 0).otherwise(1 + F.col("id") % 20)
    at = F.floor(F.pmod(F.hash("id"), F.lit(100_000)) / 250).cast("double")
    v = F.when(F.col("id") % 9 != 0, F.pmod(F.hash("id", F.lit(3)), F.lit(50)).cast("double"))
    return r.select(k.alias("k"), at.alias("at"), "id", v.alias("v")).persist()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def both(fn):
    return rows(fn(S.NEVER_HOT)), rows(fn(40))


def test_running_matches_plain_window(skewed):
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    a, b = both(lambda lim: S.running(skewed, ["k"], ["at", "id"], aggs, limit=lim))
    assert a == b
    a, b = both(lambda lim: S.running(skewed, ["k"], ["-at", "-id"], {"l": ("last", F.col("v"))}, False, lim))
    assert a == b


def test_running_without_key(skewed):
    a, b = both(lambda lim: S.position(skewed, [], ["at", "id"], limit=lim))
    assert a == b and sorted(r[-1] for r in a) == list(range(1, 601))


def test_running_orders_by_any_type_and_in_mixed_directions(spark):
    """Few distinct leading values, strings, nulls in key and order."""
    i = F.col("id")
    src = spark.range(400).select(F.when(i % 5 != 0, i % 2).alias("k"), F.when(i % 7 != 0, F.concat(F.lit("s"), (i % 3).cast("string"))).alias("name"),
                                  i.alias("id"), F.when(i % 4 != 0, i * 37 % 101).alias("v"))
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "l": ("last", F.col("v"))}
    for order in (["name", "id"], ["-name", "id"], ["name", "-id"]):
        a, b = both(lambda lim: S.running(src, ["k"], order, aggs, limit=lim))  # noqa: B023
        assert a == b


def test_row_frames_match_plain_window(skewed):
    def fn(lim):
        return S.row_frames(skewed, ["k"], ["at", "id"], lambda w: {
            "back": F.sum("v").over(w.rowsBetween(-20, -1)), "ahead": F.max("v").over(w.rowsBetween(0, 7)),
            "prev": F.lag("id").over(w)}, before=20, after=7, limit=lim)

    a, b = both(fn)
    assert a == b


def test_claims_match_when_islands_are_cut(skewed):
    hold = 1 + F.col("id") % 4
    src = skewed.withColumn("hold", hold)

    def fn(lim):
        return claim(src.select("k", "at", "id", "hold"), ["k"], "at", F.col("hold"), ["id"], 5.0, lim)

    a, b = both(fn)
    assert a == b
    until, last = {}, []
    for k, at, i, h, opened in sorted(a, key=lambda r: (r[0], r[1], r[2])):
        want = at >= until.get(k, float("-inf"))
        assert opened == want
        if want:
            until[k] = at + h
            last.append(i)
    assert last


def test_claims_of_a_null_key_are_one_key(spark):
    src = spark.range(12).select(F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("k"), F.col("id").cast("double").alias("at"), "id")
    want, until = [], {}
    for r in src.orderBy("at").collect():
        opened = r["at"] >= until.get(r["k"], float("-inf"))
        until[r["k"]] = r["at"] + 5 if opened else until[r["k"]]
        want.append((r["k"], r["at"], r["id"], opened))
    for lim in (2, S.NEVER_HOT):
        assert rows(claim(src, ["k"], "at", 5.0, ["id"], 5.0, lim)) == sorted(want, key=repr)


@pytest.mark.parametrize("spread, longest", [(1, 3), (3, 60), (2, 400), (50, 49)])
def test_claims_of_one_dense_island_in_many_blocks(spark, spread, longest):
    """400 rows without a gap that no claim spans, in blocks of 20, with claims from shorter than a block to all rows."""
    draws = np.random.default_rng(spread * longest)
    at = np.cumsum(draws.integers(0, spread + 1, 400)).astype(float)
    src = spark.createDataFrame([("k", float(t), i, float(draws.integers(1, longest + 1))) for i, t in enumerate(at)]
                                + [("k", None, 1000, 2.0), (None, 1.0, 1001, 5.0), (None, 2.0, 1002, 5.0)],
                                "k string, at double, id long, hold double")
    want, until = [], {}
    for k, t, i, h in sorted(map(tuple, src.collect()), key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2])):
        opened = t is not None and t >= until.get(k, float("-inf"))
        if opened:
            until[k] = t + h
        want.append((k, t, i, h, opened))
    for lim in (20, S.NEVER_HOT):
        got = claim(src, ["k"], "at", F.col("hold"), ["id"], longest + spread, lim)
        assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("k", [1, 3, 7])
def test_greedy_folds_against_a_walk_over_all_groups(spark, k):
    from strataframe.ml.folds import fold_of_groups

    g = spark.range(120).select(F.when(F.col("id") > 0, F.concat(F.lit("g"), F.col("id").cast("string"))).alias("g"),
                                (1 + F.pmod(F.hash("id"), F.lit(9)) * F.pmod(F.hash("id", F.lit(2)), F.lit(4))).alias("n"))
    df = g.select("g", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("row"))
    load, want = [0] * k, []
    for r in sorted(g.collect(), key=lambda r: (-r["n"], r["g"] is not None, r["g"] or "")):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += r["n"]
        want.append((r["g"], f))
    assert rows(fold_of_groups(df, "g", k)) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def tied(spark):
    """Points and intervals with repeated rows, ties, null places and a null key."""
    key = lambda i: F.when(i % 4 != 3, i % 4)
    i = F.col("id")
    pts = spark.range(200).select(key(i).alias("k"), F.when(i % 19 != 0, i * 7 % 500).cast("double").alias("x"), (i % 90).alias("pid"))
    pts = pts.unionByName(pts.where("pid < 5"))
    iv = spark.range(60).select(key(i).alias("k"), F.when(i % 23 != 0, i % 40 * 11 % 400).cast("double").alias("lo"),
                                (i % 40 * 11 % 400 + 15 + i % 30).cast("double").alias("hi"), i.alias("no"))
    return pts, iv.unionByName(iv.where("no < 8"))


@pytest.mark.parametrize("fallback", [False, True])
def test_interval_lookup_against_brute_force(tied, fallback):
    pts, iv = tied
    wins, want = iv.collect(), []
    for r in pts.collect():
        mine = [w for w in wins if w["k"] == r["k"]]
        inside = [w["no"] for w in mine if None not in (r["x"], w["lo"]) and w["lo"] <= r["x"] <= w["hi"]]
        no = min(inside, default=None)
        if no is None and fallback:
            ahead = [(w["hi"], w["no"]) for w in mine if r["x"] is not None and w["hi"] >= r["x"]]
            no = min(ahead)[1] if ahead else max((w["hi"], w["no"]) for w in mine)[1]
        want.append((r["k"], r["x"], r["pid"], no))
    for lim in (10, float("inf")):
        got = J.interval_lookup(pts, iv, ["k"], "x", "lo", "hi", ["no"], ["no"], 40.0, fallback, lim)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("way,fill", [("backward", "first"), ("forward", "last"), ("backward", None), ("forward", None)])
def test_asof_join_against_brute_force(tied, way, fill):
    pts, iv = tied
    wins, want = [w for w in iv.collect() if w["lo"] is not None], []
    for r in pts.collect():
        mine = [(w["lo"], w["no"]) for w in wins if w["k"] == r["k"]]
        near = [w for w in mine if r["x"] is not None and (w[0] <= r["x"] if way == "backward" else w[0] >= r["x"])]
        best = (max(near) if way == "backward" else min(near)) if near else None
        if best is None and fill:
            best = min(mine) if fill == "first" else max(mine)
        want.append((r["k"], r["x"], r["pid"], best and best[1]))
    for lim in (10, float("inf")):
        got = J.asof_join(pts, iv, ["k"], "x", "lo", ["no"], way, fill, lim)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_cover_against_brute_force(skewed):
    ev = skewed.where("id % 40 = 0").select("k", (F.col("at") - 2).alias("lo"), (F.col("at") + 3).alias("hi"))
    wins = ev.collect()
    for r in J.covered(skewed, ev, ["k"], "at", "lo", "hi").collect():
        want = any(w["k"] == r["k"] and w["lo"] <= r["at"] <= w["hi"] for w in wins)
        assert r["covered"] == int(want)


def test_gap_cluster_is_the_greedy_rule(skewed):
    got = {r["id"]: (r["island"], r["bucket"]) for r in W.gap_cluster(skewed, ["k"], "at", ["id"], 6, 4).collect()}
    by = {}
    for r in sorted(skewed.collect(), key=lambda r: (r["k"], r["at"], r["id"])):
        by.setdefault(r["k"], []).append((r["at"], r["id"]))
    for members in by.values():
        groups, cur = [], []
        for at, i in members:
            if cur and at - cur[-1][0] < 6 and len(cur) < 4:
                cur.append((at, i))
            else:
                cur = [(at, i)]
                groups.append(cur)
        for g in groups:
            assert len({got[i] for _, i in g}) == 1
        assert len({got[i] for _, i in members}) == len(groups)


def test_nearest_events_match_the_band_join(spark, skewed):
    from strataframe.operators.topk import topk

    ev = skewed.select("k", F.col("at").alias("e"), F.col("id").alias("event_id"))
    pts = skewed.where("id % 10 = 0").select("k", F.col("at").alias("x"), F.col("id").alias("pid"))

    def fn(lim):
        near = J.nearest_events(pts, ev, ["k"], "x", "e", 5, 40, 60, ["event_id"], lim)
        return topk(near, ["pid"], ["offset_m", "event_id"], 5).select("pid", "event_id", "rank")

    a, b = both(fn)
    assert a == b and a


@pytest.mark.parametrize("below, above", [(0, 30), (25, 25), (40, 7)])
def test_band_extremes_and_nearest_match_pairs(spark, skewed, below, above):
    """Dense bands, a null key, places without events, null places, and keys over the limit."""
    pts = spark.range(300).select(
        F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("k"), (F.col("id") * 1.5).alias("x"), "id").unionByName(
        spark.createDataFrame([(0, None, 1000), (99, 5.0, 1001)], "k long, x double, id long"))
    ev = skewed.select(F.when(F.col("k") != 3, F.col("k")).alias("k"), F.col("at").alias("e"), "v").unionByName(
        spark.createDataFrame([(0, None, 1.0)], "k long, e double, v double"))
    p, e = pts.collect(), ev.collect()
    want, near = [], []
    for r in p:
        here = [q for q in e if q["k"] == r["k"] and r["x"] is not None and q["e"] is not None
                and r["x"] - below <= q["e"] <= r["x"] + above]
        vs = [q["v"] for q in here if q["v"] is not None]
        want.append((*r, min(vs, default=None), max(vs, default=None)))
        near.append((*r, min((abs(q["e"] - r["x"]) for q in here), default=None)))
    spark.conf.set("spark.strataframe.hotRows", "100")
    try:
        got = J.band_extremes(pts, ev, ["k"], "x", "e", below, above, {"lo": F.col("v")}, {"hi": F.col("v")})
        assert rows(got) == sorted(want, key=repr)
        assert rows(J.band_nearest(pts, ev, ["k"], "x", "e", below, above)) == sorted(near, key=repr)
    finally:
        spark.conf.unset("spark.strataframe.hotRows")


def test_nearest_events_keep_null_keys_at_every_size(spark):
    pts = spark.createDataFrame([(None, 10.0), ("a", 10.0)], "k string, x double")
    ev = spark.createDataFrame([(k, 9.0 + i, i) for k in (None, "a") for i in range(3)], "k string, e double, event_id long")
    few, many = (rows(J.nearest_events(pts, ev, ["k"], "x", "e", 3, 5, 5, ["event_id"], lim)) for lim in (S.NEVER_HOT, 2))
    assert len(few) == 6 and sorted(set(many), key=repr) == few


@pytest.mark.parametrize("fallback", [False, True])
def test_steps_are_the_lookup(tied, fallback):
    pts, iv = tied
    for lim in (10, float("inf")):
        want = rows(J.interval_lookup(pts, iv, ["k"], "x", "lo", "hi", ["no"], ["no"], 40.0, fallback, lim))
        steps = J.interval_steps(iv, ["k"], "lo", "hi", ["no"], ["no"], 40.0, fallback, lim)
        near = J.asof_steps(iv, ["k"], "lo", ["no"], "first")
        got = J.along(pts, ["k"], "x", {"a": steps, "b": near}, lim)
        assert rows(got.select(*pts.columns, "a.no")) == want
        assert rows(got.select(*pts.columns, "b.no")) == rows(J.asof_join(pts, iv, ["k"], "x", "lo", ["no"], "backward", "first", lim))


def test_trailing_frames_match_plain_windows(skewed):
    """Medians and slopes in batches, also where a batch ends within a key."""
    odd = skewed.withColumn("v", F.when(F.col("id") % 31 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    w = S.keyed(["k"], ["at", "id"])
    x = odd.withColumn("x", F.row_number().over(w).cast("double"))
    v, back, short = F.when(~F.isnan("v"), F.col("v")), w.rowsBetween(-20, -1), w.rowsBetween(-12, -1)
    want = x.select("id", F.percentile(v, F.lit(0.5)).over(back), F.count(v).over(back), F.round(F.regr_slope(v, F.col("x")).over(short), 9),
                    F.count(v).over(short))
    want = rows(want)
    spark = skewed.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for lim in (40, S.NEVER_HOT):
            got = W.trailing_frames(odd, ["k"], ["at", "id"], ["v"], {"s": ("v", 12)}, limit=lim)
            got = rows(got.select("id", "_w_med_v", "_w_cnt_v", F.round("_w_slope_s", 9), "_w_have_s"))
            assert [r for r in got if r[4] > 1] == [r for r in want if r[4] > 1]
            assert [r[:3] for r in got] == [r[:3] for r in want]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
