"""Queries that have to do their whole job: reach of neighbours, hot sizes, steps that must not grow with pairs."""

from compare import duck

from strataframe.plans.registry import ORACLES, QUERIES, load_all

load_all()
WIDER = "/root/testdata/sf0.01"


def test_offsets_and_neighbours_reach_far(spark):
    con = duck(WIDER)
    for name in ("c1_rank_offsets_pressure", "c1_rank_offsets_depth", "j12_geo_neighbors"):
        assert con.execute(f"SELECT max(distance_km) FROM ({ORACLES[name]})").fetchone()[0] > 50
        assert QUERIES[name](spark, WIDER).agg({"distance_km": "max"}).first()[0] > 50


def test_an_index_of_one_kind_has_only_its_tables(spark):
    import os

    from pyspark.sql import functions as F

    from strataframe.retrieval import segments
    from strataframe.session import fresh_path

    rows = spark.createDataFrame([(1, "deep wells"), (2, "deep water"), (2, "more water"), (3, None)], "ref long, text string")
    index = segments.build(rows, "ref", F.col("text"), fresh_path(spark, "index"), kinds=("stem",), blocks=False)
    folder = index.segments[0].folder
    assert not {"words", "lexical", "semantic"} & set(os.listdir(folder))
    assert {(r["ref"], r["term"], r["tf"]) for r in index.rows("stems").collect()} == {
        (1, "deep", 1), (1, "well", 1), (2, "deep", 1), (2, "water", 2), (2, "more", 1)}
    index = segments.with_blocks(index)
    assert index.blocks and "semantic" in os.listdir(folder) and "lexical" not in os.listdir(folder)
    assert segments.open_index(spark, index.path).kinds == ("stem",)


def longest(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(row[j], best[j + 1]))
        best = row
    return best[-1]


def test_long_alignments_are_exact(monkeypatch):
    import random

    from strataframe.llm import wrappers

    dice = random.Random(5)
    a, b = [dice.choices("abcdefgh", k=n) for n in (600, 500)]
    assert len(a) * len(b) > wrappers.CELLS
    cases = [(a, b)]
    monkeypatch.setattr(wrappers, "CELLS", 20)
    cases += [(dice.choices("abc", k=dice.randrange(12)), dice.choices("abcd", k=dice.randrange(40))) for _ in range(300)]
    for a, b in cases:
        found = wrappers.common(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_wrappers_keep_all_parts():
    from strataframe.llm import wrappers

    page = lambda first: "<div>" + "".join(f"<x{first + i}></x{first + i}>" for i in range(600)) + "</div>"
    (div,) = wrappers.infer([page(0), page(1000)])[1]
    assert len(div[0][0][1]) == 1200


def test_evidence_is_gathered_in_place(spark):
    from strataframe.correlation.scoring import heuristic_risk

    points = spark.createDataFrame(
        [(1, 1, 100.0), (2, 1, 300.0), (3, None, 100.0), (4, 2, 100.0), (None, 1, 100.0), (None, 1, 100.0)],
        "point_id long, well_id long, depth double").selectExpr(
        "*", "'Formation X' AS formation", "19D AS torque", "18D AS rop", "2900D AS pressure", "1.12D AS mud_weight")
    events = spark.createDataFrame(
        [(1, 10 + i, "Kick", "High", 60.0 + 20 * i) for i in range(12)] + [(None, 40, "Kick", "Low", 110.0)],
        "well_id long, event_id long, event_type string, severity string, event_depth double")
    ask = lambda: heuristic_risk(points, events, "point_id", ["well_id"])
    plan = ask()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 2
    rows = lambda: sorted(map(repr, ask().collect()))
    got = rows()
    assert len(got) == 24
    found = {(r["point_id"], r["risk_type"]): r["evidence_n"] for r in ask().collect() if r["point_id"] is not None}
    assert found[1, "Kick"] == 6 and found[3, "Kick"] == 1 and found[4, "Kick"] == 0
    before = spark.conf.get("spark.strataframe.hotRows", None)
    spark.conf.set("spark.strataframe.hotRows", "3")
    try:
        assert rows() == got
    finally:
        spark.conf.unset("spark.strataframe.hotRows") if before is None else spark.conf.set("spark.strataframe.hotRows", before)


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strataframe.ml import models as MD

    df = spark.range(20_000).selectExpr("id", "id % 3 * 1D AS a", "id % 2 * 1D AS b").withColumn(
        "hours", 10 * F.col("a") + 5 * F.col("b") + F.floor(F.col("id") / 6) % 3)
    sizes, assemble = [], MD.assemble
    monkeypatch.setattr(MD, "UNITS", 100)
    monkeypatch.setattr(MD, "assemble", lambda d, *rest: sizes.append(d.count()) or assemble(d, *rest))
    model = MD.fit_boosted_regressor(df, ["a", "b"], "hours", 10)
    assert sizes == [6 * 17]
    told = MD.score_boosted_regressor(df, model, ["a", "b"]).groupBy("a", "b").agg(F.avg("hours").alias("h"), F.min("predicted").alias("p")).collect()
    assert len(told) == 6 and all(abs(r["h"] - r["p"]) < 0.1 for r in told)
    assert "predicted" in MD.score_boosted_regressor(df.withColumn("a", F.lit(None).cast("double")), model, ["a", "b"]).columns


def test_narratives_cost_no_more_than_a_pass(spark):
    from strataframe.ml import explain as X
    from strataframe.ml.models import LogisticModel

    model = LogisticModel(["b_x", "a", "c"], [1.0, -1.0, 1.0], 0.0, [0.0] * 3, [1.0] * 3)
    rows = spark.createDataFrame([(2.0, 2.0, 0.5), (None, 1.25, None), (1.0, None, 100.0), (0.0, None, 0.00001)], "b_x double, a double, c double")
    told = rows.select(X.narrate(model).alias("t"))
    assert [r["t"] for r in told.collect()] == [
        "Raised by b x at 2 and c at 0.5. Lowered by a at 2. Score: 62.2%.", "Lowered by a at 1.25. Nothing here raises the score. Score: 22.3%.",
        "Raised by c at 100 and b x at 1. Score: 100%.", "Nothing here raises the score. Score: 50%."]
    assert "transform(" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_keys_share_the_groups_of_the_state(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strataframe.session import fresh_path
    from strataframe.sources.replay import record_deliveries, replay_stream
    from strataframe.streaming import jobs as J
    from strataframe.streaming import ordered

    monkeypatch.setattr(ordered, "BUCKETS", 1)
    rows = spark.range(90).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3 + 2**60).alias("k"),
                                  F.timestamp_seconds(1_700_000_000 + F.col("id") * 100 + F.col("id") % 7 * 60).alias("ts"), "id")
    path = fresh_path(spark, "recording")
    record_deliveries(rows, F.floor(F.col("id") / 45), 2, path)
    stream = replay_stream(spark, path, "k bigint, ts timestamp, id bigint")
    got = J.drain(J.gap_stream(stream, ["k"], "ts", "id", 400, "10 minutes"))
    assert got.groupBy("k").count().count() == 3
    us = {}
    for r in rows.orderBy("ts", "id").collect():
        us.setdefault(r["k"], []).append(r["ts"])
    last = max(max(v) for v in us.values())
    want = sorted((str(k), a, b) for k, v in us.items() for a, b in zip(v, v[1:]) if (b - a).total_seconds() > 400 and (last - b).total_seconds() > 600)
    assert sorted((str(r["k"]), r["gap_from"], r["gap_to"]) for r in got.collect()) == want


def test_features_take_one_sort_and_code_the_jvm_compiles(spark):
    from strataframe.plans.registry import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = QUERIES["m1_build_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        codes = execution.debug().codegenToSeq()
        assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8000  # HotSpot's limit
        plan = execution.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "percentile(" not in plan and plan.count("lineitem.parquet") == 1  # incidents: before


def wells(spark, n, odd):
    """Targets, places, tops and events of n places a few kilometres apart; `odd` adds repeated, unknown and unbounded values."""
    import random

    dice, nan = random.Random(n), float("nan")
    places = [(i, dice.choice([10.0, 10.1, 10.2]) + i % 4 / 1000, 179.95 - dice.choice([0.0, 0.1]) - i % 3 / 1000) for i in range(n)]
    targets = [(i, lat, lng, float(dice.randrange(40) * 40)) for i, lat, lng in places]
    tops = [(i, f"f{j}", j * 300.0 + dice.randrange(6) * 20, dice.choice([None, 0.4, 0.5]), dice.choice([None, 0.7, 0.8])) for i in range(n) for j in range(5)]
    events = [(i, i * 1000 + j, dice.randrange(400) * 5.0) for i in range(n) for j in range((i % 4) ** 3)]
    if odd:
        places += places[::5] + [(i, 10.15, 179.9) for i in range(0, n, 6)] + [(None, 10.0, 179.9), (1, None, 179.9), (2, nan, 179.9)]
        targets += targets[::4] + [(i, 10.12, 179.9, d + 40) for i, _, _, d in targets[::9]]
        targets += [(i, 10.0, 179.9, d) for i, d in ((3, None), (5, nan), (7, float("inf")), (None, 100.0))]
        tops = tops[n // 2:] + [(8, "f1", 10.0, nan, 0.7), (9, None, 10.0, 0.5, 0.7), (10, "f2", None, 0.5, 0.7), (11, "f2", nan, 0.5, 0.7), (None, "f1", 5.0, 0.5, 0.7)]
        events += events[::3] + [(12, -1, None), (13, -2, nan), (None, -3, 100.0)]
    made = spark.createDataFrame
    return (made(targets, "place_id long, lat double, lng double, depth double"), made(places, "place_id long, lat double, lng double"),
            made(tops, "place_id long, formation string, base_md double, pp_gradient double, fg_gradient double"),
            made(events, "place_id long, event_id long, event_depth double"))


def all_pairs(targets, places, *_):
    from pyspark.sql import functions as F

    return targets.select("place_id").distinct().crossJoin(places.select(F.col("place_id").alias("near_place_id")).distinct())


def ranked(frames, strategy, monkeypatch, whole=False):
    from strataframe.correlation import offsets

    asked, asof = [], offsets.asof_join

    def seen(left, *args, **kw):
        asked.append(left.count())
        return asof(left, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(offsets, "asof_join", seen)
        if whole:
            m.setattr(offsets, "shortlist", all_pairs)
        rows = offsets.rank_offsets(*frames, offsets.OffsetSpec(strategy=strategy)).drop("nearby_events").collect()
    return rows, max(asked)


def test_offsets_are_worked_out_for_few_of_all_pairs(spark, monkeypatch):
    frames = wells(spark, 150, odd=False)
    rows, asked = ranked(frames, "pressure", monkeypatch)
    whole, pairs = ranked(frames, "pressure", monkeypatch, whole=True)
    assert sorted(map(str, rows)) == sorted(map(str, whole)) and len(rows) == 150 * 12
    assert pairs == 150 * 149 and asked < 150 * 20


def test_offsets_of_odd_rows_in_small_blocks(spark, monkeypatch):
    from strataframe.correlation import shortlist

    for name, size in (("CANDIDATES", 7), ("ASKED", 9), ("CELLS", 40)):
        monkeypatch.setattr(shortlist, name, size)
    frames = wells(spark, 60, odd=True)
    rank = lambda rows: sorted((r["place_id"], r["rank"], r["score"], r["distance_km"], r["offset_id"]) for r in rows)
    rows, asked = ranked(frames, "depth", monkeypatch)
    whole, pairs = ranked(frames, "depth", monkeypatch, whole=True)
    assert rank(rows) == rank(whole) and len(rows) > 400 and asked < pairs


def test_levels_of_dense_events_take_few_steps(spark):
    from strataframe.correlation.shortlist import level_steps

    at = {1: [float(x) for x in range(500)], 2: [0.0, 0.0, 7.0, 30.0, 41.0, 49.0], 3: [5.0]}
    events = spark.createDataFrame([(k, x) for k, xs in at.items() for x in xs] + [(4, None)], "k int, x double")
    steps = level_steps(events, ["k"], "x", 10.0, 3).collect()
    assert {r["k"] for r in steps} == {1, 2, 3} and len([r for r in steps if r["k"] == 1]) == 12
    for k, xs in at.items():
        for d in [i / 4 for i in range(-80, 2200)]:
            lo, hi = (sum(r[c] for r in steps if r["k"] == k and r["at"] <= d) for c in ("lo", "hi"))
            n, edge = sum(abs(x - d) <= 10 for x in xs), any(abs(x - d) == 10 for x in xs)
            assert lo <= min(n, 3) <= hi and (edge or lo == hi)
