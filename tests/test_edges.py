"""Hand-checked edge cases."""

import pytest
from pyspark.sql import functions as F

from strataframe.correlation.offsets import gradient_similarity
from strataframe.functions import numeric as N
from strataframe.functions import text as T
from strataframe.ml import metrics as M
from strataframe.operators import windows as W
from strataframe.operators.joins import geo_neighbors, interval_lookup
from strataframe.retrieval.search import diversify, rrf


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_ratio_needs_three_earlier_values(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([2.0, 4.0, 6.0, 8.0, None])], "k int, i int, v double")
    got = [r["v_ratio"] for r in W.local_ratios(df, ["k"], ["i"], ["v"]).orderBy("i").collect()]
    assert got == [1.0, 1.0, 1.0, 2.0, 0.0]
    zero = spark.createDataFrame([(1, i, 0.0) for i in range(5)], "k int, i int, v double")
    assert {r["v_ratio"] for r in W.local_ratios(zero, ["k"], ["i"], ["v"]).collect()} == {1.0}


def test_slope_needs_history(spark):
    df = spark.createDataFrame([(1, i, float(3 * i)) for i in range(6)], "k int, i int, v double")
    got = [r["t"] for r in W.slopes(df, ["k"], ["i"], {"t": ("v", 12, 3, 20)}).orderBy("i").collect()]
    assert got[:3] == [0.0, 0.0, 0.0] and got[3] == pytest.approx(60.0)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.2, 0), (2, 0.7, 0)], "id int, s double, y int")
    assert M.roc_auc(df, "s", "y").first()[0] is None
    assert M.average_precision(df, "s", "y", "id").first()[0] is None
    assert M.recall_at_k(df, "s", "y", "id", [1]).first()["recall"] is None


def test_tied_scores_count_half(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.5, 0)], "id int, s double, y int")
    assert M.roc_auc(df, "s", "y").first()[0] == 0.5


def test_no_threshold_reaches_the_floor(spark):
    df = spark.createDataFrame([(i, i / 100, 1 if i == 3 else 0) for i in range(100)], "id int, s double, y int")
    r = M.best_threshold(df, "s", "y", min_precision=0.3).first()
    grid = [(0.99 * g / 200) for g in range(201)]
    best = None
    for t in grid:
        up = [i for i in range(100) if i / 100 >= t]
        tp = int(3 in up)
        p, rec = tp / len(up) if up else 0, tp
        f1 = round(2 * p * rec / (p + rec), 4) if p + rec else 0
        if p < 0.3 and f1 > 0:
            continue
        if best is None or f1 > best[0]:
            best = (f1, t)
    assert r["f1"] == best[0] and r["note"] is not None
    assert r["threshold"] == pytest.approx(best[1])


def test_gradient_similarity_null_when_unknown(spark):
    n = F.lit(None).cast("double")
    assert one(spark, gradient_similarity([(n, F.lit(1.0)), (F.lit(2.0), n)])) is None
    assert one(spark, gradient_similarity([(F.lit(0.0), F.lit(0.0)), (n, n)])) == 1.0


def test_rounding_goes_up_at_halves(spark):
    assert one(spark, N.round_half_up(F.lit(-2.5))) == -2.0
    assert one(spark, N.round_half_up(F.lit(2.5))) == 3.0


def test_interval_fallback_chain(spark):
    iv = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 20.0, 30.0, "b")], "k int, lo double, hi double, n string")
    pts = spark.createDataFrame([(1, 5.0), (1, 15.0), (1, 99.0)], "k int, x double")
    got = {r["x"]: r["n"] for r in interval_lookup(pts, iv, ["k"], "x", "lo", "hi", ["n"], ["lo"], 10.0, True).collect()}
    assert got == {5.0: "a", 15.0: "b", 99.0: "b"}


def test_neighbours_across_the_date_line_and_pole(spark):
    p = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 89.9, 0.0), (4, 89.9, 180.0)], "place_id int, lat double, lng double")
    got = {(r["place_id"], r["near_place_id"]) for r in geo_neighbors(p, p, 30.0).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_tokens(spark):
    assert one(spark, T.tokenize(F.lit("At 2,880 the parties were drilling"))) == ["2880", "party", "drill"]


def test_fusion_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "q int, ref int, rank int, score double")
    b = spark.createDataFrame([(1, 11, 1, 0.7), (1, 12, 2, 0.6)], "q int, ref int, rank int, score double")
    x = rrf({"lexical": (a, 1.0), "semantic": (b, 0.85)}, "q", "ref")
    y = rrf({"semantic": (b, 0.85), "lexical": (a, 1.0)}, "q", "ref")
    pick = lambda d: sorted((r["ref"], round(r["fused"], 12)) for r in d.collect())
    assert pick(x) == pick(y)


def test_diversify_keeps_first_of_near_copies(spark):
    df = spark.createDataFrame(
        [(1, "a", "doc", list("abcde"), 0.9), (1, "b", "doc", list("abcdf"), 0.8), (1, "c", "doc", list("abcde"), 0.7),
         (1, "d", "lesson", list("abcde"), 0.6)], "q int, ref string, kind string, t array<string>, s double")
    got = {r["ref"]: r["merged_refs"] for r in diversify(df, "q", "ref", "kind", "t", ["-s", "ref"]).collect()}
    assert got == {"a": ["a", "c"], "b": ["b"], "d": ["d"]}


def test_chunks_cover_paragraphs(spark):
    text = "\n\n".join(f"Paragraph {i}. " + "x" * 300 for i in range(6)) + "\n\n" + "A sentence here. " * 200
    df = spark.createDataFrame([(1, text), (2, None), (3, "short")], "id int, text string")
    got = T.chunk_text(df, "id", "text").collect()
    assert [r["text"] for r in got if r["id"] == 3] == ["short"]
    mine = [r["text"] for r in got if r["id"] == 1]
    assert all(f"Paragraph {i}." in " ".join(mine) for i in range(6)) and max(map(len, mine)) <= 900 * 1.8


def test_chunks_repeat_what_came_before(spark):
    text = "one.\n\n" + "b" * 30 + "\n \n" + "c" * 25 + "\n\n" + "D e. " * 20
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [r["text"] for r in sorted(T.chunk_text(df, "id", "text", 40, 6).collect(), key=lambda r: r["chunk_no"])]
    tail = " ".join(["D e."] * 7)  # 41 characters with the head: the seventh still fits when it is added
    assert got[0] == "one.\n\n" + "b" * 30 and got[1] == "b" * 6 + "\n" + "c" * 25
    assert got[2] == "c" * 6 + "\n" + tail and all(len(c) <= 45 for c in got[2:]) and sum(c.count("D e.") for c in got) == 20


@pytest.mark.parametrize("edits,asked,found", [(1, "XABCD", 1), (1, "AXBCD", 1), (1, "ABD", 1), (1, "ABXD", 1), (1, "AXXD", None),
                                               (2, "AXXD", 1), (2, "XABCDX", 1), (2, "AB", 1), (1, "", None)])
def test_fuzzy_names_within_edits(spark, edits, asked, found):
    from strataframe.operators.extraction import fuzzy_names

    wells = spark.createDataFrame([("ABCD", 1), ("QRSTU", 2)], "well string, wid int")
    got = fuzzy_names(spark.createDataFrame([(asked,)], "name string"), "name", wells, "well", "wid", edits).collect()
    assert [r["wid"] for r in got] == [found]


@pytest.mark.parametrize("name, calls", [
    ("m8_fit_boosted", {"rounds": 120}), ("m10_split_usage", {"rounds": 120}), ("m33_explain_boosted", {"rounds": 120}),
    ("m9_fit_boosted_regressor", {"rounds": 100}), ("m25_evaluate_regressor", {"k": 5, "rounds": 100}),
    ("m24_evaluate_classifier", {"k": 5, "candidates": None}), ("m24_fold_report", {"iters": 400, "k": 5}),
    ("m27_train_and_choose", {"k": 5, "rounds": 120, "iters": 400, "positive_weight": 1.0})])
def test_model_queries_run_the_defaults(spark, monkeypatch, name, calls):
    import inspect
    from unittest.mock import MagicMock

    from strataframe.plans import modelling
    from strataframe.plans.registry import QUERIES, load_all

    load_all()
    seen = {}

    def watch(module, f):
        shape = inspect.signature(getattr(module, f))

        def noted(*args, **kwargs):
            bound = shape.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.update(bound.arguments)
            return MagicMock() if f == "logistic_candidate" else stop()

        monkeypatch.setattr(module, f, noted)

    def stop():
        raise InterruptedError

    for f in ("fit_boosted", "fit_boosted_regressor"):
        watch(modelling.MD, f)
    for f in ("logistic_candidate", "out_of_fold", "evaluate_classifier", "evaluate_regressor", "train_classifier"):
        watch(modelling.E, f)
    for f in ("pixels", "matrix"):
        monkeypatch.setattr(modelling, f, MagicMock())
    with pytest.raises(InterruptedError):
        QUERIES[name](spark, "")
    assert {k: seen[k] for k in calls} == calls


def test_boosted_paths_against_a_walk_row_by_row(spark):
    from pyspark.sql import functions as F

    from strataframe.ml import explain as X
    from strataframe.ml import models as MD

    df = spark.range(400).select("id", *[F.pmod(F.hash("id", F.lit(i)), F.lit(100)).cast("double").alias(f"f{i}") for i in range(3)])
    df = df.withColumn("label", ((F.col("f0") > 40) & (F.col("f1") < 70)).cast("int"))
    names = ["f0", "f1", "f2"]
    model = MD.fit_boosted(df, names, "label", rounds=6)
    trees = {}
    for r in MD.tree_nodes(spark, model).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    want = []
    for row in df.collect():
        moved = []
        for t, ns in trees.items():
            node, path = ns[0], []
            while node["feature"] >= 0:
                low = row[names[node["feature"]]] <= node["threshold"]
                path.append(f"{names[node['feature']]} {'<=' if low else '>'} {node['threshold']:.6g}")
                node = ns[node["left"] if low else node["right"]]
            moved.append((t + 1, round(model.treeWeights[t] * node["prediction"], 5), node["n"], " AND ".join(path)))
        moved.sort(key=lambda m: (-abs(m[1]), m[0]))
        want += [(row["id"], i + 1, *m) for i, m in enumerate(moved[:4])]
    got = [tuple(r) for r in X.explain_boosted(df, model, names, ["id"], 4).collect()]
    assert sorted(got) == sorted(want)
