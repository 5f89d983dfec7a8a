"""Metrics, folds, models, registry, serving and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.ml import evaluate as E
from strataframe.ml import explain as X
from strataframe.ml import iforest as IF
from strataframe.ml import metrics as M
from strataframe.ml import models as MD
from strataframe.ml import registry as RG
from strataframe.ml import serving as SV
from strataframe.ml.folds import deal_groups, fold_of_groups, group_holdout
from strataframe.operators.windows import smoothed
from strataframe.plans.frames import half_up_sql, incidents, scored, series, with_sql
from strataframe.plans.registry import query
from strataframe.session import settle
from strataframe.sources.tables import read_table

R4 = lambda e: half_up_sql(e, 4)
FEATURES = ["quantity", "price", "discount", "tax"]


def matrix(spark, sf):
    """Line items as a training matrix: the label is a return, groups are suppliers."""
    s = series(spark, sf)
    return s.select((F.col("well_id") * 10_000_000 + F.col("pos")).alias("row_id"), "well_id", "pos", "depth", *FEATURES,
                    (F.col("flag") == "R").cast("int").alias("label"))


def pixels(spark, sf):
    """Embeddings as a training matrix: one class against the rest, groups of neighbouring vectors."""
    e = read_table(spark, sf, "embeddings")
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)]
    return e.select("vec_id", (F.col("vec_id") % 20).alias("grp"), (F.col("label") < 3).cast("int").alias("label"), *cols)


PIXELS = [f"e{i}" for i in range(64)]


@query("m4_standardise", f"""WITH s AS (SELECT avg(l_quantity) AS m1, greatest(1e-6, stddev_pop(l_quantity)) AS d1, avg(l_extendedprice) AS m2,
 greatest(1e-6, stddev_pop(l_extendedprice)) AS d2 FROM lineitem WHERE l_linestatus='O')
SELECT l_linestatus, {half_up_sql('avg((l_quantity-m1)/d1)', 5)} AS z1, {half_up_sql('avg((l_extendedprice-m2)/d2)', 5)} AS z2, {half_up_sql('max((l_quantity-m1)/d1)', 5)} AS top
FROM lineitem, s GROUP BY 1""")
def m4(spark, sf):
    li = read_table(spark, sf, "lineitem")
    std = MD.Standardizer.fit(li.where("l_linestatus = 'O'"), ["l_quantity", "l_extendedprice"])
    z = std.columns()
    return li.select("l_linestatus", z[0].alias("a"), z[1].alias("b")).groupBy("l_linestatus").agg(
        round_half_up(F.avg("a"), 5).alias("z1"), round_half_up(F.avg("b"), 5).alias("z2"), round_half_up(F.max("a"), 5).alias("top"))


@query("m5_fit_logistic")
def m5(spark, sf):
    m = MD.fit_logistic(pixels(spark, sf), PIXELS, "label", 1.0)
    fit = pixels(spark, sf).withColumn("score", m.score())
    return M.roc_auc(fit, "score", "label").withColumns({"n_weights": F.lit(len(m.weights)), "bias": F.lit(m.bias)})


# A stored model: weights per standardised feature.
STORED = MD.LogisticModel(FEATURES, [0.8, -0.5, 0.3, 0.1], -0.4, [25.0, 50000.0, 0.05, 0.04], [14.3, 28657.0, 0.03, 0.025],
                          0.45, MD.Platt(1.1, -0.2, 0.4, 0.15))
_Z = "(-0.4e0 + (quantity-25)/14.3e0*0.8e0 + (price-50000)/28657e0*(-0.5e0) + (discount-0.05e0)/0.03e0*0.3e0 + (tax-0.04e0)/0.025e0*0.1e0)"
_P = f"(1/(1+exp(-{_Z})))"
_PLATT = f"(1/(1+exp(-(1.1e0*(({_P}-0.4e0)/0.15e0) - 0.2e0))))"


@query("m6_score_logistic", with_sql("series", f"SELECT well_id, pos, {R4(_P)} AS score FROM series"))
def m6(spark, sf):
    return series(spark, sf).select("well_id", "pos", round_half_up(STORED.score(), 4).alias("score"))


@query("m7_platt_apply", with_sql("series", f"SELECT well_id, pos, {R4(_PLATT)} AS calibrated FROM series"))
def m7(spark, sf):
    return series(spark, sf).select("well_id", "pos", round_half_up(STORED.calibrated(), 4).alias("calibrated"))


@query("m7_platt_fit")
def m7b(spark, sf):
    df = matrix(spark, sf).withColumn("score", STORED.score())
    p = MD.fit_platt(df, "score", "label")
    return df.withColumn("c", p.apply(F.col("score"))).groupBy("label").agg(round_half_up(F.avg("c"), 3).alias("mean_calibrated"))


@query("m8_fit_boosted")
def m8(spark, sf):
    df = pixels(spark, sf)
    m = MD.fit_boosted(df, PIXELS, "label")
    return M.roc_auc(MD.score_boosted(df, m, PIXELS), "score", "label")


@query("m9_fit_boosted_regressor")
def m9(spark, sf):
    df = matrix(spark, sf).withColumn("hours", F.col("discount") * 100 + F.col("quantity") / 10)
    m = MD.fit_boosted_regressor(df, FEATURES, "hours")
    return M.regression_metrics(MD.score_boosted_regressor(df, m, FEATURES), "predicted", "hours")


@query("m10_tree_rules")
def m10(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier

    data = MD.assemble(pixels(spark, sf), PIXELS).withColumn("_y", F.col("label").cast("double"))
    tree = DecisionTreeClassifier(featuresCol="_features", labelCol="_y", maxDepth=4, minInstancesPerNode=10, seed=7).fit(data)
    nodes = MD.tree_nodes(spark, tree)
    return MD.tree_rules(nodes, PIXELS, 4).orderBy(F.col("samples").desc(), "condition").limit(12)


@query("m10_split_usage")
def m10b(spark, sf):
    m = MD.fit_boosted(pixels(spark, sf), PIXELS, "label")
    nodes = MD.tree_nodes(spark, m)
    return MD.split_usage(nodes, PIXELS)


@query("m11_isolation_forest")
def m11(spark, sf):
    df = matrix(spark, sf)
    forest = IF.fit_iforest(df, FEATURES, "row_id")
    return E.anomaly_report(IF.score_iforest(df, forest, "score"), "score")


@query("m12_smoothed_anomaly", with_sql("series", f""", s AS (SELECT well_id, pos, {half_up_sql('avg(discount) OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)', 6)} AS score FROM series),
r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT {R4('score')} AS threshold FROM r WHERE i = least(n-1, CAST(floor(n*0.95e0) AS BIGINT))"""))
def m12(spark, sf):
    s = smoothed(series(spark, sf).select("well_id", "pos", "discount"), ["well_id"], ["pos"], "discount", 5, "raw")
    return IF.anomaly_threshold(s.select(round_half_up("raw", 6).alias("score")), "score", 0.05)


_FOLD_WALK = """, sizes AS (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, grp) AS i FROM scored GROUP BY grp),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS grp, -1 AS fold, [0, 0, 0, 0]::BIGINT[] AS load
 UNION ALL SELECT s.i, s.grp, list_position(w.load, list_min(w.load)) - 1,
  list_transform(w.load, lambda x, k: CASE WHEN k = list_position(w.load, list_min(w.load)) THEN x + s.n ELSE x END) FROM walk w JOIN sizes s ON s.i = w.i + 1)"""


@query("m13_group_kfold", with_sql("scored", _FOLD_WALK + " SELECT grp, CAST(fold AS INTEGER) AS fold FROM walk WHERE i > 0", recursive=True))
def m13(spark, sf):
    return fold_of_groups(scored(spark, sf), "grp", 4)


@query("m13_group_kfold_dealt", with_sql("scored", """SELECT grp, CAST(CASE WHEN t < 4 THEN t ELSE 7 - t END AS INTEGER) AS fold FROM (
 SELECT grp, (row_number() OVER (ORDER BY count(*) DESC, grp) - 1) % 8 AS t FROM scored GROUP BY grp)"""))
def m13b(spark, sf):
    return deal_groups(scored(spark, sf), "grp", 4)


@query("m14_group_holdout", with_sql("scored", """, g AS (SELECT grp, row_number() OVER (ORDER BY CAST(('0x' || left(md5(grp || '|7'), 12)) AS BIGINT)::DOUBLE, grp) AS r, count(*) OVER () AS n
 FROM (SELECT DISTINCT grp FROM scored))
SELECT doc_id, r <= greatest(1, floor(n*0.25e0 + 0.5e0)) AS holdout FROM scored JOIN g USING (grp)"""))
def m14(spark, sf):
    return group_holdout(scored(spark, sf), "grp", 0.25, 7).select("doc_id", "holdout")


_AUC = """(sum(CASE WHEN label=1 THEN ar END) - sum(label)*(sum(label)+1)/2e0)/(sum(label)*sum(1-label))"""
_RANKED = """, rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2e0 AS ar FROM scored)"""


@query("m15_roc_auc", with_sql("scored", _RANKED + f" SELECT {half_up_sql(_AUC, 6)} AS roc_auc FROM rk"))
def m15(spark, sf):
    return M.roc_auc(scored(spark, sf), "score", "label").select(round_half_up("roc_auc", 6).alias("roc_auc"))


@query("m15_roc_auc_by_group", with_sql("scored", """, rk AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1)/2e0 AS ar FROM scored)
SELECT grp, CASE WHEN sum(label) > 0 AND sum(1-label) > 0 THEN """ + half_up_sql(_AUC, 6) + " END AS roc_auc FROM rk GROUP BY grp"))
def m15b(spark, sf):
    return M.roc_auc(scored(spark, sf), "score", "label", ["grp"]).select("grp", round_half_up("roc_auc", 6).alias("roc_auc"))


@query("m16_average_precision", with_sql("scored", f""", o AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS i,
 sum(label) OVER (ORDER BY score DESC, doc_id) AS tp FROM scored)
SELECT {half_up_sql('sum(CASE WHEN label=1 THEN tp/i END)/sum(label)', 6)} AS average_precision FROM o"""))
def m16(spark, sf):
    return M.average_precision(scored(spark, sf), "score", "label", "doc_id").select(round_half_up("average_precision", 6).alias("average_precision"))


def rates_sql(tp="tp", fp="fp", fn="fn") -> str:
    p = f"(CASE WHEN {tp}+{fp} > 0 THEN {tp}/({tp}+{fp})::DOUBLE ELSE 0 END)"
    r = f"(CASE WHEN {tp}+{fn} > 0 THEN {tp}/({tp}+{fn})::DOUBLE ELSE 0 END)"
    f = f"(CASE WHEN {p}+{r} > 0 THEN 2*{p}*{r}/({p}+{r}) ELSE 0 END)"
    return f"{R4(p)} AS precision, {R4(r)} AS recall, {R4(f)} AS f1"


@query("m17_confusion", with_sql("scored", f"""SELECT tp, fp, tn, fn, {rates_sql()} FROM (SELECT count(*) FILTER (WHERE score >= 0.1 AND label=1) AS tp,
 count(*) FILTER (WHERE score >= 0.1 AND label=0) AS fp, count(*) FILTER (WHERE score < 0.1 AND label=0) AS tn, count(*) FILTER (WHERE score < 0.1 AND label=1) AS fn FROM scored)"""))
def m17(spark, sf):
    return M.confusion_at(scored(spark, sf), "score", "label", 0.1)


@query("m18_best_threshold", with_sql("scored", f""", e AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
g AS (SELECT g, lo + (hi-lo)*g/200 AS threshold FROM e, range(0, 201) r(g)),
c AS (SELECT g, threshold, count(*) FILTER (WHERE score >= threshold AND label=1) AS tp, count(*) FILTER (WHERE score >= threshold AND label=0) AS fp,
 count(*) FILTER (WHERE score < threshold AND label=0) AS tn, count(*) FILTER (WHERE score < threshold AND label=1) AS fn FROM g, scored GROUP BY 1, 2),
m AS (SELECT *, {rates_sql()} FROM c)
SELECT threshold, tp, fp, tn, fn, precision, recall, f1, CASE WHEN tp=0 THEN 'the threshold never fires on a positive' END AS note FROM m
WHERE NOT (precision < 0.3 AND f1 > 0) ORDER BY f1 DESC, recall DESC, g LIMIT 1"""))
def m18(spark, sf):
    return M.best_threshold(scored(spark, sf), "score", "label")


@query("m19_regression_metrics", f"""SELECT {R4('sqrt(avg(e*e))')} AS rmse, {R4('avg(abs(e))')} AS mae, {R4('1 - sum(e*e)/(var_pop(a)*count(*))')} AS r2, {R4('sqrt(var_pop(a))')} AS baseline_rmse
FROM (SELECT value AS a, value*0.8e0 + 20 - value AS e FROM events)""")
def m19(spark, sf):
    ev = read_table(spark, sf, "events").withColumn("predicted", F.col("value") * 0.8 + 20)
    return M.regression_metrics(ev, "predicted", "value")


_BIN = "CAST(least(9, floor(least(0.999999e0, greatest(0, score))*10)) AS INTEGER)"


@query("m20_calibration", with_sql("scored", f"SELECT {_BIN} AS bin, count(*) AS n, {R4('avg(score)')} AS mean_predicted, {R4('avg(label)')} AS observed FROM scored GROUP BY 1"))
def m20(spark, sf):
    return M.calibration(scored(spark, sf), "score", "label").drop("_e")


@query("m20_calibration_error", with_sql("scored", f"SELECT {R4('sum(e)/sum(n)')} AS ece FROM (SELECT abs(avg(score)-avg(label))*count(*) AS e, count(*) AS n FROM scored GROUP BY {_BIN})"))
def m20b(spark, sf):
    return M.calibration_error(scored(spark, sf), "score", "label")


@query("m21_brier", with_sql("scored", f"SELECT {R4('avg((score-label)*(score-label))')} AS brier FROM scored"))
def m21(spark, sf):
    return M.brier(scored(spark, sf), "score", "label")


@query("m22_recall_at_k", with_sql("scored", f""", o AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS i, sum(label) OVER () AS p FROM scored)
SELECT CAST(k AS INTEGER) AS k, {R4('sum(label)/max(p)')} AS recall FROM o, (VALUES (10), (25), (50)) v(k) WHERE i <= k GROUP BY k"""))
def m22(spark, sf):
    return M.recall_at_k(scored(spark, sf), "score", "label", "doc_id", [10, 25, 50])


@query("m23_bootstrap_interval")
def m23(spark, sf):
    return M.bootstrap_ci(scored(spark, sf), "score", "label")


@query("m24_evaluate_classifier")
def m24(spark, sf):
    report, _ = E.evaluate_classifier(pixels(spark, sf), PIXELS, "label", "grp", "vec_id")
    return report.select("algorithm", "rows_scored", "groups", "positives", "folds", "roc_auc", "average_precision", "brier",
                         "ece", "threshold", "precision", "recall", "f1", "usable")


@query("m24_fold_report")
def m24b(spark, sf):
    oof = settle(E.out_of_fold(pixels(spark, sf), "grp", "label", 5, E.logistic_candidate(PIXELS, "label")))
    return E.fold_report(oof, "label", "vec_id")


@query("m25_evaluate_regressor")
def m25(spark, sf):
    df = matrix(spark, sf).withColumn("hours", F.col("discount") * 100 + F.col("quantity") / 10)
    return E.evaluate_regressor(df, FEATURES, "hours", "well_id", "row_id")[0]


@query("m26_evaluate_anomaly")
def m26(spark, sf):
    df = matrix(spark, sf)
    forest = IF.fit_iforest(df, FEATURES, "row_id")
    s = settle(IF.smoothed_scores(IF.score_iforest(df, forest), ["well_id"], ["pos"]).select("well_id", "pos", "depth", "score"))
    return E.anomaly_enrichment(s, incidents(spark, sf), ["well_id"], "depth", "start_md", "score", "pos")


@query("m26_top_enrichment", with_sql("series incidents", f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY price DESC, pos) AS r, count(*) OVER (PARTITION BY well_id) AS n
 FROM series) WHERE r <= greatest(1, CAST(floor(n*0.01e0) AS BIGINT))),
x AS (SELECT count(*) AS top_rows, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM incidents i WHERE i.well_id=t.well_id AND abs(i.start_md - t.depth) <= 60)) AS hits FROM t)
SELECT top_rows, hits, (SELECT count(*) FROM incidents) AS recorded, {R4('hits/top_rows')} AS hit_share, {R4('hits/(SELECT count(*) FROM incidents)')} AS hits_per_recorded FROM x"""))
def m26b(spark, sf):
    s = series(spark, sf).select("well_id", "pos", "depth", "price")
    return E.anomaly_enrichment(s, incidents(spark, sf), ["well_id"], "depth", "start_md", "price", "pos")


@query("m27_train_and_choose")
def m27(spark, sf):
    best, model = E.train_classifier(pixels(spark, sf), PIXELS, "label", "grp", "vec_id")
    keep = {k: best.get(k) for k in ("algorithm", "roc_auc", "average_precision", "threshold", "runner_up", "runner_up_auc", "activated")}
    return spark.createDataFrame(
        [(*keep.values(), RG.model_json(model) if model else None)],
        "algorithm string, roc_auc double, average_precision double, threshold double, runner_up string, runner_up_auc double, activated boolean, artifact string")


_GATE = with_sql("scored", f""", m AS (SELECT grp, count(*) FILTER (WHERE score >= 0.05 AND label=1) AS tp, count(*) FILTER (WHERE score >= 0.05 AND label=0) AS fp, {R4('avg(label)')} AS base,
 CASE WHEN count(*) FILTER (WHERE score >= 0.05) > 0 THEN {R4('count(*) FILTER (WHERE score >= 0.05 AND label=1)/(count(*) FILTER (WHERE score >= 0.05))::DOUBLE')} ELSE 0 END AS p FROM scored GROUP BY grp),
rk AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1)/2e0 AS ar FROM scored),
u AS (SELECT grp, CASE WHEN sum(label) > 0 AND sum(1-label) > 0 THEN {R4(_AUC)} END AS auc FROM rk GROUP BY grp),
z AS (SELECT *, {R4('p-base')} AS gain, auc IS NOT NULL AND auc < 0.5 AS inv FROM m JOIN u USING (grp))
SELECT grp, gain, gain > 0 AND NOT inv AS usable, gain > 0 AS beats_flag_all, NOT inv AS not_inverted,
 CASE WHEN gain <= 0 THEN 1 ELSE 0 END + CASE WHEN inv THEN 1 ELSE 0 END + CASE WHEN tp=0 THEN 1 ELSE 0 END AS n_reasons FROM z""")


@query("m28_deployment_gate", _GATE)
def m28(spark, sf):
    s = scored(spark, sf)
    c = M.confusion_at(s, "score", "label", 0.05, ["grp"])
    auc = M.roc_auc(s, "score", "label", ["grp"]).withColumn("roc_auc", round_half_up("roc_auc", 4))
    base = s.groupBy("grp").agg(round_half_up(F.avg("label"), 4).alias("base_precision"))
    g = M.deployment_gate(c.join(auc, "grp").join(base, "grp"))
    return g.select("grp", "gain", "usable", "beats_flag_all", "not_inverted", F.size("reasons").alias("n_reasons"))


def _trainings(spark, sf):
    """Training runs: every priority's orders of large value, in date order."""
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("timestamp").alias("trained_at"), F.col("o_orderkey").alias("id"))


_VERSIONS = """WITH o AS (SELECT o_orderpriority AS name, o_orderdate AS t, o_orderkey AS id FROM orders),
f AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR date_trunc('month', t) <> date_trunc('month', lag(t) OVER w) THEN 1 ELSE 0 END AS m,
 CASE WHEN date_trunc('month', t) = date_trunc('month', lag(t) OVER w) AND CAST(t AS DATE) <> CAST(lag(t) OVER w AS DATE) THEN 1 ELSE 0 END AS d
 FROM o WINDOW w AS (PARTITION BY name ORDER BY t, id)),
a AS (SELECT *, sum(m) OVER (PARTITION BY name ORDER BY t, id) AS major FROM f),
b AS (SELECT *, sum(d) OVER (PARTITION BY name, major ORDER BY t, id) AS minor FROM a)
SELECT name, id, major || '.' || minor || '.' || (row_number() OVER (PARTITION BY name, major, minor ORDER BY t, id) - 1) AS version FROM b"""


@query("m29_version_history", _VERSIONS)
def m29(spark, sf):
    return RG.version_history(_trainings(spark, sf), "name", "trained_at", ["id"]).select("name", "id", "version")


@query("m29_register_model", f"""WITH v AS ({_VERSIONS}), l AS (SELECT v.name, v.version FROM v JOIN orders ON o_orderkey=v.id
 QUALIFY row_number() OVER (PARTITION BY v.name ORDER BY o_orderdate DESC, v.id DESC) = 1)
SELECT name, version, false AS is_active, 'old' AS note FROM l
UNION ALL SELECT name, CAST(CAST(split_part(version, '.', 1) AS INTEGER) + 1 AS VARCHAR) || '.0.0', true, 'new' FROM l""")
def m29b(spark, sf):
    hist = RG.version_history(_trainings(spark, sf), "name", "trained_at", ["id"])
    last = hist.groupBy("name").agg(F.max_by(F.struct("version", "trained_at"), F.struct("trained_at", "id")).alias("r"), F.max("id").alias("id"))
    reg = last.select("id", "name", F.lit("KICK").alias("risk_type"), "r.trained_at", F.lit(True).alias("activate"), "r.version", F.lit("old").alias("note"))
    new = reg.select((F.col("id") + 1_000_000_000).alias("id"), "name", "risk_type", F.lit("2040-01-01").cast("timestamp").alias("trained_at"),
                     "activate", F.lit("new").alias("note"))
    return RG.register_model(reg, new).select("name", "version", "is_active", "note")


@query("m29_set_active", f"""WITH v AS ({_VERSIONS}) SELECT id, version = '1.0.0' AS is_active FROM v WHERE name='1-URGENT' UNION ALL SELECT id, false FROM v WHERE name <> '1-URGENT'""")
def m29c(spark, sf):
    hist = RG.version_history(_trainings(spark, sf), "name", "trained_at", ["id"])
    reg = hist.withColumns({"risk_type": F.lit("KICK"), "is_active": F.lit(False)})
    return RG.set_active(reg, "1-URGENT", "1.0.0").select("id", "is_active")


def _scored_intervals(spark, sf):
    s = series(spark, sf).withColumn("feature_version", F.when(F.col("flag") == "N", "v0.9.0").otherwise("v1.0.0"))
    return SV.score_intervals(s, {"KICK": STORED})


@query("m30_score_intervals", with_sql("series", f"""SELECT well_id, pos, flag <> 'N' AS available, CASE WHEN flag <> 'N' THEN {R4(_P)} END AS raw_score,
 CASE WHEN flag <> 'N' THEN {R4(_PLATT)} END AS score, CASE WHEN flag <> 'N' THEN {_PLATT} >= 0.45e0 END AS flagged FROM series"""))
def m30(spark, sf):
    return _scored_intervals(spark, sf).select("well_id", "pos", "available", "raw_score", "score", "flagged")


@query("m30_interval_summary", with_sql("series", f"""SELECT 'KICK' AS risk_type, count(*) AS scored, count(*) FILTER (WHERE {_PLATT} >= 0.45e0) AS flagged,
 {R4(f'max({R4(_PLATT)})')} AS max_score, {R4(f'avg({R4(_PLATT)})')} AS mean_score FROM series WHERE flag <> 'N'"""))
def m30b(spark, sf):
    return SV.interval_summary(_scored_intervals(spark, sf), ["risk_type"])


@query("m31_freshness", """SELECT v AS current_version, 'v1.0.0' AS loaded_version, v <> 'v1.0.0' AS stale,
 CASE WHEN v <> 'v1.0.0' THEN 'training rows are at ' || v || ' but the extractor emits v1.0.0' END AS stale_reason
FROM (SELECT arg_max(CASE WHEN event_type='view' THEN 'v1.0.0' ELSE 'v0.9.0' END, event_id) AS v FROM events)""")
def m31(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "v1.0.0").otherwise("v0.9.0").alias("feature_version"))
    return RG.freshness(ev, "event_id", "v1.0.0")


_PARTS = [("quantity", "(quantity-25)/14.3e0*0.8e0"), ("price", "(price-50000)/28657e0*(-0.5e0)"), ("discount", "(discount-0.05e0)/0.03e0*0.3e0"), ("tax", "(tax-0.04e0)/0.025e0*0.1e0")]
_LONG = ", lf AS (" + " UNION ALL ".join(f"SELECT well_id, pos, '{n}' AS feature, {R4(n)} AS value, {e} AS c FROM series" for n, e in _PARTS) + ")"


@query("m32_explain_logistic", with_sql("series", _LONG + f""" SELECT well_id, pos, CAST(row_number() OVER (PARTITION BY well_id, pos ORDER BY abs(c) DESC, feature) AS INTEGER) AS rank,
 feature, value, {R4('c')} AS contribution, CASE WHEN c > 0 THEN 'raises risk' WHEN c < 0 THEN 'lowers risk' ELSE 'neutral' END AS direction FROM lf
 QUALIFY row_number() OVER (PARTITION BY well_id, pos ORDER BY abs(c) DESC, feature) <= 3"""))
def m32(spark, sf):
    return X.explain_logistic(series(spark, sf), STORED, ["well_id", "pos"], 3)


@query("m32_check_decomposition", with_sql("series", f"SELECT well_id, pos, {half_up_sql(_Z, 6)} AS accounted_log_odds, {half_up_sql(f'ln({_P}/(1-{_P}))', 6)} AS scored_log_odds FROM series"))
def m32b(spark, sf):
    return X.check_decomposition(series(spark, sf), STORED, ["well_id", "pos"])


@query("m33_explain_boosted")
def m33(spark, sf):
    df = pixels(spark, sf)
    m = MD.fit_boosted(df, PIXELS, "label")
    return X.explain_boosted(df, m, PIXELS, ["vec_id"], 3)


_TXT = "replace(feature, '_', ' ') || ' at ' || regexp_replace(printf('%.4f', value), '\\.?0+$', '')"


def _listed_sql(x: str) -> str:
    return f"CASE WHEN len({x}) = 1 THEN {x}[1] ELSE array_to_string({x}[1:len({x})-1], ', ') || ' and ' || {x}[len({x})] END"


@query("m34_narrate", with_sql("series", _LONG + f""", o AS (SELECT well_id, pos, list({_TXT} ORDER BY abs(c) DESC, feature) FILTER (WHERE {R4('c')} > 0) AS up,
 list({_TXT} ORDER BY abs(c) DESC, feature) FILTER (WHERE {R4('c')} < 0) AS down FROM lf GROUP BY 1, 2),
x AS (SELECT well_id, pos, coalesce(up, [])[1:3] AS up, coalesce(down, [])[1:2] AS down FROM o)
SELECT x.well_id, x.pos, concat_ws(' ', CASE WHEN len(up) > 0 THEN 'Raised by ' || {_listed_sql('up')} || '.' END,
 CASE WHEN len(down) > 0 THEN 'Lowered by ' || {_listed_sql('down')} || '.' END, CASE WHEN len(up) = 0 THEN 'Nothing here raises the score.' END,
 'Score: ' || regexp_replace(printf('%.1f', {half_up_sql(f'{_P}*100', 1)}), '\\.?0+$', '') || '%.') AS narrative
FROM x JOIN series s ON s.well_id=x.well_id AND s.pos=x.pos"""))
def m34(spark, sf):
    return series(spark, sf).select("well_id", "pos", X.narrate(STORED).alias("narrative"))


_RULES = [("KICK", 1, "quantity", "<", 5.0), ("KICK", 2, "price", ">", 90000.0), ("MUD_LOSS", 3, "discount", ">", 0.08), ("MUD_LOSS", 4, "static_minutes", ">", 45.0)]


@query("m35_guidance", with_sql("series", ", g AS (SELECT well_id, pos, CASE WHEN line_no % 2 = 0 THEN 'KICK' ELSE 'MUD_LOSS' END AS risk_type, quantity, price, discount FROM series)" + " UNION ALL ".join(
    f""" SELECT well_id, pos, {n} AS rule_no, """ + (
        f"""CASE WHEN {f} {o} {t}e0 THEN 'matched' ELSE 'unmatched' END AS status, {R4(f)} AS value, {half_up_sql(f'1 - least(1e0, abs({f}-{t}e0)/greatest(1e0, {t}e0))', 6)} AS closeness"""
        if f != "static_minutes" else "'unevaluable' AS status, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS closeness") + f" FROM g WHERE risk_type='{r}'"
    for r, n, f, o, t in _RULES)))
def m35(spark, sf):
    rules = X.guidance_table(spark, [(r, [(f, o, t)], "x") for r, _, f, o, t in _RULES])
    s = series(spark, sf).select(
        "well_id", "pos", F.when(F.col("line_no") % 2 == 0, "KICK").otherwise("MUD_LOSS").alias("risk_type"),
        F.create_map(*[x for c in ("quantity", "price", "discount") for x in (F.lit(c), F.col(c))]).alias("values"))
    return X.recommend(s, "values", rules).select("well_id", "pos", "rule_no", "status", "value", "closeness")


@query("m35_guidance_catalogue", with_sql("series", """SELECT risk_type, CAST(rule_no AS INTEGER) AS rule_no, status, count(*) AS n FROM (
 SELECT 'KICK' AS risk_type, unnest([4, 5]) AS rule_no, 'unevaluable' AS status FROM series
 UNION ALL SELECT 'KICK', 6, CASE WHEN order_id % 300 > 150 THEN 'matched' ELSE 'unmatched' END FROM series
 UNION ALL SELECT 'TORQUE_SPIKE', unnest([10, 12]), 'unevaluable' FROM series
 UNION ALL SELECT 'TORQUE_SPIKE', 11, CASE WHEN pos % 90 > 45 THEN 'matched' ELSE 'unmatched' END FROM series) GROUP BY ALL"""))
def m35b(spark, sf):
    from strataframe.plans.featuring import channels

    ch = channels(spark, sf).withColumn("depth_m", F.col("depth"))
    names = ["depth_m", "inclination_deg", "gas_ratio_ppm"]
    rows = ch.select("well_id", "depth", F.explode(F.array(F.lit("KICK"), F.lit("TORQUE_SPIKE"))).alias("risk_type"),
                     F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("values"))
    out = X.recommend(rows, "values", X.guidance_table(spark))
    return out.groupBy("risk_type", "rule_no", "status").agg(F.count(F.lit(1)).alias("n"))


@query("m36_describe_models", f"""SELECT event_type AS name, CASE WHEN event_type='view' THEN 'held-out ROC AUC ' || printf('%.4f', {R4('avg(value)/1000')}) || ' on ' || count(DISTINCT user_id) || ' unseen wells'
 WHEN event_type='error' THEN 'held-out RMSE ' || printf('%.4f', {R4('avg(value)')}) || 'h vs ' || printf('%.4f', {R4('max(value)')}) || 'h baseline' ELSE 'rows ' || count(*) END AS headline FROM events GROUP BY event_type""")
def m36(spark, sf):
    r = read_table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.avg("value").alias("a"), F.max("value").alias("x"), F.countDistinct("user_id").alias("groups"), F.count(F.lit(1)).alias("n"))
    r = r.select("name", "groups", F.when(F.col("name") == "view", round_half_up(F.col("a") / 1000, 4)).alias("roc_auc"),
                 F.when(F.col("name") == "error", "regressor").otherwise("classifier").alias("kind"), round_half_up("a", 4).alias("rmse"),
                 round_half_up("x", 4).alias("baseline_rmse"), F.concat(F.lit("rows "), F.col("n").cast("string")).alias("verdict"))
    return RG.describe_models(r).select("name", "headline")


