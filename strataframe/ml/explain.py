"""Why a score is what it is: contributions, narrative, guidance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.numeric import finite, round_half_up
from strataframe.ml.models import LogisticModel, tree_nodes

TOP_FACTORS, TOP_TREES, NARRATED = 8, 6, 5


def direction(c: Column) -> Column:
    return F.when(c > 0, "raises risk").when(c < 0, "lowers risk").otherwise("neutral")


def factors(model: LogisticModel, top: int | None = TOP_FACTORS) -> Column:
    """Contributions of one row as an array, strongest first; built and sorted inside the row, so no shuffle."""
    known = [round_half_up(f, 4).isNotNull() for f in model.features]
    parts = F.array(*[
        F.struct(
            (~k).alias("_unknown"), (-F.abs(c)).alias("_order"), F.lit(f).alias("feature"), round_half_up(f, 4).alias("value"),
            round_half_up(c, 4).alias("contribution"), direction(c).alias("direction"), c.alias("exact"))
        for f, c, k in zip(model.features, model.contributions(), known)
    ])
    n = reduce(lambda x, y: x + y, [k.cast("int") for k in known])  # missing values stand last and are cut off
    return F.slice(F.sort_array(parts), F.lit(1), F.least(F.lit(top), n) if top else n)


def explain_logistic(df: DataFrame, model: LogisticModel, keep: list[str], top: int = TOP_FACTORS) -> DataFrame:
    """(keep..., rank, feature, value, contribution, direction): the strongest contributions per row."""
    out = df.select(*keep, F.posexplode(factors(model, top)).alias("_i", "_f"))
    return out.select(*keep, (F.col("_i") + 1).alias("rank"), "_f.feature", "_f.value", "_f.contribution", "_f.direction")


def check_decomposition(df: DataFrame, model: LogisticModel, keep: list[str]) -> DataFrame:
    """Log-odds by summing contributions against log-odds recovered from the score itself."""
    total = F.aggregate(factors(model, None), F.lit(0.0), lambda a, s: a + s["exact"])
    p = model.score()
    return df.select(*keep, round_half_up(F.lit(model.bias) + total, 6).alias("accounted_log_odds"),
                     round_half_up(F.log(p / (1 - p)), 6).alias("scored_log_odds"))


def _plain(x: float, digits: int = 4) -> str:
    """Number as text without trailing zeros."""
    return f"{x:.{digits}f}".rstrip("0").rstrip(".")


def _listed(names: list[str]) -> str:
    return names[0] if len(names) == 1 else ", ".join(names[:-1]) + " and " + names[-1]


def narrate(model: LogisticModel) -> Column:
    """Sentence on what drives the score up and what works against it, from the five strongest factors.

    Contributions and score come from Spark; rows are put into words in Arrow batches.
    """
    by_name = sorted(zip(model.features, model.contributions()), key=lambda x: x[0])  # equal strengths go by name
    said, k = [f.replace("_", " ") for f, _ in by_name], len(by_name)

    @F.pandas_udf("string")
    def told(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
        value, c, percent = x[:, :k], x[:, k : 2 * k], x[:, 2 * k]
        unknown = np.isnan(value)
        first = np.argsort(np.where(unknown, np.inf, -np.abs(c)), axis=1, kind="stable")[:, :NARRATED]
        sign = np.where(unknown, 0, np.sign(np.floor(c * 1e4 + 0.5)))  # of the contribution as it is shown
        out = []
        for v, s, five, p in zip(value.tolist(), sign.tolist(), first.tolist(), percent.tolist()):
            up = [f"{said[i]} at {_plain(v[i])}" for i in [i for i in five if s[i] > 0][:3]]
            down = [f"{said[i]} at {_plain(v[i])}" for i in [i for i in five if s[i] < 0][:2]]
            out.append((f"Raised by {_listed(up)}. " if up else "") + (f"Lowered by {_listed(down)}. " if down else "")
                       + ("" if up else "Nothing here raises the score. ") + f"Score: {_plain(p, 1)}%.")
        return pd.Series(out, dtype=object)

    return told(*[round_half_up(f, 4) for f, _ in by_name], *[c for _, c in by_name], round_half_up(model.score() * 100, 1))


def explain_boosted(df: DataFrame, model, features: list[str], keep: list[str], top: int = TOP_TREES) -> DataFrame:
    """(keep..., rank, tree, contribution, samples, path): the trees that move a row most.

    The ensemble is a fixed number of small trees; its node table is shared with the tasks and rows are walked in
    Arrow batches.
    """
    trees: dict[int, dict] = {}
    for r in tree_nodes(df.sparkSession, model).collect():
        trees.setdefault(int(r["tree"]), {})[r["id"]] = r
    packed = []
    for t, ns in sorted(trees.items()):
        size = max(ns) + 1
        table = {c: np.zeros(size, dtype=d) for c, d in
                 (("feature", "i8"), ("threshold", "f8"), ("left", "i8"), ("right", "i8"), ("prediction", "f8"), ("n", "i8"))}
        for i, r in ns.items():
            for c in table:
                table[c][i] = r[c]
        packed.append((t, float(model.treeWeights[t]), table))
    shared = df.sparkSession.sparkContext.broadcast(packed)
    out = "array<struct<tree:int,contribution:double,samples:bigint,path:string>>"

    def told_path(table: dict, x: np.ndarray) -> tuple[int, str]:
        i, path = 0, []
        while table["feature"][i] >= 0:
            f, at = table["feature"][i], table["threshold"][i]
            down = x[f] <= at
            path.append(f"{features[f]} {'<=' if down else '>'} {at:.6g}")
            i = table["left"][i] if down else table["right"][i]
        return int(table["n"][i]), " AND ".join(path)

    @F.pandas_udf(out)
    def walk(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
        every = np.arange(len(x))
        moved = np.empty((len(x), len(shared.value)))
        for k, (_, weight, table) in enumerate(shared.value):  # all rows of the batch go down a tree together
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := table["feature"][at] >= 0).any():
                down = x[every, np.maximum(table["feature"][at], 0)] <= table["threshold"][at]
                at = np.where(inner, np.where(down, table["left"][at], table["right"][at]), at)
            moved[:, k] = np.round(weight * table["prediction"][at], 5)
        first = np.argsort(-np.abs(moved), axis=1, kind="stable")[:, :top]  # equal moves: the earlier tree
        rows = []
        for i, chosen in enumerate(first):  # paths of the kept trees only
            kept = []
            for k in chosen:
                samples, path = told_path(shared.value[k][2], x[i])
                kept.append({"tree": shared.value[k][0] + 1, "contribution": float(moved[i, k]), "samples": samples, "path": path})
            rows.append(kept)
        return pd.Series(rows)

    told = df.withColumn("_w", walk(*[F.coalesce(finite(f), F.lit(0.0)) for f in features]))
    told = told.select(*keep, F.posexplode("_w").alias("_i", "_m"))
    return told.select(*keep, (F.col("_i") + 1).alias("rank"), "_m.*")


# Features, tests and limits of the guidance rules; a rule holds when all its conditions hold. Texts are ours.
GUIDANCE = [
    ("MUD_LOSS", [("fracture_margin_ppg", "<", 0.8)],
     "Little room is left to the fracture gradient: lower the circulating density (thinner mud, fewer strokes) or clean the hole first."),
    ("MUD_LOSS", [("flow_deficit_lpm", ">", 8.0)],
     "More mud goes in than comes back: verify pit and trip-tank readings, then decide on a pill if the loss goes on."),
    ("MUD_LOSS", [("is_overbalanced_ecd", ">", 0.3)],
     "Circulating density exceeds what the rock holds: cut mud weight as far as pore pressure allows, or have sealing material ready."),
    ("KICK", [("overbalance_ppg", "<", 0.2)],
     "Mud weight barely covers the predicted pore pressure: revisit that prediction before making hole."),
    ("KICK", [("d_exponent_trend", "<", 0.0)],
     "The drilling exponent no longer rises with depth, as happens above high pressure: stop and check for flow."),
    ("KICK", [("gas_ratio_ppm", ">", 150.0)],
     "Gas readings are up: space out connections and watch the next gas peak."),
    ("STUCK_PIPE", [("rop_ratio_local", "<", 0.5), ("torque_ratio_local", ">", 1.3)],
     "Slow progress at high torque points to the pipe being held by the wall: circulate without rotating and plan a freeing pill."),
    ("STUCK_PIPE", [("static_minutes", ">", 45.0)],
     "The pipe stood still for long: move or circulate at intervals so that no cake builds around it."),
    ("STUCK_PIPE", [("is_underbalanced", ">", 0.0)],
     "Pressure across the wall is off balance: bring mud weight back inside its window."),
    ("TORQUE_SPIKE", [("torque_ratio_local", ">", 1.4), ("depth_m", ">", 600.0)],
     "Torque stands well over its recent level: circulate and wipe this stretch before going on."),
    ("TORQUE_SPIKE", [("inclination_deg", ">", 45.0)],
     "Cuttings settle easily at this angle: raise flow and hold back the drilling rate."),
    ("TORQUE_SPIKE", [("rop_ratio_local", ">", 1.0), ("torque_ratio_local", ">", 1.4)],
     "The bit outruns the hole cleaning: ream slowly before the next stand."),
]
RULE_COLUMNS = "risk_type string, rule_no int, conditions array<struct<feature:string,test:string,at:double>>, consider string"


def guidance_table(spark: SparkSession, rules=GUIDANCE) -> DataFrame:
    rows = [(r, i + 1, c, t) for i, (r, c, t) in enumerate(rules)]
    return F.broadcast(spark.createDataFrame(rows, RULE_COLUMNS))


def recommend(df: DataFrame, values: str, rules: DataFrame) -> DataFrame:
    """Rows joined to the guidance of their risk: status `matched`, `unmatched` or `unevaluable`, and closeness.

    `values` is a map of feature values. A rule with an unknown feature cannot be evaluated. Closeness is how near the
    first condition's value sits to its threshold, 1 at the threshold.
    """
    joined = df.join(rules, "risk_type")
    values_of = F.transform("conditions", lambda c: F.try_element_at(F.col(values), c["feature"]))
    met = F.transform(
        "conditions",
        lambda c: F.when(c["test"] == "<", F.try_element_at(F.col(values), c["feature"]) < c["at"]).otherwise(
            F.try_element_at(F.col(values), c["feature"]) > c["at"]))
    known = F.forall(values_of, lambda v: v.isNotNull())
    first, at = F.element_at(values_of, 1), F.element_at("conditions", 1)["at"]
    near = 1 - F.least(F.lit(1.0), F.abs(first - at) / F.greatest(F.abs(at), F.lit(1.0)))
    status = F.when(~known, "unevaluable").when(F.forall(met, lambda m: m), "matched").otherwise("unmatched")
    return joined.withColumns({"status": status, "value": round_half_up(first, 4),
                               "closeness": F.when(known, round_half_up(near, 6))})

