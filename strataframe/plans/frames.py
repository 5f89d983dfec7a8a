"""Domain frames derived from the driver tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.operators.series import position
from strataframe.sources.tables import read_table

SERIES_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus"]
CATEGORIES = ["MUD_LOSS", "KICK", "STUCK_PIPE", "TORQUE_SPIKE"]
EVENT_TYPES = ["Mud Loss", "Kick", "Stuck Pipe", "High Torque"]


def _spread(step: int, span: int, beside: float) -> F.Column:
    """Coordinate of a place: six places a few kilometres apart, the sixes all over the globe."""
    six = F.floor(F.col("s_suppkey") / 6)
    return (six * step % span) / F.lit(1000.0) - F.lit(span / 2000.0) + (F.col("s_suppkey") % 6) * F.lit(beside)


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as places on the globe."""
    s = F.col("s_suppkey")
    return read_table(spark, sf, "supplier").select(
        s.alias("place_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id"),
        _spread(37_037, 120_000, 0.05).alias("lat"), _spread(71_071, 360_000, 0.07).alias("lng"),
        F.col("s_acctbal").alias("balance"))


def series(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Line items per supplier in shipping order as a depth-indexed series, five metres a step."""
    li = position(read_table(spark, sf, "lineitem"), ["l_suppkey"], SERIES_ORDER, "pos")
    return li.select(
        F.col("l_suppkey").alias("well_id"), "pos", (F.col("pos") * 5.0).alias("depth"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("ship_ts"), *extra)


def pick(names: list[str], i) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Returned line items as recorded events of a well."""
    s = series(spark, sf).where(F.col("flag") == "R")
    kind = F.col("line_no") % 4
    sev = 1 + F.col("order_id") % 5
    return s.select(
        "well_id", (F.col("well_id") * 10_000_000 + F.col("pos")).alias("event_id"),
        pick(CATEGORIES, kind).alias("category"), pick(EVENT_TYPES, kind).alias("event_type"),
        F.col("depth").alias("start_md"), (F.col("depth") + F.col("line_no") * 10).alias("end_md"),
        sev.alias("severity"), round_half_up(F.col("discount") * 100, 1).alias("npt_hours"),
        F.concat(F.lit("Formation "), F.floor((F.col("depth") - F.col("well_id") % 100) / 500).cast("string")).alias("formation"))


def tops(spark: SparkSession, sf: str) -> DataFrame:
    """Six depth intervals per place with gradients; some gradients are unknown."""
    i, s = F.col("i"), F.col("place_id")
    base = places(spark, sf).select("place_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    top = (i * 500 + s % 100).cast("double")
    pp = 8.5 + i * 0.25 + (s % 10) * 0.05
    fg = pp + 3 + (s % 7) * 0.1
    return base.select(
        s.alias("well_id"), i.cast("bigint").alias("formation_no"), F.concat(F.lit("Formation "), i.cast("string")).alias("formation"),
        top.alias("top_md"), (top + 400).alias("base_md"), pp.alias("pp_ppg"), fg.alias("fg_ppg"),
        F.when(s % 11 != 0, pp * 0.0518894).alias("pp_gradient"), F.when(s % 13 != 0, fg * 0.0518894).alias("fg_gradient"),
        ((i * 7 + s) % 10 / 10).alias("instability"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as time samples of a user; the clock is UTC."""
    return read_table(spark, sf, "events").select(
        F.col("user_id").alias("well_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value",
        "props")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a coarse score, a label and a group."""
    d = read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return d.join(read_table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("source").alias("grp"), round_half_up(F.least(F.lit(1.0), F.col("n_chars") / 20000), 3).alias("score"),
        F.col("quality").alias("label"), "toxic")


def half_up_sql(expr: str, digits: int = 0) -> str:
    p = f"1e{digits}"
    return f"(floor(({expr})*{p}+0.5e0)/{p})"


_ORDER = ", ".join(SERIES_ORDER)
_CASE4 = lambda names, i: f"CASE {i} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"

CTE = {
    "places": (
        [], """SELECT s_suppkey AS place_id, s_name AS name, s_nationkey AS nation_id,
        ((s_suppkey//6)*37037 % 120000)/1000e0 - 60e0 + (s_suppkey % 6)*0.05e0 AS lat,
        ((s_suppkey//6)*71071 % 360000)/1000e0 - 180e0 + (s_suppkey % 6)*0.07e0 AS lng,
        s_acctbal AS balance FROM supplier"""),
    "series": (
        [], f"""SELECT l_suppkey AS well_id, pos, pos*5.0::DOUBLE AS depth, l_quantity AS quantity,
        l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_orderkey AS order_id,
        l_linenumber AS line_no, l_partkey AS part_id, l_shipdate AS ship_ts
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) AS pos FROM lineitem)"""),
    "incidents": (
        ["series"], f"""SELECT well_id, well_id*10000000+pos AS event_id, {_CASE4(CATEGORIES, 'line_no % 4')} AS category,
        {_CASE4(EVENT_TYPES, 'line_no % 4')} AS event_type, depth AS start_md, depth + line_no*10 AS end_md,
        1 + order_id % 5 AS severity, {half_up_sql('discount*100', 1)} AS npt_hours,
        'Formation ' || CAST(CAST(floor((depth - well_id % 100)/500) AS BIGINT) AS VARCHAR) AS formation
        FROM series WHERE flag='R'"""),
    "tops": (
        [], """SELECT s AS well_id, i AS formation_no, 'Formation ' || CAST(i AS VARCHAR) AS formation,
        CAST(i*500 + s % 100 AS DOUBLE) AS top_md, CAST(i*500 + s % 100 + 400 AS DOUBLE) AS base_md, pp AS pp_ppg,
        pp + 3 + (s % 7)*0.1::DOUBLE AS fg_ppg,
        CASE WHEN s % 11 != 0 THEN pp*0.0518894::DOUBLE END AS pp_gradient,
        CASE WHEN s % 13 != 0 THEN (pp + 3 + (s % 7)*0.1::DOUBLE)*0.0518894::DOUBLE END AS fg_gradient,
        ((i*7 + s) % 10)/10.0::DOUBLE AS instability
        FROM (SELECT s_suppkey AS s, i, 8.5::DOUBLE + i*0.25::DOUBLE + (s_suppkey % 10)*0.05::DOUBLE AS pp
              FROM supplier, range(0, 6) r(i))"""),
    "samples": (
        [], "SELECT user_id AS well_id, ts, event_id, event_type, value, props FROM events"),
    "scored": (
        [], f"""SELECT d.doc_id, d.source AS grp, {half_up_sql('least(1.0::DOUBLE, d.n_chars/20000::DOUBLE)', 3)} AS score,
        l.quality AS label, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""),
}


def with_sql(names: str | list[str], body: str, recursive: bool = False) -> str:
    """`body` behind the named common table expressions and whatever those need. `body` may start with more of them."""
    done: list[str] = []

    def need(n: str) -> None:
        for d in CTE[n][0]:
            need(d)
        if n not in done:
            done.append(n)

    for n in names.split() if isinstance(names, str) else names:
        need(n)
    head = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in done)
    word = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.startswith(","):
        return f"{word} {head}\n{body}"
    return f"{word} {head}\n{body}" if head else body
