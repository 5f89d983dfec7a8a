"""Aggregations: counts, exposure, leave-one-out priors, roll-ups, column statistics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import finite, round_half_up
from strataframe.operators.series import NEVER_HOT, join_keyed, running
from strataframe.session import settle


def category_counts(df: DataFrame, by: list[str], col: str, values: list[str], prefix: str = "n_") -> DataFrame:
    """One count column per listed category plus the total."""
    return df.groupBy(*by).agg(
        *[F.count_if(F.col(col) == v).alias(f"{prefix}{v.lower()}") for v in values],
        F.count(F.lit(1)).alias(f"{prefix}all"),
    )


def exposure(df: DataFrame, by: list[str], entity: str) -> DataFrame:
    """Rows and distinct entities per group (entity-level counts are taken in two steps, so no key is gathered)."""
    per = df.groupBy(*by, entity).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*by).agg(F.sum("_n").alias("entries"), F.count(F.lit(1)).alias("entities"))


def loo_priors(events: DataFrame, tops: DataFrame, by: str, entity: str, category: str, severity: str,
               rates: dict[str, str], p: float = 0.9) -> DataFrame:
    """Group history with the own entity left out: event and category rates, severity percentile, other entities hit.

    Exact: own counts are subtracted from the group's, not scaled. The severity percentile comes from a histogram per
    (group, severity) minus the entity's own histogram, so nothing is sorted per entity. `rates` maps output names to
    categories; severities are whole numbers.
    """
    exp = exposure(tops, [by], entity).select(by, F.col("entities").alias("_wells"))
    pairs = tops.select(by, entity).distinct()
    counts = {f"_{o}": F.count_if(F.col(category) == c) for o, c in rates.items()}
    sums = ["_all", *counts]
    # Written once: all that follows reads these counts, and each reader would work out the events again.
    cells = settle(events.groupBy(by, entity, severity).agg(
        F.count(F.lit(1)).alias("_all"), *[c.alias(o) for o, c in counts.items()]), "cells")
    own = cells.groupBy(by, entity).agg(*[F.sum(c).alias(c) for c in sums])
    total = own.groupBy(by).agg(*[F.sum(c).alias(f"{c}_t") for c in sums], F.count(F.lit(1)).alias("_hit_t"))
    base = join_keyed(join_keyed(pairs, exp, [by]), total, [by])
    base = join_keyed(base, own.withColumn("_hit", F.lit(1)), [by, entity])
    den = F.greatest(F.lit(1), F.col("_wells") - 1)

    def left(c: str) -> Column:
        return F.coalesce(F.col(f"{c}_t"), F.lit(0)) - F.coalesce(F.col(c), F.lit(0))

    out = base.select(
        by, entity,
        round_half_up(left("_all") / den, 4).alias("event_rate"),
        *[round_half_up(left(f"_{o}") / den, 4).alias(o) for o in rates],
        left("_hit").alias("other_entities_hit"),
        den.alias("exposure_entities"),
        left("_all").alias("_n"),
    )
    hist = cells.select(by, entity, severity, F.col("_all").alias("_c"))
    all_hist = hist.groupBy(by, severity).agg(F.sum("_c").alias("_ct"))
    grid = join_keyed(out.select(by, entity, "_n"), all_hist, [by], "inner")
    grid = join_keyed(grid, hist, [by, entity, severity])
    grid = grid.withColumn("_rest", F.col("_ct") - F.coalesce(F.col("_c"), F.lit(0))).where("_rest > 0")
    run = running(grid, [by, entity], [severity], {"_upto": ("sum", F.col("_rest"))}, limit=NEVER_HOT)
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    hit = run.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_rest") <= at))
    p90 = hit.select(by, entity, F.col(severity).cast("double").alias("severity_p90"))
    return join_keyed(out.drop("_n"), p90, [by, entity]).withColumn(
        "severity_p90", F.coalesce("severity_p90", F.lit(0.0)))


def document_rollup(pages: DataFrame, doc: str, source: str, confidence: str, text: str) -> DataFrame:
    """Pages, image pages, mean confidence without nulls, size and derived status per document."""
    out = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col(source) == "none").alias("image_pages"),
        round_half_up(F.avg(confidence), 4).alias("ocr_confidence"),
        (F.sum(F.length(text)) * 3).alias("size_bytes"),
    )
    return out.withColumns({
        "text_pages": F.col("page_count") - F.col("image_pages"),
        "ocr_status": F.when(F.col("image_pages") == F.col("page_count"), "partial").otherwise("text"),
        "text_source": F.when(F.col("image_pages") > 0, "mixed").otherwise("pdf_text_layer"),
    })


def document_frequency(tokens: DataFrame, ref: str, term: str) -> DataFrame:
    """Documents per term."""
    return tokens.select(ref, term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df"))


def update_df(df: DataFrame, removed: DataFrame, added: DataFrame, term: str = "term") -> DataFrame:
    """Document frequencies after taking out and adding (ref, term) rows; never below zero."""
    signed = (
        df.select(term, F.col("df").alias("_d"))
        .unionByName(removed.select(term, F.lit(-1).cast("bigint").alias("_d")))
        .unionByName(added.select(term, F.lit(1).cast("bigint").alias("_d")))
    )
    return signed.groupBy(term).agg(F.greatest(F.lit(0).cast("bigint"), F.sum("_d")).alias("df"))


# Fixed value: smallest deviation a column may have.
DEV_FLOOR = 1e-6


def column_stats(df: DataFrame, cols: list[str], floor: float = DEV_FLOOR) -> DataFrame:
    """One row per column: finite count, mean (0 when empty) and population deviation (floored; 1 below two values).

    Values go long first, so the plan stays small for any number of columns; the partial aggregate leaves one row per
    column and task.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), finite(c).alias("v")) for i, c in enumerate(cols)])).alias("r")).select("r.*")
    agg = long.groupBy("i").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    return agg.select(
        name.alias("feature"), "n", F.coalesce("m", F.lit(0.0)).alias("mean"),
        F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(floor), F.col("s"))).alias("dev"))


def score_summary(df: DataFrame, score: str, flagged: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.col(flagged)).alias("flagged"),
        round_half_up(F.max(score), 4).alias("max_score"), round_half_up(F.avg(score), 4).alias("mean_score"),
    )


def spread(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        round_half_up(F.avg(col), 4).alias("mean"), round_half_up(F.stddev_pop(col), 4).alias("std_dev"),
        round_half_up(F.min(col), 4).alias("min"), round_half_up(F.max(col), 4).alias("max"),
    )


def corpus_summary(frames: dict[str, DataFrame], events: DataFrame, category: str) -> DataFrame:
    """One row: a row count per named frame and a map of event counts by category."""
    cats = events.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    packed = cats.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "n")))).alias("by_category"))
    for name, df in frames.items():
        packed = packed.withColumn(name, df.agg(F.count(F.lit(1))).scalar())
    return packed


def npt_by(df: DataFrame, by: list[str], hours: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(hours).alias("npt_total"), F.count(F.lit(1)).alias("n"))
