"""Offset ranking of neighbours, section projection, programme comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.correlation.shortlist import shortlist
from strataframe.functions.geo import along_track_km, bearing_deg, cross_track_km
from strataframe.functions.numeric import round_half_up
from strataframe.operators.joins import asof_join, band_totals, geo_neighbors, nearest_events
from strataframe.operators.topk import topk, topk_list
from strataframe.session import settle

# Score weights per strategy, trouble bonus per event and its cap.
SAME_FORMATION = 0.5
STRATEGY = {"pressure": {"pressure": 0.3, "depth": 0.2}, "depth": {"pressure": 0.15, "depth": 0.35}}
TROUBLE_STEP, TROUBLE_CAP = 0.05, 0.15


@dataclass
class OffsetSpec:
    strategy: str = "pressure"
    radius_km: float = 50.0
    limit: int = 12
    tolerance: float = 120.0
    nearest: int = 6


def depth_similarity(a: Column, b: Column, tolerance: float) -> Column:
    delta = F.abs(a - b)
    return F.when(delta > tolerance, 0.0).otherwise(1 - delta / tolerance)


def gradient_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean closeness over the gradients both sides know; null when there is none."""

    def one(a, b):
        spread = F.greatest(F.abs(a), F.abs(b))
        value = F.when(spread == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / spread))
        return F.when(a.isNotNull() & b.isNotNull(), value)

    vals = [one(a, b) for a, b in pairs]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    known = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
    return F.when(known > 0, total / known)


def rank_offsets(targets: DataFrame, places: DataFrame, tops: DataFrame, events: DataFrame,
                 spec: OffsetSpec = OffsetSpec(), marker: str = "base_md") -> DataFrame:
    """Ranked offsets for many targets at once.

    targets (place_id, lat, lng, depth), one depth per target; places (place_id, lat, lng); tops (place_id,
    formation, base_md, pp_gradient, fg_gradient); events (place_id, event_id, event_depth). Own tops, the pairs within
    the radius that can be among the first, as-of tops at the target depth, similarities, nearby events, then the ranked
    cut: `shortlist` bounds all pairs, what it leaves is worked out in full.
    """
    places = places.select("place_id", "lat", "lng")
    take = ["formation", marker, "pp_gradient", "fg_gradient"]
    own = asof_join(targets.select("place_id", "depth"), tops, ["place_id"], "depth", marker, take, fallback="first")
    own = settle(own.select("place_id", "depth", *[F.col(c).alias(f"t_{c}") for c in take]), "own")
    away_tops = tops.withColumnRenamed("place_id", "offset_id")
    away_events = settle(events.select(F.col("place_id").alias("offset_id"), "event_id", "event_depth"), "events")
    short = shortlist(targets, places, own, away_tops, away_events, spec, marker, STRATEGY[spec.strategy], SAME_FORMATION,
                      TROUBLE_STEP, TROUBLE_CAP)
    pairs = geo_neighbors(targets, places, spec.radius_km, among=short)
    pairs = settle(pairs.select("place_id", "depth", F.col("near_place_id").alias("offset_id"), "distance_km",
                                bearing_deg("lat", "lng", "near_lat", "near_lng").alias("bearing")), "pairs")
    away = asof_join(pairs, away_tops, ["offset_id"], "depth", marker, take, fallback="first")
    both = away.join(own, ["place_id", "depth"]).where(F.col("t_formation").isNotNull() & F.col("formation").isNotNull())

    key = ["place_id", "offset_id"]
    asked = pairs.select(*key, "depth")
    trouble = band_totals(asked, away_events, ["offset_id"], "depth", "event_depth", spec.tolerance * 2, spec.tolerance * 2,
                          {"trouble_nearby": F.lit(1)}).drop("depth")

    out = both.join(trouble, key, "left").fillna(0, ["trouble_nearby"])
    same = F.col("formation") == F.col("t_formation")
    deep = depth_similarity(F.col(f"t_{marker}"), F.col(marker), spec.tolerance)
    press = gradient_similarity([(F.col("t_pp_gradient"), F.col("pp_gradient")),
                                 (F.col("t_fg_gradient"), F.col("fg_gradient"))])
    w = STRATEGY[spec.strategy]
    score = (F.when(same, SAME_FORMATION).otherwise(0.0) + F.coalesce(press, F.lit(0.0)) * w["pressure"]
             + F.coalesce(deep, F.lit(0.0)) * w["depth"])
    bonus = F.least(F.lit(TROUBLE_CAP), F.col("trouble_nearby") * TROUBLE_STEP)
    out = out.select(
        "place_id", "offset_id", "depth", round_half_up("distance_km", 2).alias("distance_km"),
        round_half_up("bearing", 1).alias("bearing_deg"),
        round_half_up(F.least(F.lit(1.0), score + bonus), 4).alias("score"),
        round_half_up(score, 4).alias("geology_score"), same.alias("same_formation"),
        F.col("t_formation").alias("target_formation"), F.col("formation").alias("offset_formation"),
        round_half_up(deep, 4).alias("depth_match"), round_half_up(press, 4).alias("pressure_match"),
        "trouble_nearby",
    )
    kept = settle(topk(out, ["place_id"], ["-score", "distance_km", "offset_id"], spec.limit), "offsets")
    return list_nearby(kept, away_events, key, spec)


def list_nearby(kept: DataFrame, events: DataFrame, key: list[str], spec: OffsetSpec) -> DataFrame:
    """Adds the nearest events of the ranked offsets; no score depends on them, so the pairs that were cut need none."""
    reach = spec.tolerance * 3
    near = nearest_events(kept.select(*key, "depth"), events, ["offset_id"], "depth", "event_depth", spec.nearest, reach, reach,
                          ["event_id"])
    listed = topk_list(near, key, ["offset_m", "event_id"], spec.nearest, ["event_id", "offset_m"], "nearby_events")
    return kept.join(listed, key, "left")


def section_view(places: DataFrame, line: tuple[float, float, float, float], half_width_km: float) -> DataFrame:
    """Places projected on a line, within half a width of it: distance along and across."""
    p1 = [F.lit(float(v)) for v in line]
    out = places.withColumns({
        "along_km": along_track_km("lat", "lng", *p1), "across_km": cross_track_km("lat", "lng", *p1)})
    return out.where(F.abs(F.col("across_km")) <= half_width_km)


def compare_programs(own: DataFrame, other: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows matched on section or formation with the difference other - own of each numeric value."""
    right = other.select(*key, F.col("place_id").alias("offset_id"), *[F.col(v).alias(f"offset_{v}") for v in values])
    joined = own.join(right, key).where(F.col("place_id") != F.col("offset_id"))
    return joined.withColumns({f"diff_{v}": F.col(f"offset_{v}") - F.col(v) for v in values})
