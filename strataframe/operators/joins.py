"""Joins that Spark has no operator for: as-of, interval, band, radius, coverage. None of them is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.geo import RADIUS_KM, chord_km, haversine_km, unit_xyz
from strataframe.operators.series import checked_limit, has_hot_key, hot_limit, join_keyed, position, row_frames, running


def first_match_join(left: DataFrame, right: DataFrame, key: list[str], order: list[str], take: list[str],
                     how: str = "left") -> DataFrame:
    """Each left row with at most one right row: the first of its key in `order`.

    The right side is reduced by a partial aggregate, so a key with many right rows is never gathered.
    """
    first = right.groupBy(*key).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_f"))
    out = join_keyed(left, first, key, how)
    return out.select(*left.columns, *[F.col(f"_f.{c}").alias(c) for c in take])


def _edge(right: DataFrame, by: list[str], at: str, take: list[str], which: str) -> DataFrame:
    pick = F.min if which == "first" else F.max
    return right.groupBy(*by).agg(pick(F.struct(F.col(at).alias("at"), F.struct(*take).alias("r"))).alias("_edge")).select(
        *by, F.col("_edge.r").alias("_edge"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    take: list[str],
    direction: str = "backward",
    fallback: str | None = None,
    limit: float | None = None,
) -> DataFrame:
    """Left rows with the nearest right row at or before (`backward`) or at or after (`forward`) them.

    Both sides are laid on one axis and the last right row seen is carried along: one shuffle, no pairs. Of right rows
    at one place the largest `take` wins backward, the smallest forward. Rows without a place match nothing; a null key
    is a key. `fallback` = `first` | `last` fills rows without a match with that edge row of the key.
    """
    back = direction == "backward"
    side_left, side_right = (1, 0) if back else (0, 1)
    right = right.where(F.col(right_on).isNotNull())
    lhs = left.select(*by, F.col(left_on).cast("double").alias("_at"), F.lit(side_left).alias("_side"),
                      F.struct(*left.columns).alias("_l"))
    rhs = right.select(*by, F.col(right_on).cast("double").alias("_at"), F.lit(side_right).alias("_side"),
                       F.struct(*take).alias("_r"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    order = ["_at", "_side", "_r"] if back else ["-_at", "-_side", "-_r"]
    seen = running(both, by, order, {"_m": ("last", F.col("_r"))}, limit=limit).where(F.col("_l").isNotNull())
    out = seen.select("_l.*", F.when(F.col("_at").isNotNull(), F.col("_m")).alias("_m"))
    if fallback:
        out = join_keyed(out, _edge(right, by, right_on, take, fallback), by)
        out = out.withColumn("_m", F.coalesce("_m", "_edge")).drop("_edge")
    return out.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in take])


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    by: list[str],
    point: str,
    lo: str,
    hi: str,
    width: float,
    how: str = "inner",
) -> DataFrame:
    """Pairs with `lo <= point <= hi` on equal `by`: an equi join on key and bucket plus the exact range test.

    Each interval is copied to the (hi - lo) / width + 1 buckets it touches; pick `width` near the usual length. A null
    key is a key.
    """
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    i = intervals.select(
        *[F.col(c).alias(f"_i_{c}") if c in by else F.col(c) for c in intervals.columns],
        F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("_ib"),
    )
    on = (F.col("_b") == F.col("_ib")) & (F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))
    for c in by:
        on = on & p[c].eqNullSafe(i[f"_i_{c}"])
    return p.join(i, on, how).drop("_b", "_ib", *[f"_i_{c}" for c in by])


def interval_lookup(
    points: DataFrame,
    intervals: DataFrame,
    by: list[str],
    point: str,
    lo: str,
    hi: str,
    take: list[str],
    order: list[str],
    width: float,
    fallback: bool = False,
    limit: float | None = None,
) -> DataFrame:
    """Each point with the first interval (in `order`) that contains it, null columns when none does.

    With `fallback`, a point outside every interval takes the next interval whose `hi` is at or beyond it, else the
    last one of the key. Equal points are looked up once and come back as often as they were given.
    """
    once = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_copies"))
    first = F.struct(F.struct(*order).alias("o"), F.struct(*take).alias("r"))
    rows = intervals.select(*by, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), first.alias("_iv"))
    hits = interval_join(once, rows, by, point, "_lo", "_hi", width, "left")
    found = hits.groupBy(*once.columns).agg(F.min("_iv").alias("_hit"))
    if fallback:
        ends = rows.select(*by, "_hi", F.col("_iv").alias("_next"))
        found = asof_join(found, ends, by, point, "_hi", ["_next"], "forward", "last", limit)
        found = found.withColumn("_hit", F.coalesce("_hit", "_next"))
    again = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return again.select(*points.columns, *[F.col(f"_hit.r.{c}").alias(c) for c in take])


def interval_steps(intervals: DataFrame, by: list[str], lo: str, hi: str, take: list[str], order: list[str], width: float,
                   fallback: bool = False, limit: float | None = None) -> DataFrame:
    """`interval_lookup` as a function of the place: (by, _at, _side, take), for `along`.

    The answer changes only at the ends of intervals, so it is looked up at each end (side 0) and once between it and the
    next (side 2): as many lookups as there are ends, however many points there are.
    """
    ends = intervals.select(*by, F.explode(F.array(F.col(lo).cast("double"), F.col(hi).cast("double"))).alias("_at")).where(
        F.col("_at").isNotNull()).distinct()
    gaps = row_frames(ends, by, ["_at"], lambda w: {"_next": F.lead("_at").over(w)}, after=1, limit=limit)
    asked = F.array(F.struct(F.lit(0).alias("s"), F.col("_at").alias("a")),
                    F.struct(F.lit(2).alias("s"), (F.col("_at") + (F.col("_next") - F.col("_at")) / 2).alias("a")))
    ends = gaps.select(*by, "_at", F.explode(asked).alias("_q")).select(*by, "_at", F.col("_q.s").alias("_side"), F.col("_q.a").alias("_ask"))
    before = F.explode(F.array(F.lit(None).cast("double"), F.lit(float("-inf"))))  # no place, and one before all ends
    first = intervals.select(*by).distinct().select(*by, before.alias("_at"), F.lit(0).alias("_side")).withColumn("_ask", F.col("_at"))
    found = interval_lookup(first.unionByName(ends), intervals, by, "_ask", lo, hi, take, order, width, fallback, limit)
    return found.drop("_ask")


def asof_steps(right: DataFrame, by: list[str], at: str, take: list[str], fallback: str | None = None) -> DataFrame:
    """`asof_join` backward as a function of the place: (by, _at, _side, take), for `along`."""
    known = right.where(F.col(at).isNotNull())
    steps = known.groupBy(*by, F.col(at).cast("double").alias("_at")).agg(F.max(F.struct(*take)).alias("_r"))
    if fallback:
        edge = _edge(known, by, at, take, fallback).select(*by, F.lit(None).cast("double").alias("_at"), F.col("_edge").alias("_r"))
        steps = steps.unionByName(edge)
    return steps.select(*by, "_at", F.lit(0).alias("_side"), "_r.*")


def along(points: DataFrame, by: list[str], point: str, steps: dict[str, DataFrame], limit: float | None = None) -> DataFrame:
    """Points with `_at`, their place, and for each of `steps` a struct of its columns there, null where it has none.

    All functions lie on one axis with the points and are carried along: one shuffle and one sort for any number of them.
    """
    place = [*by, "_at", "_side"]
    axis = points.withColumns({"_at": F.col(point).cast("double"), "_side": F.lit(1)})
    for name, s in steps.items():
        axis = axis.unionByName(s.select(*place, F.struct(*[c for c in s.columns if c not in place]).alias(name)), allowMissingColumns=True)
    run = running(axis, by, ["_at", "_side"], {n: ("last", F.col(n)) for n in steps}, limit=limit)
    return run.where(F.col("_side") == 1).drop("_side")


def band_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    below: float,
    above: float,
    how: str = "inner",
) -> DataFrame:
    """Pairs with `left - below <= right <= left + above` on equal `by`.

    Buckets are one band wide, so a right row is copied to two buckets at most. Right key columns are dropped; other
    column names must differ between the sides. A null key is a key.
    """
    width = float(below + above) or 1.0
    l = left.withColumn("_b", F.floor(F.col(left_on) / width))
    r = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in right.columns],
        F.explode(
            F.sequence(F.floor((F.col(right_on) - above) / width), F.floor((F.col(right_on) + below) / width))
        ).alias("_rb"),
    )
    on = (F.col("_b") == F.col("_rb")) & F.col(right_on).between(F.col(left_on) - below, F.col(left_on) + above)
    for c in by:
        on = on & l[c].eqNullSafe(r[f"_r_{c}"])
    return l.join(r, on, how).drop("_b", "_rb", *[f"_r_{c}" for c in by])


def band_totals(
    points: DataFrame,
    events: DataFrame,
    by: list[str],
    point: str,
    at: str,
    below: float,
    above: float,
    counts: dict[str, Column],
) -> DataFrame:
    """Per point, sums of integer event columns with `point - below <= at <= point + above`.

    Two running sums over one axis (everything up to the upper end minus everything before the lower end), so dense
    bands cost no pairs. `points` must hold no duplicate rows; sums are exact because they are whole numbers.
    """
    row = F.struct(*points.columns)
    none = {o: F.lit(0).cast("bigint").alias(f"_c_{o}") for o in counts}
    ev = events.select(*by, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"),
                       *[c.cast("bigint").alias(f"_c_{o}") for o, c in counts.items()])
    top = points.select(*by, (F.col(point) + above).cast("double").alias("_at"), F.lit(2).alias("_side"),
                        row.alias("_p"), F.lit(1).alias("_sign"), *none.values())
    low = points.select(*by, (F.col(point) - below).cast("double").alias("_at"), F.lit(0).alias("_side"),
                        row.alias("_p"), F.lit(-1).alias("_sign"), *none.values())
    axis = top.unionByName(low).unionByName(ev, allowMissingColumns=True)
    run = running(axis, by, ["_at", "_side"], {o: ("sum", F.col(f"_c_{o}")) for o in counts})
    ends = run.where(F.col("_p").isNotNull())
    out = ends.groupBy("_p").agg(*[F.sum(F.col(o) * F.col("_sign")).alias(o) for o in counts])
    return out.select("_p.*", *counts)


def band_extremes(
    points: DataFrame,
    events: DataFrame,
    by: list[str],
    point: str,
    at: str,
    below: float,
    above: float,
    least: dict[str, Column] | None = None,
    most: dict[str, Column] | None = None,
) -> DataFrame:
    """Per point, minima (`least`) and maxima (`most`) of event columns with `point - below <= at <= point + above`.

    The axis is cut into blocks a touch narrower than the band. A band then is the end of one block, from its lower limit on,
    and the beginnings of the next two up to its upper limit; running extremes from either end of each block answer all
    three, so dense bands cost no pairs. Empty bands give nulls. `points` must hold no duplicate rows.
    """
    least, most = least or {}, most or {}
    width = float(below + above) * (1 - 2.0**-20)
    if width <= 0:
        raise ValueError("a band needs a width")
    kinds = {**{o: "min" for o in least}, **{o: "max" for o in most}}
    none = [F.lit(None).cast(events.select(c).schema[0].dataType).alias(f"_e_{o}") for o, c in {**least, **most}.items()]
    low, high = F.col(point) - below, F.col(point) + above
    block = F.floor(low / width)
    row = F.struct(*points.columns).alias("_p")
    place = F.col(at).cast("double")
    ev = events.where(F.col(at).isNotNull()).select(
        *by, F.floor((F.col(at)) / width).alias("_blk"), place.alias("_at"), F.lit(0).alias("_side"),
        *[c.alias(f"_e_{o}") for o, c in {**least, **most}.items()])
    found = []
    for blocks, limit_at, order in ((F.array(block), low, ["-_at", "_side"]),
                                    (F.array(block + 1, block + 2), high, ["_at", "_side"])):
        ask = points.select(*by, F.explode(blocks).alias("_blk"), limit_at.cast("double").alias("_at"), F.lit(1).alias("_side"),
                            *none, row)
        axis = ask.unionByName(ev, allowMissingColumns=True)
        run = running(axis, [*by, "_blk"], order, {o: (k, F.col(f"_e_{o}")) for o, k in kinds.items()})
        found.append(run.where(F.col("_p").isNotNull()).select("_p", *kinds))
    # A point without a place asks nothing above: its own row keeps it in the result.
    own = points.select(row, *[c.alias(o) for o, c in zip(kinds, none)])
    out = own.unionByName(found[0]).unionByName(found[1]).groupBy("_p").agg(
        *[(F.min if k == "min" else F.max)(o).alias(o) for o, k in kinds.items()])
    return out.select("_p.*", *kinds)


def band_nearest(points: DataFrame, events: DataFrame, by: list[str], point: str, at: str, below: float, above: float,
                 out: str = "nearest") -> DataFrame:
    """Points with the distance of the nearest event in `point - below <= at <= point + above`, null when there is none.

    The nearest event is the last before or the first after the point: one axis, one shuffle, a pass in either direction.
    """
    ev = events.where(F.col(at).isNotNull()).select(*by, F.col(at).cast("double").alias("_at"), F.lit(0).alias("_side"),
                                                    F.col(at).alias("_e"))
    axis = points.select(*by, F.col(point).cast("double").alias("_at"), F.lit(1).alias("_side"),
                         F.struct(*points.columns).alias("_p")).unionByName(ev, allowMissingColumns=True)
    limit = checked_limit(axis, by)
    run = running(axis, by, ["_at", "_side"], {"_before": ("last", F.col("_e"))}, limit=limit)
    run = running(run, by, ["-_at", "_side"], {"_after": ("last", F.col("_e"))}, limit=limit)
    seen = run.where(F.col("_p").isNotNull()).select("_p.*", "_before", "_after")
    back, ahead = F.abs(F.col("_before") - F.col(point)), F.abs(F.col("_after") - F.col(point))
    back = F.when(F.col("_before") >= F.col(point) - below, back)
    ahead = F.when(F.col("_after") <= F.col(point) + above, ahead)
    return seen.withColumn(out, F.least(back, ahead)).drop("_before", "_after")


def nearest_events(
    points: DataFrame,
    events: DataFrame,
    by: list[str],
    point: str,
    at: str,
    k: int,
    below: float,
    above: float,
    prefer: list[str],
    limit: float | None = None,
) -> DataFrame:
    """Per point at least its k nearest events inside the band (callers rank them), with `offset_m` as the distance.

    Ordinary keys use the band join. Where a key has more events than the hot limit, a band may hold far more events than are
    wanted; there each point takes the k events on either side by their position in the key, so a point meets 2k events
    however dense they are. Both find the same k nearest. Events at one place are taken in `prefer` order (an order list).
    A null key is a key.
    """
    limit = hot_limit(events) if limit is None else limit
    if not has_hot_key(events, by, limit):
        near = band_join(points, events, by, point, at, below, above)
        return near.withColumn("offset_m", F.abs(F.col(at) - F.col(point)))
    axis = points.select(*by, F.col(point).cast("double").alias("_at"), F.lit(0).alias("_side"),
                         F.struct(*points.columns).alias("_p")).unionByName(
        events.select(*by, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side")), allowMissingColumns=True)
    one = {"_c": ("count", F.when(F.col("_side") == 1, 1))}
    sides = []
    for up in (True, False):
        # Events strictly before the point, seen from the side it looks away from.
        seen = running(axis, by, ["_at", "_side"] if up else ["-_at", "-_side"], one, limit=limit)
        seen = seen.where(F.col("_p").isNotNull()).select("_p.*", "_c")
        wanted = seen.withColumn("_n", F.explode(F.sequence(F.col("_c") + 1, F.col("_c") + k))).drop("_c")
        placed = position(events, by, [at if up else f"-{at}", *prefer], "_n", limit)
        sides.append(join_keyed(wanted, placed, [*by, "_n"], "inner").drop("_n"))
    near = sides[0].unionByName(sides[1]).withColumn("offset_m", F.abs(F.col(at) - F.col(point)))
    return near.where(F.col(at).between(F.col(point) - below, F.col(point) + above))


def covered(points: DataFrame, windows: DataFrame, by: list[str], point: str, lo: str, hi: str,
            out: str = "covered") -> DataFrame:
    """Flag (0/1): the point lies in at least one window of its key, ends included.

    A running maximum of window ends over their starts answers every point at once; no pairs, no merge step.
    """
    p = points.select(*by, F.col(point).cast("double").alias("_at"), F.lit(1).alias("_side"),
                      F.struct(*points.columns).alias("_p"))
    w = windows.select(*by, F.col(lo).cast("double").alias("_at"), F.lit(0).alias("_side"),
                       F.col(hi).cast("double").alias("_hi"))
    both = p.unionByName(w, allowMissingColumns=True)
    run = running(both, by, ["_at", "_side"], {"_end": ("max", F.col("_hi"))}).where(F.col("_p").isNotNull())
    flag = F.when(F.col("_end") >= F.col("_at"), 1).otherwise(0)
    return run.withColumn("_flag", flag).select("_p.*", F.col("_flag").alias(out))


def label_windows(samples: DataFrame, events: DataFrame, by: list[str], point: str, lo: str, hi: str,
                  margin: float) -> DataFrame:
    """Samples inside any event window widened by `margin`."""
    wide = events.select(*by, (F.col(lo) - margin).alias("_lo"), (F.col(hi) + margin).alias("_hi"))
    return covered(samples, wide, by, point, "_lo", "_hi", "_in").where("_in = 1").drop("_in")


def quiet_samples(samples: DataFrame, events: DataFrame, by: list[str], point: str, lo: str, hi: str,
                  margin: float) -> DataFrame:
    """Samples clear of every widened event window."""
    wide = events.select(*by, (F.col(lo) - margin).alias("_lo"), (F.col(hi) + margin).alias("_hi"))
    return covered(samples, wide, by, point, "_lo", "_hi", "_in").where("_in = 0").drop("_in")


def exists_within(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, margin: float,
                  out: str = "near") -> DataFrame:
    """Flag (0/1): some right row of the same key lies within `margin`."""
    wide = right.select(*by, (F.col(right_on) - margin).alias("_lo"), (F.col(right_on) + margin).alias("_hi"))
    return covered(left, wide, by, left_on, "_lo", "_hi", out)


def sphere_cells(radius_km: float, earth: float = RADIUS_KM) -> float:
    """Width of the cells of a cube grid in which places within a radius lie in one cell or in two that touch."""
    return max(chord_km(radius_km, earth), 1e-6) * (1 + 1e-9)


def grid_cell(lat: str, lng: str, cell: float, shift: tuple = (0, 0, 0), earth: float = RADIUS_KM) -> list[Column]:
    """The cell of a place, moved by `shift`."""
    return [F.floor(v * earth / cell) + s for v, s in zip(unit_xyz(lat, lng), shift)]


def geo_neighbors(
    targets: DataFrame,
    candidates: DataFrame,
    radius_km: float,
    lat: str = "lat",
    lng: str = "lng",
    key: str = "place_id",
    earth: float = RADIUS_KM,
    among: DataFrame | None = None,
) -> DataFrame:
    """Pairs of different places within `radius_km`: target columns as they are, candidate columns prefixed `near_`.

    Places are put on a cube grid over the sphere with cells one radius wide, targets are copied to the 27 cells around
    them and the join is an equi join on the cell, so poles and the date line need no special care. `among` lists the
    pairs of keys that are wanted, each once, if not all are.
    """
    if among is not None:
        c = candidates.select(*[F.col(x).alias(f"near_{x}") for x in candidates.columns])
        dist = haversine_km(lat, lng, f"near_{lat}", f"near_{lng}", earth)
        out = targets.join(among.select(key, f"near_{key}"), key).join(c, f"near_{key}").withColumn("distance_km", dist)
        out = out.where((F.col(key) != F.col(f"near_{key}")) & (F.col("distance_km") <= radius_km))
        return out.select(*targets.columns, *c.columns, "distance_km")
    cell = sphere_cells(radius_km, earth)

    def cells(a, o, shift):
        return grid_cell(a, o, cell, shift, earth)

    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    t = targets.select("*", F.explode(around).alias("_dx")).select("*", F.explode(around).alias("_dy"))
    t = t.select("*", F.explode(around).alias("_dz"))
    for n, c in zip("xyz", cells(lat, lng, (F.col("_dx"), F.col("_dy"), F.col("_dz")))):
        t = t.withColumn(f"_c{n}", c)
    c = candidates.select(*[F.col(x).alias(f"near_{x}") for x in candidates.columns])
    for n, v in zip("xyz", cells(f"near_{lat}", f"near_{lng}", (0, 0, 0))):
        c = c.withColumn(f"_n{n}", v)
    dist = haversine_km(lat, lng, f"near_{lat}", f"near_{lng}", earth)
    on = (F.col("_cx") == F.col("_nx")) & (F.col("_cy") == F.col("_ny")) & (F.col("_cz") == F.col("_nz"))
    on = on & (F.col(key) != F.col(f"near_{key}")) & (dist <= radius_km)
    out = t.join(c, on).withColumn("distance_km", dist)
    return out.drop("_dx", "_dy", "_dz", "_cx", "_cy", "_cz", "_nx", "_ny", "_nz")


def hydrate(hits: DataFrame, items: DataFrame, places: DataFrame, ref: str, place: str) -> DataFrame:
    """Hits with their item columns and their place's name; hits without an item stay."""
    return hits.join(items, ref, "left").join(places, place, "left")


def attach_provenance(events: DataFrame, placements: DataFrame, documents: DataFrame, key: str,
                      extra: DataFrame | None = None) -> DataFrame:
    """Events with the document page that narrates them; `source_type` is `document` when one does, else `telemetry`.

    `extra` holds events known only from documents; they are appended.
    """
    all_events = events.unionByName(extra, allowMissingColumns=True) if extra is not None else events
    out = all_events.join(placements, key, "left").join(documents, "doc_id", "left")
    label = F.when(F.col("doc_type").isNotNull(),
                   F.concat(F.col("doc_type"), F.lit("-"), F.lpad(F.col("page_no").cast("string"), 2, "0")))
    return out.withColumns({
        "source_type": F.when(F.col("doc_type").isNotNull(), "document").otherwise("telemetry"),
        "source_label": label,
    })
