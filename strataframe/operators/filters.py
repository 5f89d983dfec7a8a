"""Filters, validation, detail views and simple predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def contains_any(cols: list[str], text: str) -> Column:
    """Case-insensitive substring match in any of the columns."""
    return _any([F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in cols])


def within_distance(df: DataFrame, col: str, radius: float | None, tie: list[str]) -> DataFrame:
    out = df if radius is None else df.where(F.col(col) <= radius)
    return out.orderBy(col, *tie)


def faceted_filter(df: DataFrame, equals: dict | None = None, ranges: dict | None = None,
                   search: tuple[list[str], str] | None = None) -> DataFrame:
    """Conjunction of the filters that are present; None values add no clause.

    `equals` {col: value}, `ranges` {col: (lo, hi)} with open ends as None, `search` (columns, text).
    """
    conds = [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    for c, (lo, hi) in (ranges or {}).items():
        conds += [F.col(c) >= lo] if lo is not None else []
        conds += [F.col(c) <= hi] if hi is not None else []
    if search and search[1]:
        conds.append(contains_any(*search))
    return df.where(_all(conds))


def multi_search(tables: dict[str, tuple[DataFrame, str, str, list[str]]], text: str) -> DataFrame:
    """One term over several tables: {tag: (frame, ref column, title column, searched columns)}."""
    parts = [
        df.where(contains_any(cols, text)).select(
            F.lit(tag).alias("kind"), F.col(ref).cast("string").alias("ref"), F.col(title).alias("title")
        )
        for tag, (df, ref, title, cols) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def retrieval_filter(df: DataFrame, place: int | None = None, kinds: list[str] | str | None = None,
                     depth: tuple[float | None, float | None] = (None, None), places: list[int] | None = None,
                     place_col: str = "place_id", kind_col: str = "kind", depth_col=None) -> DataFrame:
    """Retrieval filter: one place, one kind or several, a depth range, a list of places."""
    d = depth_col if isinstance(depth_col, Column) else F.col(depth_col or "depth")
    conds = []
    if place is not None:
        conds.append(F.col(place_col) == place)
    if kinds:
        conds.append(F.col(kind_col).isin([kinds] if isinstance(kinds, str) else list(kinds)))
    if depth[0] is not None:
        conds.append(d >= depth[0])
    if depth[1] is not None:
        conds.append(d <= depth[1])
    if places:
        conds.append(F.col(place_col).isin(list(places)))
    return df.where(_all(conds))


def facets(df: DataFrame, cols: list[str]) -> DataFrame:
    """Option lists: every distinct value of each column with its row count, in one pass over the data."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("option"))
                                for c in cols])).alias("p")
    return df.select(pairs).select("p.*").groupBy("facet", "option").agg(F.count(F.lit(1)).alias("n"))


def register_filter(df: DataFrame, cols: list[str], text: str | None, depth_col: str,
                    depth: tuple[float | None, float | None], equals: dict | None = None) -> DataFrame:
    """Event-register view: text over the concatenated columns, a depth range and chosen facet options."""
    out = faceted_filter(df, equals, {depth_col: depth})
    if text:
        out = out.where(F.lower(F.concat_ws(" ", *cols)).contains(text.lower()))
    return out


def reasons(required: list[str] = (), enums: dict[str, list] | None = None,
            ranges: dict[str, tuple] | None = None) -> Column:
    """Array of rule names a row breaks; empty for a valid row."""
    checks = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in required]
    for c, allowed in (enums or {}).items():
        checks.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)), F.lit(f"unknown {c}")))
    for c, (lo, hi) in (ranges or {}).items():
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        checks.append(F.when(F.col(c).isNotNull() & bad, F.lit(f"{c} out of range")))
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, required: list[str] = (), enums: dict[str, list] | None = None,
             ranges: dict[str, tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with `reasons`)."""
    checked = df.withColumn("reasons", reasons(required, enums, ranges))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def same_reference(df: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Depths may only be compared under one reference: (comparable rows, rejected rows)."""
    ok = F.col(left).eqNullSafe(F.col(right))
    return df.where(ok), df.where(~ok).withColumn("reasons", F.array(F.lit("depth reference differs")))


def look_ahead(events: DataFrame, col: str, at: float, reach: float, n: int, tie: list[str]) -> DataFrame:
    """The first n events in `[at, at + reach]`."""
    return events.where(F.col(col).between(at, at + reach)).orderBy(col, *tie).limit(n)


def with_children(parent: DataFrame, child: DataFrame, key: str, fields: list[str], out: str = "children") -> DataFrame:
    """A row per child with its parent's columns and the number of children; a parent without any has one row of nulls.

    Children stay rows, so a parent with very many of them makes no wide row and none is cut off.
    """
    counts = child.groupBy(key).agg(F.count(F.lit(1)).alias(f"{out}_count"))
    joined = parent.join(counts, key, "left").join(child.select(key, *fields), key, "left")
    return joined.withColumn(f"{out}_count", F.coalesce(f"{out}_count", F.lit(0).cast("bigint")))


# Categories whose lessons transfer, and the note each category carries.
TRANSFERABLE = ["MUD_LOSS", "STUCK_PIPE", "KICK"]
APPLICABILITY = {
    "MUD_LOSS": "Applicable to any well entering a fractured or vuggy unit above a thicker overburden.",
    "STUCK_PIPE": "Applicable where static time exceeds the differential sticking window in permeable shale.",
    "KICK": "Applicable where pore pressure increases faster than the mud programme steps.",
    "TORQUE_SPIKE": "Applicable to wells with a comparable build section and hole angle.",
    "CEMENTING_ISSUE": "Applicable where displacement volume is marginal against annular capacity.",
    "FISHING": "Applicable where a free pipe or unreamable joint risk is identified.",
}


def derive_lessons(events: DataFrame) -> DataFrame:
    """Lesson rows from events (event_id, category, event_type, formation, start_md, severity, action_taken)."""
    from strataframe.functions.encode import encode

    head = F.element_at(F.split(F.lower(F.coalesce("formation", F.lit(""))), " "), 1)
    return events.where((F.col("severity") >= 3) & F.col("action_taken").isNotNull() & (F.col("action_taken") != "")
                        ).select(
        "event_id",
        F.format_string("%s in %s at %d m", "event_type", "formation",
                        F.floor(F.col("start_md") + 0.5).cast("bigint")).alias("title"),
        "category",
        F.col("start_md").alias("depth_md"),
        F.col("category").isin(TRANSFERABLE).cast("int").alias("transferable"),
        encode("category", APPLICABILITY, None).alias("applicability_note"),
        F.concat_ws(",", F.lower("category"), F.when(head != "", head)).alias("tags"),
    )
