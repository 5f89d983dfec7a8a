"""CASE-style encoders and score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# Severity words, trajectory words, score bands.
SEVERITY_WEIGHT = {"Low": 0.25, "Medium": 0.55, "High": 0.9}
SEVERITY_DEFAULT = 0.35
TRAJECTORY_WEIGHT = [("directional", 0.8), ("tangent", 0.65), ("s-shaped", 0.65)]
TRAJECTORY_DEFAULT = 0.3
LEVELS = [(70, "High"), (40, "Medium")]
LEVEL_DEFAULT = "Low"


def encode(col, mapping: dict, default) -> Column:
    """Exact-match lookup from a fixed mapping, `default` otherwise."""
    c = _c(col)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def encode_contains(col, mapping: list[tuple], default, ignore_case: bool = False) -> Column:
    """First listed substring found decides the value."""
    c = F.lower(_c(col)) if ignore_case else _c(col)
    out = None
    for part, v in mapping:
        hit = c.contains(part)
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out.otherwise(F.lit(default))


def severity_weight(col) -> Column:
    return encode(col, SEVERITY_WEIGHT, SEVERITY_DEFAULT)


def trajectory_weight(col) -> Column:
    return encode_contains(col, TRAJECTORY_WEIGHT, TRAJECTORY_DEFAULT, ignore_case=True)


def band(col, cuts: list[tuple] = LEVELS, default: str = LEVEL_DEFAULT) -> Column:
    """Name of the first cut that the value reaches."""
    c = _c(col)
    out = None
    for at, name in cuts:
        out = F.when(c >= at, F.lit(name)) if out is None else out.when(c >= at, F.lit(name))
    return out.otherwise(F.lit(default))
