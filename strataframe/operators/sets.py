"""Set operations over typed projections and keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The common shape every searchable item is brought to.
ITEM_COLUMNS = {"kind": "string", "ref": "string", "place_id": "bigint", "title": "string", "body": "string",
                "depth": "double"}


def knowledge_union(parts: list[DataFrame]) -> DataFrame:
    """Typed projections of different kinds as one corpus; missing columns become null."""
    fit = [
        p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in ITEM_COLUMNS.items()])
        for p in parts
    ]
    return reduce(DataFrame.unionByName, fit)


def missing_keys(expected: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Expected keys that have no active row."""
    return expected.select(key).distinct().join(active.select(key).distinct(), key, "left_anti")
