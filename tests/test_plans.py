"""Physical plans: no nested loops, filters and columns reach the scan."""

import pytest
from conftest import SF

from strataframe.plans.registry import QUERIES, load_all
from strataframe.sources.tables import read_table

load_all()
JOINS = ["flagship_risk_intervals", "j5_asof_backward", "j7_interval_containment", "j9_band_join", "j10_label_windows",
         "j11_quiet_samples", "j12_geo_neighbors", "j13_exists_within", "c1_rank_offsets_pressure", "m1_build_features",
         "m2_training_rows", "r1_bm25", "r5_cosine_topk"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_no_nested_loop(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_pushdown(spark):
    text = plan(read_table(spark, SF, "lineitem").where("l_quantity >= 49").select("l_suppkey"))
    assert "GreaterThanOrEqual(l_quantity,49.0)" in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text
