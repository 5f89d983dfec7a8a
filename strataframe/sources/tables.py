"""Table reads with fixed schemas, JSON columns, validated appends, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared layouts: reads never infer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table with its declared schema; pruning and filters reach the scan."""
    return spark.read.schema(schema_of(name)).parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores when the input comes in fewer splits than that; large inputs are left as they are.

    For work that is heavy per row (text): one small file is one split and would keep a single core busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parse_json_cols(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """JSON text columns as typed structs; unparsable text gives null."""
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def load_training(rows: DataFrame, wells: DataFrame, risk: str, version: str, limit: int | None = None) -> DataFrame:
    """Training rows of one risk and feature version with their well, ordered by group and depth, optionally capped."""
    out = (
        rows.where((F.col("risk_type") == risk) & (F.col("feature_version") == version))
        .join(wells, "well_id")
        .withColumn("target_value", F.coalesce("target_value", F.lit(0.0)))
    )
    order = ["split_group", "depth", "row_id"]
    return out.orderBy(*order).limit(limit) if limit else out.orderBy(*order)


def append_validated(df: DataFrame, required: list[str], defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(rows to append with defaults filled in, rejected rows with reasons)."""
    from strataframe.operators.filters import validate

    good, bad = validate(df, required=required)
    return good.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}), bad


def table_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Rows per table; null for a table that is not there."""

    def one(name: str) -> DataFrame:
        try:
            df = spark.read.schema(schema_of(name) if name in SCHEMAS else "_any int").parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            return spark.range(1).select(F.lit(name).alias("table_name"), F.lit(None).cast("bigint").alias("n"))
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")

    return reduce(DataFrame.unionByName, [one(n) for n in names])
