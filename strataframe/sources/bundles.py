"""Model bundles as JSON files and the manifest derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.windows import latest_version

BUNDLE_SCHEMA = "strataframe.model.bundle/1"
BUNDLE_COLUMNS = (
    "schema string, name string, version string, risk_type string, kind string, algorithm string, "
    "feature_version string, training_rows bigint, trained_at timestamp, metrics string, card string, "
    "artifact string, notes string"
)


def export_bundle(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write bundles (metrics, card and parameters travel in one record), one folder per name."""
    from pyspark.sql import types as T

    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(BUNDLE_COLUMNS) if f.name != "schema"]
    out = df.select(F.lit(BUNDLE_SCHEMA).alias("schema"), *cols, F.col("name").alias("model"))
    out.write.mode(mode).partitionBy("model").json(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """All readable bundles; corrupt records and records of another schema are left out."""
    raw = (
        spark.read.schema(BUNDLE_COLUMNS + ", _corrupt string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", "true").json(path)
    )
    return raw.where((F.col("schema") == BUNDLE_SCHEMA) & F.col("_corrupt").isNull()).drop("_corrupt")


def manifest(bundles: DataFrame) -> DataFrame:
    """Every version per name with `is_latest`, the newest version being the active one."""
    return latest_version(bundles.select("name", "version", "risk_type", "algorithm", "trained_at"))


def active_bundles(bundles: DataFrame) -> DataFrame:
    return latest_version(bundles).where("is_latest").drop("is_latest")


def missing_files(listed: DataFrame, bundles: DataFrame) -> DataFrame:
    """Manifest entries that name a version without a bundle."""
    return listed.join(bundles.select("name", "version"), ["name", "version"], "left_anti")
