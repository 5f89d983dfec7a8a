"""Recorded series as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.sources.tables import schema_of


def replay_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None, fmt: str = "parquet",
                  files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder in order of arrival, `files_per_trigger` at a time. CSV and parquet recordings."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(folder)


def replay_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table of the folder, be it one file or a folder of part files."""
    return replay_stream(spark, f"{folder}/{name}.parque[t]", schema_of(name), files_per_trigger=files_per_trigger)


def record_deliveries(rows: DataFrame, number: Column, deliveries: int, path: str, files: int = 1) -> None:
    """Write the rows of delivery 0, 1, ... below `path`, one after the other, each in up to `files` files.

    Read back `files` at a time they arrive as they were delivered; rows keep no order inside a delivery.
    """
    numbered = rows.withColumn("_delivery", number.cast("int"))
    for k in range(deliveries):
        part = numbered.where(F.col("_delivery") == k).drop("_delivery")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
