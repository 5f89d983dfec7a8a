"""Session helper and the one place that decides where shared files go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strataframe", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with UTC, AQE and skew-join handling on.

    On a cluster `spark-submit` names the master and sizes; the defaults here only matter for local runs.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cores: str | int = 8, **conf) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("STRATAFRAME_DRIVER_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    return build_session(master=f"local[{cores}]", conf=settings)


_OWN: dict[str, str] = {}  # folders of local sessions without the setting


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by `spark.checkpoint.dir`.

    Only a local-mode session may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:  # a running session refuses the setting
        _OWN[app] = tempfile.mkdtemp(prefix="strataframe-")
    return _OWN[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
