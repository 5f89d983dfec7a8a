"""The corpus pipeline: toxic and poor documents go, one document of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import bytecnn, packing, prefixgroups, toxicity
from strataframe.llm.labelled import remainder
from strataframe.llm.queries import BYTES, SEQUENCE
from strataframe.session import fresh_path
from strataframe.sources.tables import read_table

TOXIC_FROM, GOOD_FROM = 0.7, 0.3
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; a null text is scored as an empty one. All columns stay.

    Labels are joined to this stage's own input, so only documents that are here teach the model.
    """
    model = toxicity.fit_from(docs, read_table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return docs.where(toxicity.scorer(model)(docs["text"]) < TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold; a null text is scored as an empty one. All columns stay."""
    net = bytecnn.fit_from(docs, read_table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return docs.where(bytecnn.scorer(net)(docs["text"]) >= GOOD_FROM)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near duplicates. All columns stay.

    Documents without words are no duplicates of anything. Rows with the id and text of the kept one count as one row; of
    rows with its id and other texts of the group the one with the smallest hash stays.
    """
    found = prefixgroups.similar_components(docs, WORDS, PERCENT)
    alone = found.where(F.col("n_shingles") == 0).select("doc_id", "text_hash").distinct()
    first = found.where(F.col("n_shingles") > 0).groupBy("root").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.doc_id", "r.text_hash")
    kept = first.unionByName(alone).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    match = F.col("d.doc_id").eqNullSafe(F.col("k.kept_id")) & (F.xxhash64("d.text") == F.col("k.kept_hash"))
    rows = docs.alias("d").join(kept.alias("k"), match, "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, BYTES, SEQUENCE, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", keep_one), ("packing", pack)]

ORACLE_SQL = None  # trained models and a tokenizer library are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
