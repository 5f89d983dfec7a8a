"""Bounded samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo `n`; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, per_class: int, doc_id: str = "doc_id",
           text: str = "text", most_bytes: int = 60_000) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights of at most `per_class` rows of either class, the same rows on every run.

    Rows are taken in the order of a hash of their id. Texts over `most_bytes` are left to scoring, which reads every
    text whole; that and `per_class` bound what reaches the driver. An id that several documents share brings its least
    text. `allowed` is a condition on the column `doc_id` of the label rows. Weights restore the share of each class in the
    labels. Conflicting labels of one id are both used.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(
        allowed & F.col("y").isin(0, 1))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(
        F.octet_length("text") <= most_bytes)
    one = texts.join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = sorted(one.collect(), key=lambda r: (r["doc_id"], r["y"]))  # at most 2 * per_class rows
    n = {y: sum(r["y"] == y for r in got) for y in (0, 1)}
    weight = {y: totals.get(y, 0) / n[y] * len(got) / max(1, sum(totals.values())) if n[y] else 0.0 for y in (0, 1)}
    return [r["text"] for r in got], [r["y"] for r in got], [weight[r["y"]] for r in got]
