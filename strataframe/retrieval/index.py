"""Postings, statistics, document frequencies and sparse vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.functions.text import token_rows, word_rows
from strataframe.operators.topk import topk

# Sparse-vector size, smallest weight kept, digits of a stored weight.
TOP_TERMS = 96
QUERY_TOP_TERMS = 64
MIN_WEIGHT = 0.02
WEIGHT_DIGITS = 5


def postings(items: DataFrame, ref: str, text: Column, exact_words: bool = True) -> DataFrame:
    """(ref, term, tf): one row per item and term. Texts are dealt by item, so the counts need no shuffle of their own."""
    conf = items.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = max(items.sparkSession.sparkContext.defaultParallelism, int(conf))
    src = items.select(ref, text.alias("_text")).repartition(parts, ref)
    rows = (word_rows if exact_words else token_rows)(src, [ref], "_text")
    return rows.groupBy(ref, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(posts: DataFrame, ref: str) -> DataFrame:
    return posts.groupBy(ref).agg(F.sum("tf").alias("len"))


def idf_weights(df: DataFrame, corpus_size: Column) -> DataFrame:
    """Smoothed inverse document frequency per term: ln((N + 1) / (df + 1)) + 1."""
    return df.withColumn("idf", F.log((corpus_size + 1) / (F.col("df") + 1)) + 1)


def tfidf(posts: DataFrame, idf: DataFrame, ref: str, top: int = TOP_TERMS, unseen: Column | None = None) -> DataFrame:
    """(ref, term, weight): damped term counts times idf, small weights dropped, the strongest `top` kept.

    `unseen` is the idf of a term the corpus lacks (queries); without it such terms are dropped.
    """
    joined = posts.join(idf.select("term", "idf"), "term", "left" if unseen is not None else "inner")
    w = (1 + F.log(F.col("tf").cast("double"))) * (F.coalesce("idf", unseen) if unseen is not None else F.col("idf"))
    kept = joined.withColumn("_w", w).where(F.col("_w") >= MIN_WEIGHT)
    kept = kept.select(ref, "term", round_half_up("_w", WEIGHT_DIGITS).alias("weight"))
    return topk(kept, [ref], ["-weight", "term"], top, "_rank").drop("_rank")


def norms(vectors: DataFrame, ref: str) -> DataFrame:
    return vectors.groupBy(ref).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def index_stats(items: DataFrame, vectors: DataFrame, lexicon: DataFrame, ref: str, kind: str) -> DataFrame:
    """Counts by kind plus totals of vectors and lexicon terms, as (measure, n)."""
    by_kind = items.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("kind:"), F.col(kind)).alias("measure"), "n")
    vec = vectors.select(ref).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("vectors").alias("measure"), "n")
    lex = lexicon.where("df > 0").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("lexicon_terms").alias("measure"), "n")
    return by_kind.unionByName(vec).unionByName(lex)
