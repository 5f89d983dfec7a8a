"""Hard negatives: exact integer inner products by Strassen's recursion on tiles, and heaps that merge.

Anchors and candidates are dealt to blocks of bounded size by a hash of their id; a tile is one block of anchors against
one of candidates, in a task of its own. Its product is Strassen's: seven half-size products instead of eight, down to
small leaves, on 64-bit integers padded with zeros. Sums and products wrap around alike, so whatever the steps between,
a result that fits 64 bits is exact. A first round multiplies only tiles of one label and keeps the best few per anchor
and tile; merged, they are the positives. A second round keeps, per anchor and positive, the best few of the other labels
inside the window that the positive's score sets. What a tile leaves is bounded by its anchors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.session import settle

ANCHOR_ROWS, CANDIDATE_ROWS, LEAF = 1024, 4096, 16
POSITIVES, NEGATIVES = 5, 3
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """`a @ b` of int64 matrices, exact modulo 2**64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    levels = max(0, int(np.log2(max(1, min(m, k, n)) / leaf)))
    step = 1 << levels
    up = lambda x: -(-x // step) * step
    whole = np.zeros((up(m), up(k)), np.int64), np.zeros((up(k), up(n)), np.int64)
    whole[0][:m, :k], whole[1][:k, :n] = a, b
    return halves(*whole, levels)[:m, :n]


def halves(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """One level of the recursion; all sides are multiples of `2**levels`."""
    if not levels:
        return a @ b
    i, j, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :c], b[:j, c:], b[j:, :c], b[j:, c:]
    p1 = halves(a11 + a22, b11 + b22, levels - 1)
    p2 = halves(a21 + a22, b11, levels - 1)
    p3 = halves(a11, b12 - b22, levels - 1)
    p4 = halves(a22, b21 - b11, levels - 1)
    p5 = halves(a11 + a12, b22, levels - 1)
    p6 = halves(a21 - a11, b11 + b12, levels - 1)
    p7 = halves(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * i, 2 * c), np.int64)
    out[:i, :c], out[:i, c:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :c], out[i:, c:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def heads(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `k` largest allowed scores in each row, equal ones by column; all, if fewer."""
    held = np.where(allowed, scores, LEAST)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (held >= least[:, None])
    row, col = np.nonzero(allowed)
    by = np.lexsort((col, -held[row, col], row))
    row, col = row[by], col[by]
    first = np.searchsorted(row, np.arange(len(scores)))
    near = np.arange(len(row)) - first[row] < k
    return row[near], col[near]


def integer_rows(vectors: DataFrame, label: Column, scale: int, vec_id: str, vector: str) -> DataFrame:
    """`vec_id, label, v, dim`: one row per id, with vectors rounded down to multiples of 1 / `scale`.

    A row with a null id, label or vector or a null or non-finite component takes no part; of rows with one id the one with
    the least label and vector counts. A vector whose products could pass 64 bits stops the job with a message.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("x", fine), F.lit(False)))
    size = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), 2))
    too_long = F.raise_error(F.lit("a vector is too long for 64-bit inner products")).cast("array<bigint>")
    held = F.when(size < 2.0**62, F.transform("x", lambda x: F.floor(x * scale))).otherwise(too_long)
    once = rows.select("vec_id", "label", held.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return once.select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))


def multiplied(anchors: DataFrame, rows: DataFrame, by: list[str], made, schema: str) -> DataFrame:
    """What `made(anchors, rows, scores)` leaves of each tile; both frames share the key columns `by`.

    A candidate block meets every anchor block of its key, so candidates are copied once for each of those.
    """
    blocks = lambda df, most, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    many = blocks(anchors, ANCHOR_ROWS, "anchor_blocks").join(blocks(rows, CANDIDATE_ROWS, "row_blocks"), by)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    key = [*by, "anchor_block", "row_block"]
    left = anchors.join(many, by).withColumns({"anchor_block": own("anchor_blocks"), "row_block": every("row_blocks")})
    right = rows.join(many, by).withColumns({"row_block": own("row_blocks"), "anchor_block": every("anchor_blocks")})
    renewed = lambda df: df.select([F.col(c).alias(c) for c in df.columns if "_blocks" not in c])
    left, right = renewed(left), renewed(right)  # both come from one frame: new columns keep them apart

    def run(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return made(some.iloc[:0], others.iloc[:0], np.zeros((0, 0), np.int64))
        some, others = some.sort_values("vec_id"), others.sort_values("vec_id")
        a, b = (np.stack(x["v"].to_numpy()).astype(np.int64) for x in (some, others))
        return made(some, others, strassen(a, np.ascontiguousarray(b.T)))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)


def merged(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The `k` best rows of each key, with their `rank`; Spark trims each task's rows before they move."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def find_positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """`anchor_id, other_id, score, rank`: the `k` best other rows of each anchor's label."""

    def made(some: pd.DataFrame, others: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        ids, other = some["vec_id"].to_numpy(np.int64), others["vec_id"].to_numpy(np.int64)
        row, col = heads(scores, ids[:, None] != other[None, :], k) if len(ids) else (np.zeros(0, int),) * 2
        return pd.DataFrame({"anchor_id": ids[row], "other_id": other[col], "score": scores[row, col]})

    found = multiplied(anchors, rows, ["dim", "label"], made, "anchor_id long, other_id long, score long")
    return merged(found, ["anchor_id"], k)


def find_negatives(anchors: DataFrame, rows: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """`anchor_id, positive_id, positive_score, other_id, score, rank`: per anchor and positive the `k` best rows of other
    labels with a score of `low` to `high` hundredths of the positive's. `anchors` has arrays `positives` and `limits`."""
    schema = "anchor_id long, positive_id long, positive_score long, other_id long, score long"

    def made(some: pd.DataFrame, others: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        ids, other = some["vec_id"].to_numpy(np.int64), others["vec_id"].to_numpy(np.int64)
        unlike = some["label"].to_numpy()[:, None] != others["label"].to_numpy()[None, :]
        parts = [np.zeros((5, 0), np.int64)]
        most = max(map(len, some["positives"]), default=0)
        for nth in range(most):
            has = np.array([len(p) > nth for p in some["positives"]])
            at = np.flatnonzero(has)
            positive = np.array([p[nth] for p in some["positives"][has]], np.int64)
            score = [int(p[nth]) for p in some["limits"][has]]  # Python's integers: a hundredfold may pass 64 bits
            bottom = np.array([-(-low * s // 100) for s in score], np.int64)
            top = np.array([high * s // 100 for s in score], np.int64)
            held = scores[at]
            row, col = heads(held, unlike[at] & (held >= bottom[:, None]) & (held <= top[:, None]), k)
            parts.append(np.stack((ids[at][row], positive[row], np.array(score, np.int64)[row], other[col], held[row, col])))
        return pd.DataFrame(dict(zip(("anchor_id", "positive_id", "positive_score", "other_id", "score"), np.concatenate(parts, axis=1))))

    found = multiplied(anchors, rows, ["dim"], made, schema)
    return merged(found, ["anchor_id", "positive_id", "positive_score"], k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = 50, high: int = 95, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`, all integers and exact.

    `is_anchor` is a condition on `vec_id`, `label` any expression over `vectors`. Scores are inner products of vectors
    rounded down to multiples of 1 / `scale`; higher come first, ties by smaller id. The first `positives` other rows of an
    anchor's label are its positives; for each, the first `negatives` rows of other labels count whose score is `low` to
    `high` hundredths of the positive's, all if fewer. Anchors without positives and positives without negatives give no
    row; a positive score below zero has an empty window. Rows with a null id, label or vector or with a null or
    non-finite component take no part. A repeated id is one row, that with the least label and vector. Vectors of different
    lengths never meet. Other columns are ignored, so they may have any name; an empty table gives an empty frame.
    """
    rows = settle(integer_rows(vectors, label, scale, vec_id, vector), "integers")
    anchors = rows.where(is_anchor)
    best = settle(find_positives(anchors, rows, positives), "positives")
    lists = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("p"))
    asking = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", "dim", F.col("p.other_id").alias("positives"), F.col("p.score").alias("limits"))
    found = find_negatives(asking, rows, negatives, low, high)
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
