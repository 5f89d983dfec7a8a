"""The best items per query from postings in blocks, with bounds that let most blocks go unread.

Items are dealt to shards and stand there in order of size; a block holds the postings of one term within a short run of
positions, with its largest value and the smallest item size in it. From these two follows a bound on what the block can
add to a score, whatever the collection's statistics are by now. A shard takes the terms of a query by falling bound; a
block is read only if an item in its run may still reach the k-th best score so far; the runs with the highest bounds are
scored first, so that there is such a score from the start. A shard hands on `k` rows per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_ITEMS, BLOCK_ITEMS, QUERY_BLOCK, SEED_RUNS = 16_384, 32, 1024, 3
DIGITS = 6
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shards_for(spark, items: int, shard_items: int = SHARD_ITEMS) -> int:
    """Enough shards for their size, and for all cores as long as that leaves a few hundred items in each."""
    return max(1, -(-items // shard_items), min(spark.sparkContext.defaultParallelism, items // 512))


def place_items(sizes: DataFrame, ref: str, shards: int) -> DataFrame:
    """`sizes` (ref, size, ...) with `shard` and `pos`, the place of an item in its shard by size."""
    from pyspark.sql import Window

    own = sizes.withColumn("shard", F.pmod(F.xxhash64(ref), F.lit(shards)).cast("int"))
    order = Window.partitionBy("shard").orderBy("size", ref)
    return own.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def block_rows(posts: DataFrame, placed: DataFrame, ref: str, value: str) -> DataFrame:
    """A row per term and shard: `pos` and `value` of all its postings, and for each block of them `block` (which run of
    positions), `n`, `most` and `least`.

    `posts` is (ref, term, `value`), `placed` has the items' shard, pos and size. A row holds one shard's items at most.
    """
    rows = posts.select(ref, "term", F.col(value).alias("_v")).join(
        placed.select(ref, "shard", "pos", F.col("size").cast("double").alias("size")), ref)
    blocks = rows.repartition("term", "shard").groupBy("term", "shard", F.floor(F.col("pos") / BLOCK_ITEMS).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("_v").alias("value")))).alias("p"),
        F.count(F.lit(1)).cast("int").alias("n"), F.max("_v").cast("double").alias("most"), F.min("size").alias("least"))
    packed = blocks.groupBy("term", "shard").agg(F.sort_array(F.collect_list(F.struct(
        "block", F.col("p.pos").alias("pos"), F.col("p.value").alias("value"), "n", "most", "least"))).alias("b"))
    return packed.select("term", "shard", F.flatten("b.pos").alias("pos"), F.flatten("b.value").alias("value"),
                         *[F.col(f"b.{c}").alias(c) for c in ("block", "n", "most", "least")])


def cut_blocks(pos: np.ndarray, value: np.ndarray, size: np.ndarray) -> tuple:
    """One term's postings in a shard as the columns of `block_rows`; `size` goes by position."""
    order = np.argsort(pos)
    pos, value = pos[order], value[order]
    block, first, counts = np.unique(pos // BLOCK_ITEMS, return_index=True, return_counts=True)
    return pos, value, block, counts, np.maximum.reduceat(value, first).astype(float), np.minimum.reduceat(size[pos], first)


class TermBlocks:
    """All blocks of one term in a shard; impacts are worked out when a query first reads some."""

    def __init__(self, pos, value, block, n, most, least, measure: Measure):
        self.pos, self.value, self.block, self.counts, self.measure = pos, value, block, n, measure
        self.bound = measure(most, least)
        self.top = self.bound.max()
        self.impact = None

    def read(self, size: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.impact is None:
            self.impact = self.measure(self.value, size[self.pos])
        if needed.all():
            return self.pos, self.impact
        keep = np.repeat(needed, self.counts)
        return self.pos[keep], self.impact[keep]


def shard_topk(terms: dict[str, TermBlocks], query: list[tuple[str, float]], size: np.ndarray, live: np.ndarray, k: int,
               floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions that can be among the best `k`, their scores, and how many postings were read.

    `size` and `live` go by position and are padded to whole blocks. Scores are sums of weight times impact, all positive.
    """
    slack = 2 * 10.0**-DIGITS  # scores that rounding makes equal stay in
    asked = sorted(((terms[t], w) for t, w in query if t in terms), key=lambda x: -x[1] * x[0].top)
    rest = np.zeros(len(size) // BLOCK_ITEMS)  # what the terms not yet taken can add in each run of positions
    for own, w in asked:
        rest[own.block] += w * own.bound
    hopeful = rest >= np.partition(rest, max(0, len(rest) - SEED_RUNS))[max(0, len(rest) - SEED_RUNS)]
    start = np.where(live, 0.0, -np.inf)
    least, read = floor, 0

    def kth(scores: np.ndarray) -> float:
        return np.partition(scores, len(scores) - k)[-k] if k < len(scores) else -np.inf

    seed = start.copy()
    for own, w in asked:  # a few runs in full, for a k-th score to start from
        pos, impact = own.read(size, hopeful[own.block])
        read += len(pos)
        seed[pos] += w * impact
    least = max(least, kth(seed))
    acc = start
    for own, w in asked:
        rest[own.block] -= w * own.bound
        needed = acc.reshape(-1, BLOCK_ITEMS).max(axis=1)[own.block] + w * own.bound + rest[own.block] >= least - slack
        if not needed.any():
            continue
        pos, impact = own.read(size, needed)
        read += len(pos)
        acc[pos] += w * impact
        least = max(least, kth(acc))
    found = np.flatnonzero((acc > 0) & (acc >= least - slack))
    return found, acc[found], read


def block_topk(parts: list[tuple[DataFrame, DataFrame, int]], asked: DataFrame, qid: str, ref: str, k: int, measure: Measure,
               floor: float = 0.0, negative: bool = False) -> DataFrame:
    """(qid, ref, score): at most `k` rows per query and shard, rounded, ties by smaller ref.

    `parts` has for each segment its items (ref, shard, pos, size), its blocks, or its postings (ref, term, value) if it has
    none, and its number of shards. Blocks of postings are cut in the shard, for the terms that are asked. `asked` is (qid,
    term, weight). With `negative` scores are rounded as their negatives, so that halves go the other way. Scores
    have to pass `floor` after rounding.
    """
    packed = asked.groupBy(qid).agg(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"))).alias("asked"))
    n = packed.count()
    q_blocks = max(1, -(-n // QUERY_BLOCK))
    terms = asked.select("term").distinct()
    ref_type, qid_type = parts[0][0].schema[ref].dataType, asked.schema[qid].dataType
    left, first = None, 0
    for items, blocks, shards in parts:
        heads = items.where("size is not null").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("size").cast("double").alias("size"), F.col(ref).alias("ref")))).alias("p"))
        heads = heads.select((F.col("shard") + first).alias("shard"), F.col("p.pos").alias("pos"), F.col("p.size").alias("sizes"), F.col("p.ref").alias("refs"))
        used = blocks.join(terms, "term", "left_semi")
        if "shard" not in used.columns:
            used = used.join(items.select(ref, "shard", "pos"), ref).repartition("term", "shard").groupBy("term", "shard").agg(
                F.collect_list(F.struct("pos", "value")).alias("p")).select("term", "shard", "p.pos", "p.value")
        used = used.withColumn("shard", F.col("shard") + first)
        both = used.unionByName(heads, allowMissingColumns=True)
        left = both if left is None else left.unionByName(both)
        first += shards
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("q_block", numbers(q_blocks))
    right = packed.withColumn("q_block", F.pmod(F.xxhash64(qid), F.lit(q_blocks)).cast("int")).withColumn("shard", numbers(first))

    def run(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        head = held[held["term"].isna()] if len(held) else held
        if len(head) and len(queries):
            places = head["pos"].iloc[0]
            rows = held[held["term"].notna()]
            last = max([places[-1], *(p[-1] for p in rows["pos"])])  # items that are gone still have postings
            width = (int(last) // BLOCK_ITEMS + 1) * BLOCK_ITEMS
            size, live, refs = np.ones(width), np.zeros(width, bool), np.empty(width, object)
            size[places], live[places], refs[places] = head["sizes"].iloc[0], True, list(head["refs"].iloc[0])
            terms = {}
            for r in rows.to_dict("records"):
                cut = [r[c] for c in ("pos", "value", "block", "n", "most", "least")] if r.get("block") is not None else cut_blocks(
                    r["pos"], r["value"], size)
                terms[r["term"]] = TermBlocks(*cut, measure)
            scale = 10.0**DIGITS
            for q, words in zip(queries[qid], queries["asked"]):
                at, score, _ = shard_topk(terms, [(w["term"], w["weight"]) for w in words], size, live, k, floor)
                score = -np.floor(-score * scale + 0.5) / scale if negative else np.floor(score * scale + 0.5) / scale
                best = sorted(((-s, r) for s, r in zip(score.tolist(), refs[at]) if s > floor or negative))[:k]
                out[0].extend([q] * len(best))
                out[1].extend(r for _, r in best)
                out[2].extend(-s for s, _ in best)
        return pd.DataFrame({qid: pd.Series(out[0], dtype=object), ref: pd.Series(out[1], dtype=object), "score": pd.Series(out[2], dtype=float)})

    schema = T.StructType([T.StructField(qid, qid_type), T.StructField(ref, ref_type), T.StructField("score", T.DoubleType())])
    tasks = first * q_blocks
    dealt = lambda df: df.repartition(tasks, "shard", "q_block").groupBy("shard", "q_block")
    return dealt(left).cogroup(dealt(right)).applyInPandas(run, schema)
