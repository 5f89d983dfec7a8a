"""The join of `tokengroups` with single prefix tokens for candidates, for links that leave many tokens apart.

At 80 % a part of `tokengroups` has so few tokens that common ones are often alone in it. Here all tokens have a fixed order,
frequent ones last, and two sets that link share a token in their prefixes. Sets go by one least hash. All else is as there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.components import connected
from strataframe.llm.tokengroups import (
    CELL, HOT, PAIRS_AT_ONCE, TURNS, _digest, _sets, bitmap, bound_groups, dealt_cells, dealt_pairs, join_cells, may_be_among, open_groups)
from strataframe.session import settle

FREQUENT = 200_000  # tokens whose frequency is known to all tasks; only the order of tokens depends on them


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >= 1 << 63 else x


def leasts(tokens: np.ndarray) -> list[int]:
    return [_signed((tokens ^ t).min()) for t in TURNS]


def describe(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (id, hash of the text, size and digest of its set, least hashes), and rows of frequent tokens.

    Every task counts its tokens and reports those met often; single ones are forgotten whenever the count grows large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for (ids, hashes), sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([
                ids, hashes, pa.array([len(x) for x in sets], pa.int32()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()),
                pa.array([leasts(x) if len(x) else None for x in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.int64()),
                pa.nulls(len(sets), pa.int64())], names=names)
            one, n = np.unique(np.concatenate(sets), return_counts=True)
            tokens, back = np.unique(np.concatenate((tokens, one)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n))).astype(np.int64)
            if len(tokens) > 1_000_000:
                tokens, counts = tokens[counts > 1], counts[counts > 1]
        often = counts >= 3
        if often.any():
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays([
                pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                pa.nulls(k, pa.list_(pa.int64())), pa.array(tokens[often].astype(np.int64)), pa.array(counts[often])], names=names)

    names = ["doc_id", "text_hash", "n", "sig", "leasts", "token", "seen"]
    return docs.mapInArrow(run, "doc_id long, text_hash long, n int, sig binary, leasts array<long>, token long, seen long")


def prefixes(docs: DataFrame, words: int, percent: int, frequent: np.ndarray, rank: np.ndarray, hot: dict[tuple[int, int], int]) -> DataFrame:
    """A row per set and task: digest, size, least hashes, prefix in the order of tokens; in a hot bucket all tokens too.

    `turn` is the least hash that the set goes by: that of its largest hot bucket, else the first; `other` is that of the next
    largest hot one, if any.
    """

    names = ["sig", "n", "leasts", "turn", "other", "index", "front", "bits", "full"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for _, sets in _sets(batches, words):
            rows = []
            for x in sets:
                if not len(x) or (sig := _digest(x)) in met:
                    continue
                met.add(sig)
                n = len(x)
                order = x
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    order = x[np.lexsort((x, np.where(frequent[at] == x, rank[at], 0)))]
                front = order[: n + (-n * percent // 100) + 1].astype(np.int64)
                least = leasts(x)
                crowd = [hot.get((k, h), 0) for k, h in enumerate(least)]
                by_size = sorted(range(len(crowd)), key=lambda k: -crowd[k])
                is_hot, other = crowd[by_size[0]], by_size[1] if crowd[by_size[1]] else None
                rows.append((sig, n, least, by_size[0], other, n + (-2 * percent * n // (100 + percent)) + 1,
                             front, bitmap(x), x.tobytes() if is_hot else None))
            if len(met) > 500_000:
                met.clear()
            if rows:
                sig, n, least, turn, other, index, front, bits, full = zip(*rows)
                ends = np.concatenate(([0], np.cumsum([len(f) for f in front])))
                yield pa.RecordBatch.from_arrays([
                    pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(least, pa.list_(pa.int64())), pa.array(turn, pa.int32()), pa.array(other, pa.int32()),
                    pa.array(index, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(front))),
                    pa.array(bits, pa.binary()), pa.array(full, pa.binary())], names=names)

    return docs.select("text").mapInArrow(
        run, "sig binary, n int, leasts array<long>, turn int, other int, index int, front array<long>, bits binary, full binary")


def similar_components(docs: DataFrame, words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, text_hash, n_shingles, component_id, root` for every row; `root` (null without shingles) names the component.

    Two texts link if 100 times the common shingles are at least `percent` times the shingles of either. The component id
    is the least `doc_id` (null: least of all) that links reach. A null text, or one without words, has no shingles and is
    linked with nothing; its component is its own id. Repeated rows give repeated result rows. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                         F.col(text).cast("string").alias("text"))
    told = settle(describe(source, words), "sets")
    rows = told.where(F.col("n").isNotNull()).select("doc_id", "text_hash", "n", "sig", "leasts")
    frequent = told.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(
        F.desc("seen"), "token").limit(FREQUENT).collect()  # at most FREQUENT rows
    tokens = np.array([r["token"] for r in frequent], dtype=np.int64).astype(np.uint64)
    order = np.argsort(tokens)
    tokens, rank = tokens[order], np.array([r["seen"] for r in frequent], dtype=np.int64)[order]
    distinct = rows.where(F.col("n") > 0).groupBy("sig").agg(F.first("leasts").alias("leasts")).select(F.posexplode("leasts").alias("turn", "least"))
    buckets = distinct.groupBy("turn", "least").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL)
    hottest = buckets.orderBy(F.desc("size"), "turn", "least").limit(HOT).collect()  # at most HOT rows
    hot = {(r["turn"], r["least"]): r["size"] for r in hottest}
    front = settle(prefixes(source, words, percent, tokens, rank, hot), "prefixes")

    if hot:
        turn, other = (F.xxhash64(c, F.col("leasts")[F.col(c)]) for c in ("turn", "other"))
        large = front.where(F.col("full").isNotNull()).select(
            "sig", "full", turn.alias("bucket"), F.when(F.col("other").isNotNull(), other).alias("other"))
        first = settle(join_cells(dealt_cells(large, "bucket"), percent), "links")
        again = first.where(F.col("b").isNull()).select(
            F.col("a").alias("sig"), "full", F.col("other").alias("bucket"), F.lit(None).cast("long").alias("other"))
        second = join_cells(dealt_cells(again, "bucket"), percent)
        before = first.where(F.col("b").isNotNull()).select("a", "b").union(second.select("a", "b"))
        known = connected(before).select(F.col("node").alias("sig"), F.col("root").alias("comp"))
    else:
        known = spark.createDataFrame([], "sig binary, comp binary")

    # Groups: by the least hash that a set goes by; in hot buckets by component first if that has enough sets for groups of its own.
    went_by = F.xxhash64("turn", F.col("leasts")[F.col("turn")])
    one = front.groupBy("sig").agg(F.first(went_by).alias("least")).join(known, "sig", "left")
    by_comp = one.where(F.col("comp").isNotNull()).groupBy("least", "comp").agg(F.count(F.lit(1)).alias("in_comp")).where(
        F.col("in_comp") >= CELL // 3)
    crowded = one.groupBy("least").agg(F.count(F.lit(1)).alias("in_bucket")).where(F.col("in_bucket") > CELL)
    own = F.col("in_comp").isNotNull()
    deal = lambda size: F.pmod(F.xxhash64("sig", F.lit(3)), F.ceil(F.coalesce(size, F.lit(1)) / CELL))
    dealt = one.join(by_comp, ["least", "comp"], "left").join(crowded, "least", "left").select(
        "sig", F.when(own, F.xxhash64("comp")).alias("comp"),
        F.when(own, F.xxhash64("least", "comp", deal(F.col("in_comp")))).otherwise(
            F.xxhash64("least", deal(F.col("in_bucket")))).alias("gid"))
    groups = settle(dealt, "groups")

    # Postings of tokens that several groups have, without those whose groups are of one component.
    said = front.select("sig", "n", "index", "front").join(groups, "sig").select(
        "gid", "comp", "n", "index", F.posexplode("front").alias("at", "token"))
    place = said.select("token", "gid", "comp", F.when(F.col("at") < F.col("index"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    index_n = F.when(F.col("n") > 0, F.col("n"))
    postings = place.repartition(F.col("token")).groupBy("token", "gid", "comp").agg(
        F.min(index_n).alias("lo_i"), F.max(index_n).alias("hi_i"), F.min(F.abs("n")).alias("lo"), F.max(F.abs("n")).alias("hi"))
    of_token = Window.partitionBy("token")
    counted = postings.withColumn("total", F.count(F.lit(1)).over(of_token)).withColumn("named", F.count("comp").over(of_token)).withColumn(
        "c1", F.min("comp").over(of_token)).withColumn("c2", F.max("comp").over(of_token))
    several = counted.where((F.col("total") > 1) & ((F.col("named") < F.col("total")) | (F.col("c1") != F.col("c2"))))
    shared = settle(several.drop("total", "named", "c1", "c2"), "postings")
    lead = shared.where(F.col("comp").isNotNull()).groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "comp"))["comp"].alias("lead"))
    right = shared.join(lead, "token", "left")
    left = right.where(F.col("comp").isNull() | F.col("lead").isNull() | (F.col("comp") != F.col("lead")))
    x, y = left.alias("x"), right.alias("y")
    fits = lambda p, q: (F.col(f"{p}.lo_i") <= F.col(f"{q}.hi")) & (100 * F.col(f"{p}.hi_i") >= percent * F.col(f"{q}.lo"))
    apart = F.col("x.comp").isNull() | F.col("y.comp").isNull() | (F.col("x.comp") != F.col("y.comp"))
    once_only = (F.col("x.gid") < F.col("y.gid")) | ((F.col("x.gid") > F.col("y.gid")) & (F.col("y.comp") == F.col("y.lead")))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & once_only & apart & (fits("x", "y") | fits("y", "x")))
    pairs = met.select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb"))
    inside = groups.groupBy("gid").agg(F.min("sig").alias("u"), F.max("sig").alias("w"), F.count("comp").alias("c")).where(
        (F.col("u") != F.col("w")) & (F.col("c") == 0)).select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    pairs = settle(pairs.union(inside).distinct(), "pairs")

    asked, wanted = dealt_pairs(pairs, 8 * PAIRS_AT_ONCE)
    drawn = front.select("sig", "n", "bits").dropDuplicates(["sig"]).join(groups.select("sig", "gid"), "sig").join(
        wanted.select("gid").distinct(), "gid", "left_semi").groupBy("gid").agg(F.collect_list(F.struct("sig", "n", "bits")).alias("sets"))
    drawn = drawn.join(wanted, "gid").select("task", "gid", "sets").toDF("task", "gid", "sets")
    bounded = settle(bound_groups(asked, drawn, percent), "bounded")

    asked = bounded.where(F.col("ga").isNotNull()).select("task", "ga", "gb")
    wanted = bounded.where(F.col("gid").isNotNull()).select("task", "gid", "sig")
    needed = wanted.select("gid", "sig").distinct()
    spoken = rows.where(F.col("n") > 0).groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("sig", "r.*")
    named = settle(spoken.join(needed, "sig").select("gid", "sig", "doc_id", "text_hash"), "named")
    near = may_be_among(source, named, ["doc_id", "text_hash"])
    same = near["doc_id"].eqNullSafe(named["doc_id"]) & (near["text_hash"] == named["text_hash"])
    fetched = near.join(named, same).select("gid", "sig", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()  # repeated rows meet in one task
        for (gid, sig), found in _sets(batches, words):
            new = [k for k, x in enumerate(sig.to_pylist()) if not (x in met or met.add(x))]
            yield pa.RecordBatch.from_arrays([gid.take(pa.array(new, pa.int32())), sig.take(pa.array(new, pa.int32())),
                                              pa.array([found[k].tobytes() for k in new], pa.binary())], names=["gid", "sig", "full"])

    matrix = settle(fetched.mapInArrow(full, "gid long, sig binary, full binary"), "matrix")
    members = matrix.join(wanted, ["gid", "sig"]).select("task", "gid", "sig", "full").toDF("task", "gid", "sig", "full")
    # Links found late join components known from before; only what is between these is walked once more.
    found = open_groups(asked, members, percent)
    for end in ("a", "b"):
        found = found.join(known.select(F.col("sig").alias(end), F.col("comp").alias("known")), end, "left").withColumn(
            end, F.coalesce("known", end)).drop("known")
    late = connected(found.where("a <> b").distinct())
    roots = known.select("sig", "comp").union(late.join(known.select(F.col("sig").alias("node")), "node", "left_anti").select("node", "node"))
    roots = roots.join(late, F.col("comp") == F.col("node"), "left").select("sig", F.coalesce("root", "comp").alias("root"))

    marked = settle(rows.join(roots, "sig", "left").select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "sig").alias("root")), "marked")
    least = marked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return marked.join(least, "root", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")
