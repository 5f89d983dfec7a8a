"""Exact Jaccard similarity join on word shingles with a token-group matrix.

Equal sets are one set from the start. Sets that agree in two least hashes, as similar sets mostly do, are put into groups
of bounded size; the matrix keeps each group's sets and the union of their tokens. Four independent least hashes give six
pairs: a set goes by the one that most sets share with it, so that a family of near copies fills few groups and leaves few
members scattered over groups of their own. One least hash would not do: sets that only have a common token agree in it.

* Candidates: all tokens are dealt, by their value, to one part more than two sets that link may have tokens apart, so
  one part is the same in both. A group is asked about another only if they share a part.
  A part holds several tokens, so sets that only have some common tokens share none.
* Bound: the matrix holds each group's union as a bitmap of hashed tokens, and each set's. Every bit of a set that the
  union lacks is a token that no set of the group has; a set with too many of them links with nothing there. The bitmaps
  of the sets tell the same of single pairs.
* Opening: what passes is compared with the other group's sets, token by token.

A large family of near copies would still make all its groups meet. Therefore the sets of large buckets are first joined in
groups dealt at random, in the bucket they go by, and one set of each connected part in its next largest bucket; groups whose sets are connected already are never asked about each other, and
per token the groups of one leading component are met by the others only. The result is the same: what is left out joins
sets that are known to be in one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.chunked import blocks
from strataframe.llm.components import connected
from strataframe.llm.shingles import mix, shingle_sets
from strataframe.session import settle

CELL = 48  # sets in a group, on average
PAIRS_AT_ONCE = 60
STRETCH = 1.4  # largest by least size of a class of sets that are dealt to equally many parts
HOT = 50_000  # buckets joined beforehand; those beyond are joined like all others
BLOCK = 1_000_000
BITS = 4096  # of a bitmap
SLOTS = 1 << 18  # 64-bit words of the table that is broadcast before texts are fetched
# Tokens are random numbers, so the one nearest to a constant, by exclusive or, is a random choice for each constant.
TURNS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x5851F42D4C957F2D], np.uint64)
ONE, TWO = np.triu_indices(len(TURNS), 1)


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    """Batches of (columns before the text, sets)."""
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        for s in blocks(texts, BLOCK):
            yield [c.slice(s.start, s.stop - s.start) for c in b.columns[:-1]], list(shingle_sets(texts[s], words))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def leasts(tokens: np.ndarray) -> list[int]:
    """A key for every two of the least hashes."""
    least = np.array([(tokens ^ t).min() for t in TURNS])
    return mix(least[ONE] + mix(least[TWO])).astype(np.int64).tolist()


@lru_cache(maxsize=None)
def class_of(n: int) -> tuple[int, int]:
    """Least and largest size in the class of size `n`."""
    low = 1
    while (end := max(low + 1, int(low * STRETCH))) <= n:
        low = end
    return low, end - 1


@lru_cache(maxsize=None)
def parts_of(low: int, high: int, percent: int) -> tuple[int, int]:
    """For links whose smaller set is in the class: tokens that two such sets may have apart, number of parts.

    There are some more parts than needed, for those that stay empty.
    """
    apart = (high + 100 * high // percent) * (100 - percent) // (100 + percent)
    for spare in range(apart // 4 + 1):
        empty = (apart + 1 + spare) * np.exp(-low / (apart + 1 + spare))
        if empty + 2 * np.sqrt(empty) <= spare:
            break
    return apart, apart + 1 + spare


def part_keys(tokens: np.ndarray, mixed: np.ndarray, low: int, high: int, percent: int) -> np.ndarray:
    """Hashes of the parts of a set for links whose smaller set is in the class; two sets that link there share one.

    If all parts that are equal in two such sets are empty, all others differ, of which there are at most `apart`. A set with
    tokens in so few parts also gives its prefix in the order of values, of which two sets that link share a token too.
    """
    apart, parts = parts_of(low, high, percent)
    if not apart:
        return tokens[:0]
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    place = mix(np.append(part[starts], np.uint64(parts)) + np.uint64(low << 32))
    found = np.add.reduceat(mixed, starts) + place[:-1]
    if len(starts) <= apart:
        found = np.concatenate((found, tokens[: len(tokens) + (-len(tokens) * percent // 100) + 1] + place[-1]))
    return mix(found)


def all_part_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """`part_keys` of the set's own class and of those of the smaller sets it may link with."""
    mixed = mix(tokens)
    low, high = class_of(len(tokens))
    found = [part_keys(tokens, mixed, low, high, percent)]
    while low > 1 and 100 * (low - 1) >= percent * len(tokens):
        low, high = class_of(low - 1)
        found.append(part_keys(tokens, mixed, low, high, percent))
    return np.concatenate(found).astype(np.int64)


def describe(docs: DataFrame, words: int) -> DataFrame:
    """A row per document: id, hash of the text, size and digest of its set, keys of its least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, hashes), sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([
                ids, hashes, pa.array([len(x) for x in sets], pa.int32()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()),
                pa.array([leasts(x) if len(x) else None for x in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "sig", "leasts"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n int, sig binary, leasts array<long>")


def dealt_sets(docs: DataFrame, words: int, percent: int, hot: dict[tuple[int, int], int]) -> DataFrame:
    """A row per set and task: digest, size, key it goes by, hashes of its parts; in a hot bucket all tokens too.

    `least` is the key that the set goes by: that of its largest hot bucket, else the first; `other` is that of the next
    largest hot one, if any.
    """

    names = ["sig", "n", "turn", "least", "other_turn", "other", "front", "bits", "full"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for _, sets in _sets(batches, words):
            rows = []
            for x in sets:
                if not len(x) or (sig := _digest(x)) in met:
                    continue
                met.add(sig)
                least = leasts(x)
                crowd = [hot.get((k, h), 0) for k, h in enumerate(least)]
                turn, other = sorted(range(len(crowd)), key=lambda k: -crowd[k])[:2]
                again = (other, least[other]) if crowd[other] else (None, None)
                rows.append((sig, len(x), turn, least[turn], *again, all_part_keys(x, percent), bitmap(x), x.tobytes() if crowd[turn] else None))
            if len(met) > 500_000:
                met.clear()
            if rows:
                sig, n, turn, least, other_turn, other, front, bits, full = zip(*rows)
                ends = np.concatenate(([0], np.cumsum([len(f) for f in front])))
                yield pa.RecordBatch.from_arrays([
                    pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(turn, pa.int32()), pa.array(least, pa.int64()),
                    pa.array(other_turn, pa.int32()), pa.array(other, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(front))),
                    pa.array(bits, pa.binary()), pa.array(full, pa.binary())], names=names)

    return docs.select("text").mapInArrow(
        run, "sig binary, n int, turn int, least long, other_turn int, other long, front array<long>, bits binary, full binary")


def bitmap(tokens: np.ndarray) -> bytes:
    marks = np.zeros(BITS, dtype=bool)
    marks[(tokens >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every set of `a` with every set of `b`."""
    left, right = np.concatenate(a), np.concatenate(b)
    who, whom = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    order = np.argsort(right, kind="stable")
    right, whom = right[order], whom[order]
    lo, hi = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    n = hi - lo
    at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
    return np.bincount(np.repeat(who, n) * len(b) + whom[at], minlength=len(a) * len(b)).reshape(len(a), len(b))


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a[:, None] + b[None, :] - common)


def local_roots(link: np.ndarray) -> np.ndarray:
    """For the symmetric links of some sets, the first set of each one's component."""
    label = np.arange(len(link))
    while True:
        around = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(label, around)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _bytes(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def join_cells(sets: DataFrame, percent: int) -> DataFrame:
    """From sets dealt to cells (`cell, sig, full, other`): edges (`a`, `b`) from each set to the first of those it is connected
    with in its cell, and rows (`a, other, full`, no `b`) of these first ones, which go on to their `other` bucket if any."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("sig")  # a set comes once from every task that met it
        sig, sets_, other = g["sig"].tolist(), _bytes(g["full"]), g["other"].tolist()
        size = np.array([len(x) for x in sets_])
        root = local_roots(linked(overlaps(sets_, sets_), size, size, percent))
        out = [(sig[i], sig[r], None, None) for i, r in enumerate(root) if i != r]
        out += [(sig[i], None, other[i], sets_[i].tobytes()) for i, r in enumerate(root) if i == r and not pd.isna(other[i])]
        return pd.DataFrame(out, columns=["a", "b", "other", "full"]).astype({"other": "Int64"})

    return sets.groupBy("cell").applyInPandas(run, "a binary, b binary, other long, full binary")


def dealt_cells(sets: DataFrame, bucket: str) -> DataFrame:
    """`sets` with the `cell` of its bucket that each goes to, by its digest; buckets are at most `HOT` for each least hash."""
    cells = sets.groupBy(bucket).agg(F.ceil(F.count_distinct("sig") / CELL).alias("cells"))
    return sets.join(F.broadcast(cells), bucket).withColumn(
        "cell", F.xxhash64(bucket, F.pmod(F.xxhash64("sig", F.lit(bucket)), F.col("cells"))))


def bound_groups(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """What may link across groups, by the bitmaps of the sets: rows (`task, ga, gb`) of pairs of groups, and rows
    (`task, gid, sig`) of the sets that a task needs for its pairs, each set once.

    `members` has for every task its groups once (`task, gid, sets` of sig, n and bits). The pairs that are left go to new
    tasks of `PAIRS_AT_ONCE`, neighbours together, so that these need few sets.
    """

    def may(a: tuple, b: tuple) -> np.ndarray:
        missing = np.bitwise_count(a[1][:, None, :] & ~b[1][None, :, :]).sum(axis=2, dtype=np.int64)
        return 100 * (a[0][:, None] - missing) >= percent * np.maximum(a[0][:, None], b[0][None, :])

    def across(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        lack = np.bitwise_count(a[1] & ~b[2]).sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(100 * (a[0] - lack) >= percent * a[0])
        part = (a[0][some], a[1][some])
        found = may(part, b) & may(b, part).T
        return some[found.any(axis=1)], np.flatnonzero(found.any(axis=0))

    def run(todo: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        groups = {}
        for gid, sets_ in zip(rows["gid"], rows["sets"]):
            bits = np.stack([np.frombuffer(x["bits"], np.uint64) for x in sets_])
            groups[gid] = (np.array([x["n"] for x in sets_], np.int64), bits, np.bitwise_or.reduce(bits, axis=0), [x["sig"] for x in sets_])
        tile = lambda c: np.unique(todo[c].to_numpy(), return_inverse=True)[1] // 8
        todo = todo.iloc[np.lexsort((tile("gb"), tile("ga")))] if len(todo) else todo
        out, needs, task, k = [], set(), 0, 0
        for ga, gb in zip(todo["ga"], todo["gb"]):
            a, b = groups[ga], groups[gb]
            if ga == gb:
                found = may(a, a)
                np.fill_diagonal(found, False)
                found &= found.T
                mine, theirs = np.flatnonzero(found.any(axis=1)), []
            else:
                mine, theirs = across(a, b)
            if not len(mine):
                continue
            if k % PAIRS_AT_ONCE == 0:
                task, needs = (int(todo["task"].iloc[0]) << 24) + k // PAIRS_AT_ONCE, set()
            k += 1
            out.append((task, ga, gb, None, None))
            for gid, group, which in ((ga, a, mine), (gb, b, theirs)):
                new = {(gid, group[3][i]) for i in which} - needs
                needs |= new
                out += [(task, None, None, *x) for x in new]
        return pd.DataFrame(out, columns=["task", "ga", "gb", "gid", "sig"]).astype({c: "Int64" for c in ("task", "ga", "gb", "gid")})

    return pairs.groupBy("task").cogroup(members.groupBy("task")).applyInPandas(
        run, "task long, ga long, gb long, gid long, sig binary")


def dealt_pairs(pairs: DataFrame, at_once: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with the task that takes them, about `at_once` each, and the groups that every task needs.

    Pairs around one group, its least neighbour's or its own id, stay together, so that a task needs few groups. Many such
    pairs are dealt as tiles, parts of the groups against parts of the groups, and crowded tiles once more by pair.
    """
    tasks = max(1, -(-pairs.count() // at_once))
    ends = pairs.select("ga", "gb").union(pairs.select("gb", "ga")).toDF("g", "other")
    heads = ends.groupBy("g").agg(F.least("g", F.min("other")).alias("head"))
    headed = pairs.join(heads.toDF("ga", "ha"), "ga").join(heads.toDF("gb", "hb"), "gb").select(
        "ga", "gb", F.least("ha", "hb").alias("head"))
    sides = headed.groupBy("head").agg(F.ceil(F.sqrt(2 * F.count(F.lit(1)) / at_once)).alias("side"))
    part = lambda g: F.pmod(F.xxhash64(g, F.lit(5)), F.col("side"))
    tiled = headed.join(sides, "head").select(
        "ga", "gb", F.xxhash64("head", F.least(part("ga"), part("gb")), F.greatest(part("ga"), part("gb"))).alias("tile"))
    crowds = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / (2 * at_once)).alias("pieces"))
    piece = F.pmod(F.xxhash64("ga", "gb"), F.col("pieces"))
    pairs = settle(tiled.join(crowds, "tile").select(
        F.pmod(F.xxhash64("tile", piece), F.lit(tasks)).alias("task"), "ga", "gb"), "asked")
    wanted = pairs.select("task", F.col("ga").alias("gid")).union(pairs.select("task", F.col("gb").alias("gid"))).distinct()
    return pairs, wanted


def may_be_among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` without most that are not in `keys`: a table of one bit per key hash, of at most `SLOTS` words, is broadcast.

    An exact join has to follow. The more keys there are the more rows pass; all of `keys` pass always.
    """
    key = F.xxhash64(*columns)
    place = [F.pmod(key, F.lit(SLOTS)).alias("_slot"), F.pmod(F.shiftrightunsigned(key, 40), F.lit(64)).cast("int").alias("_bit")]
    words = keys.select(*place).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_word"))
    return rows.select("*", *place).join(F.broadcast(words), "_slot").where(F.getbit("_word", "_bit") == 1).drop("_slot", "_bit", "_word")


def open_groups(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Edges from pairs of groups (`task`, `ga`, `gb`), given each task's `members` (`task, gid, sig, full`)."""

    def run(todo: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, tuple] = {}
        for gid, g in rows.drop_duplicates("sig").groupby("gid", sort=False):
            sets_ = _bytes(g["full"])
            groups[gid] = (g["sig"].tolist(), sets_, np.array([len(x) for x in sets_]), np.unique(np.concatenate(sets_)))
        out = []
        for ga, gb in zip(todo["ga"], todo["gb"]):
            if ga not in groups or gb not in groups:
                continue
            sig_a, a, size_a, _ = groups[ga]
            sig_b, b, size_b, union = groups[gb]
            if ga == gb:
                link = linked(overlaps(a, a), size_a, size_a, percent)
                sig = sig_a
            else:
                flat = np.concatenate(a)
                inside = union[np.minimum(np.searchsorted(union, flat), len(union) - 1)] == flat
                bound = np.add.reduceat(inside.astype(np.int64), np.cumsum(size_a) - size_a)
                may = 100 * bound >= percent * size_a
                if not may.any():
                    continue
                keep = np.flatnonzero(may)
                cross = linked(overlaps([a[i] for i in keep], b), size_a[keep], size_b, percent)
                if not cross.any():
                    continue
                sig = [sig_a[i] for i in keep] + sig_b
                link = np.zeros((len(sig), len(sig)), dtype=bool)
                link[: len(keep), len(keep) :] = cross
                link |= link.T
            root = local_roots(link)
            out += [(sig[i], sig[r]) for i, r in enumerate(root) if i != r]
        return pd.DataFrame(out, columns=["a", "b"])

    return pairs.groupBy("task").cogroup(members.groupBy("task")).applyInPandas(run, "a binary, b binary")


def similar_components(docs: DataFrame, words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, text_hash, n_shingles, component_id, root` for every row; `root` (null without shingles) names the component.

    Two texts link if 100 times the common shingles are at least `percent` times the shingles of either. The component id
    is the least `doc_id` (null: least of all) that links reach. A null text, or one without words, has no shingles and is
    linked with nothing; its component is its own id. Repeated rows give repeated result rows. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                         F.col(text).cast("string").alias("text"))
    rows = settle(describe(source, words), "sets")
    distinct = rows.where(F.col("n") > 0).groupBy("sig").agg(F.first("leasts").alias("leasts")).select(F.posexplode("leasts").alias("turn", "least"))
    buckets = distinct.groupBy("turn", "least").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL)
    hottest = buckets.orderBy(F.desc("size"), "turn", "least").limit(HOT).collect()  # at most HOT rows
    hot = {(r["turn"], r["least"]): r["size"] for r in hottest}
    front = settle(dealt_sets(source, words, percent, hot), "parts")

    if hot:
        large = front.where(F.col("full").isNotNull()).select(
            "sig", "full", F.xxhash64("turn", "least").alias("bucket"),
            F.when(F.col("other").isNotNull(), F.xxhash64("other_turn", "other")).alias("other"))
        first = settle(join_cells(dealt_cells(large, "bucket"), percent), "links")
        again = first.where(F.col("b").isNull()).select(
            F.col("a").alias("sig"), "full", F.col("other").alias("bucket"), F.lit(None).cast("long").alias("other"))
        second = join_cells(dealt_cells(again, "bucket"), percent)
        before = first.where(F.col("b").isNotNull()).select("a", "b").union(second.select("a", "b"))
        known = connected(before).select(F.col("node").alias("sig"), F.col("root").alias("comp"))
    else:
        known = spark.createDataFrame([], "sig binary, comp binary")

    # Groups: by the key that a set goes by; in hot buckets by component first if that has enough sets for groups of its own.
    # The buckets of other sets are small, so their groups need no table, unless there are more large buckets than were listed.
    # Group ids are short, as most of what is shuffled are ids; two groups of one id are one group.
    keyed = front.withColumn("least", F.xxhash64("turn", "least"))
    listed = F.lit(True) if len(hot) >= HOT else F.col("full").isNotNull()
    one = keyed.where(listed).groupBy("sig").agg(F.first("least").alias("least")).join(known, "sig", "left")
    by_comp = one.where(F.col("comp").isNotNull()).groupBy("least", "comp").agg(F.count(F.lit(1)).alias("in_comp")).where(
        F.col("in_comp") >= CELL // 3)
    crowded = one.groupBy("least").agg(F.count(F.lit(1)).alias("in_bucket")).where(F.col("in_bucket") > CELL)
    own = F.col("in_comp").isNotNull()
    deal = lambda size: F.pmod(F.xxhash64("sig", F.lit(3)), F.ceil(F.coalesce(size, F.lit(1)) / CELL))
    dealt = one.join(by_comp, ["least", "comp"], "left").join(crowded, "least", "left").select(
        "sig", F.when(own, F.xxhash64("comp")).alias("comp"),
        F.when(own, F.hash("least", "comp", deal(F.col("in_comp")))).otherwise(
            F.hash("least", deal(F.col("in_bucket")))).alias("gid"))
    groups = settle(dealt, "groups")
    stood = ["sig", "n", "front", "bits", "gid", "comp"]
    placed = keyed.where(listed).join(groups, "sig").select(stood).unionByName(keyed.where(~listed).withColumn(
        "gid", F.hash("least", F.lit(0).cast("long"))).withColumn("comp", F.lit(None).cast("long")).select(stood))

    # Postings of parts that several groups have, without those whose groups are of one component.
    postings = placed.select("gid", "comp", F.explode("front").alias("token")).repartition(F.col("token")).distinct()
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
    apart = F.col("x.comp").isNull() | F.col("y.comp").isNull() | (F.col("x.comp") != F.col("y.comp"))
    once_only = (F.col("x.gid") < F.col("y.gid")) | ((F.col("x.gid") > F.col("y.gid")) & (F.col("y.comp") == F.col("y.lead")))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & once_only & apart)
    pairs = met.select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb"))
    inside = placed.groupBy("gid").agg(F.min("sig").alias("u"), F.max("sig").alias("w"), F.count(F.lit(1)).alias("c"),
        F.count("comp").alias("named"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where(
        (F.col("u") != F.col("w")) & ((F.col("named") < F.col("c")) | (F.col("c1") != F.col("c2")))).select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    pairs = settle(pairs.union(inside).distinct(), "pairs")

    asked, wanted = dealt_pairs(pairs, 8 * PAIRS_AT_ONCE)
    asked_about = wanted.select("gid").distinct()
    drawn = may_be_among(placed.select("gid", "sig", "n", "bits"), asked_about, ["gid"]).join(asked_about, "gid").dropDuplicates(
        ["gid", "sig"]).groupBy("gid").agg(F.collect_list(F.struct("sig", "n", "bits")).alias("sets"))
    drawn = drawn.join(wanted, "gid").select("task", "gid", "sets").toDF("task", "gid", "sets")
    bounded = settle(bound_groups(asked, drawn, percent), "bounded")

    asked = bounded.where(F.col("ga").isNotNull()).select("task", "ga", "gb")
    wanted = bounded.where(F.col("gid").isNotNull()).select("task", "gid", "sig")
    needed = wanted.groupBy("gid", "sig").agg(F.collect_set("task").alias("tasks"))
    spoken = rows.where(F.col("n") > 0).groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("sig", "r.*")
    named = settle(spoken.join(needed, "sig").select("gid", "sig", "tasks", "doc_id", "text_hash"), "named")
    near = may_be_among(source, named, ["doc_id", "text_hash"])
    same = near["doc_id"].eqNullSafe(named["doc_id"]) & (near["text_hash"] == named["text_hash"])
    fetched = near.join(named, same).select("gid", "sig", "tasks", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()  # repeated rows meet in one task
        for (gid, sig, tasks), found in _sets(batches, words):
            new = pa.array([k for k, x in enumerate(sig.to_pylist()) if not (x in met or met.add(x))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(new) for c in (gid, sig, tasks)), pa.array(
                [found[k].tobytes() for k in new.to_pylist()], pa.binary())], names=["gid", "sig", "tasks", "full"])

    matrix = settle(fetched.mapInArrow(full, "gid long, sig binary, tasks array<long>, full binary"), "matrix")
    members = matrix.select(F.explode("tasks").alias("task"), "gid", "sig", "full")
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
