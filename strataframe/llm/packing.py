"""Packing documents into sequences of fixed length with dominance reduction and best fit.

Only lengths matter to a packing, and there are at most as many as a sequence has places. Spark counts the pieces of
each length; the driver solves the instance on these counts, whatever the number of documents; Spark then gives every
piece its place by its running number among those of its length.

The reduction follows Martello and Toth: a longest piece and a set beside it are fixed for good if that set dominates
every other set that fits beside it, that is, if each of those can be put into the members of the fixed one:

* nothing fits beside it;
* some piece fills the rest exactly;
* no two pieces fit together: the longest that fits;
* no three pieces fit together, and the longest that fits is no shorter than any two that fit.

What is left is packed best fit, longest first. Both work on counts: equal sequences are one pattern with a multiplicity.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.chunked import blocks, encoder
from strataframe.session import settle

Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences; (length, copies in each)


def _pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length); a longer document is cut so that only its first piece may be shorter."""
    if size <= capacity:
        return [(0, size)]
    head = size % capacity
    starts = ([0] if head else []) + list(range(head, size, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], size])]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, keeps_space: bool = True, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Every document's pieces, with the writing task and the number among the task's pieces of one length.

    The frame is written to the shared folder, so these numbers never change afterwards.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            ids, texts = (c.to_pylist() for c in b.columns)
            for s in blocks(texts):
                rows = []
                for name, raw in zip(ids[s], encoder(path, keeps_space).encode(texts[s])):
                    raw += end_id.to_bytes(4, "little")
                    for k, (start, n) in enumerate(_pieces(len(raw) // 4, capacity)):
                        nth = seen[n] = seen.get(n, -1) + 1
                        rows.append((name, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), task, nth))
                kinds = [pa.int32() if n in ("piece", "task") else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    made = source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")
    return settle(made, "pieces")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some best packing contains, and the counts that are left; repeated until nothing more is fixed."""
    left, fixed = {n: c for n, c in counts.items() if c}, []

    def take(*lengths: int) -> None:
        each = {n: lengths.count(n) for n in lengths}
        m = min(left[n] // k for n, k in each.items())
        fixed.append((m, sorted(each.items(), reverse=True)))
        for n, k in each.items():
            left[n] -= m * k
            if not left[n]:
                del left[n]
                have.remove(n)

    have = sorted(left)
    changed = True
    while changed:
        changed = False
        for big in sorted(left, reverse=True):
            while big in left:
                rest = capacity - big
                others = [n for n in have if n != big or left[big] > 1]
                at = bisect.bisect_right(others, rest)
                if not at:
                    take(big)
                elif others[at - 1] == rest:
                    take(big, rest)
                else:
                    best = others[at - 1]
                    small = [n for n in others[:3] for _ in range(min(3, left[n] - (n == big)))][:3]
                    alone = len(small) < 2 or small[0] + small[1] > rest
                    if not alone and (len(small) < 3 or sum(small) > rest):
                        pair = 0
                        for n in others[:at]:
                            k = bisect.bisect_right(others, rest - n) - 1
                            if k >= 0 and others[k] == n and left[n] - (n == big) < 2:
                                k -= 1
                            if k >= 0:
                                pair = max(pair, n + others[k])
                        alone = best >= pair
                    if not alone:
                        break
                    take(big, best)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first: each piece goes where least room stays; sequences alike are handled together."""
    rooms: dict[int, list[Pattern]] = {}
    order: list[int] = []  # rooms in use, ascending

    def put(room: int, pattern: Pattern) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append(pattern)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(order, length)
            room = order[at] if at < len(order) else capacity
            each = room // length  # a sequence that took one is the fullest that takes the next
            if at < len(order):
                many, inside = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                many, inside = -(-todo // each), []
            whole = min(many, todo // each)
            if whole:
                put(room - each * length, (whole, [*inside, (length, each)]))
                todo, many = todo - whole * each, many - whole
            if many and todo and todo < each:
                put(room - todo * length, (1, [*inside, (length, todo)]))
                todo, many = 0, many - 1
            if many and inside:
                put(room, (many, inside))
    return [p for room in order for p in rooms[room]]


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def segments(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first number, copies per sequence, first sequence, offset): which pieces go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for many, inside in patterns:
        offset = 0
        for length, each in inside:
            out.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + many * each
            offset += length * each
        sequence += many
    return out


def place(spark: SparkSession, cut: DataFrame, capacity: int) -> DataFrame:
    """Adds `sequence_id` and `offset` to the rows of `pieces`."""
    sizes = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length at most
    plan = segments(solve(counts, capacity))
    by: dict[int, list] = {}
    for length, *rest in sorted(plan):
        by.setdefault(length, []).append(rest)
    tables = {length: np.array(rows, dtype=np.int64).T for length, rows in by.items()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    held = spark.sparkContext.broadcast(tables)  # bounded by the capacity: patterns have few lengths each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, each, start, at = held.value[int(n)]
                k = np.searchsorted(first, number[rows], side="right") - 1
                r = number[rows] - first[k]
                sequence[rows] = start[k] + r // each[k]
                offset[rows] = at[k] + r % each[k] * n
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    numbered = cut.join(shift, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("shift")).alias("number"))
    return numbered.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keeps_space: bool = True,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document: where it starts in the document, its length and CRC-32, and its place.

    A null text is an empty one: its piece holds the end id. Repeated rows and ids are pieces of their own, null ids are
    kept, extra columns are ignored, and an empty table gives an empty frame.
    """
    spark = docs.sparkSession
    return place(spark, pieces(docs, path, capacity, end_id, keeps_space, doc_id, text), capacity)
