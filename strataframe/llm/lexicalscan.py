"""Ranked lexical search by scanning texts with an automaton of all item terms; there is no document index.

The terms of a bounded block of items go into one Aho-Corasick automaton. Each pattern is a term between two guards, and a
text is scanned with all its separators turned into guards, so that only whole terms match. Texts are read twice. The first
scan counts terms, documents and documents per item term, added up in every task before anything moves. The second counts
again, turns each document's term counts into scores of the items that hold the terms, and keeps for each task and item
the best documents, which are merged at the end. Postings are never written or moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.session import settle

ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 2000, 8_000_000  # proven bounds of what is broadcast at once; more items, more scans
SHARE, SATURATION, SCALE = 90, 8, 1_000_000_000
GUARD = 0x20
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else GUARD
              for c in range(256))
CELLS = 2_000_000


def guarded(text: bytes) -> bytes:
    """The text in UTF-8 with A-Z in lower case and a guard for each byte that belongs to no term, and at both ends."""
    return b" " + text.translate(LOWER) + b" "


def term_count(text: bytes) -> int:
    return len(text.split())


class Block:
    """Items and their distinct terms; what is broadcast."""

    def __init__(self, items: dict[int, set[bytes]]):
        self.items = sorted(items)
        self.terms = sorted(set().union(*items.values()))
        place = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((place[t], k) for k, i in enumerate(self.items) for t in items[i])
        self.holders = np.array([k for _, k in pairs], np.int64)  # items of each term, term after term
        self.ends = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))


@lru_cache(maxsize=2)
def automaton(terms: tuple[bytes, ...]):
    """Of guarded terms, read byte by byte; made once in a worker process for each block."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(f" {t.decode('latin-1')} ", i)
    out.make_automaton()
    return out


def scan(texts: list[bytes | None], terms: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each text; then, for every text and item term in it, the text's place, the term and its count."""
    found = automaton(terms)
    sizes, where, which, often = np.zeros(len(texts), np.int64), [], [], []
    for k, t in enumerate(texts):
        if not t:
            continue
        t = guarded(t)
        sizes[k] = term_count(t)
        ids, n = np.unique(np.fromiter(map(itemgetter(1), found.iter(t.decode("latin-1"))), np.int64), return_counts=True)
        where.append(np.full(len(ids), k))
        which.append(ids)
        often.append(n)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return sizes, join(where), join(which), join(often)


def blocks_of(items: DataFrame, most_items: int, most_bytes: int) -> Iterator[Block]:
    """Items in ascending order in blocks; the driver holds one block at a time.

    `items` has `item_id` and `text`; rows of one id are one item with the terms of all of them.
    """
    held, size = {}, 0
    for r in items.orderBy("item_id").toLocalIterator():
        raw = bytes(r["text"])
        if r["item_id"] not in held and held and (len(held) >= most_items or size + len(raw) > most_bytes):
            yield Block(held)
            held, size = {}, 0
        size += len(raw)
        held.setdefault(r["item_id"], set()).update(raw.translate(LOWER).split())
    if held:
        yield Block(held)


def texts_of(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes | None]]]:
    """Texts of a batch in runs of about `most` bytes, each with its first row's place."""
    start, size, run = 0, 0, []
    for t in batch.column(column).to_pylist():
        run.append(t)
        size += len(t) if t else 0
        if size >= most:
            yield start, run
            start, size, run = start + len(run), 0, []
    if run:
        yield start, run


def corpus_counts(texts: DataFrame, shared, empty: int = -1, total: int = -2) -> dict[int, int]:
    """Documents that hold each term of the block, by its place; `empty`: documents with terms, `total`: all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = tuple(shared.value.terms)
        holding, documents, size = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for _, part in texts_of(b, 0):
                sizes, _, which, _ = scan(part, terms)
                holding += np.bincount(which, minlength=len(terms))
                documents, size = documents + int((sizes > 0).sum()), size + int(sizes.sum())
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((some, [empty, total]))), pa.array(np.concatenate((holding[some], [documents, size])))], names=["term", "n"])

    counted = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}  # two rows and one for each term of the block at most


def weights(counts: dict[int, int], n_terms: int, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(n_terms)], np.int64)


def item_scores(n_rows: int, n_items: int, where, holders, first, many, value, exact_in_double: bool) -> np.ndarray:
    """Rows x items: each (row, term, value) adds its value to all items that hold the term."""
    begin = np.repeat(first - (np.cumsum(many) - many), many)
    cell = np.repeat(where, many) * n_items + holders[begin + np.arange(len(begin))]
    value = np.repeat(value, many)
    if exact_in_double:
        return np.bincount(cell, weights=value, minlength=n_rows * n_items).astype(np.int64).reshape(n_rows, n_items)
    out = np.zeros(n_rows * n_items, np.int64)
    np.add.at(out, cell, value)
    return out.reshape(n_rows, n_items)


def best_of(items: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` highest scores of each item, equal ones by id."""
    by = np.lexsort((ids, -scores, items))
    items, scores, ids = items[by], scores[by], ids[by]
    near = np.arange(len(items)) - np.searchsorted(items, items) < k
    return items[near], scores[near], ids[near]


def best_documents(texts: DataFrame, shared, weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """`item, doc_id, score`: for each task and item its `k` best documents; `texts` has columns doc_id and text."""
    exact_in_double = int(weight.sum()) * (SCALE // 1000) < 2**53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        terms, n_items = tuple(block.terms), len(block.items)
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        least = np.ones(n_items, np.int64)
        rows = max(1, CELLS // n_items)
        for b in batches:
            doc_ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, part in texts_of(b, 1):
                sizes, where, which, often = scan(part, terms)
                m = 100 - SHARE + SHARE * sizes * documents // total
                value = weight[which] * (SCALE * often // (1000 * often + SATURATION * m[where]))
                first, many = block.ends[which], block.ends[which + 1] - block.ends[which]
                for s in range(0, len(part), rows):
                    lo, hi = np.searchsorted(where, (s, s + rows))
                    n = min(rows, len(part) - s)
                    scores = item_scores(n, n_items, where[lo:hi] - s, block.holders, first[lo:hi], many[lo:hi], value[lo:hi], exact_in_double)
                    row, item = np.nonzero(scores >= least)
                    new = (item, scores[row, item], doc_ids[at + s + row])
                    best = best_of(*(np.concatenate(x) for x in zip(best, new)), k)
                    full = np.bincount(best[0], minlength=n_items) == k
                    last = np.searchsorted(best[0], np.arange(n_items), side="right") - 1
                    least[full] = best[1][last[full]]
        names = np.array(block.items, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["item_id", "doc_id", "score"])

    return texts.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           items_per_block: int = ITEMS_PER_BLOCK, bytes_per_block: int = BYTES_PER_BLOCK) -> DataFrame:
    """`item_id, rank, doc_id, score`: the `k` documents with the highest score above 0 for each item, all if fewer.

    Equal scores go by ascending `doc_id`. Every row with an id is a document of its own, so a repeated row is ranked as
    often as it stands there; rows with a null id are counted in the statistics and never ranked. Null and empty texts have
    no terms. Rows of one item id are one item; those with a null id are left out, and an item without terms, or whose terms
    no document has, gives no row. Long texts are read whole. Other columns are ignored, so they may have any name; an
    empty table on either side gives an empty frame.
    """
    spark = docs.sparkSession
    raw = F.col(text).cast("string").cast("binary").alias("text")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), raw).where("item_id is not null and text is not null")
    parts = []
    for block in blocks_of(asked, items_per_block, bytes_per_block):
        if not block.terms:
            continue
        shared = spark.sparkContext.broadcast(block)
        counts = corpus_counts(texts.select("text"), shared)
        documents, total = counts.get(-1, 0), counts.get(-2, 0)
        if total:
            weight = weights(counts, len(block.terms), documents)
            found = best_documents(texts.where("doc_id is not null"), shared, weight, documents, total, k)
            order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            parts.append(settle(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
