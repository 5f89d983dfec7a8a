"""A search index of immutable segments: built once, searched without the texts, changed in proportion to the change.

A segment holds the postings of its items by item (to take them out again) and in blocks by term (to search), the items'
places, signed changes of the document frequencies, and the items of earlier segments that it replaces or removes. A
version of the index is a list of segments with the collection's totals; committing one is the write of one small
file, which fails if another writer was first. Readers keep the version they opened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.retrieval.index import idf_weights, postings, tfidf
from strataframe.retrieval.ranked import SHARD_ITEMS, block_rows, place_items, shards_for

TABLES = ("words", "stems", "vectors", "items", "lexical", "semantic", "changes", "gone")
SEARCHED = {"lexical": ("words", "tf"), "semantic": ("vectors", "weight")}  # blocks and the postings they hold
POSTINGS = {"word": "words", "stem": "stems"}  # an index of one kind has only what that kind needs
MANIFEST = "position int, name string, shards int, items bigint, docs bigint, word_count bigint, kinds string, blocks boolean"


@dataclass(frozen=True)
class Segment:
    spark: SparkSession
    folder: str
    shards: int

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")


@dataclass(frozen=True)
class SearchIndex:
    """One version: `items` counts all items, `docs` those with words, `word_count` their words."""

    spark: SparkSession
    path: str
    version: int
    names: tuple[str, ...]
    shards: tuple[int, ...]
    items: int
    docs: int
    word_count: int
    kinds: tuple[str, ...] = tuple(POSTINGS)
    blocks: bool = True

    @property
    def segments(self) -> list[Segment]:
        return [Segment(self.spark, f"{self.path}/{n}", s) for n, s in zip(self.names, self.shards)]

    @property
    def avg_len(self) -> float:
        return self.word_count / self.docs if self.docs else 0.0

    def gone_after(self, k: int) -> DataFrame | None:
        """Items of segment `k` that later segments replaced or removed."""
        later = [s.read("gone") for s in self.segments[k + 1 :]]
        return reduce(DataFrame.unionByName, later) if later else None

    def live(self, table: str, k: int) -> DataFrame:
        """Rows by item of one segment without those that are gone."""
        gone, rows = self.gone_after(k), self.segments[k].read(table)
        return rows if gone is None else rows.join(gone, "ref", "left_anti")

    def rows(self, table: str) -> DataFrame:
        """Live rows of all segments of `words`, `stems`, `vectors` or `items`."""
        return reduce(DataFrame.unionByName, [self.live(table, k) for k in range(len(self.names))])

    def lexicon(self, kind: str) -> DataFrame:
        """(term, df, tf) over all live items; `kind` is word or stem."""
        signed = reduce(DataFrame.unionByName, [s.read("changes") for s in self.segments]).where(F.col("kind") == kind)
        if len(self.names) > 1:
            signed = signed.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        return signed.select("term", "df", "tf").where("df > 0")

    def idf(self) -> DataFrame:
        """(term, df, tf, idf) of the stems."""
        return idf_weights(self.lexicon("stem"), F.lit(self.items))

    def parts(self, table: str, size: str, allowed: DataFrame | None = None) -> list[tuple[DataFrame, DataFrame, int]]:
        """What `block_topk` reads of each segment: live (and allowed) items with their size, blocks or postings, number of shards."""
        out = []
        for k, s in enumerate(self.segments):
            items = self.live("items", k).select("ref", "shard", "pos", F.col(size).alias("size"))
            items = items if allowed is None else items.join(allowed, "ref", "left_semi")
            rows, value = SEARCHED[table]
            out.append((items, s.read(table) if self.blocks else s.read(rows).select("ref", "term", F.col(value).alias("value")), s.shards))
        return out


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    rows = spark.read.schema(MANIFEST + ", version int").parquet(f"{path}/manifest")
    last = rows.agg(F.max("version")).first()[0]
    rows = sorted(rows.where(F.col("version") == last).collect(), key=lambda r: r["position"])  # a row per segment
    totals = rows[0]
    return SearchIndex(spark, path, last, tuple(r["name"] for r in rows), tuple(r["shards"] for r in rows), totals["items"],
                       totals["docs"], totals["word_count"], tuple(totals["kinds"].split(",")), totals["blocks"])


def _commit(spark: SparkSession, path: str, version: int, segments: list[tuple[str, int]], totals: tuple[int, int, int],
            kinds: tuple[str, ...], blocks: bool) -> SearchIndex:
    rows = [(k, n, s, *totals, ",".join(kinds), blocks) for k, (n, s) in enumerate(segments)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")
    return open_index(spark, path)


def _signed(posts: DataFrame, kind: str, sign: int) -> DataFrame:
    return posts.groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"), (F.sum("tf") * sign).alias("tf")).select(
        F.lit(kind).alias("kind"), "term", "df", "tf")


def _totals(items: DataFrame) -> tuple[int, int, int]:
    r = items.agg(F.count(F.lit(1)).alias("n"), F.count("len").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    return r["n"], r["docs"], r["words"]


def _write_blocks(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> None:
    read = lambda table: spark.read.parquet(f"{folder}/{table}")
    for kind, table, rows, value, size in (("word", "lexical", "words", "tf", "len"), ("stem", "semantic", "vectors", "weight", "norm")):
        if kind in kinds:
            block_rows(read(rows), read("items").withColumn("size", F.col(size)), "ref", value).write.parquet(f"{folder}/{table}")


def _write_segment(spark: SparkSession, path: str, refs: DataFrame, posts: dict[str, DataFrame], gone: DataFrame,
                   taken: list[DataFrame], before: SearchIndex | None, items_after: int, shard_items: int, blocks: bool) -> tuple[str, int]:
    """Tables of a new segment; `taken` are signed changes for what goes, `items_after` the items of the new version."""
    name = f"segment-{uuid.uuid4().hex}"
    at = lambda table: f"{path}/{name}/{table}"
    write = lambda df, table: df.write.parquet(at(table))
    read = lambda table: spark.read.parquet(at(table))
    write(gone, "gone")
    for kind, rows in posts.items():
        write(rows, POSTINGS[kind])
    posts = {kind: read(POSTINGS[kind]) for kind in posts}
    changes = [*[_signed(rows, kind, 1) for kind, rows in posts.items()], *taken]
    summed = reduce(DataFrame.unionByName, changes).groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    write(summed.sort("kind", "term"), "changes")  # a filter on the kind skips row groups
    items = refs
    if "word" in posts:
        items = items.join(posts["word"].groupBy("ref").agg(F.sum("tf").alias("len")), "ref", "left")
    else:
        items = items.withColumn("len", F.lit(None).cast("bigint"))
    if "stem" in posts:
        known = read("changes") if before is None else read("changes").unionByName(
            reduce(DataFrame.unionByName, [s.read("changes") for s in before.segments]))
        df = known.where("kind = 'stem'").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        write(tfidf(posts["stem"], idf_weights(df, F.lit(items_after)), "ref"), "vectors")
        lengths = read("vectors").groupBy("ref").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        items = items.join(lengths, "ref", "left")
    else:
        items = items.withColumn("norm", F.lit(None).cast("double"))
    shards = shards_for(spark, refs.count(), shard_items)
    size = F.col("len" if "word" in posts else "norm")
    write(place_items(items.withColumn("size", size), "ref", shards).drop("size"), "items")
    if blocks:
        _write_blocks(spark, f"{path}/{name}", tuple(posts))
    return name, shards


def _postings(src: DataFrame, kinds: tuple[str, ...]) -> dict[str, DataFrame]:
    return {kind: postings(src, "ref", F.col("_text"), exact_words=kind == "word") for kind in kinds}


def build(items: DataFrame, ref: str, text: Column, path: str, shard_items: int = SHARD_ITEMS,
          kinds: tuple[str, ...] = tuple(POSTINGS), blocks: bool = True) -> SearchIndex:
    """A new index of one segment; `path` must be new. Items with one ref count as one item with all their texts.

    Lexical search needs the kind word, search by vectors the kind stem. `blocks` serve many searches; without them a search
    reads the postings of its terms and cuts blocks of these, until `with_blocks`.
    """
    spark = items.sparkSession
    src = items.select(F.col(ref).alias("ref"), text.alias("_text"))
    refs = src.select("ref").distinct()
    n = refs.count()
    segment = _write_segment(spark, path, refs, _postings(src, kinds), refs.limit(0), [], None, n, shard_items, blocks)
    made = Segment(spark, f"{path}/{segment[0]}", segment[1])
    return _commit(spark, path, 0, [segment], _totals(made.read("items")), kinds, blocks)


def with_blocks(index: SearchIndex) -> SearchIndex:
    """The same version with the blocks that searches read, written from its postings. Once per index."""
    if not index.blocks:
        for s in index.segments:
            _write_blocks(index.spark, s.folder, index.kinds)
    return replace(index, blocks=True)


def update(index: SearchIndex, changed: DataFrame, ref: str, text: Column, removed: DataFrame | None = None,
           shard_items: int = SHARD_ITEMS) -> SearchIndex:
    """The next version, with one more segment: `changed` items are replaced or added, `removed` ones (`ref`) go.

    Only rows about these items are written. Vectors of the new items take the document frequencies of the new
    version; those of older segments keep theirs until `merge`.
    """
    spark = index.spark
    src = changed.select(F.col(ref).alias("ref"), text.alias("_text"))
    refs = src.select("ref").distinct()
    asked = refs if removed is None else refs.unionByName(removed.select(F.col(ref).alias("ref"))).distinct()
    taken, lost, old = [], [], (0, 0, 0)
    for k in range(len(index.names)):
        rows = index.live("items", k).join(asked, "ref", "left_semi")
        old = tuple(a + b for a, b in zip(old, _totals(rows)))
        lost.append(rows.select("ref"))
        taken += [_signed(index.live(POSTINGS[kind], k).join(asked, "ref", "left_semi"), kind, -1) for kind in index.kinds]
    after = index.items - old[0] + refs.count()
    segment = _write_segment(spark, index.path, refs, _postings(src, index.kinds), reduce(DataFrame.unionByName, lost), taken,
                             index, after, shard_items, index.blocks)
    new = _totals(Segment(spark, f"{index.path}/{segment[0]}", segment[1]).read("items"))
    totals = (index.items - old[0] + new[0], index.docs - old[1] + new[1], index.word_count - old[2] + new[2])
    return _commit(spark, index.path, index.version + 1, [*zip(index.names, index.shards), segment], totals, index.kinds, index.blocks)


def merge(index: SearchIndex, shard_items: int = SHARD_ITEMS) -> SearchIndex:
    """The next version, with all live items in one segment and vectors of today's frequencies; no text is read."""
    refs = index.rows("items").select("ref")
    posts = {kind: index.rows(POSTINGS[kind]) for kind in index.kinds}
    segment = _write_segment(index.spark, index.path, refs, posts, refs.limit(0), [], None, index.items, shard_items, index.blocks)
    return _commit(index.spark, index.path, index.version + 1, [segment], (index.items, index.docs, index.word_count), index.kinds, index.blocks)
