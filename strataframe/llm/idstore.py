"""A store of token ids: fixed-size blocks of ids, turned into byte or bit planes, each compressed by zstandard.

A store is a folder of Parquet files that Spark writes and commits, one row per block:

| column | meaning |
|-|-|
| part, chunk | the block's place: parts in order of document id, blocks in order within a part |
| first | ids of the part before the block |
| n_ids, width, bits | ids in the block; planes; whether these are bit planes |
| planes | one zstandard frame per plane, lowest first |
| docs | index of the documents in the block: id, its number in the part, ids of it in earlier blocks, ids of it here |

Every block can be read by itself, in any order and on any machine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.llm.chunked import blocks, encoder

BLOCK = 1 << 15
ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()),
    ("bits", pa.bool_()), ("planes", pa.list_(pa.binary())),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("before", pa.int64()), ("n", pa.int64())])))])
FOUND = pa.schema([(n, pa.int32() if n == "part" else pa.int64()) for n in ("part", "ordinal", "doc_id", "before", "n", "at", "crc")])
SCHEMA = ("part int, chunk int, first long, n_ids int, width int, bits boolean, planes array<binary>, "
          "docs array<struct<doc_id:long,ordinal:long,before:long,n:long>>")


def to_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    """Planes of a block, lowest first; as many as its largest id needs."""
    pack = zstandard.ZstdCompressor(level=level).compress
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [pack(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(-(-top // 8))]
    return [pack(np.packbits(raw[:, k // 8] >> (k % 8) & 1).tobytes()) for k in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    raw = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        data = np.frombuffer(unpack(plane), dtype=np.uint8)
        if bits:
            raw[:, k // 8] |= np.unpackbits(data, count=n) << (k % 8)
        else:
            raw[:, k] = data
    return raw.view("<u4").reshape(-1)


def write_store(docs: DataFrame, folder: str, path: str, keeps_space: bool, end_id: int, doc_id: str = "doc_id",
                text: str = "text", bits: bool = False, block: int = BLOCK) -> None:
    """Encode every whole text, append `end_id`, and write the ids in ascending order of `doc_id` to `folder`.

    Rows are dealt by ranges of (id, hash of the text), so a repeated id is no hot key; rows with one id stand in the
    order of that hash, rows alike in both in any. Null ids come first. A null text is an empty one. Other columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, first, ordinal = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        index: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            planes = to_planes(ids, bits)
            return pa.RecordBatch.from_pylist([{
                "part": part, "chunk": chunk, "first": first, "n_ids": len(ids), "width": len(planes), "bits": bits,
                "planes": planes, "docs": index}], schema=ARROW)

        for b in batches:
            names, texts = (c.to_pylist() for c in b.columns)
            for s in blocks(texts):
                for name, raw in zip(names[s], encoder(path, keeps_space).encode(texts[s])):
                    ids = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id))
                    done = 0
                    while done < len(ids):
                        take = ids[done : done + block - size]
                        index.append({"doc_id": name, "ordinal": ordinal, "before": done, "n": len(take)})
                        held.append(take)
                        size, done = size + len(take), done + len(take)
                        if size == block:
                            yield row()
                            chunk, first, size, held, index = chunk + 1, first + block, 0, [], []
                    ordinal += 1
        if size:
            yield row()

    dealt.mapInArrow(run, SCHEMA).write.parquet(folder)


def read_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' stretches in every block, read from the planes: number of ids, CRC-32 and place."""
    store = spark.read.schema(SCHEMA).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                raw = memoryview(from_planes(r["planes"], r["n_ids"], r["bits"]).tobytes())
                at, out = 0, []
                for d in r["docs"]:
                    crc = zlib.crc32(raw[4 * at : 4 * (at + d["n"])])
                    out.append(d | {"part": r["part"], "at": r["first"] + at, "crc": crc})
                    at += d["n"]
                if at != r["n_ids"]:
                    raise ValueError("the index does not fill its block")
                yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return store.select("part", "first", "n_ids", "bits", "planes", "docs").mapInArrow(
        run, "part int, ordinal long, doc_id long, before long, n long, at long, crc long")


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def join_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings in a row from their own; `size` is that of the second.

    A CRC behind `size` zero bytes is a linear map of its bits over GF(2), applied by repeated squaring.
    """
    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit; the polynomial is a fixed value of CRC-32
    bits = size * 8
    while bits:
        if bits & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        bits >>= 1
    return first ^ second


def _joined(parts: pd.Series) -> pd.Series:
    def one(p) -> int:
        crc = p[0]["crc"]
        for x in p[1:]:
            crc = join_crc(crc, x["crc"], 4 * int(x["n"]))
        return crc

    return parts.map(one)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the store: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32`.

    Only a row per part (its number of ids) is summed over parts; documents over several blocks are put together by the
    CRCs of their stretches, so no ids travel.
    """
    found = read_fragments(spark, folder)
    whole = found.groupBy("part", "ordinal").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("parts"))
    crc = F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]).otherwise(F.pandas_udf(_joined, "long")("parts"))
    parts = spark.read.schema(SCHEMA).parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per part
    before = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    return whole.join(before, "part").select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", crc.alias("ids_crc32"))
