"""Whole-text encoding with a public tokenizer, one white-space chunk at a time.

Both vocabularies split a text into pre-tokens that never reach from a visible character into white space. A text may
therefore be cut in front of white space that follows a visible character, and its ids are those of its chunks. Chunks
repeat, so each worker keeps the ids of those it met; of a full store those are kept that are met again before the next
one is full, which changes speed only. Texts that hold a special token or unusual white space go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
SPACE_RUN = re.compile(r"\s ")
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[,.;:!?]")  # letters that stay one code point in lower case
VISIBLE = re.compile(r"\S+")
SPACED = re.compile(r"\s*\S+|\s+\Z")


class Store(dict):
    """Ids of known chunks; an unknown chunk answers itself and is noted. Chunks of the store before, `old`, move here when met."""

    def __init__(self, old: dict[str, bytes]):
        super().__init__()
        self.new: list[str] = []
        self.old = old

    def __missing__(self, key: str) -> str | bytes:
        found = self.old.get(key)
        if found is None:
            self.new.append(key)
            return key
        self[key] = found
        return found


class ChunkEncoder:
    """Texts to little-endian 32-bit ids, as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    Where the vocabulary keeps spaces (`keeps_space`), the key of a chunk that starts with one space is what follows it;
    any other chunk has a space behind it as its key, which the former cannot have.
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = 550_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.keeps_space, self.limit = keeps_space, limit
        self.known = Store({})
        self.waiting: list[str] = []
        self.edge = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)  # first ids of chunks, or last ids of words
        for token, i in self.library.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if keeps_space else token.endswith("</w>")

    def _keys(self, text: str) -> list[str]:
        odd = "<|" in text or ODD_SPACE.search(text)
        if not self.keeps_space:
            return [text] if odd else text.split()
        if odd:
            return [text + " "]
        if SPACE_RUN.search(text):
            return [c + " " for c in SPACED.findall(text)]
        keys = text.split(" ")
        keys[0] += " "
        return keys

    def _learn(self, keys: list[str]) -> None:
        """Words with a point or comma behind them are put together from both; the library encodes the rest."""
        known, ends_in = self.known, " " if self.keeps_space else ""
        joined = [k for k in keys if PLAIN.fullmatch(k)]
        rest = dict.fromkeys(keys)
        for k in joined:
            del rest[k]
        for k in joined:
            for part in (k[:-1], k[-1] + ends_in):
                if part not in known and part not in known.old:
                    rest[part] = None
        fits, plain, other = VISIBLE.fullmatch if self.keeps_space else str.isalpha, [], []
        for k in rest:
            (plain if fits(k) else other).append(k)
        rest = self._words(plain) + other
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            texts = [k[:-1] if k[-1:] == " " else " " + k for k in part] if self.keeps_space else part
            for key, found in zip(part, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                ids = found.ids
                known[key] = pack(f"<{len(ids)}I", *ids)
        for k in joined:
            known[k] = known[k[:-1]] + known[k[-1] + ends_in]

    def _words(self, words: list[str]) -> list[str]:
        """Learn chunks many at a time. Of visible characters behind one space, the first id alone carries the space; of letters
        in a vocabulary of words, the last id alone carries the word end.

        Returns those of a batch in which that does not part the chunks.
        """
        left, head = [], " " if self.keeps_space else ""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            (found,) = self.library.encode_batch_fast([head + " ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(self.edge[ids])
            cuts = np.append(cuts, len(ids)) if self.keeps_space else np.append(0, cuts + 1)
            if len(cuts) != len(part) + 1 or cuts[0]:
                left += part
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        return left

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.old = {}
            self.known = Store(self.known)
        known = self.known
        look, new, out, open_ = known.__getitem__, known.new, [], []
        for i, t in enumerate(texts):
            found = list(map(look, self._keys(t))) if t else []
            if new:  # answers that are still keys
                open_.append((i, found))
                out.append(b"")
                self.waiting += new
                new.clear()
            else:
                out.append(b"".join(found))
        if open_:
            self._learn(list(dict.fromkeys(self.waiting)))
            self.waiting.clear()
            for i, found in open_:
                out[i] = b"".join([known[x] if type(x) is str else x for x in found])
        return out


@lru_cache(maxsize=2)
def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One per worker process and file."""
    return ChunkEncoder(path, keeps_space)


def blocks(texts: list[str | None], most: int = 4_000_000):
    """Ranges of rows whose texts together stay near `most` characters, so that a batch of long texts stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def map_texts(docs: DataFrame, make: Callable[[list], dict[str, list]], schema: str, doc_id: str = "doc_id",
              text: str = "text", most: int = 4_000_000) -> DataFrame:
    """`doc_id` and the columns that `make` gives for a list of texts (null as None), row by row and without a shuffle.

    Only the two columns named are read, so further columns may have any name. Ids pass through unchanged, null too.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in blocks(texts, most):
                made = make(texts[s])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.start, s.stop - s.start), *map(pa.array, made.values())], names=["doc_id", *made])

    return source.mapInArrow(run, "doc_id long, " + schema)
