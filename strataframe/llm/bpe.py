"""Byte-pair encoding and decoding over whole partitions with a pair occurrence index.

Each word of a block of texts becomes a run of symbols in one array with links to the neighbours. An index maps every
mergeable pair to all its positions. The pairs that occur wait in a heap by rank; the lowest rank is applied to all its
positions at once, and the pairs that arise beside them join the index. Words repeat, so a block holds each word once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.chunked import map_texts

WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PairIndex:
    """Encodes distinct words of a byte-level vocabulary with marked word ends."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        split = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in split], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in split], dtype=np.int64)
        self.left, self.right = keys // self.size, keys % self.size
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and, for each word, where its ids end."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        after = np.arange(1, n + 1, dtype=np.int64)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[ends - sizes] = -1
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that start at these positions."""
            rank = self._rank(symbol[at] * self.size + symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(rank)) + 1))
            for r, part in zip(rank[starts].tolist(), np.split(at, starts[1:])):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(waiting, r)

        add(np.flatnonzero(after >= 0))
        while waiting:
            r = heapq.heappop(waiting)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, c = self.left[r], self.right[r], self.made[r]
            follow = after[at]
            at = at[(symbol[at] == a) & (follow >= 0) & (symbol[follow] == b)]
            if not len(at):
                continue
            if a == b:  # of a run of equal symbols every second one starts a pair
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                place = np.arange(len(at))
                place -= np.maximum.accumulate(np.where(chained, 0, place))
                at = at[place % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = c, -1
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            lead = before[at]
            add(np.unique(np.concatenate((lead[lead >= 0], at[has]))))
        alive = symbol >= 0
        return symbol[alive], np.cumsum(alive)[ends - 1]


class WordCodec:
    """Texts to ids and back for a vocabulary file whose text is put in lower case and cut into words."""

    def __init__(self, path: str, limit: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pattern = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_or_ends = regex.compile(pattern + "|\\n")
        self.pairs = PairIndex(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.token = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.limit = limit
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks together: one pass finds their words, and line ends keep the chunks apart."""
        plain = "\n".join(chunks)
        marked = [plain] if "<|" not in plain else self.cut.split(plain)
        words: dict[str, int] = {}
        order: list[int] = []
        for part in marked:
            if part in self.special:
                order.append(-2 - self.special[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # as the library: no final sigma
            order += [-1 if w == "\n" else words.setdefault(w, len(words)) for w in self.words_or_ends.findall(part)]
        flat, ends = self.pairs.encode([w.encode() for w in words])
        flat, cuts = flat.tolist(), [0, *ends.tolist()]
        found = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for store, each in ((self.ids, lambda ids: " ".join(map(str, ids))), (self.decoded, self.decode)):
            texts = [each(ids) for ids in found]
            run = " ".join(["\n" if k == -1 else texts[k] if k >= 0 else each([-2 - k]) for k in order])
            store.update(zip(chunks, run.split(" \n ")))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def both(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its decimal ids joined by spaces, and the decoded text."""
        cut = [[] if not t else [c for c in WHITE.split(t) if c] if SEPARATORS.search(t) else t.split() for t in texts]
        if len(self.ids) > self.limit:
            self.ids.clear()
            self.decoded.clear()
        missing = list(set().union(*cut).difference(self.ids))
        if missing:
            self._learn(missing)
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        return [(" ".join(map(ids, c)), " ".join(map(decoded, c))) for c in cut]


@lru_cache(maxsize=1)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, its ids as decimals joined by one space, and the text decoded from them.

    A null or empty text has no ids. Rows are independent, so repeated ids, ties and extra columns need no rule.
    """

    def make(texts: list) -> dict:
        both = codec(path).both(texts)
        return {"ids": [x for x, _ in both], "decoded": [x for _, x in both]}

    return map_texts(docs, make, "ids string, decoded string", doc_id, text, most=6_000_000)


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and hashes of `encode_documents`, taken in the same pass so that no ids travel between tasks."""
    full = encode_documents(docs, path, doc_id, text)

    return full.select(
        "doc_id", F.when(F.col("ids") == "", F.lit(0)).otherwise(F.length("ids") - F.length(F.translate("ids", " ", "")) + 1)
        .cast("long").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
