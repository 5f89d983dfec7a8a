"""Document quality by a byte-level convolutional network in numpy.

Every byte is a symbol, marked when its block of eight repeats what stood up to `LAGS` bytes earlier. Learned filters of
`WIDTH` symbols run over the whole text; their largest value in each chunk of 256 bytes is kept (chunks overlap by half),
and the mean over all chunks goes through one linear layer to a probability. Filters are an embedding times a kernel, so
that a pass is a table lookup and a sum per byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.chunked import blocks, map_texts
from strataframe.llm.labelled import sample

WIDTH, FILTERS, EMBEDDING = 4, 12, 8
HALF = 128  # half a chunk
PAD, SYMBOLS = 512, 513
LAGS = 40
SLICE = 1 << 18


@dataclass
class Net:
    embedding: np.ndarray  # SYMBOLS x EMBEDDING
    kernel: np.ndarray  # WIDTH x EMBEDDING x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    shift: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.kernel, self.bias, self.out, self.shift]

    def tables(self) -> np.ndarray:
        t = np.einsum("se,wef->wsf", self.embedding, self.kernel)
        t[:, PAD] = 0
        return t.astype(np.float32)


def symbols(raw: bytes) -> np.ndarray:
    """Codes of a text's bytes, with the repeat mark, padded to whole half chunks with room for a filter behind."""
    n = len(raw)
    out = np.full(-(-(n + WIDTH - 1) // HALF) * HALF, PAD, dtype=np.uint16)
    data = np.frombuffer(raw, dtype=np.uint8)
    out[:n] = data
    if n >= 64:
        words = np.lib.stride_tricks.sliding_window_view(data, 8)
        words = np.ascontiguousarray(words[: n - 7]).view(np.uint64)[:, 0]
        at = np.arange(8, n - 7, 8)
        seen = np.zeros(len(at), dtype=bool)
        for lag in range(1, LAGS + 1):
            seen |= (words[at] == words[np.maximum(at - lag, 0)]) & (at >= lag)
        out[8 : 8 + 8 * len(at)] += np.repeat(seen, 8).astype(np.uint16) * 256
    return out


def join(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of several texts in a row and how many half chunks each has; a null text is an empty one."""
    each = [symbols((t or "").encode("utf-8", "surrogatepass")) for t in texts]
    return np.concatenate(each) if each else np.zeros(0, np.uint16), np.array([len(e) // HALF for e in each])


def pooled(codes: np.ndarray, tables: np.ndarray, places: bool = False):
    """Largest value of every filter in every half chunk, and where it stands if `places`."""
    best = np.empty((len(codes) // HALF, FILTERS), np.float32)
    where = np.empty(best.shape, np.int64) if places else None
    ahead = np.concatenate((codes, np.full(WIDTH, PAD, codes.dtype)))
    for s in range(0, len(codes), SLICE):
        e = min(s + SLICE, len(codes))
        value = tables[0][ahead[s:e]]
        for w in range(1, WIDTH):
            value += tables[w][ahead[s + w : e + w]]
        value = value.reshape(-1, HALF, FILTERS)
        best[s // HALF : e // HALF] = value.max(axis=1)
        if places:
            where[s // HALF : e // HALF] = value.argmax(axis=1) + np.arange(s, e, HALF)[:, None]
    return best, where


def chunks(best: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every half chunk the chunk that starts there: the half with the larger value of it and the next one."""
    last = np.cumsum(halves) - 1
    follow = np.minimum(np.arange(len(best)) + 1, len(best) - 1)
    follow[last] = last
    own = best >= best[follow]
    return np.where(own, best, best[follow]), np.where(own, np.arange(len(best))[:, None], follow[:, None])


def features(net: Net, tables: np.ndarray, codes: np.ndarray, halves: np.ndarray) -> np.ndarray:
    value, _ = chunks(pooled(codes, tables)[0], halves)
    value = np.tanh(np.maximum(value + net.bias, 0))
    starts = np.cumsum(halves) - halves
    return np.add.reduceat(value, starts, axis=0) / halves[:, None]


def score(net: Net, texts: list[str | None], tables: np.ndarray | None = None) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    tables = net.tables() if tables is None else tables
    z = features(net, tables, *join(texts)) @ net.out + net.shift[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(texts: list[str], labels: list[int], weights: list[float], steps: int = 600, batch: int = 48, rate: float = 0.015,
        seed: int = 7) -> Net:
    """Adam on the weighted log loss, for about `steps` batches. Without both classes the network answers their share everywhere."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.5, (SYMBOLS, EMBEDDING)), rng.normal(0, 0.5, (WIDTH, EMBEDDING, FILTERS)), np.zeros(FILTERS),
              rng.normal(0, 0.5, FILTERS), np.zeros(1))
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.shift[:] = 4.0 * (2 * labels[0] - 1) if labels else 0.0
        return net
    each = [symbols(t.encode("utf-8", "surrogatepass")) for t in texts]
    y, weight = np.array(labels, float), np.array(weights)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for _ in range(max(1, round(steps * batch / len(each)))):
        order = rng.permutation(len(each))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            codes, halves = np.concatenate([each[i] for i in rows]), np.array([len(each[i]) // HALF for i in rows])
            best, where = pooled(codes, net.tables(), places=True)
            value, half = chunks(best, halves)
            bent = np.maximum(value + net.bias, 0)
            act = np.tanh(bent)
            mean = np.add.reduceat(act, np.cumsum(halves) - halves, axis=0) / halves[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ net.out + net.shift[0], -30, 30)))
            dz = (p - y[rows]) * weight[rows] / len(rows)
            dvalue = np.repeat(dz / halves, halves)[:, None] * net.out * (1 - act**2) * (bent > 0)
            place = np.take_along_axis(where, half, axis=0)
            ahead = np.concatenate((codes, np.full(WIDTH, PAD, codes.dtype)))
            dtables = np.zeros((WIDTH, SYMBOLS, FILTERS))
            column = np.broadcast_to(np.arange(FILTERS), place.shape).ravel()
            for w in range(WIDTH):
                cell = ahead[place + w].astype(np.int64).ravel() * FILTERS + column
                dtables[w] = np.bincount(cell, dvalue.ravel(), SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
            dtables[:, PAD] = 0
            slopes = [np.einsum("wsf,wef->se", dtables, net.kernel), np.einsum("wsf,se->wef", dtables, net.embedding),
                      dvalue.sum(axis=0), mean.T @ dz, np.array([dz.sum()])]
            step += 1
            for part, slope, (m, v) in zip(net.parts(), slopes, moments):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit_from(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 1500) -> Net:
    return fit(*sample(docs, labels, "quality", allowed, per_class, most_bytes=16_000))


def scorer(net: Net):
    """A column function text -> probability of label 1."""
    tables = net.tables()

    def run(text: pd.Series) -> pd.Series:
        values = text.tolist()
        return pd.Series(np.concatenate([score(net, values[s], tables) for s in blocks(values)] or [np.zeros(0)]))

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def score_documents(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, score` for every row; a null text scores as an empty one. Other columns are not read."""
    tables = net.tables()
    return map_texts(docs, lambda texts: {"score": score(net, texts, tables).tolist()}, "score double", doc_id, text)
