"""Toxicity by weak supervision.

1. Voters: each word of a built-in lexicon, abuse and shouting patterns, and words and word beginnings that stand out in a
   bounded sample of labelled rows. Each votes 0 or 1 on a text or abstains. The label is one more voter while the model is
   fitted, and tells the classes apart where the lexicon is silent.
2. A generative label model is fitted to the votes by expectation maximisation, with the class of a text hidden. It has the
   share of toxic texts, and for each voter and class how often it says 0, 1 or nothing. Voters that go together beyond what
   the class explains are joined by a tree: a voter's table then also depends on the vote of its parent. No accuracy is set
   beforehand, that of the annotator neither.
3. The posterior of each sampled text, from all voters but its label, trains a linear classifier on its words and word
   beginnings.
4. Every whole text is scored by that classifier, through one automaton over all features.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.chunked import blocks, map_texts
from strataframe.llm.labelled import sample

LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "dumb", "ugly",
           "bastard", "jerk", "fool", "hate", "kill", "crap", "filth", "vermin", "garbage")
_ANY = "(?:" + "|".join(LEXICON) + ")"
PATTERNS = {
    "you are": re.compile(r"\byou(?:'re| are) (?:a |an |so |such )?" + _ANY + r"\b", re.I),
    "shut up": re.compile(r"\b(?:shut up|get lost|go away|drop dead)\b", re.I),
    "masked": re.compile(r"\b[a-z]+\*{2,}[a-z]*\b(?!\*)", re.I),
    "pointed at": re.compile(r"\b(?:a|an|the|this|that|such|you|your|of|is|are)\s+" + _ANY + r"\b", re.I),
    "shouting": re.compile(r"(?:\b[A-Z]{2,}\b[!?.,]*\s+){5}"),
}
WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 4, 8  # lengths of word beginnings
VOTERS, FEATURES = 300, 3000
ABSTAINS = 2  # a vote is 0, 1 or this


@dataclass
class Classifier:
    weight: dict[str, float]  # " word " or " begin"
    shift: float

    def automaton(self):
        a = ahocorasick.Automaton()
        for key, w in self.weight.items():
            a.add_word(key, (key, w))
        a.make_automaton()
        return a


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def keys_of(words: set[str]) -> set[str]:
    """What a text shows: its words, and the beginnings of its words."""
    keys = {f" {w} " for w in words}
    keys.update(f" {w[:n]}" for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return keys


def indexed(texts: list[str], labels: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """Features of the toxic texts and of the lexicon, and their numbers in every text."""
    place = {f" {w} ": i for i, w in enumerate(LEXICON)}
    shown: list = [None] * len(texts)
    for i in [*np.flatnonzero(labels == 1), *np.flatnonzero(labels != 1)]:
        keys = keys_of(words_of(texts[i]))
        ids = [place.setdefault(k, len(place)) for k in keys] if labels[i] == 1 else [place[k] for k in keys if k in place]
        shown[i] = np.array(sorted(ids), dtype=np.int32)
    return list(place), shown


def standing_out(names: list[str], shown: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the features whose smoothed odds between the classes are largest.

    A long toxic text says little about each of its words: a text counts the less the more features it shows, and a
    feature needs the support of two short texts at least, of more long ones, and of more in a larger sample.
    """
    size = np.array([len(s) for s in shown])
    flat, owner = np.concatenate(shown), np.repeat(np.arange(len(shown)), size)
    toxic = labels[owner] == 1
    seen1, seen0 = (np.bincount(flat[m], minlength=len(names)) for m in (toxic, ~toxic))
    support = np.bincount(flat[toxic], 1 / (1 + size[owner[toxic]] / 500), len(names))
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels != 1).sum()))
    odds = np.log((support + 0.5) / (n1 + 1)) - np.log((seen0 + 0.5) / (n0 + 1))
    fine = np.flatnonzero((support >= 1.25 + 0.002 * n1) & (seen1 >= 2) & (odds > 1.5))
    strength = odds[fine] * np.sqrt(support[fine])
    return np.array([k for _, _, k in sorted((-x, names[k], k) for x, k in zip(strength, fine))[:most]], dtype=np.int64)


def marks(shown: list[np.ndarray], keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, column) of the features `keys` that texts show."""
    column = np.full(n, -1)
    column[keys] = np.arange(len(keys))
    flat, owner = np.concatenate(shown), np.repeat(np.arange(len(shown)), [len(s) for s in shown])
    at = column[flat]
    return owner[at >= 0], at[at >= 0]


def voting(names: list[str], shown: list[np.ndarray], labels: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Numbers of the features that vote: those standing out whose log odds exceed `least` at the lower end of a 90 % interval.

    Of features with the same texts one votes, as they say the same.
    """
    found = standing_out(names, shown, labels, VOTERS)
    size = np.array([len(s) for s in shown])
    flat, owner = np.concatenate(shown), np.repeat(np.arange(len(shown)), size)
    toxic = labels[owner] == 1
    support = np.bincount(flat[toxic], 1 / (1 + size[owner[toxic]] / 500), len(names))[found] + 0.5
    against = np.bincount(flat[~toxic], minlength=len(names))[found] + 0.5
    n1, n0 = (labels == 1).sum() + 1, (labels != 1).sum() + 1
    low = np.log(support / n1) - np.log(against / n0) - 1.64 * np.sqrt(1 / support + 1 / against)
    found = found[low > least]
    text, column = marks(shown, found, len(names))
    first: dict[tuple, int] = {}
    ends = np.cumsum(np.bincount(column, minlength=len(found)))[:-1]
    for k, who in zip(found.tolist(), np.split(text[np.argsort(column, kind="stable")], ends)):
        first.setdefault(tuple(np.sort(who).tolist()), k)
    return np.array(list(first.values()), dtype=np.int64)


def ballots(texts: list[str], names: list[str], shown: list[np.ndarray], keys: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Votes, texts x voters: words, patterns, the count of lexicon words (two or more: 1, none: 0), and the label."""
    keys = np.array(list(dict.fromkeys([*range(len(LEXICON)), *keys.tolist()])))
    votes = np.full((len(texts), len(keys) + len(PATTERNS) + 2), ABSTAINS)
    votes[marks(shown, keys, len(names))] = 1
    for j, p in enumerate(PATTERNS.values()):
        votes[[bool(p.search(t)) for t in texts], len(keys) + j] = 1
    count = (votes[:, : len(LEXICON)] == 1).sum(axis=1)
    votes[count >= 2, -2] = 1
    votes[count == 0, -2] = 0
    votes[:, -1] = gold
    return votes


@dataclass
class LabelModel:
    """The share of label 1, and log P(vote of j | class, vote of j's parent) as `table[class, j, parent's vote, vote]`."""

    prior: float
    table: np.ndarray
    parent: np.ndarray  # -1: depends on the class alone

    def accuracy(self, votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """[class, voter]: the share of a voter's votes, 0 or 1, that are right on texts of the class."""
        post = self.posterior(votes)
        said = [[(p * weights) @ (votes == v) for v in (0, 1)] for p in (1 - post, post)]
        return np.stack([said[y][y] / np.maximum(said[y][0] + said[y][1], 1e-12) for y in (0, 1)])

    def posterior(self, votes: np.ndarray, used: np.ndarray | slice = slice(None)) -> np.ndarray:
        """P(label 1) of each text from the voters in `used`; parents of used voters are read even if not used."""
        seen = votes[:, np.maximum(self.parent, 0)]
        each = np.arange(votes.shape[1])
        one, none = (self.table[y][each, seen, votes][:, used].sum(axis=1) for y in (1, 0))
        logit = one - none + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def tables(votes: np.ndarray, parent: np.ndarray, post: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Smoothed log tables: rare votes lean to the voter's rate over all texts, rare pairs to the voter's own rate."""
    m = votes.shape[1]
    seen = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
    at = (np.arange(m) * 9 + seen * 3 + votes).ravel()
    counts = np.stack([np.bincount(at, np.repeat(weights * p, m), m * 9).reshape(m, 3, 3) for p in (1 - post, post)])
    alone = counts.sum(axis=2)
    usual = (alone.sum(axis=0) + 0.1) / (alone.sum(axis=(0, 2))[:, None] + 0.3)
    alone = (alone + usual) / (alone.sum(axis=2, keepdims=True) + 1)
    pairs = (counts + 4 * alone[:, :, None, :]) / (counts.sum(axis=3, keepdims=True) + 4)
    return np.log(np.where((parent >= 0)[None, :, None, None], pairs, alone[:, :, None, :]))


def correlations(votes: np.ndarray, post: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Information, in nats per text, that the votes of each two voters have on each other when the class is known."""
    total = weights.sum()
    said = [(votes == v).astype(np.float64) for v in range(3)]
    out = np.zeros((votes.shape[1],) * 2)
    for p in ((1 - post) * weights / total, post * weights / total):
        rate = [p @ s for s in said]
        for a in range(3):
            for b in range(3):
                both, apart = said[a].T @ (said[b] * p[:, None]), np.outer(rate[a], rate[b]) / max(p.sum(), 1e-12)
                out += np.where(both > 1e-12, both * np.log(np.maximum(both, 1e-12) / np.maximum(apart, 1e-12)), 0)
    return out


def forest(strength: np.ndarray, least: float) -> np.ndarray:
    """Parents in the spanning forest of the strongest pairs over `least`."""
    m = len(strength)
    left, right = np.triu_indices(m, 1)
    order = np.argsort(-strength[left, right], kind="stable")
    tree, near = list(range(m)), [[] for _ in range(m)]

    def top(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    for e in order:
        i, j = int(left[e]), int(right[e])
        if strength[i, j] <= least:
            break
        if top(i) != top(j):
            tree[top(i)] = top(j)
            near[i].append(j)
            near[j].append(i)
    parent, reached = np.full(m, -1), [False] * m
    for root in range(m):
        todo = [] if reached[root] else [root]
        while todo:
            i = todo.pop()
            reached[i] = True
            for j in near[i]:
                if not reached[j]:
                    parent[j] = i
                    todo.append(j)
    return parent


def label_model(votes: np.ndarray, weights: np.ndarray, rounds: int = 60, apart: tuple[int, ...] = ()) -> LabelModel:
    """Fits the model to votes alone, from the shares of 1 among them on.

    The strongest pairs are joined early, before voters that repeat each other pass for the hidden class; the whole tree is
    drawn twice more as the classes get clearer. A pair is joined when its correlation passes a chi-squared test at a thousandth, corrected for the number of pairs. Voters in `apart` are never
    joined: an annotator does not see the other votes.
    """
    n, m = votes.shape
    ones, zeros = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    post, parent = (0.1 + ones) / (1 + ones + zeros), np.full(m, -1)
    for i in range(rounds):
        prior = float(np.clip(post @ weights / weights.sum(), 0.001, 0.999))
        model = LabelModel(prior, tables(votes, parent, post, weights), parent)
        if i in (2, rounds // 3, 2 * rounds // 3):
            strength = correlations(votes, post, weights)
            strength[list(apart), :] = strength[:, list(apart)] = 0
            least = (26.0 + 2 * np.log(max(1, m * (m - 1) / 2))) / (2 * n)
            parent = forest(strength, max(least, strength.max() / 2) if i == 2 else least)
        post = model.posterior(votes)
    return model


def fit(texts: list[str], labels: list[int], weights: list[float], steps: int = 3000, rate: float = 0.1) -> Classifier:
    """Without labelled rows only the lexicon speaks."""
    if not texts:
        return Classifier({f" {w} ": 4.0 for w in LEXICON}, -2.5)
    y, weight = np.array(labels), np.array(weights)
    names, shown = indexed(texts, y)
    votes = ballots(texts, names, shown, voting(names, shown, y), y)
    annotator = votes.shape[1] - 1
    post = label_model(votes, weight, apart=(annotator,)).posterior(votes, np.arange(annotator))
    chosen = standing_out(names, shown, (post > 0.5).astype(int), FEATURES)
    chosen = np.array(list(dict.fromkeys([*chosen.tolist(), *range(len(LEXICON))])))
    vocabulary = [names[k] for k in chosen]
    owner, flat = marks(shown, chosen, len(names))
    rows = shown
    w, shift = np.zeros(len(vocabulary)), -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[flat], len(rows)) + shift
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post) * weight / weight.sum()
        slope = np.append(np.bincount(flat, d[owner], len(w)) + 5e-5 * w / np.sqrt(len(rows)), d.sum())
        m += 0.1 * (slope - m)
        v += 0.001 * (slope**2 - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        shift -= move[-1]
    return Classifier({k: float(x) for k, x in zip(vocabulary, w) if abs(x) > 1e-3}, float(shift))


def score(model: Classifier, automaton, texts: list[str | None]) -> list[float]:
    """Probability of label 1 for each whole text; each feature counts once."""
    out = []
    for t in texts:
        found: dict[str, float] = {}
        if t and len(automaton):
            found = {key: w for _, (key, w) in automaton.iter(" " + " ".join(WORD.findall(t.lower())) + " ")}
        z = sum(found[k] for k in sorted(found)) + model.shift
        out.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
    return out


def fit_from(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 2500) -> Classifier:
    return fit(*sample(docs, labels, "toxic", allowed, per_class, most_bytes=16_000))


def scorer(model: Classifier):
    """A column function text -> probability of label 1."""
    automaton = model.automaton()

    def run(text: pd.Series) -> pd.Series:
        values = text.tolist()
        return pd.Series([x for s in blocks(values) for x in score(model, automaton, values[s])], dtype="float64")

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def score_documents(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, score` for every row; a null text scores as an empty one. Other columns are not read.

    Long texts are read whole, in one pass; each feature counts once however often it stands there.
    """
    automaton = model.automaton()
    return map_texts(docs, lambda texts: {"score": score(model, automaton, texts)}, "score double", doc_id, text)
