"""The segmented index: searches against exhaustive scoring, updates against rebuilds, bounds that leave postings unread."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.retrieval import ranked, search, segments
from strataframe.session import fresh_path

WORDS = [f"w{k}" for k in range(60)]


def texts(n, seed, start=0):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return [(start + i, "common " + " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ref long, text string")


def queries(spark):
    rng = random.Random(8)
    return spark.createDataFrame([(k, "common " + " ".join(rng.choices(WORDS, k=5))) for k in range(12)], "q long, text string")


def bm25(rows, asked, k):
    docs = [(i, t.split()) for i, t in rows if t and t.split()]
    avg = sum(len(t) for _, t in docs) / len(docs)
    out = []
    for q, text in asked:
        words = set(text.split())
        df = {w: sum(w in t for _, t in docs) for w in words}
        idf = {w: max(1e-6, math.log((len(docs) - n + 0.5) / (n + 0.5))) for w, n in df.items() if n}
        scored = []
        for i, t in docs:
            hit = [w for w in idf if w in t]
            if hit:
                s = sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in hit)
                scored.append((math.floor(-s * 1e6 + 0.5) / 1e6, i))
        out += [(q, i, r + 1, s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(index, spark, k, allowed=None):
    asked = queries(spark)
    top = search.lexical_topk(index, search.query_terms(asked, "q", "text"), "q", k, allowed)
    return sorted((r["q"], r["ref"], r["rank"], r["raw_score"]) for r in top.collect())


def test_search_is_exhaustive_search_and_survives_changes(spark):
    rows = texts(700, 1) + [(900, ""), (901, None), (902, "common common")]
    asked = [tuple(r) for r in queries(spark).collect()]
    index = segments.build(frame(spark, rows), "ref", F.col("text"), fresh_path(spark, "index"), shard_items=150)
    assert len(index.names) == 1 and index.shards == (5,) and index.items == 703 and index.docs == 701
    assert found(index, spark, 7) == bm25(rows, asked, 7)
    few = spark.range(0, 703, 3).select(F.col("id").alias("ref"))
    n = {r[0]: r for r in found(index, spark, 1000)}
    assert len(n) == 12 and all(r[1] % 3 == 0 for r in found(index, spark, 5, few))
    pool = sorted(r for r in ((q, s, i) for q, i, _, s in found(index, spark, 1000)) if r[2] % 3 == 0)
    assert [(r[0], r[3]) for r in found(index, spark, 2, few)] and sorted((q, s) for q, _, _, s in found(index, spark, 1, few)) == [
        min((q, s) for q, s, _ in pool if q == own) for own in range(12)]

    changed, gone = texts(30, 2, start=690), list(range(50, 80))
    after = segments.update(index, frame(spark, changed), "ref", F.col("text"), spark.createDataFrame([(g,) for g in gone + [5000]], "ref long"),
                            shard_items=150)
    again = segments.update(after, frame(spark, [(3, "w1 w2"), (691, "w3")]), "ref", F.col("text"), shard_items=150)
    state = dict(rows) | dict(changed)
    state = {i: t for i, t in state.items() if i not in gone}
    assert found(after, spark, 9) == bm25(state.items(), asked, 9)
    state |= {3: "w1 w2", 691: "w3"}
    rebuilt = segments.build(frame(spark, list(state.items())), "ref", F.col("text"), fresh_path(spark, "index"), shard_items=150)
    merged = segments.merge(again, shard_items=150)
    assert found(again, spark, 9) == found(rebuilt, spark, 9) == found(merged, spark, 9) == bm25(state.items(), asked, 9)
    for kind in ("word", "stem"):
        assert len({tuple(sorted(map(tuple, x.lexicon(kind).collect()))) for x in (again, rebuilt, merged)}) == 1
    assert (again.items, again.docs, again.word_count) == (rebuilt.items, rebuilt.docs, rebuilt.word_count)

    cosine = lambda x: sorted(map(tuple, search.semantic_topk(x, search.query_vectors(x, queries(spark), "q", "text"), "q", 6).collect()))
    assert cosine(merged) == cosine(rebuilt) != []
    assert found(index, spark, 7) == bm25(rows, asked, 7)  # an opened version stays as it was
    assert segments.open_index(spark, index.path).version == 3
    with pytest.raises(Exception):  # another writer was first
        segments.update(index, frame(spark, [(1, "late")]), "ref", F.col("text"))


def test_an_update_writes_in_proportion(spark):
    index = segments.build(frame(spark, texts(2000, 3)), "ref", F.col("text"), fresh_path(spark, "index"))
    after = segments.update(index, frame(spark, texts(4, 4)), "ref", F.col("text"))
    rows = [sum(s.read(t).count() for t in segments.TABLES if t != "changes") for s in after.segments]
    assert rows[1] < rows[0] / 100


def test_empty_index(spark):
    index = segments.build(frame(spark, []), "ref", F.col("text"), fresh_path(spark, "index"))
    assert found(index, spark, 5) == []
    after = segments.update(index, frame(spark, [(1, "common w1")]), "ref", F.col("text"))
    assert {r[1] for r in found(after, spark, 5)} == {1}


def test_rows_before_the_cut_are_bounded_by_shards(spark):
    rows = texts(1500, 5)
    index = segments.build(frame(spark, rows), "ref", F.col("text"), fresh_path(spark, "index"), shard_items=300)
    asked = queries(spark).select("q", F.explode(F.split("text", " ")).alias("term"), F.lit(1.0).alias("weight")).distinct()
    handed = ranked.block_topk(index.parts("lexical", "len"), asked, "q", "ref", 10, search.share)
    assert 0 < handed.count() <= 10 * sum(index.shards) * 12  # "common" is in all 1500


def test_bounds_leave_postings_unread():
    rng = np.random.default_rng(2)
    n = 32 * 256
    size, live = np.sort(rng.integers(20, 400, n)).astype(float), rng.random(n) > 0.1
    measure = lambda v, s: v / (v + 0.01 * s)
    terms, query = {}, []
    for t, share in (("all", 1.0), ("often", 0.3), ("rare", 0.004), ("rarer", 0.002)):
        pos = np.flatnonzero(rng.random(n) < share)
        value = rng.integers(1, 9, len(pos)).astype(float)
        block, first, counts = np.unique(pos // ranked.BLOCK_ITEMS, return_index=True, return_counts=True)
        terms[t] = ranked.TermBlocks(pos, value, block, counts, np.maximum.reduceat(value, first), np.minimum.reduceat(size[pos], first), measure)
        query.append((t, -math.log(share) + 1e-6))
    full = np.zeros(n)
    for t, w in query:
        full[terms[t].pos] += w * measure(terms[t].value, size[terms[t].pos])
    full[~live] = 0
    at, scores, read = ranked.shard_topk(terms, query, size, live, 10)
    best = np.argsort(-full, kind="stable")[:10]
    assert set(best) <= set(at) and np.allclose(np.sort(scores)[::-1][:10], full[best])
    assert read < 0.2 * sum(len(t.pos) for t in terms.values())


def test_an_index_without_blocks_reads_the_postings_of_asked_terms(spark, monkeypatch):
    import os

    rows = texts(400, 6) + [(900, ""), (901, None)]
    asked = [tuple(r) for r in queries(spark).collect()]
    monkeypatch.setattr(segments, "_write_blocks", None)
    index = segments.build(frame(spark, rows), "ref", F.col("text"), fresh_path(spark, "index"), shard_items=90, blocks=False)
    assert found(index, spark, 7) == bm25(rows, asked, 7)
    assert not {"lexical", "semantic"} & set(os.listdir(index.segments[0].folder))
    changed = {3: "common w5 w5", 402: "w7 common"}
    after = segments.update(index, frame(spark, list(changed.items())), "ref", F.col("text"), frame(spark, [(0, "")]))
    now = {**dict(rows), **changed}
    del now[0]
    assert found(after, spark, 7) == bm25(list(now.items()), asked, 7)


def test_registered_searches_write_no_blocks(spark):
    import os

    from conftest import SF

    from strataframe.plans import retrieving

    retrieving.j15(spark, SF).count()
    for kind in ("word", "stem"):
        assert not {"lexical", "semantic"} & set(os.listdir(retrieving.indexed(spark, SF, kind).segments[0].folder))
