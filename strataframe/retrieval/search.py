"""Ranking: BM25, cosine, rank fusion, reranking, near-duplicate removal, and the whole search."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.numeric import round_half_up
from strataframe.functions.text import query_tokens, snippet, words
from strataframe.operators.filters import retrieval_filter
from strataframe.operators.topk import topk
from strataframe.retrieval.index import QUERY_TOP_TERMS, postings, tfidf
from strataframe.retrieval.ranked import block_topk
from strataframe.retrieval.segments import SearchIndex

# BM25 constants, the display scale, fusion constant and weights, rerank bonuses, thresholds.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
DISPLAY_SCALE = 8
RRF_K = 60
LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 1.0, 0.85
MIN_COSINE = 0.02
OVER_FETCH = 3
DEPTH_REACH, DEPTH_BONUS, PLACE_BONUS, BOTH_BONUS, LESSON_BONUS = 150, 0.05, 0.03, 0.02, 0.015
OVERLAP_THRESHOLD = 0.82


def query_terms(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, term): distinct index words of the cleaned query."""
    toks = F.flatten(F.transform(query_tokens(text), words))
    return queries.select(qid, F.explode(F.array_distinct(toks)).alias("term"))


def bm25_impact(value, size, avg_len: float):
    """What one occurrence count adds at weight 1; grows with the count, falls with the length."""
    return value * (K1 + 1) / (value + K1 * (1 - B + B * size / avg_len))


def lexical_topk(index: SearchIndex, terms: DataFrame, qid: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Top k items per query by BM25 with idf ln((N - n + .5) / (n + .5)) floored at 1e-6; `terms` is (qid, term).

    `raw_score` is negative and smaller is better; `score` maps it to (0, 1) for display. `allowed` (ref) restricts the
    items ranked, not the statistics.
    """
    df = index.lexicon("word").join(terms.select("term").distinct(), "term", "left_semi").select("term", "df")
    idf = F.greatest(F.lit(MIN_IDF), F.log((F.lit(float(index.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    used = terms.join(df, "term").select(qid, "term", idf.alias("weight"))
    found = block_topk(index.parts("lexical", "len", allowed), used, qid, "ref", k,
                       partial(bm25_impact, avg_len=index.avg_len), negative=True)
    ranked = topk(found.select(qid, "ref", (-F.col("score")).alias("raw_score")), [qid], ["raw_score", "ref"], k)
    return ranked.withColumn("score", 1 / (1 + F.exp(F.col("raw_score") / DISPLAY_SCALE)))


def share(value, size):
    return value / size


def semantic_topk(index: SearchIndex, queries: DataFrame, qid: str, k: int, floor: float = MIN_COSINE,
                  allowed: DataFrame | None = None) -> DataFrame:
    """Top k items per query by cosine of sparse vectors, above `floor`; `queries` is (qid, term, weight)."""
    norm = queries.groupBy(qid).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_qn"))
    used = queries.join(norm, qid).select(qid, "term", (F.col("weight") / F.col("_qn")).alias("weight"))
    found = block_topk(index.parts("semantic", "norm", allowed), used, qid, "ref", k, share, floor)
    return topk(found, [qid], ["-score", "ref"], k)


def query_vectors(index: SearchIndex, queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, term, weight) of query texts, weighted by the index's frequencies; unseen stems count as in no item."""
    unseen = F.log(F.lit(index.items + 1.0)) + 1
    posts = postings(queries, qid, F.col(text), exact_words=False)
    return tfidf(posts, index.idf(), qid, QUERY_TOP_TERMS, unseen)


def rrf(lists: dict[str, tuple[DataFrame, float]], qid: str, ref: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of named rankings {name: (frame with rank and score, weight)}.

    Keeps each retriever's rank and score and the list of retrievers that found the item.
    """
    tagged = [
        df.select(qid, ref, F.lit(name).alias("_src"), F.col("rank"), F.col("score").cast("double"),
                  (F.lit(float(weight)) / (k + F.col("rank"))).alias("_part"))
        for name, (df, weight) in lists.items()
    ]
    both = reduce(DataFrame.unionByName, tagged)
    per = [
        e for n in lists for e in (
            F.max(F.when(F.col("_src") == n, F.col("rank"))).alias(f"{n}_rank"),
            F.max(F.when(F.col("_src") == n, F.col("score"))).alias(f"{n}_score"),
        )
    ]
    return both.groupBy(qid, ref).agg(F.sum("_part").alias("fused"), *per,
                                      F.array_sort(F.collect_set("_src")).alias("sources"))


def rerank(df: DataFrame, depth: str = "depth", place: str = "place_id", kind: str = "kind",
           target_depth: Column | None = None, active_place: Column | None = None,
           ranks: tuple[str, ...] = ("lexical_rank", "semantic_rank")) -> DataFrame:
    """Fused score plus small bonuses: near in depth, same place, found by both retrievers, a lesson."""
    bonus = F.lit(0.0)
    if target_depth is not None:
        known = F.col(depth).isNotNull() & target_depth.isNotNull()
        bonus = bonus + F.when(known & (F.abs(F.col(depth) - target_depth) <= DEPTH_REACH), DEPTH_BONUS).otherwise(0.0)
        if active_place is not None:
            bonus = bonus + F.when(known & (F.col(place) == active_place), PLACE_BONUS).otherwise(0.0)
    both = reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in ranks])
    bonus = bonus + F.when(both, BOTH_BONUS).otherwise(0.0)
    bonus = bonus + F.when(F.col(kind) == "lesson", LESSON_BONUS).otherwise(0.0)
    return df.withColumn("rerank_score", F.col("fused") + bonus)


def diversify(df: DataFrame, qid: str, ref: str, kind: str, terms: str, order: list[str],
              threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Greedy removal of near copies within each query's result list; the kept hit lists the refs it stands for.

    A hit is dropped when an earlier kept hit of its kind shares `threshold` of the smaller term set. Result lists are
    short (the over-fetched top of each retriever), so one query is one small group.
    """
    out_schema = df.select("*", F.array(F.col(ref)).alias("merged_refs")).schema
    names = [o.lstrip("-") for o in order]
    ascending = [not o.startswith("-") for o in order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, object, set, list]] = []
        for i, row in pdf.sort_values(names, ascending=ascending, kind="stable").iterrows():
            own = set(row[terms]) if row[terms] is not None else set()
            home = next(
                (k for k in kept if k[1] == row[kind] and own and k[2]
                 and len(own & k[2]) / min(len(own), len(k[2])) >= threshold), None)
            if home:
                home[3].append(row[ref])
            else:
                kept.append((i, row[kind], own, [row[ref]]))
        return pdf.loc[[k[0] for k in kept]].assign(merged_refs=[k[3] for k in kept])

    return df.groupBy(qid).applyInPandas(run, out_schema)


@dataclass
class SearchSpec:
    limit: int = 20
    place: int | None = None
    kinds: list[str] = field(default_factory=list)
    depth: tuple[float | None, float | None] = (None, None)
    places: list[int] = field(default_factory=list)
    target_depth: float | None = None
    active_place: int | None = None


def hybrid_search(items: DataFrame, index: SearchIndex, queries: DataFrame, qid: str, text: str,
                  spec: SearchSpec = SearchSpec(), stems: SearchIndex | None = None) -> DataFrame:
    """Retrieve lexically and by vectors, fuse, attach items, rerank, drop near copies, cut, add snippets.

    `items` has ref, kind, place_id, title, body, depth; of it only the hits' rows, and the filter's columns, are used.
    `stems` is the index searched by vectors, if it is another one.
    """
    stems = index if stems is None else stems
    filtered = bool(spec.place is not None or spec.kinds or any(d is not None for d in spec.depth) or spec.places)
    allowed = retrieval_filter(items, spec.place, spec.kinds, spec.depth, spec.places).select("ref") if filtered else None
    fetch = spec.limit * OVER_FETCH
    lexical = lexical_topk(index, query_terms(queries, qid, text), qid, fetch * OVER_FETCH, allowed)
    semantic = semantic_topk(stems, query_vectors(stems, queries, qid, text), qid, fetch, allowed=allowed)

    fused = rrf({"lexical": (lexical, LEXICAL_WEIGHT), "semantic": (semantic, SEMANTIC_WEIGHT)}, qid, "ref")
    hits = fused.join(items, "ref")
    ranked = rerank(hits, target_depth=F.lit(spec.target_depth) if spec.target_depth is not None else None,
                    active_place=F.lit(spec.active_place) if spec.active_place is not None else None)
    terms = stems.rows("vectors").join(fused.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(
        F.collect_list("term").alias("_terms"))
    ranked = ranked.join(terms, "ref", "left").withColumn("fused", round_half_up("rerank_score", 6))
    kept = diversify(ranked.drop("rerank_score"), qid, "ref", "kind", "_terms", ["-fused", "ref"])
    top = topk(kept, [qid], ["-fused", "ref"], spec.limit)
    asked = queries.select(F.col(qid), F.col(text).alias("_query"))
    return top.join(asked, qid).select(
        qid, "rank", "ref", "kind", "place_id", "title", snippet("body", "_query").alias("snippet"), "depth", "fused",
        round_half_up("lexical_score", 4).alias("lexical_score"), "lexical_rank",
        round_half_up("semantic_score", 4).alias("semantic_score"), "semantic_rank", "sources", "merged_refs",
    )
