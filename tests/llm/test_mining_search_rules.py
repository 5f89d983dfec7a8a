"""Hard negatives, ranked lexical search and URL rules against brute force, and the three queries against their SQL."""

import math
import random
import re

import numpy as np
import pytest
from compare import compare
from conftest import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strataframe.llm import hardnegatives, lexicalscan, queries, urlrules

CLASH = ["label_", "dim", "v", "score", "rank", "term", "n", "block", "hits", "host", "path", "verdict", "anchor_block", "other_id"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_strassen_is_the_product():
    rng = np.random.default_rng(1)
    for shape in [(1, 1, 1), (64, 64, 64), (65, 33, 129), (200, 64, 300), (3, 100, 500), (128, 1, 128), (5, 0, 4)]:
        a, b = (rng.integers(-300, 300, s) for s in (shape[:2], shape[1:]))
        assert (hardnegatives.strassen(a, b, leaf=4) == a @ b).all()
    a, b = np.full((64, 64), 2**27), np.full((64, 64), 2**27)  # sums between pass 64 bits, results do not
    assert (hardnegatives.strassen(a, b, leaf=4) == 2**60).all()


def mined(rows, k=5, n=3):
    """Every pair, one after the other."""
    kept = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            new = (label, [math.floor(256 * c) for c in x])
            kept[i] = min(kept.get(i, new), new)
    out = []
    for a, (own, va) in kept.items():
        if a % 5:
            continue
        seen = sorted((-sum(p * q for p, q in zip(va, v)), i, label) for i, (label, v) in kept.items() if i != a and len(v) == len(va))
        for s, p, _ in [x for x in seen if x[2] == own][:k]:
            window = [x for x in seen if x[2] != own and 50 * -s <= 100 * -x[0] <= 95 * -s][:n]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(window)]
    return sorted(out)


def test_mining_is_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0, 0.001]) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for i in range(160)]
    rows += [(i, [0.5] * 6, 1) for i in range(200, 240)]  # equal vectors
    rows += [rows[5], rows[5], (10, [0.25] * 6, 2), (300, [1.0, 1.0], 0), (305, [1.0, 0.5], 0), (306, [0.9, 0.5], 1), (310, [], 0), (311, [], 1), (312, [], 0)]
    rows += [(None, [0.5] * 6, 0), (400, None, 0), (405, [0.5, None, 0.5, 0.5, 0.5, 0.5], 0), (410, [float("nan")] * 6, 0),
             (415, [float("inf")] * 6, 0), (420, [0.5] * 6, None), (425, [-0.5] * 6, 7)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = mined(rows)
    assert len(want) > 200
    for anchors, candidates in ((1024, 4096), (7, 16)):
        monkeypatch.setattr(hardnegatives, "ANCHOR_ROWS", anchors)
        monkeypatch.setattr(hardnegatives, "CANDIDATE_ROWS", candidates)
        got = hardnegatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label"))
        assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert hardnegatives.mine(empty, F.col("vec_id") % 5 == 0, F.col("label")).collect() == []
    with pytest.raises(PySparkException):
        hardnegatives.mine(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<double>, label int"),
                           F.col("vec_id") == 0, F.col("label")).collect()


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def searched(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(TERM.findall(t.translate(LOWER)))
    out = []
    for item, words in asked.items():
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in t for _, t in terms) + 1))) for w in words}
        scored = []
        for i, t in terms:
            if i is not None and t:
                m = 10 + 90 * len(t) * n_docs // total
                scored.append((-sum(w * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x, w in weight.items()), i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out)


DOCS = [(1, "The cat, the CAT! a cat-like thing"), (2, "ÉTÉ été x²y 日本 語 cat"), (3, None), (4, ""), (None, "cat dog"), (5, "dog dog dog"),
        (6, "dog dog dog"), (6, "dog dog dog"), (7, " \t,.!"), (8, "bird " * 70_000 + "cat"), (9, "end"), (10, "catx xcat ca t a1 1a"), (11, "a\x00cat\x7fdog")]
ITEMS = [(1, "Cat the"), (2, "dog, DOG dog"), (3, None), (4, ""), (None, "cat"), (5, "été 日本"), (6, "nowhere"), (7, "bird end a1"), (2, "cat"), (8, "x²y a")]


@pytest.mark.parametrize("per_block", [2000, 1, 3])
def test_search_is_brute_force(spark, per_block):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["été", "Dog", "cat"]
    docs = DOCS + [(100 + k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)]
    items = ITEMS + [(20 + k, " ".join(rng.choices(words, k=6))) for k in range(8)]
    found = lexicalscan.search(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)),
                               clashing(spark.createDataFrame(items, "item_id long, text string")), k=4, items_per_block=per_block)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == searched(docs, items, 4)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexicalscan.search(docs.limit(0), items).collect() == [] == lexicalscan.search(docs, items.limit(0)).collect()
    assert lexicalscan.search(docs.where("doc_id = 7"), items).collect() == []


def test_scores_beyond_doubles_are_added_as_integers():
    where, first, many = np.array([0, 0, 1]), np.array([0, 2, 0]), np.array([2, 1, 2])
    holders, value = np.array([0, 1, 1]), np.array([2**53, 1, 5])
    both = [lexicalscan.item_scores(2, 2, where, holders, first, many, value, x) for x in (True, False)]
    assert both[1].tolist() == [[2**53, 2**53 + 1], [5, 5]] and both[0][1].tolist() == [5, 5]


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


def judged(pages, rules, default):
    out = []
    for i, url in pages:
        host, path = split_url(url)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
                if None not in (h, p, v) and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out.append((i, host, path, best[2], best[3]))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


URLS = [None, "", "no scheme", "http://", "http://org", "http://a.ORG/es?x", "https://example.org/en/1#t", "http://x.example.org/en/12/3", "http://xexample.org/en/1",
        "a://b.com/fr/é?q=://c", "http://com/fr/", "http://u@com/fr/", "http://..com/de/x", "http://com/de/" + "z" * 50_000, "http://" + "a." * 20_000 + "org/",
        "http://org/ a\nb", "http://example.org/es/", "http://example.org/es"]


def test_rules_are_brute_force(spark):
    rng = random.Random(9)
    names, parts = ["a", "b", "org", "com", "x-y"], ["", "/", "/e", "/e/1", "/é/", "/e/12"]
    make = lambda: (".".join(rng.choices(names, k=rng.randint(1, 4))), rng.choice(parts))
    rules = [(*make(), rng.choice(["allow", "block"])) for _ in range(120)] + [("org", None, "block"), (None, "/", "block"), ("", "/", "block"), ("a.org", "/", None)]
    pages = list(enumerate(URLS)) + [(100 + k, "http://" + "".join(make()) + rng.choice(["", "/x", "1", "?q", "#f"])) for k in range(900)]
    pages += [(None, "http://org/"), (100, "http://a.org/e"), (100, "http://a.org/e")]
    frame = clashing(spark.createDataFrame(pages, "page_id long, url string"))
    listed = spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("own_host", F.lit("clash"))
    for most in (1 << 10, 1):  # one block: many false hits for the join to remove
        got = urlrules.judge(frame, listed, default="review", most_blocks=most)
        assert sorted(map(tuple, got.collect()), key=lambda r: tuple((x is not None, x) for x in r)) == judged(pages, rules, "review")
    assert urlrules.judge(frame.limit(0), listed).collect() == []
    assert {r["verdict"] for r in urlrules.judge(frame, listed.limit(0)).collect()} == {"allow"}


def test_the_filter_lets_listed_keys_pass_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id")).alias("host"))
    found = urlrules.build_filter(keys)
    tried = spark.range(40_000).select("id", urlrules.passes(found, F.concat(F.lit("h"), F.col("id"))).alias("hit"))
    n = {r["listed"]: r["n"] for r in tried.where("hit").groupBy((F.col("id") < 20_000).alias("listed")).agg(F.count("*").alias("n")).collect()}
    assert n[True] == 20_000 and n.get(False, 0) < 200
