"""The training-data operators against libraries, brute force, exact round trips and held-out labels."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataframe.llm import (
    bpe, bytecnn, chat, idstore, labelled, matroska, packing, queries, shingles, tokengroups, toxicity, vamana, wrappers)
from strataframe.llm.chunked import ChunkEncoder
from strataframe.session import fresh_path

LONG = " ".join(f"w{i % 997} and{i % 13}," for i in range(30_000))
ROWS = [(1, "The cat sat on the mat. The end!"), (None, "no id here at all"), (2, None), (3, ""), (4, LONG), (5, "same text twice over"),
        (5, "same text twice over"), (6, " \t\n  "), (7, "Ünïcode 日本語 🙂 <|endoftext|> a\x1cb  c"), (8, "same text twice over")]
CLASH = ["score", "sig", "token", "gid", "h", "r", "y", "n", "ids", "start", "length", "host", "q", "point", "root", "kept_id"]


def frame(spark, rows=ROWS, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def key(r):
    return tuple((x is not None, x) for x in r)


ODD = [t or "" for _, t in ROWS] + ["a   b\n\n  c\t d  ", "ΣΑΣ İstanbul", "aaaa abab's !!! 42²½", "Don't  we'll </s>", "é ́x", "x​y﻿z"]


@pytest.mark.parametrize("name, spaces", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_ids_are_the_librarys(name, spaces):
    lib, own = library(name), ChunkEncoder(public_tokenizers.path(name), spaces, limit=5)
    for _ in range(2):
        for text, raw in zip(ODD, own.encode(ODD)):
            assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bpe_is_the_librarys(spark):
    lib = library("word_bpe_49k.json")
    codec = bpe.WordCodec(queries.WORDS)
    for text, (ids, decoded) in zip(ODD, codec.both(ODD)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == lib.decode(want, skip_special_tokens=False)
    got = sorted(map(tuple, bpe.encode_digests(frame(spark), queries.WORDS).collect()), key=key)
    want = []
    for i, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert bpe.encode_digests(frame(spark, []), queries.WORDS).collect() == []


def test_matroska_round_trip_and_lacing(spark):
    for n in (1, 5, 192 * 9, 192 * 3000):
        payload, _ = matroska.payload_of("x" * n)
        rows = matroska.packets(data := matroska.write_file(payload))
        assert b"".join(data[r[2] : r[2] + r[3]] for r in rows) == payload and all(r[5] for r in rows)
        assert [r[1] for r in rows] == [k * 24_000_000 for k in range(len(rows))]
    for kind in (matroska.XIPH, matroska.EBML_LACING):
        frames = [b"a" * 300, b"b" * 7, b"c" * 20_000, b"d" * 255]
        block = b"\x81" + struct.pack(">hB", -5, kind << 1) + matroska.laced(frames, kind)
        _, relative, _, found = matroska.block_frames(block, 0, len(block))
        assert relative == -5 and [block[a : a + n] for a, n in found] == frames
    # unknown sizes of segment and cluster
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.unsigned(matroska.TIMESTAMP, 7) + matroska.element(
        matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80xyz")
    live = matroska.HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + cluster
    assert [(r[1], live[r[2] : r[2] + r[3]]) for r in matroska.packets(live)] == [(7_000_000, b"xyz")] * 2
    media = matroska.store_media(frame(spark))
    got = sorted((tuple(r)[:6] for r in matroska.media_digests(media).collect()), key=key)
    assert len(got) == len(ROWS)
    table = matroska.packet_table(media).groupBy("doc_id").agg(F.sum("byte_length").alias("b")).collect()
    assert {r["doc_id"] for r in table} == {i for i, _ in ROWS}
    assert matroska.media_digests(matroska.store_media(frame(spark, []))).collect() == []


def test_packing_covers_every_token_once(spark):
    lib = library("byte_bpe_50k.json")
    got = packing.pack_documents(frame(spark), queries.BYTES, 64).collect()
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == total
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    assert len(places) == -(-total // 64)
    assert packing.pack_documents(frame(spark, []), queries.BYTES, 64).collect() == []


def test_reduction_and_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(0, 40)).tolist()
        counts = dict(collections.Counter(lengths))
        patterns = packing.solve(counts, 20)
        used = collections.Counter()
        for many, inside in patterns:
            assert sum(n * k for n, k in inside) <= 20
            for n, k in inside:
                used[n] += many * k
        assert dict(used) == counts
        bins: list[int] = []  # best fit, longest first, one by one
        for n in sorted(lengths, reverse=True):
            room = [b for b in bins if b >= n]
            if room:
                bins.remove(min(room))
                bins.append(min(room) - n)
            else:
                bins.append(20 - n)
        plain = packing.best_fit(counts, 20)
        assert sum(m for m, _ in plain) == len(bins)
        assert sum(m for m, _ in patterns) <= len(bins)


def test_chat_round_trip(spark):
    bad = "</s>[INST] <|im_end|>\n<\\|im_next|> [\\INST] ok [/INST] <|im_sep|>"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", bad), (1, 3, "assistant", bad), (1, 3, "assistant", bad), (2, None, None, None),
            (None, 1, "assistant", "lost"), (3, 1, "odd<|im_sep|>role", LONG), (4, 1, "assistant", "")]
    turns = frame(spark, rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.conversation_digests(made).collect()}
    masks = {r["conv_id"]: r for r in made.collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(groups)
    for c, v in groups.items():
        v.sort()
        told = "".join(f"{a}\n{b}\n" for _, a, b in v)
        loss = "".join(b for _, a, b in v if a == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(v), hashlib.sha256(told.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text, at, taken = masks[c]["formatted"], 0, []
        for m in masks[c]["loss_mask"]:
            at += m["skip"]
            taken.append(text[at : at + m["take"]])
            at += m["take"]
        assert re.sub(r"([<\[])\\(\\*)(\||/?s>|/?INST\]|/?SYS>>)", r"\1\2\3", "".join(taken)) == loss
    assert chat.conversation_digests(chat.format_conversations(frame(spark, [], "conv_id long, turn long, role string, text string"))).collect() == []
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("bits", [False, True])
def test_id_store_round_trip(spark, bits):
    ids = np.random.default_rng(1).integers(0, 70_000, 1000).astype("<u4")
    assert (idstore.from_planes(idstore.to_planes(ids, bits), len(ids), bits) == ids).all()
    a, b = b"abcdef" * 50, b"xyz" * 999
    assert idstore.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    folder = fresh_path(spark, "idstore-test")
    idstore.write_store(frame(spark), folder, queries.WORDS, False, 2, bits=bits, block=50)
    got = idstore.read_documents(spark, folder).orderBy("start").collect()
    lib = library("word_bpe_49k.json")
    want = collections.Counter()
    for i, t in ROWS:
        x = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[(i, len(x), zlib.crc32(x.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    named = [r["doc_id"] for r in got]
    assert named == sorted(named, key=lambda i: (i is not None, i))


def test_id_store_of_nothing(spark):
    folder = fresh_path(spark, "idstore-test")
    idstore.write_store(frame(spark, []), folder, queries.WORDS, False, 2)
    assert idstore.read_documents(spark, folder).collect() == []


def plain_sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(rows, k, percent):
    sets = [plain_sets(t, k) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    least = {}
    for (d, _), g in zip(rows, label):
        least[g] = min(least.get(g, d), d, key=lambda x: (x is None, x or 0))
    return collections.Counter((d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, label))


def near_rows(n=260):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for i in range(n):
        w = list(base) if i % 2 else [f"r{i}x{j}" for j in range(60)]
        for j in rng.integers(0, len(w), i % 7):
            w[j] = f"e{i}x{j}"
        rows.append((1000 + i, " ".join(w) + (" " + passage if i % 2 == 0 else "")))
    return rows


@pytest.mark.parametrize("k, percent, cell", [(3, 90, 48), (5, 80, 4)])
def test_similarity_join_is_exact(spark, monkeypatch, k, percent, cell):
    monkeypatch.setattr(tokengroups, "CELL", cell)
    rows = [r for r in ROWS if r[0] != 4] + [(9, "The  CAT sat on the mat. the end!"), (10, "two words"), (11, "Two words")] + near_rows()
    got = tokengroups.similar_components(frame(spark, rows), k, percent).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, k, percent)


def test_common_lines_make_no_candidates(spark, monkeypatch):
    rng = np.random.default_rng(11)
    lines = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(1500)]
    rows = [(i, " ".join(lines[k] for k in rng.choice(1500, 10, replace=False))) for i in range(400)]
    rows += [(1000 + i, t + f" extra{i}") for i, t in rows[:20]]
    asked, settle = {}, tokengroups.settle

    def counted(df, label):
        out = settle(df, label)
        asked[label] = out.count()
        return out

    monkeypatch.setattr(tokengroups, "settle", counted)
    got = tokengroups.similar_components(frame(spark, rows), 3, 90).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 3, 90)
    assert asked["pairs"] <= 40


@pytest.mark.parametrize("percent", [90, 80])
def test_sets_that_link_share_a_part(percent):
    rng, linked, thin = np.random.default_rng(3), 0, 0
    for k in range(4000):
        n, top = int(np.exp(rng.uniform(0.5, 5.5))), 1 << (60 if k % 3 == 0 else 63)  # few high bits: many parts stay empty
        new = lambda n: rng.integers(0, top, n, dtype=np.uint64) * np.uint64(2)
        a = np.unique(new(n))
        b = np.unique(np.concatenate((rng.permutation(a)[rng.integers(0, n // 10 + 2) :], new(rng.integers(0, n // 10 + 2)))))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= percent * (len(a) + len(b) - common) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(tokengroups.all_part_keys(a, percent), tokengroups.all_part_keys(b, percent)))
            linked += 1
            thin += k % 3 == 0
    assert linked > 500 and thin > 100


def test_groups_of_one_id_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(tokengroups, "CELL", 4)
    monkeypatch.setattr(tokengroups.F, "hash", lambda *c: F.lit(7))
    rows = near_rows(60)
    got = tokengroups.similar_components(frame(spark, rows), 3, 90).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 3, 90)


def test_similarity_join_of_nothing(spark):
    assert tokengroups.similar_components(frame(spark, [])).collect() == []
    got = tokengroups.similar_components(frame(spark, [(1, None), (2, ""), (2, "")])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_shingle_counts():
    texts = [t or "" for _, t in ROWS] + ["x" * 5000 + " y z", "a a a a a"]
    assert [len(s) for s in shingles.shingle_sets(texts, 3)] == [len(plain_sets(t, 3)) for t in texts]


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    many = [(i, rng.normal(size=8).round(3).tolist()) for i in range(3000)]
    odd = [(5000, None), (5100, [0.0] * 8), (5200, [1.0, None] + [0.0] * 6), (5300, [float("nan")] + [1.0] * 7), (None, [1.0] * 8),
           (5400, [3.0, 4.0]), (5500, [3.0, 5.0])] + [(6000 + i, [9.0] * 8) for i in range(40)]
    df = frame(spark, many + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vamana.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: np.array(v, np.float32).astype(float) for i, v in many + odd[7:]}
    ids = np.array(sorted(fine))
    m = np.stack([fine[i] for i in ids])
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - fine[q]) ** 2).sum(axis=1))
        want = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        hit += len(set(want) & {i for _, i, _ in rows})
        total += 10
    assert hit / total >= 0.9
    assert [i for _, i, _ in sorted(got[6000])] == list(range(6001, 6011))
    assert [(i, s) for _, i, s in got[5400]] == [(5500, 1.0)] and 5000 not in got and 5100 not in got
    assert vamana.nearest(frame(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("kind", ["plain", "large", "small", "shifted", "clusters"])
def test_graph_search_on_odd_clouds(kind):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 16))
    if kind == "clusters":
        points = np.repeat(rng.normal(size=(50, 16)) * 1e4, 30, axis=0) + rng.normal(size=(1500, 16)) * 1e-2
    points = {"large": points * 1e20, "small": points * 1e-25, "shifted": points + 1e6}.get(kind, points)
    seen = vamana.centred(points, points)
    graph, starts = vamana.build_graph(seen)
    asked = np.arange(0, 1500, 10)
    found, _ = vamana.beam_search(seen, graph, starts, seen[asked], vamana.SEARCH_BEAM)
    hits = 0
    for q, row in zip(asked, found):
        want = np.argsort(((points - points[q]) ** 2).sum(axis=1), kind="stable")[:11]
        hits += len(set(want) & set(row[:11]))
    assert hits / (11 * len(asked)) >= 0.95


@pytest.mark.parametrize("page, want", [
    ("<p data-x=it's>First</p><p>Second para that's long</p><p>Third</p>", "First Second para that's long Third"),
    ("<p data-x=it's>First</p><p>Second</p>", "First Second"), ("<p title='a > b' x=\"c>d\">One</p>", "One"),
    ("<p>a</p><script src=\"a\"/>var a=1;</script><p>b</p>", "a b"), ("<p>a</p><!--><p>b</p>", "a b"),
    ("<p>a</p><!---><p>b</p>", "a b"), ("<p>a</p><!-- x --!><p>b</p>", "a b"), ("<p>a <b class=x/>c</b></p>", "a c"),
    ("<p>a</p><script>for(i=0;i<n;i++){}</script><p>b</p>", "a b"), ("<p>a</p><br/><p>1 < 2</p>", "a 1 < 2")])
def test_tokens_follow_the_rules_of_html(page, want):
    assert wrappers.extract(page) == want


def test_wrappers(spark):
    def page(body):
        return f"<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>{body}<footer>f</footer></body></html>"

    rows = [(1, "http://a.example/1", page("<article><h1>One</h1><p>x &amp; y<p>z<br>w</article>")),
            (2, "http://a.example/2", page("<article><h1>Two</h1><p>only  this</p><div class=comments>nice</div></article>")),
            (3, "http://b.example/1", None), (4, None, "plain"), (5, "http://a.example/3", ""), (2, "http://a.example/2", "<p>odd"),
            (6, "http://c.example/", page("<div class='content'><p>" + LONG + "</p></div><script>var a = '<p>no</p>'</script>")),
            (None, "http://a.example/9", page("<article><ul><li>a<li>b</ul></article>"))]
    got = collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in
                              wrappers.extract_main(frame(spark, rows, "page_id long, url string, html string")).collect())
    want = [(1, "One x & y z w"), (2, "Two only this"), (3, ""), (4, "plain"), (5, ""), (2, "odd"), (6, LONG), (None, "a b")]
    assert got == collections.Counter((i, t, len(t)) for i, t in want)
    assert wrappers.extract_main(frame(spark, [], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("code", [
    "<script>for(i=0;i<n;i++){}</script>", "<script>if (a<b) x = '<!-- '</script>", "<style>a<b <!-- </style >", "<textarea><b x='</textarea>",
    "<SCRIPT>'</scripted>' <p</Script\n>"])
def test_tags_in_code_are_no_tags(code):
    page = f"<html><body>{code}<article><h1>One</h1><p>a &lt; b</p></article>{code}</body></html>"
    assert wrappers.extract(page) == "One a < b"


WORDY = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("body, want", [
    (f"<article class=teaser>short</article><div class=text><p>{WORDY}</p></div>", f"short {WORDY}"),
    (f"<article class=a><p>{WORDY}</p></article><article class=b><p>the other one</p></article>", f"{WORDY} the other one"),
    (f"<div class=content-intro><p>{WORDY}</p></div>" + f"<div class=section><p>{WORDY}</p></div>" * 2, " ".join([WORDY] * 3)),
    (f"<div><h1>T</h1><div class=content>{WORDY}</div></div>", f"T {WORDY}"),
    (f"<div><div class=content><p>{WORDY}</p></div><span>by</span></div>", WORDY)])
def test_region_keeps_the_whole_article(body, want):
    assert wrappers.extract(f"<html><body><nav>menu</nav>{body}<footer>f</footer></body></html>") == want


@pytest.mark.parametrize("n", [250, 20_000])
def test_depth_has_no_limit(n):
    deep = "<div>" * n + "<script>if (a<b) x()</script><nav>menu</nav><p>in</p>" + "</div>" * n
    page = f"<html><body><article><p>{WORDY}</p>{deep}<p>after</p></article><footer>f</footer></body></html>"
    assert wrappers.extract(page) == f"{WORDY} in after"
    assert wrappers.infer([page])[0] == ""


def test_wrappers_come_from_all_pages(spark):
    rows = [(f"http://h.example/{i}", f"<title>t{i}</title><body><article><h1>h{i}</h1><p>x{i}</p></article></body>") for i in range(60)]
    rows += [(f"http://h.example/b{i}", f"<title>b{i}</title><body><div><main><em>{'all' * (i < 3)}{i}</em></main></div></body>") for i in range(3)]
    rows += [(f"http://h.example/{60 + i}", f"<title>u{i}</title><body><article><h1>h</h1><p>x</p><hr></article></body>") for i in range(2)]
    pages = frame(spark, rows, "url string, html string").repartition(7)
    got = {r["layout"]: wrappers.read_wrapper(r["wrapper"]) for r in wrappers.infer_wrappers(pages).collect()}
    kinds = sorted(tuple(n[0] for n in wrappers.nodes_of(w) if n[0] not in ("#", "", "title", "body")) for w in got.values())
    assert kinds == [("article", "hr", "p", "h1"), ("div", "main", "em")]
    deep = wrappers.infer(["<b><i>x</i>" * 5000, "<b><i>y</i>" * 5000])
    assert wrappers.write_wrapper(wrappers.read_wrapper(wrappers.write_wrapper(deep))) == wrappers.write_wrapper(deep)


@pytest.mark.parametrize("mark", ["class='article-body no-sidebar'", "class='ad-free'", "id='legal-analysis'", "class=related", "id=tags"])
def test_words_in_names_do_not_drop_the_article(mark):
    page = f"<body><nav>menu</nav><div {mark}><p>{WORDY}</p></div><div class=comments>nice</div></body>"
    assert wrappers.extract(page) == WORDY
    assert wrappers.extract(f"<body><article><div {mark}><p>{WORDY}</p></div><div class=ad>buy</div></article></body>") == WORDY
    assert wrappers.extract("<body><div class=ad>longer than the article</div><article>short</article></body>") == "short"


def test_constant_texts_are_template(spark):
    def page(title, text, note="call us, we are open all week long"):
        return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><div class=box9>{note}</div><p>{text}</p><p>end</p></article></body></html>"

    rows = [(i, f"http://h.example/{i}", page(f"t{i}", f"about {i}")) for i in range(5)]
    rows += [(10 + i, f"http://copies.example/{i}", page("same", "same")) for i in range(5)]
    rows += [(20 + i, f"http://two.example/{i}", page(f"t{i}", f"about {i}")) for i in range(2)]
    rows += [(30 + i, f"http://h.example/x{i}", f"<title>x{i}</title><body><main><p>one{i}</p></main><div><i>bottom line</i></div></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main(frame(spark, rows, "page_id long, url string, html string").repartition(5)).collect()}
    note = "call us, we are open all week long"
    assert got == {**{i: f"t{i} about {i} end" for i in range(5)}, **{10 + i: f"same {note} same end" for i in range(5)},
                   **{20 + i: f"t{i} {note} about {i} end" for i in range(2)}, **{30 + i: f"one{i}" for i in range(3)}}


def test_loss_digest_is_of_the_text_under_the_mask(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"é{k} </s> \U0001f600" * (1 + k % 3 * 400)) for k in range(700)]
    made = chat.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    right = "".join(t for _, k, _, t in rows if k % 2)
    (got,) = chat.conversation_digests(made).collect()
    assert (got["loss_chars"], got["loss_sha256"]) == (len(right), hashlib.sha256(right.encode()).hexdigest())
    shift = F.transform("loss_mask", lambda m, i: F.struct((m["skip"] - F.when(i == 0, 1).otherwise(0)).alias("skip"), m["take"].alias("take")))
    (wrong,) = chat.conversation_digests(made.withColumn("loss_mask", shift)).collect()
    assert wrong["loss_sha256"] != got["loss_sha256"] and wrong["turns_sha256"] == got["turns_sha256"]


def test_wrapper_folds_and_options():
    w = wrappers.infer(["<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><h1>b</h1><p>z</p><em>q</em></div>"])
    (div,) = w[1]
    assert [(wrappers.key(p), p[1], p[2]) for p in div[0][0][1]] == [(("h1",), False, False), (("p",), False, True), (("em",), True, False)]


def test_pages_query_reads_articles(spark):
    import html

    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op5_wrappers"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:br|p|h1)>", "\x01", inner)).split("\x01")
        assert got[r["page_id"]] == " ".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    y = np.array(labels, bool)
    return (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize("name, target, least", [("op1_toxicity", "toxic", 0.9), ("op10_bytecnn", "quality", 0.97)])
def test_classifiers_on_held_out_labels(spark, name, target, least):
    folder = SF.replace("0.001", "0.01")
    label = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES[name](spark, folder).collect() if r["held_out"] and r["doc_id"] in label]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert auc(np.array([r["score"] for r in rows]), [label[r["doc_id"]] for r in rows]) >= least


def test_classifiers_take_odd_rows(spark):
    docs, none = frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, bytecnn):
        model = module.fit_from(docs, none, F.lit(True))
        rows = module.score_documents(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score_documents(frame(spark, []), model).collect() == []
    votes = np.array([[1, 1, 1]] * 5 + [[0, toxicity.ABSTAINS, 0]] * 20)
    shouted = toxicity.label_model(votes, np.ones(25)).posterior(votes)
    assert shouted[:5].min() > 0.8 and shouted[5:].max() < 0.2


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, toxic = docs, None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, rows, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "near_duplicates":
            before = sorted(kept["quality"].items())
            groups = collections.defaultdict(set)
            for (d, n, c), _ in plain_components(before, 5, 80).items():
                groups[c].add(d)
            assert set(kept[name]) == {min(g) for g in groups.values()}
        rows = out
    assert {r["doc_id"] for r in rows.collect()} == set(kept["near_duplicates"])
    few = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (None, "x y"), (None, "x y"), (4, "")])
    out = corpus_pipeline.keep_one(spark, few, SF)
    assert out.columns == few.columns
    assert sorted(map(lambda r: (r["doc_id"] or 0, r["text"]), out.collect()), key=str) == sorted(
        [(1, "a b c d e f"), (3, None), (0, "x y"), (4, "")], key=str)


def planted_votes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Voters of known accuracy that are silent on a third of the texts; the last repeats the one before it, mostly."""
    rng = np.random.default_rng(seed)
    y, right = (rng.random(n) < 0.3).astype(int), [0.92, 0.85, 0.8, 0.75, 0.7, 0.65]
    votes = np.array([np.where(rng.random(n) < 1 / 3, toxicity.ABSTAINS, np.where(rng.random(n) < r, y, 1 - y)) for r in right])
    echo = np.where(rng.random(n) < 0.9, votes[-1], rng.integers(0, 3, n))
    return y, np.vstack([votes, echo]).T, right


def test_label_model_finds_planted_accuracies_and_the_echo():
    y, votes, right = planted_votes(8000, 5)
    model = toxicity.label_model(votes, np.ones(len(y)))
    assert np.abs(model.accuracy(votes, np.ones(len(y)))[:, :-1] - right).max() < 0.06
    assert abs(model.prior - 0.3) < 0.04
    assert model.parent[-1] == len(right) - 1 or model.parent[-2] == len(right)
    assert (model.parent[: len(right) - 1] == -1).all()
    post = model.posterior(votes)
    wrong = ((post > 0.5) != y).mean()
    assert wrong < min((np.where(v == toxicity.ABSTAINS, 0, v) != y).mean() for v in votes.T)


def test_posterior_without_the_label_beats_every_voter():
    import duckdb

    folder = SF.replace("0.001", "0.01")
    rows = duckdb.sql(f"""SELECT text, toxic FROM '{folder}/labels.parquet' JOIN '{folder}/documents.parquet' USING (doc_id)
        WHERE text IS NOT NULL AND toxic IS NOT NULL ORDER BY doc_id""").fetchall()
    texts, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    names, shown = toxicity.indexed(texts, y)
    votes = toxicity.ballots(texts, names, shown, toxicity.voting(names, shown, y), y)
    last = votes.shape[1] - 1
    assert (votes[:, -2 - len(toxicity.PATTERNS):-2] == 1).any(axis=0).sum() >= 2  # patterns vote on real rows
    post = toxicity.label_model(votes, np.ones(len(y)), apart=(last,)).posterior(votes, np.arange(last))
    best = min(((votes[:, j] == 1) != y).sum() for j in range(last))
    assert ((post > 0.5) != y).sum() < best


def test_toxicity_scores_equal_a_plain_scorer():
    rng = np.random.default_rng(3)
    words = ["trash", "trashy", "stupid", "stupidity", "well", "Idiot", "réeux", "réeuxment", "a1b", "don't"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(300)] + [None, "", LONG]
    model = toxicity.Classifier({" trash ": 2.0, " stup": 1.5, " stupid ": -0.5, " idiot ": 3.0, " réeux": 0.7, " trash": -0.2}, -1.0)
    plain = []
    for t in texts:
        keys = toxicity.keys_of(toxicity.words_of(t or ""))
        plain.append(1 / (1 + np.exp(-(sum(w for k, w in model.weight.items() if k in keys) + model.shift))))
    assert np.allclose(toxicity.score(model, model.automaton(), texts), plain)


def test_sample_takes_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {i:04d}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    texts, ys, _ = labelled.sample(docs, labels, "quality", F.lit(True), 10)
    assert (texts, ys) == (["text 0000", "other"], [1, 0])


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_full_store_keeps_the_chunks_that_are_met_again(name, spaces):
    own = ChunkEncoder(public_tokenizers.path(name), spaces, limit=3)
    text = "one two, three don't four2 five. one"
    ids = own.encode([text])
    assert ids == [np.array(own.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]
    own.library = None  # every chunk is known
    assert own.encode([text, "one two, three"])[0] == own.encode([text])[0] == ids[0]
