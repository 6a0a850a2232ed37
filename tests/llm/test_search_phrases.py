"""Lexical search, exact top-k and phrase mining on small tables with every odd case, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from kindred.llm import lexical, phrases, topk

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 6))) for _ in range(150)]


def prose(n, seed, vocabulary=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", "\t", ","]) for _ in range(n))


COMMON = prose(30, 1)
TEXTS = [(i, prose(5 + 3 * i, i)) for i in range(40)] + [(100 + i, COMMON) for i in range(60)] + [
    (200, None), (201, ""), (202, " .,\n"), (203, "Überß ÄÖ a b"), (204, "überß äö A B"), (205, prose(30_000, 5)), (206, COMMON + "\n" + prose(9, 3)),
    (207, prose(12, 4)), (207, prose(12, 4)), (None, prose(12, 4)), (None, None), (208, "a\x01b a\x1cb " * 12), (209, "x" * 70 + " y " + "x" * 70 + " y")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "und", "de"][k % 4], k, 1.0, "s", 2) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rank long, score double, term string, n int").repartition(5)


def find(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_search(texts, items, top):
    held = [(i, Counter(find(t))) for i, t in texts]
    held = [(i, c) for i, c in held if c]
    total, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in held:
            m = 100 - 90 + 90 * c.total() * total // length
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(find(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


ITEMS = [(k, prose(4 + k, 900 + k)) for k in range(12)] + [(20, COMMON), (21, None), (22, ""), (23, "Äö überSS ÜBERß äö"), (24, "zzzz"), (25, prose(12, 4)),
                                                         (25, prose(12, 4)), (25, "a a b"), (None, "a b"), (26, prose(3000, 8))]


@pytest.mark.parametrize("coordinates,block", [(1024, 1 << 12), (1, 1 << 12), (64, 5)])
def test_lexical_search(spark, docs, coordinates, block):
    items = spark.createDataFrame([(i, t, 1, "d") for i, t in ITEMS], "item_id long, text string, score int, doc_id string")
    got = lexical.search(docs, items, top=4, coordinates=coordinates, block_items=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(TEXTS, ITEMS, 4)


def test_lexical_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(docs.where("text is null"), items).collect() == []


def test_sketch_bounds_leave_documents_unscored():
    """Far fewer documents are scored exactly than have a query's term, and none of the best is missed."""
    rng = np.random.default_rng(2)
    queries = [rng.choice(2000, 8, replace=False) for _ in range(5)]
    ranking = lexical.Ranking(queries, np.full(2000, 1000, np.int64), 4000, 400_000, 10, 1024)
    for part in range(4):
        counts = np.full(1000, 40)
        term = np.concatenate([rng.choice(2000, 40, replace=False) for _ in range(1000)])
        ranking.add(list(range(part * 1000, part * 1000 + 1000)), [100] * 1000, counts, term, np.ones(40_000, np.int64))
    assert all(len(b) == 10 and b == sorted(b) for b in ranking.best)
    assert ranking.rescored < 5 * 4000 / 8


def brute_products(rows, every, top):
    fit = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
           if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)): None for i, v in fit if i is not None and i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in fit if i != q)
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:top])]
    return sorted(out, key=repr)


def vectors(seed, n=300, d=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:150] = x[50]  # a third are copies
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return rows + [(300, None), (400, [None] + [1.0] * 6), (500, [float("nan")] * 7), (600, [float("inf")] * 7), (700, []), (800, [1.0, -2.0]),
                   (900, [0.0] * 7), (None, [0.5] * 7), (50, rows[50][1]), (50, rows[50][1]), (100, [3.0] * 7), (1000, [1e6, -1e6] * 3 + [1e5])]


@pytest.mark.parametrize("slices,first,block,tile", [(2, 32, 1 << 13, 4096), (3, 1, 3, 16), (7, 5, 1 << 13, 64)])
def test_exact_topk(spark, monkeypatch, slices, first, block, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    rows = vectors(1)
    df = spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, tile string, score double").repartition(4)
    got = topk.top_products(df, top=5, slices=slices, first=first, block_queries=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_products(rows, 50, 5)


def test_exact_topk_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(50, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_products(df).collect())) == [(50, 1, 1, 131072), (50, 2, 2, -65536)]
    assert topk.top_products(df.where("vec_id = 50")).collect() == []
    assert topk.top_products(df.where("false")).collect() == []


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[1 << 40, -3]], np.int64), np.array([[1 << 35, 5]], np.int64)
    assert topk.scores(a, b)[0, 0] == (1 << 75) - 15
    assert topk.scores(a >> 12, b >> 5)[0, 0] == (1 << 58)


def brute_phrases(texts, least, top):
    split, out = {}, []
    for lang, text in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in regex.split(r"[.,;:!?\x0A-\x0D]", lower):
            split.setdefault("und" if lang is None else lang, []).append(regex.findall(r"[^\x20\x09]+", piece))
    for lang, pieces in split.items():
        f = Counter(tuple(p[i:i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in often.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for r, x in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("max_words,shard_words", [(1 << 19, 1 << 20), (1 << 19, 1 << 8), (20, 1 << 10), (0, 1 << 20)])
def test_phrases(spark, docs, monkeypatch, max_words, shard_words):
    monkeypatch.setattr(phrases, "FLUSH", 1 << 12)
    got = phrases.collocations(docs, least=4, top=200, max_words=max_words, shard_words=shard_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases([(r["lang"], r["text"]) for r in docs.collect()], 4, 200)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_phrases_of_empty_tables(docs):
    assert phrases.collocations(docs.where("false")).collect() == []
    assert phrases.collocations(docs.where("text is null")).collect() == []


def test_scores_of_huge_counts_are_exact(spark):
    a, left, right = 900_000_000_001, 1_000_000_000_007, 999_999_999_989
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score("a", "l", "r")).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_quotient_filters_lose_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert (phrases.restored(phrases.permuted(x)) == x).all()
    assert len(np.unique(phrases.permuted(np.arange(5000, dtype=np.uint64)))) == 5000
    for width in (63, 40, 13, 1):
        filters, want = [], Counter()
        for n in (700, 1, 30):
            some = np.unique(rng.integers(0, 1 << width, n, dtype=np.uint64))
            counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], len(some))
            want.update(dict(zip(some.tolist(), counts.tolist())))
            filters.append(phrases.QuotientFilter.from_bytes(phrases.QuotientFilter(some, counts, width).to_bytes()))
        whole = phrases.QuotientFilter.from_bytes(phrases.QuotientFilter.merged(filters).to_bytes())
        assert dict(zip(whole.numbers.tolist(), whole.counts.tolist())) == want
        assert (np.diff(whole.numbers.astype(object)) > 0).all()
