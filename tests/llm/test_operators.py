"""The training-text operators on small tables with every odd case, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from kindred.llm import components, decontaminate, lines, mix, paragraphs, quality, shard, simhash, suffixes, tokens, warc

random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefghijklmno") for _ in range(random.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."


PASSAGE = prose(90, 1)
TEXTS = [
    (1, prose(120, 2)), (2, prose(60, 3) + "\n" + PASSAGE), (3, PASSAGE + "\n" + prose(70, 4)), (4, ""), (5, None),
    (6, "  \t\n"), (7, "one"), (8, prose(120, 2)), (9, prose(120, 2).replace("a", "A", 1)), (10, "Ünïcode ½ ２３ don't <|endoftext|> <|X|> ﬁ 漢字 éé"),
    (11, prose(4000, 6)), (11, prose(4000, 6)), (None, prose(30, 7)), (None, None), (12, "Der " * 80), (13, "a | b | c\nHome\n" + prose(60, 8)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src%d" % (k % 3) if k % 4 else None, k, "x", 7.0) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, row string, score double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def same(rows, want):
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_token_counts_are_the_librarys(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    want = []
    for i, t in TEXTS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    same(tokens.token_counts(docs, top=50, sample=8).collect(), want)
    assert tokens.token_counts(empty).collect() == []


def test_worker_cache_stays_bounded():
    counter = tokens.Counting(tokens.default_path(), {}, room=8)
    assert counter.count(prose(200, 9)) == tokens.Counting(tokens.default_path(), {}).count(prose(200, 9))
    assert len(counter.lengths.cache) <= 8


def brute_spans(texts, least):
    seen = Counter(t[p:p + least] for t in texts for p in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if seen[t[p:p + least]] > 1:
                gone[p:p + least] = b"\1" * least
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("kinds", [512, 1])  # 1: every key goes the way of hot ones
def test_suffix_dedup(docs, empty, kinds):
    texts = [(t or "").encode() for _, t in TEXTS]
    got = suffixes.remove_repeats(docs, 400, kinds)
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(),
         [(i, *b) for (i, _), b in zip(TEXTS, brute_spans(texts, 400))])
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())
    assert suffixes.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("kinds", [512, 1])
def test_suffix_dedup_of_a_common_passage(spark, kinds):
    texts = [prose(30, 100 + k)[: 80 + k] + PASSAGE[k % 5: 480 + k % 7] + "ab" * (k % 3) * 90 + prose(20, 200 + k) for k in range(40)]
    got = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400, kinds)
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(),
         [(i, *b) for i, b in enumerate(brute_spans([t.encode() for t in texts], 400))])


def test_interval_expansion_equals_window_counts():
    r = random.Random(3)
    for _ in range(40):
        least, letters = r.choice([3, 5, 12]), r.choice([b"ab", b"abcd", bytes(range(256))])
        base = bytes(r.choice(letters) for _ in range(200))
        strings = list({base[r.randint(0, 99):r.randint(100, 200)] + bytes(r.choice(letters) for _ in range(9)) for _ in range(9)})
        copies = np.array([r.choice([1, 1, 2]) for _ in strings])
        seen = Counter()
        for s, k in zip(strings, copies):
            for p in range(len(s) - least + 1):
                seen[s[p:p + least]] += k
        assert [g.tolist() for g in suffixes.repeated_windows(strings, copies, least)] == [
            [p for p in range(len(s) - least + 1) if seen[s[p:p + least]] > 1] for s in strings]


def test_quality_classifier(spark, docs, empty):
    rows = [(i, prose(60, i) if i % 3 else " | ".join(prose(30, i).split()), int(i % 3 > 0)) for i in range(1, 240)]
    table = spark.createDataFrame(rows, "doc_id long, text string, q int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(table.select("doc_id", "text"), labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r["predicted"], q) for (i, _, q) in rows if (r := got[i])["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95
    odd = quality.score(docs, quality.fit(table.select("doc_id", "text"), labels)).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if not r["row"]["text"]}) == 1
    assert quality.classify(empty, labels).collect() == []
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}


def test_a_labelled_id_that_many_rows_share_is_learned_from_once(spark):
    texts = [(1, prose(30, 1)), (2, "the " + prose(30, 2)), (3, prose(30, 3)), (4, "the " + prose(30, 4))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    known = {r["doc_id"] for r in quality.training_labels(labels).collect()}
    texts = [(i, t) for i, (_, t) in zip(sorted(known), texts)]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    hot = plain.union(spark.createDataFrame([(texts[0][0], texts[0][1])] * 500 + [(texts[0][0], texts[0][1] + " " + prose(9, 5))] * 500, plain.schema))
    for a, b in zip(quality.fit(plain, labels), quality.fit(hot, labels)):
        assert np.array_equal(a, b)


def test_indicators_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    text = prose(3000, 12)
    whole = quality.indicators(text)
    monkeypatch.setattr(quality, "_PIECE", 1000)
    assert set(whole) >= set(quality.indicators(text)) and len(whole) - len(quality.indicators(text)) < 40


def test_line_rules(docs, empty):
    def brute(t):
        w = words(t)
        windows = Counter(tuple(w[p:p + 3]) for p in range(len(w) - 2))
        covered = {p + k for p in range(len(w) - 2) if windows[tuple(w[p:p + 3])] > 1 for k in range(3)}
        kept = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(kept) - len(set(kept)), len(covered)

    got = lines.clean_lines(docs).collect()
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got],
         [(i, *brute(t)) for i, t in TEXTS])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert [r["kept"] for r in got if r["doc_id"] in (2, 12, 13)] == [True, False, True]
    assert [r["cleaned"].split("\n")[0] for r in got if r["doc_id"] == 13] == [prose(60, 8)]
    assert lines.clean_lines(empty).collect() == []


def test_mix(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][min(i % 11, 3)]) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix.mix(table).select("row.source", "size", "source_size", "target", "copies").collect()
    total = sum(r["size"] for r in mixed)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in mixed}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values()) and targets["a"][0] == 3 * targets["a"][1]
    for source, (target, _) in targets.items():
        taken = sum(r["size"] * r["copies"] for r in mixed if r["source"] == source)
        assert abs(taken - target) < 0.1 * target
    assert max(r["copies"] for r in mixed) <= 3
    assert mix.emit(mix.mix(table)).count() == sum(r["copies"] for r in mixed)
    assert mix.mix(docs).count() == len(TEXTS) and mix.emit(mix.mix(docs)).columns == docs.columns
    assert mix.mix(empty).collect() == []


def test_rows_of_one_id_toss_their_own_coins(spark, monkeypatch):
    monkeypatch.setattr(mix, "RUN_ROWS", 64)
    rows = [(7 if i < 1500 else i, "w " * (5 + i % 2 if i < 500 else 5 if i < 1000 else 5 + i % 9), "a") for i in range(3000)]
    rows += [(None, None, "b"), (None, "", "b"), (7, "w " * 5, "b")] * 200 + [(i, "w " * 8, "c") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mix.mix(table, (1, 2, 3)).select("row.*", "size", "target", "copies").collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(repr, rows))
    assert sorted(map(repr, got)) == sorted(map(repr, mix.mix(table.repartition(3), (1, 2, 3)).select("row.*", "size", "target", "copies").collect()))
    for source in "abc":
        taken, target = (sum(r["size"] * r.copies for r in got if r.source == source), next(r.target for r in got if r.source == source))
        assert abs(taken - target) < 0.05 * target
    names = [(r.number, r.doc_id, r.text, r.source) for r in mix.numbered(table.select(F.struct("*").alias("row")).select(
        "row", F.lit(0).alias("size"), mix.digest(F.col("row.text")).alias("digest"))).select("number", "row.*").collect()]
    for key in {(n[1], n[2] or "", n[3]) for n in names}:
        mine = sorted(n[0] for n in names if (n[1], n[2] or "", n[3]) == key)
        assert mine == list(range(len(mine)))


def pages_table(spark):
    big, small = "<p>" + prose(400, 20), "<p>x"
    rows = [(1, "http://a.example.com/x?q=1#f", big), (2, "https://A.example.com:443/y", big), (3, None, small), (4, "no url", small),
            (5, "http://a.example.com/x", None), (5, "http://a.example.com/x", None), (6, "http://[bad", big), (None, "http://b.org/", big),
            (7, "http://b.org/ü ü", "é" * 900), (8, "http://b.org/", "é" * 499)]
    rows += [(100 + i, "http://hot.example.com/", big + str(i % 50)) for i in range(300)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_warc_round_trip(spark):
    pages, rows = pages_table(spark)
    folder, parts = warc.archive(pages, block_lines=16)
    got = warc.read_captures(warc.page_keys(pages), folder, parts, with_payload=True).collect()
    best = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            best[body] = max(best.get(body, i), i)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        refers = best.get(body) if best.get(body) != i else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers,
                     None if refers is not None else body))
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
           None if r["payload"] is None else bytes(r["payload"])) for r in got], want)
    one = spark.createDataFrame([(warc.sort_key("http://hot.example.com/", 107),), ("none 1",)], "sort_key string")
    assert [r["page_id"] for r in warc.read_captures(one, folder, parts).collect()] == [107]
    empty = pages.where("false")
    where, none = warc.archive(empty)
    assert none == [] and warc.read_captures(warc.page_keys(empty), where, none).collect() == []


def test_reversed_host():
    assert warc.reversed_host("https://u:p@M.Shop.Example.com:8080/a?b#c") == "com,example,shop,m:8080)/a?b"
    assert warc.reversed_host("http://example.com") == "com,example)/" and warc.reversed_host(None) == ")"


def near(words_, changes, seed):
    out, r = list(words_), random.Random(seed)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"zz{seed}"
    return " ".join(out)


@pytest.mark.parametrize("block", [2048, 8])  # 8: buckets are searched by pairs of blocks
def test_paragraph_dedup(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(paragraphs.rest_links, "__defaults__", (block,))
    base = prose(80, 30).split()
    texts = [prose(40, 300 + i) + "\n" + near(base, i % 2, 400 + i) + "\nshort line" for i in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(i, n, set(paragraphs.shingle_set(w).tolist())) for i, t in enumerate(texts) for n, w in paragraphs.paragraphs_of(t, 20)]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if len(items[a][2] & items[b][2]) >= 0.8 * len(items[a][2] | items[b][2]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    removed = Counter(items[k][0] for k in range(len(items)) if find(k) != k)
    got = paragraphs.dedup_paragraphs(table).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: removed[i] for i in range(len(texts))}
    assert paragraphs.recall(0.8) > 0.99
    odd = paragraphs.dedup_paragraphs(docs).collect()
    assert len(odd) == len(TEXTS) and {r["n_removed"] for r in odd if r["doc_id"] in (8, 9)} == {1}
    assert paragraphs.dedup_paragraphs(empty).collect() == []


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("tree", [4096, 2])  # 2: shards are split by further blocks
def test_simhash(spark, docs, empty, tree):
    got = simhash.near_duplicates(docs, max_tree=tree).collect()
    prints = [(i, brute_print(t)) for i, t in TEXTS]
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got) == Counter(prints)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {4}
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_one(docs, max_tree=tree)
    assert kept.columns == docs.columns
    comps = Counter(r["comp"] for r in got)
    assert kept.count() == len(comps)


@pytest.mark.parametrize("tree", [4096, 20])
def test_bk_trees_find_all_components(spark, tree):
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(20)]
    values = set(centres)
    for c in centres:
        x = c
        for _ in range(30):
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, tree)
    comp = {x["node"]: x["comp"] for x in components.connected_components(links).collect()}
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = find(signed[i]), find(signed[j])
                root[max(x, y)] = min(x, y)
    assert {v: comp.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_components_of_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in got} == {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(51)}}


@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 1000, 4099])
def test_permutation(spark, total):
    got = [r[0] for r in spark.range(total).select(shard.permuted(F.col("id"), total)).collect()]
    assert sorted(got) == list(range(total))


def test_shards(spark, docs, empty):
    many = docs.union(spark.createDataFrame([(99, "same", "s", 0, "x", 1.0)] * 500, docs.schema))
    rows = shard.assign(many).collect()
    assert len(rows) == len(TEXTS) + 500
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (4, 5)} == {(1, 0)}
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, shard.assign(many.repartition(5)).collect()), key=repr)
    assert shard.assign(empty).collect() == []


def test_decontamination(spark, docs, empty):
    items = [(1, prose(40, 50)), (2, prose(25, 51)), (3, "two words"), (4, ""), (5, None), (6, prose(40, 50))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    leak = prose(40, 50).split()
    rows = [(1, prose(80, 60) + "\n" + " ".join(leak).upper() + "\n" + prose(500, 61)), (2, near(leak, 1, 70)), (3, near(leak, 9, 71)),
            (4, prose(3000, 62) + " " + " ".join(leak[:38]) + " " + prose(10, 63)), (5, "two, words!"), (6, "two other words"), (7, None), (8, ""),
            (9, prose(25, 51)), (9, prose(25, 51)), (None, " ".join(leak))]
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def split(t):
        return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())

    def brute(t):
        found = {}
        for i, text in items:
            w, v = split(text), split(t)
            if not w or not v:
                continue
            k = min(5, len(w))
            a = Counter(tuple(w[p:p + k]) for p in range(len(w) - k + 1))
            s = [tuple(v[p:p + k]) for p in range(len(v) - k + 1)]
            m = sum(a.values())
            for p in range(max(1, len(s) - m + 1)):
                b = Counter(s[p:p + m])
                both = sum((a & b).values())
                found[i] = max(found.get(i, 0), both / (m + sum(b.values()) - both))
        found = {i: x for i, x in found.items() if x >= 0.8}
        top = max(found.values(), default=None)
        return len(found), min((i for i in found if found[i] == top), default=None), top

    got = decontaminate.flag(table, benchmark).collect()
    same([(r["row"]["doc_id"], r["n_items"], r["best_item"], r["best_similarity"]) for r in got], [(i, *brute(t)) for i, t in rows])
    assert decontaminate.clean(docs, benchmark).columns == docs.columns and decontaminate.clean(docs, benchmark).count() == len(TEXTS)
    assert decontaminate.flag(empty, benchmark).collect() == []
    assert decontaminate.clean(docs, benchmark.where("false")).count() == len(TEXTS)
