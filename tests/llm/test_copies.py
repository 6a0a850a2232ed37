"""The near-duplicate stage against brute-force Jaccard."""

import random

import pytest

import corpus_pipeline
from kindred.llm import copies, simhash


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(500)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def texts():
    out = [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "two"), (None, "one"), (None, "three"), (905, "four"), (905, "four")]
    for g in range(12):
        base = prose(150 + 40 * g, g)
        for i in range(6):
            w, r = list(base), random.Random(100 * g + i)
            for _ in range(i * len(w) // 120):
                w[r.randrange(len(w))] = f"z{r.randrange(999)}"
            out.append((10 * g + i, " ".join(w)))
    return out


def test_one_document_of_near_copies_stays(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    missed = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                missed += (simhash.fingerprint(texts[a][1] or "") ^ simhash.fingerprint(texts[b][1] or "")).bit_count() > simhash.RADIUS
    assert missed > 10  # pairs that three bits of 64 do not catch
    groups = {}
    for k, (i, t) in enumerate(texts):
        groups.setdefault(find(k), []).append((i is None, i or 0))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(map(min, groups.values()))


def test_close_fingerprints_are_candidates(spark):
    loop, shared = " ".join(["red green blue"] * 60), " ".join(prose(100, 70))
    texts = [f"{loop} {shared} " + " ".join(prose(5, seed)) for seed in range(200, 206)]
    prints = [simhash.fingerprint(t) for t in texts]
    assert max((a ^ b).bit_count() for a in prints for b in prints) <= simhash.RADIUS
    assert min(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a in texts for b in texts) >= 0.8
    # Same fingerprint, other words after the loop: a candidate, but no near copy.
    texts.append(f"{loop} " + " ".join(prose(20, 99)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in copies.near_copies(docs, bands=1, rows=60).collect():  # a band that hardly any pair shares
        found.setdefault(r["comp"], set()).add(r["doc_id"])
    assert sorted(map(sorted, found.values())) == [[0, 1, 2, 3, 4, 5], [6]]
