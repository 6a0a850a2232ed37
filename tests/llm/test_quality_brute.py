"""The quality classifier against a plain version: n-grams one by one, dictionaries, the machine solved in its kernel form."""

import re
import zlib

import numpy as np
import pytest

from kindred.llm import quality

A, B, C, M = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, (1 << 64) - 1


def bucket(h, bits):
    h &= M
    return (((h ^ (h >> 29)) * B) & M) >> (64 - bits)


def word_hash(word):
    total = len(word) * A
    for place, byte in enumerate(word):
        x = ((byte + 1) * ((place * A + B) & M)) & M
        total += ((x ^ (x >> 31)) * C) & M
    return total & M


def plain_indicators(text, bits):
    data = text.encode()
    found = {bucket((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * A + C, bits) for i in range(len(data) - 2)}
    words = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    found |= {bucket(w, bits) for w in words}
    found |= {bucket(a * A + b * C, bits) for a, b in zip(words, words[1:])}
    run = longest = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return found | {bucket(n * C, bits) for n in range(2, min(longest, 9) + 1) if longest > 1}


def plain_ratio(sets, labels, bits):
    """Log-count ratio of every bucket, counts smoothed by one over all buckets."""
    counts = {k: {} for k in (0, 1)}
    for s, label in zip(sets, labels):
        for b in s:
            counts[label][b] = counts[label].get(b, 0) + 1
    totals = {k: (1 << bits) + sum(counts[k].values()) for k in (0, 1)}
    return lambda b: np.log((1 + counts[1].get(b, 0)) / totals[1]) - np.log((1 + counts[0].get(b, 0)) / totals[0])


def plain_machine(sets, labels, bits):
    """The margin of any set of buckets: squared hinge loss at its optimum, active rows by Newton steps in the kernel form."""
    ratio = plain_ratio(sets, labels, bits)

    def scaled(s):
        v = {b: ratio(b) for b in s}
        length = max(np.sqrt(sum(x * x for x in v.values())), 1e-9)
        return {b: x / length for b, x in v.items()}

    rows, y = [scaled(s) for s in sets], np.where(np.array(labels) > 0, 1.0, -1.0)
    kernel = np.array([[1 + sum(x * v.get(b, 0.0) for b, x in u.items()) for v in rows] for u in rows])
    share = {1.0: (y > 0).mean(), -1.0: (y < 0).mean()}
    cost = np.array([0.5 / max(share[s], 1e-3) for s in y])
    active, alpha = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(100):
        at = np.flatnonzero(active)
        alpha[:] = 0
        alpha[at] = np.linalg.solve(kernel[np.ix_(at, at)] * np.outer(y[at], y[at]) + np.diag(0.5 / cost[at]), np.ones(len(at)))
        now = y * (kernel @ (alpha * y)) < 1
        if (now == active).all():
            break
        active = now
    return lambda s: float(sum(a * t * (1 + sum(x * v.get(b, 0.0) for b, x in scaled(s).items()))
                               for a, t, v in zip(alpha, y, rows) if a))


def plain_curve(margins, labels):
    """Slope and offset of the damped logistic curve, by ever finer grids."""
    m, t, a, b, wide = np.array(margins), np.array(labels), 10.0, 0.0, 10.0
    for _ in range(40):
        every = []
        for x in np.linspace(a - wide, a + wide, 9):
            for z in np.linspace(b - wide, b + wide, 9):
                f = x * m + z
                loss = (np.logaddexp(0, f) - t * f).sum() + 0.005 * ((x - 1) ** 2 + z * z)
                every.append((loss, x, z))
        _, a, b = min(every)
        wide *= 0.6
    return max(a, 1e-3), b


def sample(n, seed):
    rng = np.random.default_rng(seed)
    good, bad = "the river runs past old stone houses and a quiet mill".split(), "buy now click here free cash win big the a".split()
    texts, labels = [], []
    for i in range(n):
        label = int(rng.integers(2))
        mostly, less = (good, bad) if label else (bad, good)
        words = [str(rng.choice(mostly if rng.random() < 0.65 else less)) for _ in range(int(rng.integers(4, 14)))]
        texts.append(" ".join(words))
        labels.append(label)
    return texts, labels


@pytest.mark.parametrize("text", ["", "a", "ab  ab", "no no no yes", "Äpfel und\tBirnen\r\nund 東京 \x0b end", " x" * 12, "é" * 300])
def test_indicators_are_those_of_each_ngram(text):
    assert quality.indicators(text, 14).tolist() == sorted(plain_indicators(text, 14))


def test_ratios_and_machine_are_those_of_the_optimum():
    texts, labels = sample(40, 1)
    sets = [plain_indicators(t, 12) for t in texts]
    rows = [quality.indicators(t, 12) for t in texts]
    ratio, w = quality._fit_once(rows, np.where(np.array(labels) > 0, 1.0, -1.0), 1 << 12, 5000, quality.COST)
    plain = plain_ratio(sets, labels, 12)
    assert np.allclose(ratio, [plain(b) for b in range(1 << 12)])
    margin = plain_machine(sets, labels, 12)
    unseen = sample(20, 2)[0] + [""]
    for t in [*texts, *unseen]:
        got = quality.margin(quality.indicators(t, 12), ratio, w[:-1], w[-1])
        assert got == pytest.approx(margin(plain_indicators(t, 12)), abs=5e-3)


def test_scores_of_the_query_are_those_of_the_plain_version(spark):
    texts, labels = sample(60, 3)
    texts[7], texts[8] = "", None
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marked = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, marked).collect()}
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    bits = quality.BITS
    sets, y = [plain_indicators(texts[i] or "", bits) for i in train], [labels[i] for i in train]
    outside = [0.0] * len(train)
    for fold in range(3):
        inside = [k for k in range(len(train)) if k % 3 != fold]
        margin = plain_machine([sets[k] for k in inside], [y[k] for k in inside], bits)
        for k in range(fold, len(train), 3):
            outside[k] = margin(sets[k])
    slope, offset = plain_curve(outside, y)
    margin = plain_machine(sets, y, bits)
    for i, t in enumerate(texts):
        want = 1 / (1 + np.exp(-(slope * margin(plain_indicators(t or "", bits)) + offset)))
        assert got[i].held_out == (i not in train)
        assert got[i].score == pytest.approx(want, abs=0.01)
        assert got[i].predicted == int(got[i].score >= 0.5)
