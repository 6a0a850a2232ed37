"""Decontamination with items of every length a counter may be tight for, and the reach of its index."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import decontaminate


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("longest", [127, 128, 255, 256])
def test_items_of_many_equal_or_different_shingles(spark, longest):
    items = [(1, " ".join(words(longest + 4, 1))), (2, "same " * (longest + 4)), (3, "ab cd " * (longest // 2 + 2)), (4, " ".join(words(12, 2)))]
    rows = [(1, " ".join([*words(300, 3), *words(longest + 4, 1), *words(40, 4)])), (2, "same " * (longest + 4)), (3, "x " + "same " * 2000),
            (4, "ab cd " * 800), (5, " ".join(words(2000, 5))), (6, " ".join(words(longest + 4, 1)[:longest // 2])), (7, "same " * (longest // 2))]
    got = decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["row"]["doc_id"]: (r["n_items"], r["best_item"], r["best_similarity"]) for r in got.collect()} == {
        1: (1, 1, 1.0), 2: (1, 2, 1.0), 3: (1, 2, 1.0), 4: (1, 3, 1.0), 5: (0, None, None), 6: (0, None, None), 7: (0, None, None)}


def test_an_item_of_more_shingles_than_a_small_counter_holds(spark):
    n = (1 << 15) + 4
    items = spark.createDataFrame([(1, "same " * n), (2, " ".join(words(40, 1)))], "item_id long, text string")
    rows = [(1, "same " * n), (2, "same " * (n // 2)), (3, " ".join(words(80, 1)))]
    got = decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r["row"]["doc_id"]: r["best_item"] for r in got} == {1: 1, 2: None, 3: 2}


@pytest.mark.parametrize("n", [1, 127, 128, 300])
def test_fingerprints(spark, n):
    rng = np.random.default_rng(n)
    rows = [[int(x) for x in rng.integers(-1 << 63, (1 << 63) - 1, n)], [-1] * n, [0] * n, [1 << 62] * n, [-1 << 63] * n]
    got = spark.createDataFrame([(h,) for h in rows], "h array<long>").select(decontaminate.fingerprint("h", n).alias("fp")).collect()
    want = [sum((2 * sum(x >> b & 1 for x in h) > n) << b for b in range(64)) for h in rows]
    assert [r["fp"] % (1 << 64) for r in got] == want


def test_every_fingerprint_within_the_radius_is_reached(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        x, far = r.getrandbits(64), r.choice([0, 1, 5, 19, 20])
        pairs.append((x, x ^ sum(1 << b for b in r.sample(range(64), far))))
    signed = [tuple(v - (1 << 64) if v >> 63 else v for v in p) for p in pairs]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(signed)], "k int, x long, y long")
    index = table.withColumn("b", decontaminate.blocks("y")).select("k", "b.block", decontaminate.reached(F.col("b"), 20).alias("value"))
    probes = table.withColumn("b", decontaminate.blocks("x")).select("k", "b.block", "b.value")
    assert probes.join(index, ["k", "block", "value"]).select("k").distinct().count() == len(pairs)


def test_similar_windows_lie_within_the_radius(spark):
    """Of windows of similarity 0.8 to 0.9 at least 0.99 are within the radius of their item."""
    from kindred.llm.decontaminate import RADIUS, fingerprint, shingles
    rows = []
    for k in range(1500):
        r = random.Random(k)
        n = r.randint(30, 80)
        item = words(n, 10_000 + k)
        cut = r.randint(1, n // 8)
        window = item[cut:] + words(cut, 20_000 + k)
        a, b = (Counter(tuple(w[i:i + 5]) for i in range(n - 4)) for w in (item, window))
        if 0.8 <= (both := sum((a & b).values())) / (2 * (n - 4) - both) < 0.9:
            rows.append((item, window))
    table = spark.createDataFrame(rows, "a array<string>, b array<string>").select(
        *[shingles(F.transform(c, lambda w: F.xxhash64(w)), 5).alias(c) for c in ("a", "b")])
    far = table.select(F.bit_count(fingerprint("a", 80).bitwiseXOR(fingerprint("b", 80))).alias("d"))
    assert len(rows) > 300 and far.where(F.col("d") <= RADIUS).count() >= 0.99 * len(rows)
