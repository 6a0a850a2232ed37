"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import table, text_key
from kindred.session import cut

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
FILTER_BITS = 20
MAX_FILTER = 1 << 17
_LANES = 32


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; none for fewer words."""
    n = F.size(hashes)
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def fingerprint(sh: str, most: int) -> Column:
    """SimHash of the array ``sh`` of at most ``most`` hashes: a bit is 1 if over half of them have it.

    A long holds several counters, as wide as ``most`` needs; lane i counts the
    bits i, i + width, ... at once. The topmost counter leaves the sign bit free.
    """
    width = 8 if most < 1 << 7 else 16 if most < 1 << 15 else 32
    ones = _long(sum(1 << at for at in range(0, 64, width)))
    lanes = ", ".join(f"aggregate({sh}, 0L, (x, h) -> x + (shiftrightunsigned(h, {i}) & {ones})) as lane{i}" for i in range(width))
    bits = [(f"shiftrightunsigned(one.lane{i}, {at}) & {(1 << width) - 1}L", 1 << (i + at)) for i in range(width) for at in range(0, 64, width)]
    terms = " | ".join(f"if(2 * ({count}) > size({sh}), {_long(bit)}, 0L)" for count, bit in bits)
    return F.expr(f"transform(array(struct({lanes})), one -> {terms})[0]")


def _long(value: int) -> str:
    return "(-9223372036854775807L - 1L)" if value == 1 << 63 else f"{value}L"


def blocks(fp: str) -> Column:
    """The four 16-bit blocks of a fingerprint as rows ``block, value``."""
    return F.expr("explode(array(" + ", ".join(
        f"struct({i} as block, cast(shiftrightunsigned({fp}, {16 * i}) & 65535L as int) as value)" for i in range(4)) + "))")


def reached(b: Column, radius: int) -> Column:
    """The values of a block within radius / 4 bits: fingerprints within ``radius`` bits are so near in one block at least."""
    near = [m for m in range(1 << 16) if m.bit_count() <= radius // 4]
    return F.explode(F.transform(F.lit(np.array(near, np.int32)), lambda m: b["value"].bitwiseXOR(m)))


def benchmark_items(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``item, item_id, size, k, n, sh`` of every item with words; an item below ``k`` words is one shingle."""
    known = benchmark.select("item_id", words(F.col("text")).alias("w"), text_key(F.col("text")).alias("key")).where("size(w) > 0")
    hashed = known.select("item_id", F.xxhash64("item_id", "key").alias("item"), F.size("w").alias("size"),
                          F.transform("w", lambda w: F.xxhash64(w)).alias("wh")).dropDuplicates(["item", "item_id"])
    short = F.array(*[F.struct(F.lit(j).alias("k"), shingles(F.col("wh"), j).alias("sh")) for j in range(1, k + 1)])
    return hashed.withColumn("k", F.least("size", F.lit(k))).withColumn(
        "sh", F.element_at(short, F.col("k"))["sh"]).select("item", "item_id", "size", "k", F.size("sh").alias("n"), "sh")


def _probes(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) for at in (0, 21, 42)]


def bit_filter(marks: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter of the column ``h``: 2**bits bits in longs, put together by the cluster, at most 2**bits / 64 rows collected."""
    spots = marks.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("spot"))
    words64 = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("mask"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words64.collect():
        out[r["word"]] = r["mask"]
    return out


def may_hold(sh: Column, held: np.ndarray, bits: int = FILTER_BITS) -> Column:
    """Whether any hash of the array ``sh`` may be in the filter (never false for one that is)."""
    array = F.lit(held)

    def one(spot: Column) -> Column:
        return F.get(array, F.shiftright(spot, 6).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))) != 0

    return F.exists(sh, lambda h: one(_probes(h, bits)[0]) & one(_probes(h, bits)[1]) & one(_probes(h, bits)[2]))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY,
          radius: int = RADIUS) -> DataFrame:
    """``doc_id, text_key, item_id, similarity``: the best window of every document for every item it holds.

    A window has as many words as the item (the whole document, if it is shorter).
    Windows that share no shingle with any item have similarity 0, so those that
    share one with an item of their size are formed: all of them, at every start,
    once. Different fingerprints of windows are looked up in a multi-index of the
    items: four 16-bit blocks, each entered under all values within radius / 4
    bits, which finds every item of the window's size within ``radius`` bits. The
    similarity of these pairs is then computed exactly: the weight of a shingle is
    its count, similarity the sum of the lesser weights over the sum of the
    greater. At similarity 0.8 two fingerprints differ in about 10 of 64 bits, 20
    is over three standard deviations away.

    Items' shingles, up to ``MAX_FILTER`` different ones, are put into a bit
    filter of fixed size that drops documents without any, in the scan; with
    more shingles all documents take part in the exact join that follows.
    Null and empty texts hold nothing and match nothing. Items below ``k`` words
    match a run equal to them. Repeated rows share one result; null ids are told
    apart by their text. Other columns are not read. Empty tables give no rows.
    """
    items = cut(benchmark_items(benchmark, k), "items")
    sizes = items.agg(F.collect_set("k").alias("ks"), F.max("n").alias("most"), F.sum("n").alias("all")).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    if not sizes["ks"]:
        return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.lit(None).cast(item_kind).alias("item_id"),
                           F.lit(0.0).alias("similarity")).limit(0)
    most = sizes["most"]
    marks = items.select("item", "k", "n", "size", F.posexplode("sh").alias("offset", "h"))
    hashed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.transform(
        words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))
    by_k = F.array(*[F.struct(F.lit(j).alias("k"), shingles(F.col("wh"), j).alias("sh")) for j in sorted(sizes["ks"])])
    if sizes["all"] <= MAX_FILTER:
        held = bit_filter(marks.select("h").distinct())
        by_k = F.filter(by_k, lambda one: may_hold(one["sh"], held))
    # Whole arrays of the documents that may hold an item, written: everything below reads only these.
    some = cut(hashed.select("doc_id", "text_key", F.size("wh").alias("words"), F.explode(by_k).alias("one")).select(
        "doc_id", "text_key", "words", "one.k", "one.sh"), "holding").dropDuplicates(["doc_id", "text_key", "k"])
    # Long documents are taken in chunks of shingles, each with the neighbours a window may reach into.
    step = max(1024, 2 * most)
    chunks = cut(some.where("size(sh) > 0").select(
        F.xxhash64("doc_id", "text_key", "k").alias("doc"), "doc_id", "text_key", "words", "k", F.size("sh").alias("total"),
        F.explode(F.expr(f"transform(sequence(0, size(sh) - 1, {step}), i -> struct(greatest(i - {most}, 0) as first, i as own, "
                         f"slice(sh, greatest(i - {most}, 0) + 1, least(i, {most}) + {step} + {most}) as sh))")).alias("c"))
        .select("doc", "doc_id", "text_key", "words", "k", "total", "c.first", "c.own", "c.sh"), "chunks")
    positions = chunks.select("doc", "k", "words", "total", "first", "own", F.posexplode("sh").alias("at", "h")).withColumn(
        "at", F.col("at") + F.col("first"))
    own = positions.where(f"at >= own and at < own + {step}")
    hits = own.join(marks.select("h", "k", "n").distinct(), ["h", "k"])
    # All starts of windows of n shingles that contain a hit and lie in the document: each hit adds those after the hit before.
    last = "greatest(total - n, 0)"
    before = F.lag("at").over(Window.partitionBy("doc", "k", "n").orderBy("at"))
    starts = hits.withColumn("before", F.coalesce(before, F.lit(-1))).select("doc", "k", "n", F.expr(
        f"least(greatest(at - n + 1, before + 1, 0), {last}) as low"), F.expr(f"least(at, {last}) as high"), F.expr(f"least(before, {last}) as done"))
    windows = cut(starts.where("high > done").select(
        "doc", "k", "n", F.explode(F.expr("sequence(greatest(low, done + 1), high)")).alias("start")), "windows")
    window = ["doc", "k", "n", "start"]

    def with_shingles(starting: DataFrame) -> DataFrame:
        """Windows with their shingles ``sh``: a window lies in the chunk its start is in."""
        return starting.withColumn("own", F.floor(F.col("start") / step).cast("int") * step).join(
            chunks.select("doc", "k", "own", "first", "sh"), ["doc", "k", "own"]).select(
            *starting.columns, F.expr("slice(sh, start - first + 1, n)").alias("sh"))

    formed = cut(with_shingles(windows).select(*window, fingerprint("sh", most).alias("fp")), "formed")
    # Different fingerprints of windows meet the items of their size by block.
    prints = formed.select("k", "n", "fp").distinct().withColumn("b", blocks("fp")).select("k", "n", "fp", "b.block", "b.value")
    # Some 27,000 entries an item at 20 bits: dealt over the tasks and written, so that joins go by its true size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = cut(items.select("item", "k", "n", fingerprint("sh", most).alias("item_fp")).repartition(tasks).withColumn("b", blocks("item_fp")).select(
        "item", "k", "n", "item_fp", "b.block", reached(F.col("b"), radius).alias("value")), "index")
    pairs = prints.join(index, ["k", "n", "block", "value"]).where(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("k", "n", "fp", "item").distinct()
    near = with_shingles(cut(formed.join(cut(pairs, "pairs"), ["k", "n", "fp"]).select(*window, "item"), "near"))
    window = [*window, "item"]
    weights = near.select(*window, F.size("sh").alias("held"), F.explode("sh").alias("h")).groupBy(*window, "held", "h").agg(
        F.count("*").alias("weight"))
    item_weights = marks.groupBy("item", "h").agg(F.count("*").alias("item_weight"))
    common = weights.join(item_weights, ["item", "h"]).groupBy(*window, "held").agg(
        F.sum(F.least("weight", "item_weight")).alias("common"))
    best = common.withColumn("similarity", F.col("common") / (F.col("held") + F.col("n") - F.col("common"))).where(
        F.col("similarity") >= similarity).groupBy("doc", "item").agg(F.max("similarity").alias("similarity"))
    names = chunks.select("doc", "doc_id", "text_key").distinct()
    return best.join(names, "doc").join(items.select("item", "item_id"), "item").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "text_key", "item_id", "similarity")


def flag(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``row, n_items, best_item, best_similarity`` for every row of ``docs``; 0 and null where it holds no item.

    ``row`` has all columns of the row. Ties between items go to the least item_id.
    """
    found = leaks(docs, benchmark, **options).groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.countDistinct("item_id").alias("n_items"), F.max("similarity").alias("best_similarity"),
        F.min_by("item_id", F.struct(-F.col("similarity"), F.col("item_id"))).alias("best_item"))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    return packed.join(cut(found, "leaks"), F.col("row.doc_id").eqNullSafe(F.col("of_id")) & (
        text_key(F.col("row.text")) == F.col("of_key")), "left").select(
        "row", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "best_item", "best_similarity")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    return flag(docs, benchmark, **options).where("n_items = 0").select("row.*")


def op10_decontaminate(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return flag(docs, table(spark, folder, "benchmark")).select(
        F.col("row.doc_id").alias("doc_id"), (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "best_similarity")
