"""SimHash near-duplicates found in BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, table, text_key, texts_of
from kindred.llm.components import connected_components
from kindred.session import cut

RADIUS = 3
WORDS = 3
HASH_SEED = 42
MAX_TREE = 4096
_PAIRS = 1 << 20


def fingerprint(text: str, k: int = WORDS) -> int:
    """SimHash of the whole text: a bit is 1 if over half of the hashes of its k-word shingles have it.

    A-Z count as lower case, words are runs of anything but ASCII white space,
    repeated shingles count each time; fewer than k words make one shingle, none
    give 0.
    """
    words = text.encode().lower().split()  # bytes: ASCII white space and letters only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > k:
        starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 14):
        hashes = np.fromiter((of(joined[a:b], HASH_SEED) for a, b in zip(
            starts[at:at + (1 << 14)].tolist(), ends[at:at + (1 << 14)].tolist())), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``doc_id, text_key, fp`` (fp as a signed long) of every row; nothing is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, k) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints, pa.int64())],
                                          ["doc_id", "text_key", "fp"])

    return map_batches(docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text"), work,
                       f"doc_id {kind}, text_key long, fp long")


class Trees:
    """BK-trees over the fingerprints of many shards, in flat arrays.

    ``shard`` is sorted. The first fingerprint of a shard is its root; every
    other one goes down the edge of its distance to each node it meets, until no
    child has that distance, and becomes that child. All shards grow together,
    one level per step.
    """

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        self.root = np.repeat(first, np.diff(np.append(first, len(fp))))
        edges = []
        moving = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        at = self.root[moving]
        while len(moving):
            edge = at * 65 + np.bitwise_count(fp[moving] ^ fp[at])
            codes, child, back = np.unique(edge, return_index=True, return_inverse=True)
            edges.append((codes, moving[child]))
            down = np.ones(len(moving), bool)
            down[child] = False
            at = moving[child][back][down]
            moving = moving[down]
        codes = np.concatenate([c for c, _ in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.child = (np.concatenate([n for _, n in edges]) if edges else np.zeros(0, np.int64))[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of one shard with distance 1 .. radius, following only edges within the radius."""
        asks, nodes = queries, self.root[queries]
        found = []
        while len(asks):
            far = np.bitwise_count(self.fp[asks] ^ self.fp[nodes]).astype(np.int64)
            hit = (far <= radius) & (asks != nodes)
            found.append((asks[hit], nodes[hit]))
            low = np.searchsorted(self.codes, nodes * 65 + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.codes, nodes * 65 + np.minimum(far + radius, 64), "right")
            n = high - low
            asks = np.repeat(asks, n)
            nodes = self.child[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of the pairs (a, b) one label each component, the least index in it."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def shard_links(fp: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least linked fingerprint index's value): one row per member of a group, none for loners."""
    trees, label = Trees(fp, shard), np.arange(len(fp))
    sizes = np.bincount(trees.root, minlength=len(fp))[trees.root]
    asked = np.flatnonzero(sizes > 1)
    slices = np.cumsum(sizes[asked]) // _PAIRS
    for part in np.split(asked, np.flatnonzero(np.diff(slices)) + 1):
        if len(part):
            merge(label, *trees.within(part, radius))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _blocks(rest: str, width: int, radius: int) -> tuple[str, int]:
    """SQL for the blocks of the ``width`` bits in ``rest``: an array of (block, value, bits left), and their least width left."""
    n, out, at = radius + 1, [], 0
    for i in range(n):
        w = (width - at) // (n - i)
        low = f"({rest} & {(1 << at) - 1}L)" if at else "0L"
        high = f"shiftleft(shiftrightunsigned({rest}, {at + w}), {at})" if at + w < 64 else "0L"
        value = f"(shiftrightunsigned({rest}, {at}) & {(1 << w) - 1}L)"
        out.append(f"struct({i} as block, {value} as value, ({high} | {low}) as rest)")
        at += w
    return "array(" + ", ".join(out) + ")", width - (width // n)


def shards(prints: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """``shard, fp``: two fingerprints within ``radius`` share at least one shard.

    Of radius + 1 blocks of the bits at least one is equal, so a shard is a block
    and its value. A shard of more than ``max_tree`` fingerprints is split by the
    blocks of its remaining bits, which must agree within the radius as well,
    down to three levels.
    """
    level = prints.selectExpr("0L as shard", "fp", "fp as rest")
    width, done = 64, None
    for depth in range(3):
        blocks, left = _blocks("rest", width, radius)
        level = level.selectExpr("shard", "fp", f"explode({blocks}) as b").selectExpr(
            f"xxhash64(shard, {depth}, b.block, b.value) as shard", "fp", "b.rest as rest")
        level = cut(level, "shards")
        sizes = cut(level.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        fit = sizes if depth == 2 else sizes.where(F.col("n") <= max_tree)
        small = level.join(fit.select("shard"), "shard").select("shard", "fp")
        done = small if done is None else done.union(small)
        if depth == 2 or not sizes.where(F.col("n") > max_tree).limit(1).count():
            return done
        level = level.join(sizes.where(F.col("n") > max_tree).select("shard"), "shard")
        width = left
    return done


def linked(prints: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of different ``fp`` within ``radius``.

    A task builds the trees of the shards dealt to it, searches them with their
    own fingerprints and returns one link per member of a group, never pairs.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def flush(pdf: pd.DataFrame) -> pa.RecordBatch:
            a, b = shard_links(pdf["fp"].to_numpy().view(np.uint64), pdf["shard"].to_numpy(), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(batch.to_pandas())
            if sum(map(len, held)) >= 1 << 18:
                rows = pd.concat(held, ignore_index=True)
                last = rows["shard"] == rows["shard"].iloc[-1]
                held = [rows[last]]
                if not last.all():
                    yield flush(rows[~last])
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    dealt = shards(prints, radius, max_tree).repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = WORDS, max_tree: int = MAX_TREE) -> DataFrame:
    """``doc_id, text_key, fp, comp, component_id`` for every row of ``docs``.

    Equal fingerprints are merged first, so copies cost one row; different ones
    are linked within ``radius`` bits. ``comp`` names the component by a
    fingerprint, ``component_id`` by its least doc_id (null ids count last, and
    give null only if there is no other). Null and empty texts have fingerprint 0
    and are linked like any other. Repeated rows keep a row each; other columns
    are not read; an empty table gives an empty table. Trees are not broadcast,
    as they grow with the data: each goes to the task that searches it.
    """
    rows = cut(fingerprints(docs, k), "prints")
    different = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    comps = connected_components(linked(different.select("fp"), radius, max_tree)).selectExpr("node as fp", "comp")
    named = cut(different.join(comps, "fp", "left").selectExpr("fp", "coalesce(comp, fp) as comp", "least"), "named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "comp").join(least, "comp"), "fp").select(
        "doc_id", "text_key", "fp", "comp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id (then text); all its columns."""
    return keep_least(docs, near_duplicates(docs, **options))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``comp`` of ``found`` (doc_id, text_key, comp of every row), that of the least doc_id (then text).

    Of rows equal in both one stays. Null ids come last in a component.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("best")
    chosen = found.groupBy("comp").agg(best).select("best.doc_id", "best.text_key")
    rows = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    stays = cut(chosen.join(rows, rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["text_key"] == chosen["text_key"]))
                .select(chosen["doc_id"].alias("_of_id"), chosen["text_key"].alias("_of_key"), "copies"), "stays")
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    kept = packed.join(stays, F.col("row.doc_id").eqNullSafe(F.col("_of_id")) & (
        text_key(F.col("row.text")) == F.col("_of_key")))
    if stays.where("copies > 1").limit(1).count():
        once = kept.where("copies > 1").groupBy("_of_id", "_of_key").agg(F.first("row").alias("row"))
        kept = kept.where("copies = 1").select("row").union(once.select("row"))
    return kept.select("row.*")


def op8_simhash_dedup(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
