"""Removal of repeated substrings: common prefixes from a Burrows-Wheeler transform, grown up to a least length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, table, text_key, texts_of
from kindred.session import cut

LEAST = 400
MAX_KINDS = 512
CHUNK = 3 << 19
_GRAM = 8
_PIECE = 1 << 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- the transform and the search in it: a group of strings at a time -------------------------------------------------

def suffix_order(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; ``left`` is the distance to the next separator (code 0).

    Separators are all different, the earlier the smaller, so no comparison
    passes one.
    """
    n, h = len(codes), 7
    padded = np.concatenate([codes, np.zeros(h, codes.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << 9) | np.where(left >= j, padded[j:n + j], 0)
    order = np.argsort(key, kind="stable")
    sorted_key, ended = key[order], left[order] < h
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | ended[1:] | ended[:-1]
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(slots):
        some = order[slots]
        pair = rank[some] * n + rank[some + h]
        by = np.argsort(pair, kind="stable")
        some, pair = some[by], pair[by]
        order[slots] = some
        fresh = np.ones(len(slots), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[some] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order


def prefix_bounds(bwt: np.ndarray, least: int) -> np.ndarray:
    """Places i where the suffixes i - 1 and i share less than ``least`` characters, by interval expansion.

    Breadth first by the length of the common prefix: the interval of a string
    w, extended backward by each character c found in it, is the interval of
    cw; if its right end is not yet a bound, the suffixes beside it share |w|
    characters, it becomes one, and the interval is extended in the next round.
    The rounds stop at ``least``. Separators are never extended by.
    """
    n = len(bwt)
    back = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[back] = np.arange(n)
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        inside = np.arange(size.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        real = bwt[inside] > 0
        inside, owner = inside[real], owner[real]
        at = step[inside]
        if len(at) > n // 16:
            held = np.full(n, -1, np.int64)
            held[at] = owner
            at = np.flatnonzero(held >= 0)
            owner = held[at]
        else:
            by = np.argsort(at)
            at, owner = at[by], owner[by]
        if not len(at):
            break
        letter = bwt[back[at]]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (letter[1:] != letter[:-1])
        starts = np.flatnonzero(first)
        low, high = at[starts], at[np.append(starts[1:], len(at)) - 1] + 1
        new = ~bound[high]
        low, high = low[new], high[new]
        bound[high] = True
    return bound


def repeated_windows(strings: list[bytes], copies: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """For each string (it stands for ``copies`` equal ones) the starts of its ``least``-byte windows found at two places or more."""
    codes = np.zeros(sum(len(s) + 1 for s in strings), np.int16)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    codes[:] = raw
    codes += 1
    codes[ends] = 0
    owner = np.repeat(np.arange(len(strings)), np.diff(np.concatenate([[-1], ends])))
    left = ends[owner] - np.arange(len(codes))
    order = suffix_order(codes, left)
    bound = prefix_bounds(codes[order - 1], least)
    short = left[order] < least
    bound[:-1] |= short
    bound[1:] |= short
    starts = np.flatnonzero(bound[:-1])
    times = np.add.reduceat(np.asarray(copies, np.int64)[owner[order]], starts)
    twice = np.repeat(times > 1, np.diff(np.append(starts, len(order)))) & ~short
    marked = np.zeros(len(codes), bool)
    marked[order[twice]] = True
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [np.flatnonzero(marked[b:e]) for b, e in zip(begins, ends)]


# --- pieces of texts that could repeat --------------------------------------------------------------------------------

def anchors(data: np.ndarray, least: int) -> np.ndarray:
    """For each window of ``least`` bytes the place of its least hashed 8-gram, the leftmost of equals."""
    wide = data.astype(np.uint64)
    for width in (1, 2, 4):
        wide = wide[:-width] | (wide[width:] << np.uint64(8 * width))
    h = (wide ^ (wide >> np.uint64(29))) * _A
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = least - _GRAM + 1
    count = len(h) - span + 1
    blocks = np.full(-(-len(h) // span) * span, np.iinfo(np.uint64).max)
    blocks[:len(h)] = h
    blocks = blocks.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:count], before[span - 1:span - 1 + count]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs(text: bytes, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, kind, start, windows, offset) of the runs of windows of one text.

    A run holds consecutive windows that have the same anchor in the same half
    of the window. ``key`` hashes the bytes that all windows with this anchor in
    this half share, so equal windows always have equal keys; ``kind`` hashes
    all bytes of the run. Very long texts are read in overlapping pieces.
    """
    half = -(-(least - _GRAM + 1) // 2)
    top = least - _GRAM
    of = xxhash.xxh3_64_intdigest
    for base in range(0, max(1, len(text) - least + 1), _PIECE):
        piece = text[base:base + _PIECE + least - 1]
        if len(piece) < least:
            return
        place = anchors(np.frombuffer(piece, np.uint8), least)
        offset = place - np.arange(len(place))
        part = offset // half
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(first, len(place)))
        for p, n, a, j in zip(first.tolist(), size.tolist(), place[first].tolist(), part[first].tolist()):
            yield (of(piece[a - half * j:a - min(half * j + half - 1, top) + least], j),
                   of(piece[p:p + n + least - 1], a - p), base + p, n, a - p)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def all_runs(docs: DataFrame, least: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "doc_id", "text_key", "start", "windows"]

        def rows_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            source = pa.array([f[5] for f in found], pa.int64())
            return pa.RecordBatch.from_arrays(
                [_signed([f[0] for f in found]), _signed([f[1] for f in found]), batch.column("doc_id").take(source),
                 batch.column("text_key").take(source), pa.array([f[2] for f in found], pa.int64()),
                 pa.array([f[3] for f in found], pa.int32())], names)

        for batch in batches:
            found: list[tuple] = []
            for i, text in enumerate(texts_of(batch)):
                for run in runs(text.encode(), least):
                    found.append((*run, i))
                    if len(found) >= 1 << 16:
                        yield rows_of(batch, found)
                        found = []
            if found:
                yield rows_of(batch, found)

    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        work, f"key long, kind long, doc_id {kind}, text_key long, start long, windows int")


def fetch(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``key, kind, copies, hot, body``: the bytes of the runs in ``wanted`` (one place of each kind)."""
    lists = wanted.groupBy(F.col("at.doc_id").alias("of_id"), F.col("at.text_key").alias("of_key")).agg(
        F.collect_list(F.struct("key", "kind", "copies", "hot", "at.start", "at.windows")).alias("wants"))
    some = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").join(
        lists, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))).select("text", "wants")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("kind", pa.int64()), ("copies", pa.int64()), ("hot", pa.bool_()), ("body", pa.binary())])
        for batch in batches:
            for text, wants in zip(texts_of(batch), batch.column("wants").to_pylist()):
                data = text.encode()
                for at in range(0, len(wants), 4096):
                    yield pa.RecordBatch.from_pylist([
                        {k: w[k] for k in ("key", "kind", "copies", "hot")}
                        | {"body": data[w["start"]:w["start"] + w["windows"] + least - 1]} for w in wants[at:at + 4096]], schema)

    return some.mapInArrow(work, "key long, kind long, copies long, hot boolean, body binary")


def _stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of the stretches of consecutive numbers."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(s[0]), len(s)) for s in np.split(starts, cuts)]


def compared(bodies: DataFrame, least: int, chunk: int = CHUNK) -> DataFrame:
    """``key, kind, first, windows``: stretches of repeated windows in each body; all bodies of a key meet in one task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows([h[3] for h in held], np.array([h[2] for h in held]), least)
            rows = [(h[0], h[1], first, n) for h, starts in zip(held, found) for first, n in _stretches(starts)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "kind", "first", "windows"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "copies", "body"))):
                if held and total > chunk and held[-1][0] != row[0]:
                    yield flush()
                    held, total = [], 0
                if held and held[-1][:2] == row[:2]:  # a repeated row's body again
                    continue
                held.append(row)
                total += len(row[3])
        if held:
            yield flush()

    return bodies.select("key", "kind", "copies", "body").repartition("key").sortWithinPartitions("key", "kind").mapInArrow(
        work, "key long, kind long, first int, windows int")


def hot_compared(bodies: DataFrame, least: int, part: int = 16) -> DataFrame:
    """The same for keys of very many kinds, with sums only: no task gets a key whole.

    Runs are cut into parts of ``part`` windows. The bytes all windows of a part
    share, then all bytes of the part, then, where parts differ, single windows
    are counted by hash (128 bits) with map-side combine.
    """
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for key, kind, copies, body in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "copies", "body"))):
                place = anchors(np.frombuffer(body, np.uint8), least)
                offset = place - np.arange(len(place))
                first = np.flatnonzero(np.concatenate([[True], (offset[1:] + 1) // part != (offset[:-1] + 1) // part]))
                for p, n in zip(first.tolist(), np.diff(np.append(first, len(place))).tolist()):
                    a = p + int(offset[p])
                    low = (int(offset[p]) + 1) // part * part - 1  # offsets low .. low + part - 1 share these bytes
                    common = body[max(a - max(low, 0), 0):a - (low + part - 1) + least]
                    rows.append((key, kind, copies, p, n, of(common, low + 1) - (1 << 63), of(body[p:p + n + least - 1], int(offset[p])) - (1 << 63)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                ["key", "kind", "copies", "first", "windows", "core", "whole"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, kind, copies, body, parts in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "copies", "body", "parts"))):
                for part_ in parts:
                    rows.extend((key, kind, copies, p, xxhash.xxh3_128_digest(body[p:p + least]))
                                for p in range(part_["first"], part_["first"] + part_["windows"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "kind", "copies", "first", "window"])

    parts = cut(bodies.select("key", "kind", "copies", "body").mapInArrow(
        cut_up, "key long, kind long, copies long, first int, windows int, core long, whole long"), "parts")
    sums = parts.groupBy("key", "core").agg(F.sum("copies").alias("times"), (F.min("whole") == F.max("whole")).alias("alike"))
    judged = cut(parts.join(sums.where("times > 1"), ["key", "core"]), "judged")
    mixed = judged.where("not alike").groupBy("key", "kind").agg(F.collect_list(F.struct("first", "windows")).alias("parts"))
    windows = cut(bodies.select("key", "kind", "copies", "body").join(mixed, ["key", "kind"]).mapInArrow(
        single, "key long, kind long, copies long, first int, window binary"), "windows")
    again = windows.groupBy("window").agg(F.sum("copies").alias("times")).where("times > 1")
    return judged.where("alike").select("key", "kind", "first", "windows").union(
        windows.join(again, "window").select("key", "kind", "first", F.lit(1).alias("windows")))


def repeated_spans(docs: DataFrame, least: int = LEAST, max_kinds: int = MAX_KINDS) -> DataFrame:
    """``doc_id, text_key, spans``: for each text the stretches of ``least``-byte windows that start elsewhere too, as (from, to) bytes.

    Runs of windows meet by key. A key seen once can't repeat. Where all runs of
    a key are equal, they are copies and repeat whole. Runs that differ are
    merged by kind and compared byte by byte through the transform, at most
    ``max_kinds`` kinds in a group; keys with more go through ``hot_compared``.
    """
    found = cut(all_runs(docs, least), "runs")
    # Written, so that the join reads plain exchanges and Spark can split a hot key.
    keys = cut(found.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "repeated")
    often = cut(found.join(keys, "key"), "often")
    place = F.struct("doc_id", "text_key", "start", "windows")
    kinds = cut(often.groupBy("key", "kind").agg(F.count("*").alias("copies"), F.min(place).alias("at")), "kinds")
    per_key = cut(kinds.groupBy("key").agg(F.count("*").alias("kinds")), "keys")
    same = often.join(per_key.where("kinds = 1"), "key").select(
        "doc_id", "text_key", F.struct("start", (F.col("start") + F.col("windows") + least - 1).alias("end")).alias("span"))
    differing = per_key.where("kinds > 1").withColumn("hot", F.col("kinds") > max_kinds)
    bodies = cut(fetch(docs, kinds.join(differing, "key"), least), "bodies", ("hot",))
    stretches = compared(bodies.where("not hot"), least)
    if differing.where("hot").limit(1).count():
        stretches = stretches.union(hot_compared(bodies.where("hot").dropDuplicates(["key", "kind"]), least))
    # One row per kind, its stretches in a list no longer than the kind's run.
    of_kind = cut(stretches.groupBy("key", "kind").agg(F.collect_list(F.struct("first", "windows")).alias("stretches")), "stretches")
    other = often.select("doc_id", "text_key", "key", "kind", "start").join(of_kind, ["key", "kind"]).select(
        "doc_id", "text_key", F.expr("transform(stretches, s -> struct(start + s.first as start, "
                                     f"start + s.first + s.windows + {least - 1} as end))").alias("found"))
    return same.select("doc_id", "text_key", F.array("span").alias("found")).union(other).groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_list("found")).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def remove_repeats(docs: DataFrame, least: int = LEAST, max_kinds: int = MAX_KINDS, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, removed ``spans`` and ``kept`` bytes of every row of ``docs``.

    Every byte covered by a ``least``-byte string that also starts anywhere else,
    in the same document or another, is removed; strings are judged on the input
    and don't cross documents. Null or empty text: nothing to remove. Repeated
    rows are copies of each other. Texts are kept apart by doc_id and hash, null
    ids by the hash. Other columns are not read; an empty table gives an empty
    table. ``kept`` is binary, as a cut may fall inside a character.
    """
    spans = cut(repeated_spans(docs, least, max_kinds), "spans").withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    joined = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").join(
        spans, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text, found in zip(texts_of(batch), batch.column("spans").to_pylist()):
            data, gone, at, kept = text.encode(), _merged(found), 0, []
            for start, end in gone:
                kept.append(data[at:start])
                at = end
            rest = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(),
                        [{"start": s, "end": e} for s, e in gone] if with_text else None, rest if with_text else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return map_batches(joined.select("doc_id", "text", "spans"), work,
                       f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                       "spans array<struct<start: long, end: long>>, kept binary")


def op2_suffix_dedup(spark, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), with_text=False).drop("spans", "kept")
