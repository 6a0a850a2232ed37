"""Near-duplicate paragraphs: MinHash bands, exact Jaccard, components, removal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, table, text_key, texts_of
from kindred.llm.components import connected_components
from kindred.llm.lines import _WORD, words_of
from kindred.llm.simhash import merge
from kindred.session import cut

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
MIN_WORDS = 20
BLOCK = 2048
#: A piece ends at the least hash of the word pairs within so many words on both sides.
REACH = 6
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two paragraphs of this similarity meet in a band at least."""
    return 1 - (1 - similarity ** rows) ** bands


#: Words whose hashes are worked on at once: arrays of this length stay in a core's cache.
STRIP = 1 << 15


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def marked_hashes(words: list[str]) -> np.ndarray:
    """Hashes whose last bit marks the words that end a sentence."""
    ends = np.fromiter((w[-1] in ".!?" for w in words), np.uint64, len(words))
    return word_hashes(words) & ~np.uint64(1) | ends


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, repeats included (fewer words: of all of them), rolled out of the words' hashes."""
    k = max(1, min(k, len(hashes)))
    rolled = np.zeros(max(1, len(hashes) - k + 1), np.uint64)
    for i in range(min(k, len(hashes))):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[i:i + len(rolled)]
    return _mixed(rolled + np.uint64(k))


def shingle_set(words: list[str], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words (fewer words: of all of them)."""
    return np.unique(shingles_of(word_hashes(words), k))


def strips(units: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Consecutive units of about ``STRIP`` values in all; a longer one is alone."""
    some, size = [], 0
    for unit in units:
        if some and size + len(unit) > STRIP:
            yield some
            some, size = [], 0
        some.append(unit)
        size += len(unit)
    if some:
        yield some


def bands_of(hashes: list[np.ndarray], k: int, bands: int, rows: int) -> np.ndarray:
    """For every unit (its words' hashes) one 64-bit key per band: the least values of ``rows`` hash functions, folded."""
    out = [np.zeros((0, bands), np.uint64)]
    for units in strips(hashes):
        shingles = [shingles_of(h, k) for h in units]
        flat, starts = np.concatenate(shingles), np.cumsum([0, *map(len, shingles[:-1])])
        least = np.empty((bands * rows, len(units)), np.uint64)
        for i in range(bands * rows):
            h = flat * _SEEDS[0, i]  # odd factors; the shingles are mixed already
            h += _SEEDS[1, i]
            least[i] = np.minimum.reduceat(h, starts)
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(units), 1))
        for r in range(rows):
            key = (key ^ least[r::rows].T) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.concatenate(out)


def paragraphs_of(text: str, min_words: int) -> Iterator[tuple[int, list[str]]]:
    """(line number, lower-cased words) of every line of ``min_words`` or more words."""
    for i, line in enumerate(text.lower().split("\n")):
        words = words_of(line)
        if len(words) >= min_words:
            yield i, words


def _name(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


Units = Callable[[str], Iterator[tuple[int, list[str]]]]


def occurrences(docs: DataFrame, units: Units, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, line, name, n_words, keys`` of every unit of text: ``name`` is a 128-bit hash of its words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, line, name, size, which, fresh, known = [], [], [], [], [], [], {}
        for i, text in enumerate(texts_of(batch)):
            for at, words in units(text):
                label = _name(words)
                if label not in known:
                    known[label] = len(fresh)
                    fresh.append(word_hashes(words))
                source.append(i), line.append(at), name.append(label), size.append(len(words)), which.append(known[label])
        rows_in = pa.array(source, pa.int64())
        keys = bands_of(fresh, k, bands, rows)[np.array(which, np.int64)].view(np.int64)
        ends = pa.array(np.arange(len(which) + 1, dtype=np.int32) * bands)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows_in), batch.column("text_key").take(rows_in), pa.array(line, pa.int32()),
             pa.array(name, pa.binary()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
            ["doc_id", "text_key", "line", "name", "n_words", "keys"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # a few texts at a time: each has the hashes of its words in memory
                yield part(batch.slice(at, 256))

    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        work, f"doc_id {kind}, text_key long, line int, name binary, n_words int, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, units: Units, k: int) -> DataFrame:
    """``name, shingles`` of the units in ``wanted`` (name, doc_id, text_key, line: one occurrence each)."""
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines"))
    some = docs.select(F.col("doc_id").alias("of_id"), text_key(F.col("text")).alias("of_key"), "text").join(
        lists, F.col("of_id").eqNullSafe(F.col("doc_id")) & (F.col("of_key") == F.col("text_key")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sets = [], []
        for text, lines in zip(texts_of(batch), batch.column("lines").to_pylist()):
            chosen = set(lines)
            for at, words in units(text):
                if at in chosen:
                    names.append(_name(words)), sets.append(shingle_set(words, k).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["name", "shingles"])

    return map_batches(some.select("text", "lines"), work, "name binary, shingles array<long>").dropDuplicates(["name"])


def _jaccard(a: str, b: str):
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def star_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of members to the most frequent paragraph of each of their buckets, verified exactly.

    The table of these is written, so a hot bucket's members are a skewed join that Spark splits.
    """
    hub = cut(members.groupBy("bucket").agg(F.max(F.struct("times", "name")).alias("hub")), "hubs")
    pairs = members.join(hub.select("bucket", F.col("hub.name").alias("hub")), "bucket").where("name <> hub").select(
        F.col("name").alias("a"), F.col("hub").alias("b")).distinct()
    return (pairs.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("sb")), "b")
            .where(_jaccard("sa", "sb") >= similarity).select("a", "b"))


def block_links(names: list, sets: list[np.ndarray], half: np.ndarray, similarity: float) -> list[tuple]:
    """Links that give the components of all pairs within ``sets`` of at least ``similarity``.

    ``half`` 0 and 1: only pairs between the two; all 2: every pair. Common
    shingles are counted by a product over those that occur twice, a few rows at
    a time.
    """
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    if not len(shared):
        return []
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    use = place[column] >= 0
    owner, column = owner[use], place[column][use]
    sizes, label, n = np.array([len(s) for s in sets]), np.arange(len(sets)), len(sets)
    width, room = 2048, max(1, min(n, 256))
    for at in range(0, n, room):
        top = min(n, at + room)
        common = np.zeros((top - at, n), np.float32)
        for c in range(0, len(shared), width):
            inside = (column >= c) & (column < c + width)
            m = np.zeros((n, width), np.float32)
            m[owner[inside], column[inside] - c] = 1
            common += m[at:top] @ m.T
        rows, cols = np.nonzero(common >= similarity / (1 + similarity) * (sizes[at:top, None] + sizes[None, :]) - 0.01)
        near = common[rows, cols]
        rows += at
        hit = (cols > rows) & (near / (sizes[rows] + sizes[cols] - near) >= similarity)
        hit &= (half[rows] == 2) | (half[rows] != half[cols])
        merge(label, rows[hit], cols[hit])
    return [(names[i], names[label[i]]) for i in np.flatnonzero(label != np.arange(n))]


def rest_links(members: DataFrame, comps: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links inside buckets whose members are in more than one component still.

    Buckets of the same members are searched once. A bucket of up to ``block``
    members is one group; a larger one is cut into blocks and every pair of
    blocks is a group, so no group exceeds two blocks and no pair is left out.
    """
    placed = members.join(comps.withColumnRenamed("node", "name"), "name", "left").withColumn(
        "comp", F.coalesce("comp", "name"))
    mark = F.xxhash64("name")
    open_buckets = placed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(name))").alias("mark"), F.sum(mark.bitwiseAND(F.lit((1 << 31) - 1))).alias("sum"),
        F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").groupBy("n", "mark", "sum").agg(
        F.min("bucket").alias("bucket"))
    sized = members.join(open_buckets.select("bucket", "n"), "bucket").select(
        "bucket", "name", F.ceil(F.col("n") / block).cast("int").alias("blocks")).withColumn(
        "mine", F.expr("cast(pmod(xxhash64(name, 1), blocks) as int)"))
    groups = sized.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "name", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"),
        F.when(F.col("blocks") == 1, 2).when(F.col("mine") == F.col("other"), 2)
        .when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("half"))
    dealt = groups.join(sets, "name").select("grp", "half", "name", "shingles").repartition("grp").sortWithinPartitions("grp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[pd.DataFrame]) -> pa.RecordBatch:
            pdf = pd.concat(rows, ignore_index=True)
            found = block_links(pdf["name"].tolist(), [np.asarray(s, np.int64) for s in pdf["shingles"]],
                                pdf["half"].to_numpy(), similarity) if len(pdf) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()),
                                               pa.array([b for _, b in found], pa.binary())], ["a", "b"])

        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, rows in batch.to_pandas().groupby("grp", sort=False):
                if held and held[0]["grp"].iloc[0] != rows["grp"].iloc[0]:
                    yield flush(held)
                    held = []
                held.append(rows)
        if held:
            yield flush(held)

    return dealt.mapInArrow(search, "a binary, b binary").distinct()


def unit_components(docs: DataFrame, units: Units, k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS, buckets: Callable[[DataFrame], DataFrame] | None = None,
                    **search) -> tuple[DataFrame, DataFrame]:
    """Every unit of text (``occurrences``), and ``name, times, at, comp`` of every different one.

    Equal units are merged first. Different ones that share a band key are
    compared with the most frequent one of the bucket, then, where a bucket is
    not yet one component, with each other. ``buckets`` makes more of them out of the
    units (``name, bucket``). ``comp`` names the component, ``at``
    is the least (doc_id, text, line) of the unit.
    """
    found = cut(occurrences(docs, units, k, bands, rows), "paragraphs")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "line")
    distinct = cut(found.groupBy("name").agg(F.first("keys").alias("keys"), F.count("*").alias("times"), F.min(place).alias("at")), "distinct")
    keyed = distinct.select("name", "times", F.explode("keys").alias("bucket"))
    if buckets:
        keyed = cut(keyed.union(distinct.select("name", "times").join(buckets(found), "name").select("name", "times", "bucket")), "keyed")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = cut(keyed.join(shared, "bucket"), "members")
    involved = members.select("name").distinct()
    wanted = distinct.join(involved, "name").select("name", "at.doc_id", "at.text_key", "at.line")
    sets = cut(shingle_sets(docs, wanted, units, k), "sets")
    links = cut(star_links(members, sets, similarity), "links")
    comps = connected_components(links)
    rest = cut(rest_links(members, comps, sets, similarity, **search), "rest")
    if rest.limit(1).count():
        comps = connected_components(links.union(rest))
    return found.drop("keys"), distinct.join(comps.withColumnRenamed("node", "name"), "name", "left").select(
        "name", "times", "at", F.coalesce("comp", "name").alias("comp"))


def paragraph_classes(docs: DataFrame, min_words: int = MIN_WORDS, k: int = SHINGLE, similarity: float = SIMILARITY,
                      bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, line, name, n_words, comp, first`` of every paragraph that has a copy or near copy.

    ``comp`` names the component (``unit_components``); ``first`` marks its one
    occurrence that stays, the least (doc_id, text, line).
    """
    found, named = unit_components(docs, partial(paragraphs_of, min_words=min_words), k, similarity, bands, rows)
    groups = named.groupBy("comp").agg(F.sum("times").alias("members"), F.min("at").alias("stays")).where("members > 1")
    classed = cut(named.join(groups, "comp").select("name", "comp", "stays"), "classes")
    return found.join(classed, "name").select(
        "doc_id", "text_key", "line", "name", "n_words", "comp",
        (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))
         & (F.col("line") == F.col("stays.line"))).alias("first"))


def segments(text: str, min_words: int) -> Iterator[tuple[int, str]]:
    """(first line number, text) of every paragraph, and of every run of shorter lines that has ``min_words`` in all."""
    run, held = [], 0
    for i, line in enumerate([*text.split("\n"), None]):
        n = min_words if line is None else len(words_of(line))
        if n < min_words:
            run.append(line)
            held += n
            continue
        if held >= min_words:
            yield i - len(run), "\n".join(run)
        run, held = [], 0
        if line is not None:
            yield i, line


def piece_starts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a piece: where words say so, not where the segment begins.

    ``hashes``: of the words (``marked_hashes``) of segments that begin at ``starts``. A
    piece ends where the hash of the words on both sides is the least within
    ``REACH`` words, sentence ends before all others. So a passage is cut alike
    wherever it stands, but for its edges.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    segment = np.zeros(len(hashes), np.int64)
    segment[starts[1:]] = 1
    segment = np.cumsum(segment)
    score = _mixed(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]) >> np.uint64(1)
    score |= (~hashes[:-1] & np.uint64(1)) << np.uint64(63)
    least = segment[1:] == segment[:-1]  # pairs of words inside a segment
    own = np.where(least, segment[:-1], -1 - np.arange(len(score)))
    for d in range(1, min(REACH + 1, len(score))):
        apart = own[d:] != own[:-d]
        least[d:] &= apart | (score[d:] < score[:-d])
        least[:-d] &= apart | (score[:-d] <= score[d:])
    return np.union1d(starts, np.flatnonzero(least) + 1)


def piece_names(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the words of each piece, in order."""
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    place = (np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))).astype(np.uint64)
    return np.stack([np.add.reduceat(_mixed(hashes * np.uint64(factor) + place * np.uint64(step)), starts) for factor, step in (
        (0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))], axis=1)


def pieces(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, text_key, line, word, size, name`` of every piece of every segment; ``word`` is the number of its first word there."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, line, hashes = [], [], []
        for i, text in enumerate(texts_of(batch)):
            for at, segment in segments(text, min_words):
                source.append(i), line.append(at), hashes.append(marked_hashes(words_of(segment.lower())))
        begins = np.cumsum([0, *map(len, hashes)])[:len(hashes)]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        starts = piece_starts(flat, begins)
        of = np.searchsorted(begins, starts, "right") - 1
        names = piece_names(flat, starts)
        rows_in = pa.array(np.array(source, np.int64)[of])
        ends = pa.py_buffer(np.arange(len(names) + 1, dtype=np.int32) * 16)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows_in), batch.column("text_key").take(rows_in), pa.array(np.array(line, np.int32)[of]),
             pa.array((starts - begins[of]).astype(np.int32)), pa.array(np.diff(np.append(starts, len(flat))).astype(np.int32)),
             pa.Array.from_buffers(pa.binary(), len(names), [None, ends, pa.py_buffer(names.tobytes())])],
            ["doc_id", "text_key", "line", "word", "size", "name"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # a few texts at a time: they have many pieces
                yield part(batch.slice(at, 256))

    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        work, f"doc_id {kind}, text_key long, line int, word int, size int, name binary")


def repeated_pieces(docs: DataFrame, removed: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, text_key, line, word, size`` of every piece that occurred before, outside the lines ``removed`` (doc_id, text_key, line)."""
    found = cut(pieces(docs, min_words), "pieces")
    names = found.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name")
    again = cut(found.join(names, "name"), "again")
    gone = removed.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), F.col("line").alias("of_line"))
    live = cut(again.join(gone, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
                          & (F.col("line") == F.col("of_line")), "left_anti"), "live")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "line", "word")
    first = live.groupBy("name").agg(F.min(place).alias("stays"))
    return live.withColumn("place", place).join(first, "name").where("not (place <=> stays)").select("doc_id", "text_key", "line", "word", "size")


def runs_of(gone: dict[int, int], min_words: int) -> list[list[int]]:
    """Runs [first word, end] of at least ``min_words`` words that the pieces ``gone`` (first word -> words) make side by side."""
    runs: list[list[int]] = []
    for a in sorted(gone):
        if runs and runs[-1][1] == a:
            runs[-1][1] = a + gone[a]
        else:
            runs.append([a, a + gone[a]])
    return [x for x in runs if x[1] - x[0] >= min_words]


def without_runs(segment: str, runs: list[list[int]]) -> str:
    spans, at, out = [m.span() for m in _WORD.finditer(segment)], 0, []
    for a, b in runs:
        out.append(segment[at:spans[a][0]])
        at = spans[b][0] if b < len(spans) else spans[b - 1][1]
    return "".join(out) + segment[at:]


def cleaned_text(text: str, lines: set[int], gone: dict[int, dict[int, int]], min_words: int) -> tuple[str, int]:
    """The text without ``lines`` and without runs of repeated pieces (first line -> first word -> words), and how many runs went."""
    runs = {at: found for at, pieces in gone.items() if at not in lines and (found := runs_of(pieces, min_words))}
    if not runs:
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lines) if lines else text, 0
    held = dict(enumerate(text.split("\n")))
    for at, segment in segments(text, min_words):
        if at in runs:
            for i in range(at, at + segment.count("\n") + 1):
                del held[i]
            if (rest := without_runs(segment, runs[at])).strip():
                held[at] = rest
    return "\n".join(held[i] for i in sorted(held) if i not in lines), sum(map(len, runs.values()))


def dedup_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, k: int = SHINGLE, similarity: float = SIMILARITY,
                     bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_paragraphs, n_removed, n_bytes, n_removed_bytes, class_ids, cleaned`` of every row of ``docs``.

    Paragraphs are lines of ``min_words`` words or more, compared by
    the Jaccard similarity of their distinct lower-cased ``k``-word shingles.
    Bands are tuned for recall (``recall(0.8)`` is 0.998), candidates verified
    exactly, and of each component all but the first occurrence are removed
    (``class_ids``: 64-bit names of the document's components, sorted; also of one that stays).
    What stays, runs of shorter lines included, is cut into pieces where its words
    say so (``piece_starts``); of pieces equal in lower-cased words all but the
    first go, if those side by side have ``min_words`` words or more. Each such
    run counts once in ``n_removed``. Null or empty text: no paragraphs, empty
    ``cleaned``. Equal rows share one result: the first occurrence stays in each
    of them. Null ids come last in the order of occurrences. Other columns are
    not read; an empty table gives an empty table.
    """
    classes = cut(paragraph_classes(docs, min_words, k, similarity, bands, rows), "lines")
    pieces_gone = repeated_pieces(docs, classes.where("not first"), min_words).groupBy(
        F.col("doc_id").alias("for_id"), F.col("text_key").alias("for_key")).agg(
        F.collect_set(F.struct("line", "word", "size")).alias("pieces"))
    per_doc = classes.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.collect_set(F.when(~F.col("first"), F.col("line"))).alias("lines"),
        F.sort_array(F.collect_set(F.xxhash64("comp"))).alias("class_ids"))
    removals = per_doc.join(pieces_gone, F.col("of_id").eqNullSafe(F.col("for_id")) & (F.col("of_key") == F.col("for_key")), "full").select(
        F.coalesce("of_id", "for_id").alias("of_id"), F.coalesce("of_key", "for_key").alias("of_key"), "lines", "pieces", "class_ids")
    joined = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").join(
        cut(removals, "removals"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for text, lines, again in zip(texts_of(batch), batch.column("lines").to_pylist(), batch.column("pieces").to_pylist()):
            lines, gone = set(lines or ()), {}
            for piece in again or ():
                gone.setdefault(piece["line"], {})[piece["word"]] = piece["size"]
            cleaned, runs = cleaned_text(text, lines, gone, min_words)
            n_bytes = len(text.encode())
            for column, value in zip(out, (sum(len(words_of(x)) >= min_words for x in text.split("\n")), len(lines) + runs, n_bytes,
                                           n_bytes - len(cleaned.encode()) if cleaned is not text else 0, cleaned)):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:4]), batch.column("class_ids"), pa.array(out[4], pa.string())],
            ["doc_id", "n_paragraphs", "n_removed", "n_bytes", "n_removed_bytes", "class_ids", "cleaned"])

    return map_batches(joined.select("doc_id", "text", "lines", "pieces", F.coalesce("class_ids", F.array().cast("array<long>")).alias("class_ids")), work,
                       f"doc_id {kind}, n_paragraphs long, n_removed long, n_bytes long, n_removed_bytes long, "
                       "class_ids array<long>, cleaned string")


def op7_paragraph_dedup(spark, folder: str) -> DataFrame:
    return dedup_paragraphs(table(spark, folder, "documents"))
