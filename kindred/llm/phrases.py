"""Phrase collocations by counting quotient filters of packed word-id n-grams."""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import best_rows, table
from kindred.session import cut, cut_counting

LEAST = 10
TOP = 2000
#: Words that have an id in every task (at most), and their length: 33 MB of text at the utmost.
MAX_WORDS, MAX_BYTES = 1 << 19, 64
#: Words a task holds before it sends its counts on.
FLUSH = 1 << 21
SHARD_WORDS = 1 << 20
ID_BITS = 21
BITS = 3 * ID_BITS

# A-Z lower-cased; signs that end a piece become \n, the tab a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
# Odd, so that both have an inverse for products of 63 bits.
_FACTORS = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_MASK = np.uint64((1 << BITS) - 1)


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in order, ``.`` between two pieces."""
    return (text or b"").translate(_BYTES).replace(b"\n", b" . ").split()


def permuted(x: np.ndarray) -> np.ndarray:
    """An invertible mix of 63-bit numbers."""
    for factor in _FACTORS:
        x = x * np.uint64(factor) & _MASK
        x = x ^ (x >> np.uint64(32))
    return x


def restored(x: np.ndarray) -> np.ndarray:
    for factor in reversed(_FACTORS):
        x = x ^ (x >> np.uint64(32))  # its own inverse: two shifts of 32 leave nothing of 63 bits
        x = x * np.uint64(pow(factor, -1, 1 << BITS)) & _MASK
    return x


class QuotientFilter:
    """Counts of ``width``-bit numbers, sorted, without loss.

    The high bits of a number are its quotient: entry i in bucket q is bit q + i
    of ``high``, so a bucket is a run of ones. The low bits, the remainder, are kept
    in full in as few bytes as hold them. A count is one byte, from 255 on eight
    more in ``large``.
    """

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, width: int):
        self.numbers, self.counts, self.width = numbers, counts, width

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Sums of the counts of sorted filters."""
        numbers = np.concatenate([f.numbers for f in filters])
        order = np.argsort(numbers, kind="stable")  # finds the sorted runs
        numbers, counts = numbers[order], np.concatenate([f.counts for f in filters])[order]
        first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        return cls(numbers[first], np.add.reduceat(counts, first), filters[0].width)

    def to_bytes(self) -> bytes:
        n = len(self.numbers)
        quotient_bits = min(max(n.bit_length() - 1, 0), self.width)
        rest = self.width - quotient_bits
        quotients = (self.numbers >> np.uint64(rest)).astype(np.int64)
        high = np.zeros(n + (1 << quotient_bits), np.uint8)
        high[quotients + np.arange(n)] = 1
        low = (self.numbers & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :-(-rest // 8)]
        small = np.minimum(self.counts, 255).astype(np.uint8)
        large = self.counts[self.counts >= 255].astype("<i8")
        parts = [np.packbits(high).tobytes(), low.tobytes(), small.tobytes(), large.tobytes()]
        return struct.pack("<5q", n, quotient_bits, self.width, len(parts[0]), len(parts[1])) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        n, quotient_bits, width, n_high, n_low = struct.unpack_from("<5q", data)
        rest, at = width - quotient_bits, 40
        high = np.unpackbits(np.frombuffer(data, np.uint8, n_high, at), count=n + (1 << quotient_bits))
        quotients = np.flatnonzero(high) - np.arange(n)
        low = np.zeros((n, 8), np.uint8)
        low[:, :-(-rest // 8)] = np.frombuffer(data, np.uint8, n_low, at + n_high).reshape(n, -1)
        counts = np.frombuffer(data, np.uint8, n, at + n_high + n_low).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", -1, at + n_high + n_low + n)
        return cls(quotients.astype(np.uint64) << np.uint64(rest) | low.view("<u8").ravel(), counts, width)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f``: occurrences of every word; in a row without a word those of all words of the language."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                counts.pop(b".", None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(counts) + 1), pa.string()), pa.array([None, *counts], pa.binary()).cast(pa.string()),
                     pa.array([counts.total(), *counts.values()], pa.int64())], ["lang", "word", "f"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                seen[lang].update(words(text.as_py()))
            if sum(map(len, seen.values())) > FLUSH // 4:
                yield from sent()
        yield from sent()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        work, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(frequent: DataFrame, count: int, max_words: int) -> tuple[DataFrame, dict[str, dict[bytes, int]]]:
    """``id, lang, word, f`` of all frequent words, and the ids of those in the tasks' dictionary.

    Up to ``max_words`` words of at most ``MAX_BYTES`` bytes are in the dictionary: all, or
    the more frequent by steps of an eighth of a doubling (at most about 500
    steps, counted by the cluster). The others get larger ids.
    """
    spark = frequent.sparkSession
    step = F.floor(8 * F.log2("f"))
    short = frequent.where(F.octet_length("word") <= MAX_BYTES)
    lowest = 0
    if count > max_words:
        room = max_words
        for r in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            lowest, room = r["step"] + 1, room - r["count"]
            if room < 0:
                break
            lowest = r["step"]
    inside = step >= lowest
    known = short.where(inside).select("lang", "word", "f").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    ids: dict[str, dict[bytes, int]] = defaultdict(dict)
    for k, (lang, word) in enumerate(zip(known["lang"].to_pylist(), known["word"].cast(pa.binary()).to_pylist())):
        ids[lang][word] = k + 1
    table = spark.createDataFrame(known.append_column("id", pa.array(range(1, len(known) + 1), pa.int64())),
                                  "lang string, word string, f long, id long").select("id", "lang", "word", "f")
    if len(known) < count:
        others = frequent.where(~inside | (F.octet_length("word") > MAX_BYTES)).select(
            (F.lit(1 << ID_BITS) + F.monotonically_increasing_id()).alias("id"), "lang", "word", "f")
        table = table.unionAll(others)
    return cut(table, "words"), dict(ids)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            yield lang, words(text.as_py())


def filters(docs: DataFrame, shared, shard_bits: int) -> DataFrame:
    """``shard, filter``: each task's counts of the packed n-grams of 2 and 3 dictionary words, by the first bits of the mix."""
    width = BITS - shard_bits

    def sent(a: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of the n-grams that begin before the last two words."""
        one, two, three = a[:-2], a[1:-1], a[2:]
        pair = (one > 0) & (two > 0)
        packed = one << np.uint64(2 * ID_BITS) | two << np.uint64(ID_BITS)
        grams = np.concatenate([packed[pair], (packed | three)[pair & (three > 0)]])
        numbers, counts = np.unique(permuted(grams), return_counts=True)
        shards = (numbers >> np.uint64(width)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else []
        for start, end in zip(starts, [*starts[1:], len(shards)]):
            inside = numbers[start:end] & np.uint64((1 << width) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shards[start]], pa.int64()),
                 pa.array([QuotientFilter(inside, counts[start:end], width).to_bytes()], pa.binary())], ["shard", "filter"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, gap = [], 0, np.zeros(1, np.uint64)
        for lang, own in _texts(batches):
            known = shared.value.get(lang, {})
            held += [np.fromiter((known.get(w, 0) for w in own), np.uint64, len(own)), gap]
            size += len(own) + 1
            if size >= FLUSH:
                a = np.concatenate(held)
                yield from sent(a)
                held, size = [a[-2:]], 2
        yield from sent(np.concatenate([*held, gap, gap]))

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(work, "shard long, filter binary")


def merged(shards: DataFrame, shard_bits: int, least: int) -> DataFrame:
    """``w1, w2, w3, f`` (``w3`` 0 for two words) of the n-grams found ``least`` times or more: one sorted filter out of each shard's."""
    width = BITS - shard_bits

    def merge(group: pa.Table) -> pa.Table:
        whole = QuotientFilter.merged([QuotientFilter.from_bytes(f.as_py()) for f in group.column("filter")])
        often = whole.counts >= least
        shard = np.uint64(group.column("shard")[0].as_py() << width)
        x = restored(whole.numbers[often] | shard)
        part = np.uint64((1 << ID_BITS) - 1)
        return pa.table({name: pa.array((x >> np.uint64(at) & part).astype(np.int64)) for name, at in
                         (("w1", 2 * ID_BITS), ("w2", ID_BITS), ("w3", 0))} | {"f": pa.array(whole.counts[often], pa.int64())})

    return shards.groupBy("shard").applyInArrow(merge, "w1 long, w2 long, w3 long, f long")


def other_grams(docs: DataFrame, shared, known: DataFrame, least: int) -> DataFrame:
    """``w1, w2, w3, f`` of the n-grams with a frequent word that has no place in the tasks' dictionary, counted as words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            rows = list(seen)
            columns = [pa.array([r[0] for r in rows], pa.string())]
            columns += [pa.array([r[c] for r in rows], pa.binary()).cast(pa.string()) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], ["lang", "a", "b", "c", "f"])
            seen.clear()

        for lang, own in _texts(batches):
            ids = shared.value.get(lang, {})
            for a, b, c in zip(own, own[1:], [*own[2:], b"."]):
                if a != b"." != b:
                    if a not in ids or b not in ids:
                        seen[lang, a, b, None] += 1
                    if c != b"." and (a not in ids or b not in ids or c not in ids):
                        seen[lang, a, b, c] += 1
            if len(seen) > FLUSH // 4:
                yield from sent()
        yield from sent()

    grams = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        work, "lang string, a string, b string, c string, f long").groupBy("lang", "a", "b", "c").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    for word, name in (("a", "w1"), ("b", "w2"), ("c", "w3")):
        own = known.select("lang", F.col("word").alias(word), F.col("id").alias(name))
        grams = grams.join(own, ["lang", word], "left")
    return grams.select("w1", "w2", F.coalesce("w3", F.lit(0)).alias("w3"), "f")


def _score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (l * r)) in exact decimals; at most 1000000."""
    whole = "cast({} as decimal(18, 0))"
    a, left, right = (whole.format(x) for x in (a, left, right))
    return F.expr(f"(1000000 * {a} * {a}) div ({left} * {right})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, max_words: int = MAX_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 or 3 words of every language.

    (1) Words are counted; a phrase found ``least`` times has only words found as
    often, so only these get ids. (2) Every task packs the n-grams of 2 and 3 such
    words into numbers, mixes these invertibly and counts them in quotient filters,
    one for each value of the first bits (the shard). (3) A shard's sorted filters
    are merged into one, and the n-grams found ``least`` times are turned back
    into ids. Shards are so many that each has about ``shard_words`` n-grams of two
    words at the utmost, however often one n-gram occurs. (4) Counts of the parts are
    joined, phrases inside frequent longer ones dropped, the rest ranked.

    The dictionary that is broadcast has at most ``max_words`` words of at most
    64 bytes. N-grams with a frequent word beyond that are counted by their words
    in a grouped table: the same counts, only slower.

    A null lang is ``und``, a null text empty; an empty text, one word, or a piece
    of one word holds no phrase. Repeated rows count each. Texts of any length
    are taken whole. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    counts, _ = cut_counting(word_counts(docs).where(F.col("word").isNull() | (F.col("f") >= least)), "word-counts")
    frequent = counts.where(F.col("word").isNotNull())
    totals = counts.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    known, ids = numbered(frequent, count := frequent.count(), max_words)
    shared = spark.sparkContext.broadcast(ids)
    shard_bits = min(max(size // shard_words, 1).bit_length(), 32)
    grams = merged(filters(docs, shared, shard_bits), shard_bits, least)
    if sum(map(len, ids.values())) < count:
        grams = grams.unionAll(other_grams(docs, shared, known, least))
    grams = cut(grams, "grams")
    # Occurrences of single words: a table of bounded size while all words are in the dictionary.
    single = known.select("id", F.col("f").alias("own"), "lang")
    single = F.broadcast(single) if count <= max_words else single

    def occurring(df: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(single.select(F.col("id").alias(word), F.col("own").alias(name)), word)

    pairs = grams.where("w3 = 0").select("w1", "w2", F.col("f").alias("a"))
    triples = grams.where("w3 > 0").withColumnRenamed("f", "a")
    # The most frequent longer phrase around each pair.
    around = triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a").groupBy(
        F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("longer"))
    free = pairs.join(around, ["w1", "w2"], "left").where("longer is null or 100 * longer < 50 * a")
    two = occurring(occurring(free, "w1", "l"), "w2", "r").select(
        "w1", "w2", F.lit(0).cast("long").alias("w3"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    cuts = triples.join(pairs.select("w1", "w2", F.col("a").alias("l2")), ["w1", "w2"]).join(
        pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["w2", "w3"])
    cuts = occurring(occurring(cuts, "w1", "l1"), "w3", "r2").withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    three = cuts.select("w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    scored = cut(two.unionAll(three).join(single.select(F.col("id").alias("w1"), "lang"), "w1"), "scored")
    # Only phrases that reach the last rank's score and count need their words, to break ties.
    order = [F.desc("score"), F.desc("a")]
    last = best_rows(scored.select("lang", "score", "a", "w1", "w2", "w3"), ["lang"], order, top, F.struct("w1", "w2", "w3")).groupBy("lang").agg(
        F.min(F.struct("score", "a")).alias("last"))
    able = scored.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    for name in ("w1", "w2", "w3"):
        text = known.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"))
        able = able.join(text, name, "left" if name == "w3" else "inner")
    able = able.withColumn("phrase", F.concat_ws(" ", "w1_word", "w2_word", "w3_word"))
    ranked = best_rows(able, ["lang"], [*order, F.asc("phrase")], top, F.col("phrase"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece
    from documents),
split as (select lang, row_number() over () as piece, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
one as (select lang, piece, unnest(w) as a, unnest(range(len(w))) as place from split),
run as (
    select lang, a, lead(a, 1) over (partition by piece order by place) as b, lead(a, 2) over (partition by piece order by place) as c
    from one),
grams as (
    select lang, 1 as k, a as phrase from run
    union all select lang, 2, a || ' ' || b from run where b is not null
    union all select lang, 3, a || ' ' || b || ' ' || c from run where c is not null),
counted as materialized (select lang, k, phrase, count(*) as f from grams group by all),
total as (select lang, sum(f)::bigint as n from counted where k = 1 group by lang),
candidates as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counted where k > 1 and f >= 10),
cuts as materialized (
    select lang, k, phrase, a, w, 1 as head, w[1] as x, array_to_string(w[2:], ' ') as y from candidates
    union all
    select lang, k, phrase, a, w, 2, w[1] || ' ' || w[2], w[3] from candidates where k = 3),
scored as (
    select c.lang, c.k, c.phrase, c.a, c.w, c.head, p.f as l, q.f as r,
           ((1000000::hugeint * c.a * c.a) // (p.f::hugeint * q.f))::bigint as score
    from cuts c
    join counted p on p.lang = c.lang and p.phrase = c.x
    join counted q on q.lang = c.lang and q.phrase = c.y),
lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, head) = 1),
around as (
    select lang, p as phrase, max(a) as longer
    from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as p from candidates where k = 3) group by lang, p),
free as (
    select x.* from lowest x left join around y on x.k = 2 and x.lang = y.lang and x.phrase = y.phrase
    where y.longer is null or 100 * y.longer < 50 * x.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
from ranked join total using (lang) where rank <= 2000
"""


def op13_phrase_mining(spark, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
