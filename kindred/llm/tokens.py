"""Token counts of whole texts by a two-tier lookup of pre-token lengths."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, table, texts_of

# The pre-token pattern and the special strings of the word-end vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

#: Documents (about) that the list of frequent pre-tokens is made from, and the tasks that count them.
SAMPLE, SAMPLE_TASKS = 1 << 13, 8

# Letters, marks and signs whose lower case, composition and class are the same in every Unicode version in use.
_PLAIN = regex.compile("[\x00-\x1b\x20-˿‐-…€]*+")
_PRE = regex.compile(PRE_TOKEN)
_SPLIT = regex.compile("(" + "|".join(map(regex.escape, SPECIAL)) + ")")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Lengths(dict):
    """Second tier: lengths this worker has met, in bounded room; a miss asks ``encode``."""

    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.room:
            self.clear()
        self[piece] = n = self.encode(piece)
        return n


class _Frequent(dict):
    """First tier: the broadcast table; a miss goes to the worker's cache and is not kept here."""

    def __init__(self, table: dict[str, int], cache: _Lengths):
        super().__init__(table)
        self.cache = cache

    def __missing__(self, piece: str) -> int:
        return self.cache[piece]


class Counting:
    """Counts tokens of texts as the library's ``encode`` gives them, by summing pre-token lengths.

    A pre-token is encoded on its own by the library. Texts of ordinary letters
    are lower-cased and cut here; any other text is normalised and cut by the
    library's own steps, so its rules hold for every script.
    """

    def __init__(self, path: str, frequent: dict[str, int], room: int = 1 << 19):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = self.library.model
        self.lengths = _Frequent(frequent, _Lengths(
            lambda piece: len(self.library.encode(piece, add_special_tokens=False).ids), room))
        self.by_bytes = _Lengths(lambda piece: len(model.tokenize(piece)), room)

    def count(self, text: str) -> int:
        if plain(text):
            return sum(map(self.lengths.__getitem__, _PRE.findall(text.lower())))
        total = 0
        for part in _SPLIT.split(text):
            if part in SPECIAL:
                total += 1
            elif plain(part):
                total += sum(map(self.lengths.__getitem__, _PRE.findall(part.lower())))
            elif part:
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                total += sum(self.by_bytes[piece] for piece, _ in pieces)
        return total


def plain(text: str) -> bool:
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


_COUNTING: dict[tuple, Counting] = {}


def counting(path: str, version: str, frequent: dict[str, int]) -> Counting:
    """The worker's counter: made once per worker process and table, kept between tasks."""
    if (path, version) not in _COUNTING:
        _COUNTING.clear()
        _COUNTING[path, version] = Counting(path, frequent)
    return _COUNTING[path, version]


def frequent_pre_tokens(docs: DataFrame, top: int, sample: int) -> list[str]:
    """About the ``top`` most frequent pre-tokens, judged by about ``sample`` documents drawn with a fixed seed.

    The drawn texts are dealt to ``SAMPLE_TASKS`` tasks, each of which counts its
    share and sends its ``top`` pre-tokens; the driver adds these few lists up.
    The list only decides what is looked up fast, never a result.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                if plain(text):
                    seen.update(_PRE.findall(text.lower()))
                if len(seen) > 64 * top:
                    seen = Counter(dict(seen.most_common(32 * top)))
        best = seen.most_common(top)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["piece", "n"])

    rows = docs.count()  # of Parquet tables: read off the footers
    drawn = docs.select("text").sample(min(1.0, sample / max(rows, 1)), seed=1).repartition(SAMPLE_TASKS)
    seen: Counter = Counter()
    for r in drawn.mapInArrow(summarise, "piece string, n long").collect():
        seen[r["piece"]] += r["n"]
    return sorted(seen, key=lambda p: (-seen[p], p))[:top]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, top: int = 1 << 14,
                 sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Tokens are those of the vocabulary file at ``path`` by its library, without
    begin, end or added special tokens; special strings inside a text count as
    one token each, as the library takes them. The lengths of the ``top`` most
    frequent pre-tokens of about ``sample`` documents are broadcast (at most ``top``
    strings); misses are encoded once per worker and kept in a bounded cache.
    No pre-token is shuffled; of texts only the drawn ones are, once. Null
    or empty text: 0 bytes, 0 tokens, within the limit. Repeated rows and null
    ids are counted like others; other columns are not read; an empty table
    gives an empty table. Memory holds one Arrow batch and the pieces of one text.
    """
    path = path or default_path()
    pieces = frequent_pre_tokens(docs, top, sample)
    first = Counting(path, {})
    shared = docs.sparkSession.sparkContext.broadcast({p: first.lengths[p] for p in pieces})
    version = f"{docs.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = counting(path, version, shared.value)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"),
             pa.array(map(counter.count, texts_of(batch)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))
