"""Ranked lexical search: hashed max-sketches give upper bounds, exact scores go in their descending order."""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kindred.llm.common import best_rows, map_batches, table
from kindred.session import cut

TOP = 10
COORDINATES = 1024
#: Terms and items that one block of queries holds (about): all that is broadcast or kept on the driver at once.
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 1 << 12
SLICE = 2048

# Bytes of a term stay (A-Z lower-cased, all beyond ASCII as they are); any other byte ends one.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def _bytes_of(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf``: length of every text with a term, and its terms out of ``vocabulary`` as arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        lengths, ends, found, times = [], [0], [], []
        for text in _bytes_of(batch):
            own = terms(text)
            counts = Counter(own)
            held = [t for t in counts if t in known] if len(counts) < len(known) else [t for t in known if t in counts]
            lengths.append(len(own))
            found += [known[t] for t in held]
            times += [counts[t] for t in held]
            ends.append(len(found))
        offsets = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], ["doc_id", "n", "term", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, n long, term array<int>, tf array<long>").where("n > 0")


class Ranking:
    """The best documents so far of every query of a block, over slices of documents."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, documents: int, length: int, top: int, coordinates: int):
        self.queries, self.weights, self.top = queries, weights, top
        self.documents, self.length, self.coordinates = documents, length, coordinates
        # Terms are dealt to coordinates by a multiplicative hash; a query counts its terms in each.
        self.at = (np.arange(len(weights), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % coordinates
        self.looked_up = np.zeros((coordinates, len(queries)))
        for q, own in enumerate(queries):
            np.add.at(self.looked_up[:, q], self.at[own], 1.0)
        self.best: list[list[tuple]] = [[] for _ in queries]
        self.rescored = 0

    def add(self, ids: list, lengths: list[int], counts: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """A slice of documents: their ids and lengths, how many terms each has, and these with their occurrences."""
        if not len(term):
            return
        # n and N may be large: m is computed in unbounded integers, once a document.
        m = np.array([10 + 90 * n * self.documents // self.length for n in lengths], np.int64)
        row = np.repeat(np.arange(len(ids)), counts)
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        sketch = np.zeros((len(ids), self.coordinates))
        np.maximum.at(sketch, (row, self.at[term]), impact.astype(float))
        # Sums of whole numbers in doubles: exact below 2**53, and beyond never too low with this margin.
        bounds = sketch @ self.looked_up * (1 + 2.0 ** -40)
        order = np.argsort(key := row * len(self.weights) + term)
        key, impact = np.append(key[order], -1), np.append(impact[order], 0)
        for q, own in enumerate(self.queries):
            bound, best = bounds[:, q], self.best[q]
            least = self.least(q)
            able = np.flatnonzero(bound >= max(least, 1))
            able = able[np.argsort(-bound[able], kind="stable")]
            start, step = 0, self.top
            while start < len(able) and bound[able[start]] >= least:
                some = able[start:start + step]
                wanted = some[:, None] * len(self.weights) + own
                spot = np.searchsorted(key[:-1], wanted)
                score = np.where(key[spot] == wanted, impact[spot], 0).sum(axis=1)
                self.rescored += len(some)
                for k in np.flatnonzero(score >= max(least, 1)):
                    i = ids[some[k]]
                    entry = (-int(score[k]), i is None, 0 if i is None else i)
                    if len(best) < self.top or entry < best[-1]:
                        bisect.insort(best, entry)
                        del best[self.top:]
                least, start, step = self.least(q), start + step, min(4 * step, SLICE)

    def least(self, q: int) -> int:
        return -self.best[q][-1][0] if len(self.best[q]) == self.top else 0


def _ranked(counted: DataFrame, ranking: tuple, names: list, kinds: tuple[str, str]) -> DataFrame:
    """``query, item_id, doc_id, score``: each task's best documents for every query."""
    shared = counted.sparkSession.sparkContext.broadcast(ranking)
    ddl = f"query int, item_id {kinds[0]}, doc_id {kinds[1]}, score long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                term, tf = part.column("term"), part.column("tf")
                ranking.add(part.column("doc_id").to_pylist(), part.column("n").to_pylist(), term.value_lengths().to_numpy(),
                            term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy())
        rows = [(q, names[q], None if none else i, -score) for q, best in enumerate(ranking.best) for score, none, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return counted.mapInArrow(work, ddl)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, coordinates: int = COORDINATES,
           block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every row of ``items``, of score above 0.

    A document's sketch has ``coordinates`` values: each the greatest impact
    (weight by rarity times damped frequency) of the terms that hash to it. For a
    block of queries at once, one matrix product sums the coordinates of each
    query's terms: never less than the score. Documents are then scored exactly
    in descending order of that bound, until it is below the least of the best
    found by the task. Every task sends on at most ``top`` rows a query.

    Terms outside all queries touch no score, so the sketch leaves them out.
    Queries are taken in blocks by hash, of about ``block_terms`` terms and
    ``block_items`` items: that bounds what is broadcast or sent to the driver
    (words and their document counts). One item is never split. A document whose
    sketch is loose (a very long text) is only scored more often.

    Null and empty texts, and texts without a term, are no documents here and
    find nothing as items. Every other row counts as a document of its own,
    repeated ones too; equal scores go by ascending doc_id, null last. Equal
    rows of ``items`` count once; different texts of one item_id are ranked each
    for itself. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    asked = items.select("item_id", "text").where("text is not null").distinct()
    # A term is over one byte on average; this only sizes the blocks.
    size = asked.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["items"] // block_items), -(-size["bytes"] // (2 * block_terms)))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        words = [sorted(set(terms(r["text"].encode()))) for r in rows]
        names, words = [r["item_id"] for r, w in zip(rows, words) if w], [w for w in words if w]
        vocabulary = {t: k for k, t in enumerate(sorted({t for w in words for t in w}))}
        counted = cut(occurrences(docs, vocabulary), "occurrences")
        total = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * int(k) + 1))) for k in df], np.int64)
        queries = [np.array([vocabulary[t] for t in w], np.int64) for w in words]
        found.append(_ranked(counted, (queries, weights, total["documents"], total["length"], top, coordinates), names, kinds)
                     .withColumn("block", F.lit(block)))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return best_rows(every, ["block", "query"], [F.desc("score"), F.asc_nulls_last("doc_id")], top, F.col("doc_id")).select(
        "item_id", "rank", "doc_id", "score")


SQL = r"""
with docs as (
    select doc_id, row_number() over () as row,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
    from documents where text is not null),
held as (select doc_id, row, len(words) as n, words from docs where len(words) > 0),
total as (select count(*) as all_docs, sum(n)::bigint as all_terms from held),
occurring as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(words) as term from held) group by all),
weight as (
    select term, floor(1000 * ln((2 * all_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from occurring, total group by term, all_docs),
asked as (
    select distinct item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark),
scored as (
    select item_id, text, row, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))))::bigint as score
    from asked join occurring using (term) join weight using (term), total
    group by all),
placed as (
    select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank
    from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from placed where rank <= 10
"""


def op11_lexical_search(spark, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
