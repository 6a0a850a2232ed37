"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, table, texts_of

BITS = 18
MAX_ROWS = 6000
ROUNDS = 20
COST = 1.0
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 22


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _B
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _marks(data: np.ndarray, bits: int, seen: np.ndarray, last: np.uint64 | None) -> np.uint64 | None:
    """Mark the buckets of the byte 3-grams, words and word pairs of ``data``; returns the last word's hash.

    N-grams of one word (2 to 9 times) have a bucket of their own besides, shared by all words.
    """
    wide = data.astype(np.uint64)
    if len(wide) > 2:
        seen[_buckets((wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) * _A + _C, bits)] = True
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return last
    # A word's hash is the sum of its bytes, each mixed with its place in the word.
    place = np.arange(len(data), dtype=np.int64) - np.concatenate(
        [np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    mixed = (wide + np.uint64(1)) * (place.astype(np.uint64) * _A + _B)
    mixed ^= mixed >> np.uint64(31)
    mixed *= _C
    mixed[space] = 0
    words = np.add.reduceat(mixed, starts) + (ends - starts).astype(np.uint64) * _A
    seen[_buckets(words, bits)] = True
    breaks = np.flatnonzero(words[1:] != words[:-1])
    run = int(np.diff(np.concatenate([[-1], breaks, [len(words) - 1]])).max())
    if run > 1:  # n-grams of one word, n up to 9, whatever the word
        seen[_buckets(np.arange(2, min(run, 9) + 1, dtype=np.uint64) * _C, bits)] = True
    before = words[:-1] if last is None else np.concatenate([[last], words[:-1]])
    seen[_buckets(before * _A + words[len(words) - len(before):] * _C, bits)] = True
    return words[-1]


def indicators(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of the whole text (an empty text has none).

    Long texts are taken in pieces cut at white space, with the pair across
    each cut; byte 3-grams across it hold the white space only in part.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    seen, last, at = np.zeros(1 << bits, bool), None, 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        last = _marks(data[at:end], bits, seen, last)
        at = end
    return np.flatnonzero(seen)


def _dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, costs: np.ndarray,
                  dim: int, rounds: int) -> np.ndarray:
    """Weights (the last is the bias) of the L2-loss hinge machine, one dual coordinate at a time."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    shift = 0.5 / costs
    norm = np.array([v @ v + 1 for v in values]) + shift
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[dim]) - 1 + shift[i] * alpha[i]
            new = max(alpha[i] - gradient / norm[i], 0.0)
            step = (new - alpha[i]) * y[i]
            worst = max(worst, abs(new - alpha[i]))
            if step:
                w[rows[i]] += step * values[i]
                w[dim] += step
                alpha[i] = new
        if worst < 1e-4:
            break
    return w


def _fit_once(rows: list[np.ndarray], y: np.ndarray, dim: int, rounds: int, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratio per bucket, machine weights) of one set of rows."""
    counts = [np.ones(dim), np.ones(dim)]
    for r, label in zip(rows, y):
        counts[int(label > 0)][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[r] for r in rows]
    values = [(v / max(np.sqrt(v @ v), 1e-9)).astype(np.float32) for v in values]
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    costs = cost * np.array([0.5 / max(share[int(label > 0)], 1e-3) for label in y])
    return ratio, _dual_descent(rows, values, y, costs, dim, rounds)


def margin(row: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float) -> float:
    v = ratio[row]
    return float(weights[row] @ v / max(np.sqrt(v @ v), 1e-9) + bias) if len(row) else float(bias)


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps on the log loss, lightly damped)."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        s = p * (1 - p)
        g = np.array([((p - t) * margins).sum() + 0.01 * (a - 1), (p - t).sum() + 0.01 * b])
        h = np.array([[(s * margins ** 2).sum() + 0.01, (s * margins).sum()], [(s * margins).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, cost: float = COST):
    """(ratio, weights, bias, slope, offset); without rows of both classes the score is the share of label 1."""
    dim, y = 1 << bits, np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        part = float((y > 0).mean()) if len(y) else 0.5
        part = min(max(part, 1e-3), 1 - 1e-3)
        return np.zeros(dim), np.zeros(dim), 0.0, 1.0, float(np.log(part / (1 - part)))
    fold, outside = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        ratio, w = _fit_once([rows[i] for i in inside], y[inside], dim, rounds, cost)
        for i in np.flatnonzero(fold == k):
            outside[i] = margin(rows[i], ratio, w[:dim], w[dim])
    slope, offset = _logistic(outside, y)
    ratio, w = _fit_once(rows, y, dim, rounds, cost)
    return ratio, w[:dim], float(w[dim]), slope, offset


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` of rows that may be learned from: crc32 of the id as text mod 3 is not 1.

    Null ids and labels are left out; a document labelled twice gets its more frequent label, 1 on a tie.
    """
    return labels.where("doc_id is not null and quality in (0, 1)").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, rounds: int = ROUNDS,
        cost: float = COST):
    """Fit on at most ``max_rows`` labelled documents, those of the least hash of doc_id; the model as from ``fit_rows``.

    Only ids are ranked to choose them. Of an id that rows share, the text of fewest
    buckets (ties: the least) is learned from, however many rows those are. The bucket
    numbers meet in one task, bounded by ``max_rows``, which returns one row per bucket
    (2**bits at most) and the five numbers of the curve.
    """
    chosen = training_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"),
             pa.array([indicators(t, bits).astype(np.int32) for t in texts_of(batch)], pa.list_(pa.int32()))],
            ["doc_id", "label", "row"])

    rows = map_batches(docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", "text"), hashed,
                       f"doc_id {kind}, label int, row array<int>")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.size("row").alias("size"), "row")).alias("least")).select(
        "doc_id", "label", "least.row")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ratio, weights, bias, slope, offset = fit_rows(
            [np.asarray(r, np.int32) for r in pdf["row"]], pdf["label"].to_numpy(), bits, rounds, cost)
        used = np.flatnonzero((ratio != 0) | (weights != 0))
        curve = [(-1, bias, 0.0), (-2, slope, offset)]
        return pd.concat([pd.DataFrame({"bucket": used, "ratio": ratio[used], "weight": weights[used]}),
                          pd.DataFrame(curve, columns=["bucket", "ratio", "weight"])])

    model = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "bucket long, ratio double, weight double").toPandas()
    if not len(model):
        return fit_rows([], np.zeros(0), bits)
    ratio, weights = np.zeros(1 << bits), np.zeros(1 << bits)
    cells = model[model.bucket >= 0]
    ratio[cells.bucket], weights[cells.bucket] = cells.ratio, cells.weight
    numbers = model.set_index("bucket")
    return (ratio, weights, float(numbers.at[-1, "ratio"]), float(numbers.at[-2, "ratio"]), float(numbers.at[-2, "weight"]))


def score(docs: DataFrame, model, bits: int = BITS, column: str = "text") -> DataFrame:
    """``row, score`` for every row of ``docs`` (``row``: all its columns); the model is broadcast (2**bits numbers twice).

    One pass over whole texts, nothing is shuffled. Null text counts as empty and
    gets the score of the bias alone. Nothing but the text enters a score.
    """
    ratio, weights, bias, slope, offset = model
    shared = docs.sparkSession.sparkContext.broadcast((ratio.astype(np.float32), (ratio * weights).astype(np.float32)))
    plain = docs.select(F.struct(*docs.columns).alias("row"))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        scale, product = shared.value
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found = indicators(text or "", bits)
            v = scale[found]
            m = product[found].sum(dtype=np.float64) / max(np.sqrt((v * v).sum(dtype=np.float64)), 1e-9) + bias if len(found) else bias
            out[i] = 1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30)))
        return pd.Series(out)

    return plain.withColumn("score", scored(F.col("row")[column]))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``held_out``: crc32 of the id as text mod 3 is 1 (false for a null id). No
    labels of both classes to learn from: every score is the share of label 1
    (0.5 without labels). Repeated rows get equal scores; an empty table gives
    an empty table; other columns are not read.
    """
    known = docs.select("doc_id", "text")
    scored = score(known, fit(known, labels, max_rows))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
