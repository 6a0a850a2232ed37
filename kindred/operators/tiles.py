"""Tiles: rows packed into bounded blocks, so that pairwise work is matrix work.

A tile is one row holding up to about ``rows`` ids and their vectors. All
pairwise operators join tiles with tiles on an explicit partner number and run
one matrix product per tile pair inside Arrow batches. No task sees more than
the two tiles it is working on, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kindred.operators.ranks import top_n
from kindred.session import cut

TILE_ROWS = 1024
# Pairs of tiles are dealt to about TASKS keys, a part of one side against a part of the other:
# parts of LEAST tiles where there are few, of MOST at most.
TASKS, LEAST, MOST = 48, 4, 256
# Numbers of the vectors that a task of a ``stream`` holds.
HELD_NUMBERS = 1 << 24
# Largest number that a ``Screen`` takes; products of single precision end at 1e38.
LARGEST = 1e12


def distinct_vectors(df: DataFrame, keys: Sequence[str], id_col: str, vec_col: str,
                     weight: str | None = None) -> DataFrame:
    """One row per different vector of a group: lowest ``id`` and number of ``copies``.

    Copies are merged before any pairwise work (with map-side combine), so a
    vector stored a billion times costs as much as one stored once. ``weight``
    names a column telling how many rows a row stands for.
    """
    return df.groupBy(*keys, vec_col).agg(
        F.min(id_col).alias("id"), (F.sum(weight) if weight else F.count(F.lit(1))).alias("copies"))


def write_distinct(df: DataFrame, keys: Sequence[str], id_col: str, vec_col: str, name: str) -> DataFrame:
    """``distinct_vectors`` written, the vectors that have copies in a folder of their own."""
    made = distinct_vectors(df, keys, id_col, vec_col).withColumn("copied", F.col("copies") > 1)
    return cut(made, name, ("copied",))


def _copied(distinct: DataFrame, keys: Sequence[str], vec_col: str) -> DataFrame:
    return distinct.where("copied").select(
        *keys, F.col(vec_col), F.xxhash64(vec_col).alias("_h"), F.col("id").alias("_rep"))


def with_rep(rows: DataFrame, distinct: DataFrame, keys: Sequence[str], id_col: str, vec_col: str,
             out: str = "rep") -> DataFrame:
    """Rows without their vector, with the id that stands for it in ``write_distinct``.

    A vector without copies stands for itself, so only those with copies are
    joined, by hash first; the table of them is usually small enough to broadcast.
    """
    joined = rows.withColumn("_h", F.xxhash64(vec_col)).join(
        _copied(distinct, keys, vec_col), [*keys, "_h", vec_col], "left")
    return joined.withColumn(out, F.coalesce("_rep", id_col)).drop("_h", "_rep", vec_col)


def copies_of(rows: DataFrame, distinct: DataFrame, keys: Sequence[str], id_col: str, vec_col: str,
              keep: int) -> DataFrame:
    """The ``keep`` lowest ids of every vector that has copies: ``keys, rep, id_col``.

    Ranked before the shuffle, so each task sends at most ``keep`` ids per vector.
    """
    joined = rows.withColumn("_h", F.xxhash64(vec_col)).join(
        _copied(distinct, keys, vec_col), [*keys, "_h", vec_col]).select(
        *keys, F.col("_rep").alias("rep"), id_col)
    return top_n(joined, [*keys, "rep"], [F.col(id_col)], keep, "_r").drop("_r")


def hash_slot(id_col: str | Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), slots.cast("long"))


def pack(df: DataFrame, keys: Sequence[str], fields: Sequence[str], vec_col: str,
         prefix: str) -> DataFrame:
    """Collect the rows of each tile into parallel arrays, in the order of ``fields``."""
    packed = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*fields, vec_col))).alias("_rows"))
    arrays = [F.col(f"_rows.{f}").alias(f"{prefix}{f}") for f in fields]
    return packed.select(*keys, *arrays, F.flatten(F.col(f"_rows.{vec_col}")).alias(f"{prefix}vec"))


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], left_no: str | Column, right_no: str | Column,
         condition: Column | None = None) -> DataFrame:
    """All pairs of written tiles of the same ``keys`` (that meet ``condition``).

    A pair is never shuffled as a pair. Both sides of a group are cut into parts by
    the group's share of all pairs, about TASKS pairs of parts in all, and a tile goes
    once to every part of the other side: a table travels about sqrt(TASKS) times
    whatever its size, until parts would hold over MOST tiles. A task
    holds one part of the right side. ``left_no`` and ``right_no`` deal the tiles.
    """
    left, right, _ = _dealt(left, right, keys, left_no, right_no, MOST)
    # Merged, not broadcast: the size Spark sees is that before the copies are made.
    pairs = left.join(right.hint("merge"), [*keys, "_lp", "_rp"]).drop("_lp", "_rp")
    return pairs if condition is None else pairs.where(condition)


def _dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], left_no: str | Column, right_no: str | Column,
           most: int) -> tuple[DataFrame, DataFrame, Row | None]:
    """Both sides with the parts ``_lp, _rp`` a tile goes to; without keys also their numbers ``_ls, _rs``."""
    def count(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))

    left_n, right_n = count(left, "_l"), count(right, "_r")
    sizes = cut(left_n.join(right_n, list(keys)) if keys else left_n.crossJoin(right_n), "tile-pairs")
    work = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 1.0
    share = F.ceil(F.sqrt(F.col("_l").cast("double") * F.col("_r") * F.lit(TASKS / work)))

    def parts(n: str) -> Column:
        return F.greatest(F.least(share, F.ceil(F.col(n) / LEAST)), F.ceil(F.col(n) / most))

    parted, one = sizes.select(*keys, parts("_l").alias("_ls"), parts("_r").alias("_rs")), None
    if not keys:
        one = parted.first()
        parted = [F.lit(n).cast("long") for n in one]

    def dealt(df: DataFrame, no: str | Column, own: str, other: str) -> DataFrame:
        df = df.join(parted, list(keys)) if keys else df.withColumns({"_ls": parted[0], "_rs": parted[1]})
        df = df.withColumn(f"_{own}p", hash_slot(no, F.col(f"_{own}s")))
        copies = F.sequence(F.lit(0).cast("long"), F.col(f"_{other}s") - 1)
        return df.where(F.col(f"_{other}s") > 0).withColumn(f"_{other}p", F.explode(copies)).drop("_ls", "_rs")

    return dealt(left, left_no, "l", "r"), dealt(right, right_no, "r", "l"), one


def stream(left: DataFrame, right: DataFrame, keys: Sequence[str], left_no: str | Column, right_no: str | Column) -> DataFrame:
    """Written tiles dealt as by ``meet``, each sent once to a task per pair of parts: ``keys, _lp, _rp, _side`` and their columns.

    In a task the right side (``_side`` 0) of a pair of parts comes before its left side, so ``passing`` holds the
    one while the other passes; no row is made per pair of tiles. The column ``vec`` holds the
    vectors; a held part has HELD_NUMBERS of them at most (or one tile).
    """
    wide = right.agg(F.max(F.size("vec"))).first()[0] or 1
    left, right, one = _dealt(left, right, keys, left_no, right_no, max(1, min(MOST, HELD_NUMBERS // wide)))
    both = right.withColumn("_side", F.lit(0)).unionByName(left.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    if one:
        both = both.repartitionById(max(1, one["_ls"] * one["_rs"]), (F.col("_lp") * F.lit(one["_rs"]) + F.col("_rp")).cast("int"))
    else:
        both = both.repartition(TASKS, *keys, "_lp", "_rp")
    return both.sortWithinPartitions(*keys, "_lp", "_rp", "_side")


def passing(batches, keys: Sequence[str], take) -> Iterator[tuple[tuple, list, object]]:
    """(key, held, row) of every left row of a ``stream``; ``held`` is a new list for each pair of parts.

    ``take(batch, row)`` gives what is kept of a row; it must copy what it keeps.
    """
    at, held = None, []
    for batch in batches:
        for row in range(batch.num_rows):
            part = tuple(batch.column(c)[row].as_py() for c in (*keys, "_lp", "_rp"))
            if part != at:
                at, held = part, []
            if batch.column("_side")[row].as_py() == 0:
                held.append(take(batch, row))
            else:
                yield part[:len(keys)], held, take(batch, row)


def list_values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, name: str, row: int, rows: int) -> np.ndarray:
    return list_values(batch, name, row).reshape(rows, -1).astype(np.float64)


def euclidean_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices.

    The product form loses digits when two vectors are close; those pairs are
    few and are computed again from the difference.
    """
    xx = np.einsum("ij,ij->i", x, x)[:, None]
    yy = np.einsum("ij,ij->i", y, y)[None, :]
    squared = x @ (-2.0 * y).T
    squared += xx
    squared += yy
    if not squared.size or not squared.min() >= 1e-6 * (xx.max() + yy.max()):
        close = np.argwhere(squared < 1e-6 * (xx + yy))
        if len(close):
            diff = x[close[:, 0]] - y[close[:, 1]]
            squared[close[:, 0], close[:, 1]] = np.einsum("ij,ij->i", diff, diff)
        np.maximum(squared, 0.0, out=squared)
    return np.sqrt(squared, out=squared)


def cosine_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine similarities; 0 for vectors without length."""
    return unit_rows(x) @ unit_rows(y).T


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without length stay 0."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def smallest_per_row(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` smallest entries of each row, ties to the lower column."""
    n, m = values.shape
    if k >= m:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    limit = np.partition(values, k - 1, axis=1)[:, k - 1:k]
    below = values < limit
    room = k - below.sum(axis=1, keepdims=True)
    tied = values == limit
    keep = below | (tied & (np.cumsum(tied, axis=1) <= room))
    return np.nonzero(keep)


class Screen:
    """Rows of one matrix within given distances of the rows of others: a product in low precision, then exact distances.

    The product only leaves out pairs that lie farther than its error bound allows, so what
    stays is computed in double precision (Euclidean from the difference of the rows). It is
    in single precision until that tells too few pairs apart.
    """

    def __init__(self, x: np.ndarray, metric: str):
        self.cosine = metric == "cosine"
        self.x = unit_rows(x) if self.cosine else x
        # Distances about a middle of the rows lose no digits where all lie far from the origin.
        self.middle = np.zeros(x.shape[1]) if self.cosine else x.mean(axis=0)
        self.moved = self.x - self.middle
        self.length = np.sqrt(np.einsum("ij,ij->i", self.moved, self.moved))
        self.most = np.abs(x).max(initial=0.0)
        if self.most < LARGEST:
            self._as(np.float32)

    def _as(self, kind: type) -> None:
        self.kind, self.small = kind, float(np.finfo(kind).eps)
        self.left = np.ones((len(self.x), self.x.shape[1] + 1), kind)
        self.left[:, :-1] = self.moved

    def within(self, y: np.ndarray, worst: np.ndarray, k: int, some: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(row, row of ``y``, distance) of all pairs within ``worst`` that can be among a row's ``k`` nearest of ``y``.

        None where the screen is no help: too many pairs look alike or numbers are out of its range.
        """
        most = np.abs(y).max(initial=0.0)
        if k >= len(y):
            rows = np.arange(len(worst))
            return self._exact(np.repeat(rows, len(y)), np.tile(np.arange(len(y)), len(rows)), unit_rows(y) if self.cosine else y, worst, some)
        if not (self.most < LARGEST and most < LARGEST):
            return None
        y = unit_rows(y) if self.cosine else y
        moved = y - self.middle
        square = np.einsum("ij,ij->i", moved, moved)
        pick = slice(None) if some is None else some
        length, far = self.length[pick], np.sqrt(square.max(initial=0.0))
        least = 1.0 - worst if self.cosine else (length * length - worst * worst) / 2
        slip = 2.0 ** -51 * (self.most + most) * np.sqrt(y.shape[1])
        while True:
            right = np.empty((len(y), y.shape[1] + 1), self.kind)
            right[:, :-1] = moved
            # x.y - y.y / 2 is (x.x - |x - y|^2) / 2.
            right[:, -1] = 0.0 if self.cosine else square / -2.0
            score = self.left[pick] @ right.T
            error = (y.shape[1] + 16) * self.small * (length * far + (0.0 if self.cosine else far * far)) + (length + far + slip) * slip + 1e-30
            bound = self._below(least - error)
            hit = score >= bound[:, None]
            if np.count_nonzero(hit) > 2 * k * len(score):
                # The k-th largest of the largest of strips is at most the k-th largest.
                strips = min(len(y), 4 * k)
                tops = np.maximum.reduceat(score, np.arange(strips) * len(y) // strips, axis=1)
                kth = np.partition(tops, strips - k, axis=1)[:, strips - k].astype(np.float64)
                hit = score >= np.maximum(bound, self._below(kth - 2 * error))[:, None]
            found = np.flatnonzero(hit)
            if len(found) <= 8 * k * len(score):
                break
            if self.kind is np.float64:
                return None
            self._as(np.float64)
        return self._exact(*np.divmod(found, len(y)), y, worst, some)

    def _exact(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, worst: np.ndarray, some: np.ndarray | None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = i if some is None else some[i]
        if self.cosine:
            d = 1.0 - np.einsum("ij,ij->i", self.x[at], y[j])
        else:
            apart = self.x[at] - y[j]
            d = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        near = d <= worst[i]
        return i[near], j[near], d[near]

    def _below(self, values: np.ndarray) -> np.ndarray:
        """``values`` rounded down to the numbers of the product."""
        return (values - np.abs(values) * 4 * self.small - 1e-37).astype(self.kind)
