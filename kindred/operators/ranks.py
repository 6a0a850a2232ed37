"""Row positions and top-n, without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import cut_counting

ID_CHUNK = 1 << 20
# Groups named one by one in a scan's filter; with more of them they are joined.
LISTED_GROUPS = 1000


def _before(counts: DataFrame, by: list[str], levels: int) -> DataFrame:
    """``by, _chunk, _before``: rows in the chunks ahead of each, from ``by, _chunk, _n``.

    With ``levels`` above 0 chunks are numbers; ``ID_CHUNK`` consecutive ones are summed
    together, and the sums of those are placed the same way one level up.
    """
    group = [*by, "_piece"] if levels else by
    tagged = counts.withColumn("_piece", F.floor(F.col("_chunk") / F.lit(ID_CHUNK))) if levels else counts
    ahead = F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tagged.withColumn("_before", ahead).drop("_n")
    if not levels:
        return placed
    pieces = tagged.groupBy(*group).agg(F.sum("_n").alias("_n")).withColumnRenamed("_piece", "_chunk")
    outer = _before(pieces, by, levels - 1).withColumnsRenamed({"_chunk": "_piece", "_before": "_outer"})
    return placed.join(outer, group).select(*by, "_chunk", (F.col("_before") + F.col("_outer")).alias("_before"))


def position(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], chunk: Column,
             out: str = "pos", levels: int = 0) -> DataFrame:
    """0-based position of each row inside its ``by`` group, in ``order``.

    ``chunk`` must grow with ``order``: it cuts a group, however large, into
    consecutive pieces. Pieces are counted, their offsets summed (in ``levels`` more
    steps where there may be many), and only the rows of one piece are ever sorted
    together.
    """
    by = list(by)
    tagged = df.withColumn("_chunk", chunk)
    offsets = _before(tagged.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n")), by, levels)
    inside = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)) - 1
    return (
        tagged.withColumn("_in", inside).join(offsets, [*by, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_chunk", "_in", "_before")
    )


def relative_index(df: DataFrame, by: Sequence[str], id_col: str = "idx_global",
                   out: str = "idx_relativo", chunk_rows: int = ID_CHUNK) -> DataFrame:
    """Position in file order inside the group.

    Ids are unique longs, so a range of ``chunk_rows`` ids never holds more than
    ``chunk_rows`` rows; two more levels of ``ID_CHUNK`` ranges leave at most 16 at the
    top, so sparse ids (hashes) are no more work for a task than row numbers.
    """
    chunk = F.floor(F.col(id_col) / F.lit(chunk_rows))
    return position(df, by, [id_col], chunk, out, 2)


def hash_position(df: DataFrame, by: Sequence[str], id_col: str, seed: str,
                  out: str = "pos", digits: int = 5) -> DataFrame:
    """Position inside the group in seeded-hash order: a repeatable shuffle.

    Up to ``16**digits`` pieces per group (about a million), summed in one task of small rows.
    """
    key = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    hashed = df.withColumn("_key", key)
    return position(hashed, by, ["_key", id_col], F.substring("_key", 1, digits), out).drop("_key")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
          out: str = "rank") -> DataFrame:
    """First ``n`` rows per group; each task keeps only ``n`` rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def exact_sample(df: DataFrame, fraction: float, id_col: str, seed: str,
                 digits: int = 4) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows, chosen by seeded hash, without replacement.

    A histogram of hash prefixes (at most ``16**digits`` rows) finds the prefix
    the cut falls in; only that prefix is ranked.
    """
    key = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    hashed = df.withColumn("_key", key).withColumn("_bin", F.substring("_key", 1, digits))
    bins = hashed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bins = (
        bins.withColumn("_before", F.coalesce(F.sum("_n").over(ordered), F.lit(0)))
        .withColumn("_want", F.round(F.sum("_n").over(everything) * F.lit(fraction)).cast("long"))
        .where(F.col("_before") < F.col("_want"))
    )
    # The histogram holds at most 16**digits rows, so broadcasting it is safe.
    near = hashed.join(F.broadcast(bins), "_bin")
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy("_key", id_col))
    return (
        near.withColumn("_in", inside)
        .where(F.col("_before") + F.col("_in") <= F.col("_want"))
        .select(*df.columns)
    )


def in_asked_groups(corpus: DataFrame, asked: DataFrame, label: str) -> DataFrame:
    """Rows of ``corpus`` whose group occurs in ``asked``.

    Up to ``LISTED_GROUPS`` groups become a filter on values, which reaches the scan and
    leaves out the folders of other groups; more are a semi-join.
    """
    groups, count = cut_counting(asked.where(F.col(label).isNotNull()).select(label).distinct(), "asked-groups")
    if count > LISTED_GROUPS:
        return corpus.join(groups, label, "left_semi").select(*corpus.columns)
    return corpus.where(F.col(label).isin([r[0] for r in groups.collect()]))
