"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import n_words, table
from kindred.session import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-0"


# Repeated rows are numbered in runs of at most this many.
RUN_ROWS = 4096


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def coin(doc_id: Column, text_digest: Column, number: Column, seed: str) -> Column:
    """Uniform in [0, 1) out of the id, the text's digest and the row's number among its equals."""
    name = F.concat_ws("#", F.coalesce(doc_id.cast("string"), F.lit("")), text_digest, number.cast("string"), F.lit(seed))
    digits = F.substring(F.md5(name.cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (``row, size, digest``) with ``number``: 0, 1, ... among rows of equal source, id and text.

    Keys that occur once (counted with a combine before the shuffle) have the
    number 0 and stay where they are. The others are written with the run they
    lie in, at most ``RUN_ROWS`` neighbours of one task, and numbered run by run,
    so a key that a third of all rows share is no single group. Which of several
    equal rows has which number is left open; together they have all of them.
    """
    key = {"k_source": F.col("row.source"), "k_id": F.col("row.doc_id"), "digest": F.col("digest")}
    keyed = rows.withColumns(key)
    names = list(key)
    several = cut(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_several")), "mix-repeated")
    met = keyed.join(several, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "left")
    single = met.where("_several is null").select("row", "size", "digest", F.lit(0).cast("long").alias("number"))
    runs = cut(met.where("_several").select("row", "size", *names, F.floor(
        F.monotonically_increasing_id() / F.lit(RUN_ROWS)).alias("run")), "mix-runs")
    lengths = runs.groupBy(*names, "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*names).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("run").alias("_run"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*names, "run").orderBy(F.lit(0))
    placed = runs.withColumn("_at", F.row_number().over(inside) - 1).join(
        starts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*names, "run")])
    return single.unionByName(placed.select("row", "size", "digest", (F.col("start") + F.col("_at")).cast("long").alias("number")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` of ``source, size`` rows: one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating. The
    targets are ``min(most * source_size, weight * level)`` with the one level
    that makes them add up to all sizes, which is where handing the excess of
    capped sources on by weight ends. Windows here run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    capped = per_source.withColumn(
        "weight", F.get(pattern, (F.row_number().over(ordered) - 1) % len(weights)))
    capped = capped.withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    # With the k sources of least cap per weight held at their caps, the others share the rest by weight.
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    levels = capped.withColumn("total", F.sum("source_size").over(every)).withColumn(
        "level", (F.col("total") - F.coalesce(F.lit(most) * F.sum("source_size").over(before), F.lit(0)))
        / F.sum("weight").over(after))
    # The first source whose cap is not reached fixes the level for it and all after it.
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)
    level = open_level["level"]
    return levels.withColumn("share", F.col("weight") * level).select(
        "source", "source_size",
        F.when(F.col("share") < F.lit(most) * F.col("source_size"), F.col("share"))
        .otherwise((F.lit(most) * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``row, size, source_size, target, copies`` for every row of ``docs`` (``row``: all its columns).

    Tokens are words (runs of anything but ASCII white space). A source repeats
    at rate target / source_size: every document floor(rate) times and once more
    if its coin falls below the fraction. Only one row per source and the keys of
    repeated rows meet the documents; texts move only where a row occurs more than
    once (all do, in one join by key, where Spark finds the repeated keys too many
    to broadcast). Null or empty text: size 0. A source without words: target 0, no copies.
    Null sources form a source of their own. Rows that share an id, or an id and a
    text, toss coins of their own. Very long texts are read once more for their
    digest. Other columns ride along inside ``row``. An empty table gives an empty
    table.
    """
    sized = docs.select(F.struct(*docs.columns).alias("row")).select(
        "row", n_words(F.col("row.text")).alias("size"), digest(F.col("row.text")).alias("digest"))
    # The scan that only counts is written: sources and sizes, no texts.
    counted = cut(sized.select(F.col("row.source").alias("source"), "size")
                  .groupBy("source").agg(F.sum("size").alias("size")), "mix")
    targets = source_targets(counted, weights, most).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    tossed = coin(F.col("row.doc_id"), F.col("digest"), F.col("number"), seed) < (rate - F.floor(rate))
    return numbered(sized).join(targets, F.col("row.source").eqNullSafe(F.col("of")), "left").select(
        "row", "size", "source_size", "target",
        (F.floor(rate) + tossed.cast("long")).cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of the mix: every row as often as ``copies`` says."""
    return mixed.where("copies > 0").select(
        F.explode(F.expr("transform(sequence(1, cast(copies as int)), i -> row)")).alias("row")).select("row.*")


def op5_mix_sources(spark, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
with d as (select doc_id, md5(coalesce(text, '')) as digest, row_number() over (partition by source, doc_id, coalesce(text, '')) - 1 as number, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from d group by source),
r as (select *, 3 * source_size / weight as ratio, (sum(source_size) over ())::bigint as total from s),
l as (select *, (total - coalesce(3 * sum(source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::bigint
        / (sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following))::bigint as level from r),
o as (select arg_min(level, ratio) as level from l where ratio > level),
t as (select source, source_size, case when weight * o.level < 3 * source_size then weight * o.level else (3 * source_size)::double end as target from l left join o on true),
c as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
        ('0x' || substr(md5(coalesce(d.doc_id::varchar, '') || '#' || d.digest || '#' || d.number::varchar || '#mix-0'), 1, 13))::bigint / 4503599627370496.0::double as coin
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end))::bigint as taken from c
"""
