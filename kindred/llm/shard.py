"""Sharding by a computable shuffle of row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import table
from kindred.session import cut

SHARDS = 16
SEED = 20240601
ROUNDS = 4
_MOD = 1 << 31
_MIX = 1103515245
_WALK = 64


def halves(total: int) -> tuple[int, int]:
    """(bits of the right half, size of the left half) of the least domain ``left << bits`` over ``total``."""
    bits = (max(1, total).bit_length() + 1) // 2
    return bits, max(1, -(-total >> bits))


def _round(half: Column, key: int) -> Column:
    """Round function: two multiply-and-fold steps below 2**62, so no overflow."""
    for step in (key % _MOD, (key * 48271 + 11) % _MOD):
        half = F.shiftright(((half + F.lit(step)) % F.lit(_MOD)) * F.lit(_MIX), 16) % F.lit(_MOD)
    return half


def _feistel(number: Column, bits: int, left: int, seed: int) -> Column:
    """One pass over the domain ``left << bits``; each half is added to in turn, which can be undone."""
    a, b = F.shiftright(number, bits), number.bitwiseAND(F.lit((1 << bits) - 1))
    for i in range(ROUNDS):
        if i % 2:
            b = (b + _round(a, seed + i)).bitwiseAND(F.lit((1 << bits) - 1))
        else:
            a = (a + _round(b, seed + i)) % F.lit(left)
    return F.shiftleft(a, bits) + b


def permuted(number: Column, total: int, seed: int = SEED) -> Column:
    """Place of row ``number`` (0 .. total - 1) in a shuffle of all row numbers.

    A Feistel network permutes a domain slightly larger than ``total``; a value
    outside is sent through again until it falls inside (cycle walking). The
    domain exceeds ``total`` by less than 2**bits, about its square root, so
    64 steps always end for up to 4,096 rows and otherwise miss with a chance
    below 64**-64.
    """
    bits, left = halves(total)
    first = _feistel(number, bits, left, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), first, lambda x, _: F.when(
        x < F.lit(total), x).otherwise(_feistel(x, bits, left, seed)))
    return F.when(first < F.lit(total), first).otherwise(walked)


def row_numbers(keyed: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``keyed`` with ``number`` (0 .. n - 1, by ``order``, nulls first), and n.

    Rows are range-partitioned and written with the number of their range; one
    count per range gives each range its offset, and rows are numbered inside
    their range. Rows that agree in all of ``order`` are told apart by ``_tie``,
    fixed when the rows are written, so a value a third of the rows share is
    dealt over many ranges.
    """
    tied = keyed.withColumn("_tie", F.monotonically_increasing_id())
    width = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(tied.repartitionByRange(width, *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    # One row per range: at most as many as there are shuffle partitions.
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie")) - 1
    numbered = ranged.withColumn("number", inside.cast("long")).join(F.broadcast(offsets), "_range").withColumn(
        "number", F.col("number") + F.col("_offset"))
    return numbered.drop("_tie", "_range", "_offset"), ranged.count()


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Rows are numbered by (doc_id, text_crc32, size), nulls first; the number is
    permuted, and place p goes to shard p mod ``shards``, slot p div ``shards``:
    law ``rows``, counts at most one apart, slots gapless, ``grown_shard`` null.
    Anyone who knows a row's number, the total and the seed can compute both.
    Only these few columns are shuffled, no text. Null or empty text: size 1,
    checksum 0. Null ids are numbered like others. Repeated rows get a slot
    each. Other columns are not read. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, total = row_numbers(keyed, ["doc_id", "text_crc32", "size"])
    place = numbered.withColumn("place", permuted(F.col("number"), total, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor((F.col("place") - F.col("place") % shards) / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op9_shard_rows(spark, folder: str) -> DataFrame:
    return assign(table(spark, folder, "documents"))


def _sql_round(half: str, key: int) -> str:
    for step in (key % _MOD, (key * 48271 + 11) % _MOD):
        half = f"((((({half}) + {step}) % {_MOD}) * {_MIX}) >> 16) % {_MOD}"
    return half


def _sql_step(number: str) -> str:
    """The same network as a chain of selects over ``number``."""
    inner = f"select *, {number} >> bits as a0, {number} & (mask) as b0 from @"
    names = ["a0", "b0"]
    for i in range(ROUNDS):
        a, b = names
        if i % 2:
            inner = f"select *, ({b} + {_sql_round(a, SEED + i)}) & mask as b{i + 1} from ({inner})"
            names = [a, f"b{i + 1}"]
        else:
            inner = f"select *, ({a} + {_sql_round(b, SEED + i)}) % lefts as a{i + 1} from ({inner})"
            names = [f"a{i + 1}", b]
    return f"select n, bits, mask, lefts, total, id, size, crc, ({names[0]} << bits) + {names[1]} as place from ({inner})"


def _sql() -> str:
    # The checksum has no name in the other engine: the table of remainders is made there, and a list folds the bytes.
    bit = "case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end"
    grown = "select i, i::bigint as v from range(256) t(i)"
    for _ in range(8):
        grown = f"select i, {bit} as v from ({grown})"
    start = "row_number() over (order by doc_id nulls first, crc, size) - 1 as n"
    return f"""
with recursive crc_table as (select list(v order by i) as lut from ({grown})),
raw as (select doc_id as id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, hex(encode(coalesce(text, ''))) as h from documents),
sums as (select id, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, (size - 1)::bigint), lambda i:
      ('0x' || h[(2 * i + 1):(2 * i + 2)])::bigint)), lambda c, x: xor(c >> 8, lut[(xor(c, x) & 255) + 1])), 4294967295::bigint) as crc from raw, crc_table),
c as (select count(*)::bigint as total, ((length(bin(greatest(count(*), 1)::bigint)) + 1) // 2)::bigint as bits from documents),
k as (select total, bits, (1::bigint << bits) - 1 as mask, greatest(1, (total + (1::bigint << bits) - 1) >> bits)::bigint as lefts from c),
o as (select {start.replace('doc_id', 'id')}, bits, mask, lefts, total, id, size, crc from sums, k),
w as ({_sql_step('n').replace('@', 'o')}
      union all
      {_sql_step('place').replace('@', 'w where place >= total')})
select id as doc_id, size, crc as text_crc32, 'rows' as law, (place % {SHARDS})::int as shard, (place // {SHARDS})::bigint as slot,
  null::int as grown_shard from w where place < total
"""


SQL = _sql()
