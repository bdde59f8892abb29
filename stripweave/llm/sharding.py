"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions only.

The generator is the published 64-bit one. Spark's long arithmetic checks for overflow, so the 64-bit state is held as two
32-bit halves, and products are formed from 16-bit pieces, which never overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stripweave.llm.common import written

MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF
#: Rounds for large shard counts; up to so many shards there is a round for each, which cannot be used up. Jumps are independent records, about ln(shards) of them: with
#: 2**31 shards more than 256 come once in 10**170 keys, and would raise an error.
ROUNDS = 256


def _low(x: Column, c: int) -> Column:
    """x * c modulo 2**32, for 32-bit x and c."""
    return (x.bitwiseAND(0xFFFF) * F.lit(c) + F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The state after one step: state * MULTIPLIER + 1 modulo 2**64."""
    c1, c0 = MULTIPLIER >> 32, MULTIPLIER & MASK
    upper = F.shiftright(lo, 16) * F.lit(c0)
    low = lo.bitwiseAND(0xFFFF) * F.lit(c0) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(upper, 16) + _low(hi, c0) + _low(lo, c1)
    return high.bitwiseAND(MASK), low.bitwiseAND(MASK)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a long key. A null key counts as 0. With one more shard, only about one row in
    ``shards`` + 1 moves, each of them to the new shard."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(MASK).alias("lo"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        on = s["j"] < F.lit(shards)
        return F.struct(
            F.when(on, hi).otherwise(s["hi"]).alias("hi"), F.when(on, lo).otherwise(s["lo"]).alias("lo"),
            F.when(on, s["j"]).otherwise(s["b"]).alias("b"), F.when(on, jump).otherwise(s["j"]).alias("j"),
        )

    rounds = F.array_repeat(F.lit(0), min(shards, ROUNDS))
    out = F.aggregate(rounds, start, step, lambda s: F.when(s["j"] >= F.lit(shards), s["b"]).otherwise(F.raise_error(F.lit("jump hash: rounds used up")).cast("long")))
    return out.cast("int")


#: Equal rows that part in one piece.
RUN = 10_000


def shard_key(df: DataFrame, column: str) -> Column:
    """Whole numbers are their own keys; anything else is hashed first."""
    return F.col(column).cast("long") if isinstance(df.schema[column].dataType, T.IntegralType) else F.xxhash64(column)


def assign_shards(docs: DataFrame, shards: int = 8, *, key: str = "doc_id", text: str = "text", lanes: int = 4096) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``shard`` comes from ``key`` and the shard count alone; ``grown_shard`` is that of one shard more. ``size`` is the UTF-8
    length plus 1 (null text: 1, checksum of the empty text). ``slot`` numbers a shard's rows from 0 without gaps, by lane,
    then key, then checksum: a lane is a hash of key and checksum, so that neither strides of keys nor one key of many texts meet in one. A
    shard is numbered lane by lane and the lanes' counts are summed up, so no task ever sorts a whole shard. Rows without a key go to the shard of
    key 0. Repeated rows get slots of their own. An empty table gives no rows. Other columns are ignored.
    """
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.octet_length(F.col(text)))
    rows = docs.select(
        F.col(key).alias("doc_id"), (n + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        shard_key(docs, key).alias("_key"),
    )
    rows = rows.select(
        "*", F.lit("key").alias("law"), jump_hash(F.col("_key"), shards).alias("shard"), jump_hash(F.col("_key"), shards + 1).alias("grown_shard"),
        (F.crc32(F.concat_ws(":", F.col("_key").cast("string"), F.col("text_crc32").cast("string")).cast("binary")) % lanes).alias("_lane"),
    )
    # Equal rows are one row with a number, so that a row repeated however often is sorted once; they part again in runs.
    rows = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "shards")
    counts = rows.groupBy("shard", "_lane").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = Window.partitionBy("shard", "_lane").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    place = place.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_at", F.coalesce(F.sum("_n").over(place), F.lit(0))).join(offsets, ["shard", "_lane"])
    out = out.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    out = out.repartition("doc_id", "text_crc32", "_run")
    last = F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN) - 1
    out = out.withColumn("_same", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    slot = F.col("_before") + F.col("_at") + F.col("_run") * RUN + F.col("_same")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", slot.cast("long").alias("slot"), "grown_shard")


#: A table expression with the list ``t`` that ``crc_sql`` reads.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
)"""


def crc_sql(text: str) -> str:
    """DuckDB SQL of the checksum of a text's UTF-8 bytes."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295)"""


def oracle(shards: int = 8, lanes: int = 4096) -> str:
    """DuckDB SQL for ``assign_shards`` over ``documents`` with whole, non-null, non-negative keys."""
    crc = crc_sql
    return f"""
WITH RECURSIVE {CRC_TABLE}, checksums AS (
  SELECT doc_id, {crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table
), lanes AS (
  SELECT doc_id, text_crc32, {crc("doc_id || ':' || text_crc32")} % {lanes} AS lane FROM checksums, crc_table
), walk AS (
  SELECT n, doc_id, doc_id::HUGEINT AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES ({shards}), ({shards + 1})) v(n)
  UNION ALL
  SELECT n, doc_id, s, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((s // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT n, doc_id, j, (state * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s FROM walk WHERE j < n)
), placed AS (
  SELECT doc_id, max(b) FILTER (n = {shards} AND j >= n) AS shard, max(b) FILTER (n = {shards + 1} AND j >= n) AS grown FROM walk GROUP BY doc_id
)
SELECT d.doc_id, strlen(coalesce(d.text, '')) + 1 AS size, c.text_crc32, 'key' AS law, p.shard::INT AS shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY c.lane, d.doc_id) - 1 AS slot, p.grown::INT AS grown_shard
FROM documents d JOIN placed p USING (doc_id) JOIN lanes c USING (doc_id)
"""
