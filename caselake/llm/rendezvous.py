"""Operator 11, weighted rendezvous hashing of record keys to shards.

Every shard draws an exponential of its weight's rate from a hash of (key, shard), and the least draw takes the record.
The draws of old shards do not change when a shard is added, so a record either stays or goes to the new one, and a shard
of weight w takes w / (sum of weights) of the keys. All of it is DataFrame expressions.

Slots number the rows of a shard without gaps. They need no task that holds a shard: equal rows are counted (combined before
the shuffle) and cut into chunks, chunks are dealt to a fixed number of buckets of a shard by hash, and
a slot is what lies in earlier buckets plus the place in its own. Only the bucket totals, of which there are at most shards x BUCKETS, are broadcast.

Defined results: a null text has no bytes (size 1, crc 0); a null id is a key of its own, the empty string; equal ids
share a shard, whatever their texts (the law is ``key``, so equal texts of different ids need not); repeated rows get a slot each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_documents

#: Parts of a shard in which slots are given, a power of 16; equal rows that one chunk holds at most.
BUCKETS, CHUNK = 4096, 1000


def draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential variable of rate ``weight``, always the same for a key and a shard: 52 bits of an MD5 as a uniform."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def least(draws: Column) -> Column:
    """Number of the least draw; the first on ties."""
    return F.coalesce(F.array_position(draws, F.array_min(draws)) - 1, F.lit(0)).cast("int")


def with_shards(rows: DataFrame, key: Column, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """Columns shard, and grown_shard: the shard if one more, of weight ``added``, stood beside these."""
    if not weights or min(*weights, added) <= 0:
        raise ValueError("weights must be positive")
    draws = F.array(*(draw(F.col("__key"), i, w) for i, w in enumerate([*weights, added])))
    keyed = rows.withColumn("__key", F.coalesce(key.cast("string"), F.lit(""))).withColumn("__draws", draws)
    return keyed.withColumns({"shard": least(F.slice("__draws", 1, len(weights))), "grown_shard": least(F.col("__draws"))}).drop("__draws", "__key")


def place(rows: DataFrame, key: str, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """``rows`` (of columns that can be grouped) with shard, grown_shard and slot, gapless from 0 in each shard.

    The exchange of the counted rows is used twice, for the rows and for the bucket totals; nothing that can be null is joined on, so
    that no filter tells the two uses apart.
    """
    names = rows.columns
    equal = with_shards(rows.groupBy(*names).agg(F.count("*").alias("__n")), F.col(key), weights, added)
    chunks = equal.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / CHUNK))))
    spelled = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names), F.col("__chunk").cast("string"))
    bucket = F.coalesce(F.conv(F.substring(F.md5(spelled), 1, 8), 16, 10).cast("long") % BUCKETS, F.lit(0)).cast("int")
    dealt = chunks.withColumns({"__m": F.least(F.lit(CHUNK), F.col("__n") - F.col("__chunk") * CHUNK), "__bucket": bucket})
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("shard", "__bucket").agg(F.sum("__m").alias("__m"))
    bases = F.broadcast(totals.select("shard", "__bucket", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base")))
    inside = Window.partitionBy("shard", "__bucket").orderBy(*names, "__chunk").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("__end", F.sum("__m").over(inside)).join(bases, ["shard", "__bucket"])
    first = F.col("__base") + F.col("__end") - F.col("__m")
    return placed.withColumn("slot", F.explode(F.sequence(first, first + F.col("__m") - 1))).select(*names, "shard", "grown_shard", "slot")


def op11_rendezvous_shards(spark: SparkSession, sf_dir: str, weights: Sequence[float] = (1.0,) * 16) -> DataFrame:
    """All documents in 16 shards of equal weight, with the shard that each would have among 17."""
    text = F.coalesce("text", F.lit(""))
    rows = read_documents(spark, sf_dir, "doc_id", "text").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return place(rows, "doc_id", weights).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def crc32_sql(hexadecimal: str) -> str:
    """SQL for the CRC-32 of the bytes that a hexadecimal string spells: a fold over bytes, whose table is the exclusive or of an entry for each bit."""
    entry = "0"
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entry = f"xor({entry}, (xor(c, b) >> {bit} & 1) * {value})"
    bytes_ = f"list_transform(regexp_extract_all({hexadecimal}, '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, {entry})), 4294967295)"


def _draw_sql(shard: int) -> str:
    return f"-ln((('0x' || md5(k || ':{shard}')[1:13])::BIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)"


#: Each row on its own; a chunk is a thousand rows of equal ones.
ORACLE = f"""
WITH sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32_sql("hex(encode(coalesce(text, '')))")} AS text_crc32 FROM documents),
drawn AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS k, [{", ".join(map(_draw_sql, range(17)))}] AS d FROM sized),
dealt AS (SELECT doc_id, size, text_crc32, list_position(d[1:16], list_min(d[1:16])) - 1 AS shard, list_position(d, list_min(d)) - 1 AS grown_shard,
    (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {CHUNK} AS chunk FROM drawn),
placed AS (SELECT *, ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32 || ':' || chunk)[1:8])::BIGINT % {BUCKETS} AS bucket FROM dealt)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, chunk) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed
"""
