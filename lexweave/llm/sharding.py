"""Weighted rendezvous hashing of stable record keys.

A record goes to the shard with the least ``-ln(u) / weight``, where u is a uniform number made of the
record's key and the shard's. No shard's number depends on another shard, so adding one moves only the
records that it wins, and raising a weight only draws records to that shard. All JVM expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import utf8_bytes

#: Hex digits of the MD5 that make u: 52 bits, exact in a double.
DIGITS = 13
#: Numbering is dealt to so many ranges of the key hash in each shard: 16 to the power of three.
RANGE_DIGITS = 3
#: Ranges of rows without a key.
NULL_RANGES = 256


def score(key: Column, shard: object, weight: float = 1.0) -> Column:
    """What a shard asks for a record; the least wins."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{shard}")))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, shards: Sequence | Mapping[object, float]) -> Column:
    """The shard of a key; ties go to the shard named first. A null key is taken as the empty string."""
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1.0)
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    key = F.coalesce(key.cast("string"), F.lit(""))
    asks = [
        F.struct(score(key, s, w).alias("ask"), F.lit(k).alias("k"), F.lit(s).alias("shard"))
        for k, (s, w) in enumerate(weights.items())
    ]
    return (F.least(*asks) if len(asks) > 1 else asks[0])["shard"]


def numbered(df: DataFrame, shard: str, key: str, slot: str = "slot", ties: Sequence[str] = ()) -> DataFrame:
    """Adds gapless numbers from 0 within each shard, in order of the key's MD5, the key and ``ties``.

    Each shard is cut into ranges of that hash, numbered side by side and shifted by the counts of the
    ranges before them, so no task holds a shard. Rows without a key all have one hash: they are dealt to
    ``NULL_RANGES`` further ranges by a hash of ``ties`` and stand behind the keys of their range. Rows
    that are equal in key and ties are numbered in any order, which shows nowhere.
    """
    from pyspark.sql import Window

    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*ties), F.lit(NULL_RANGES)) + 1).otherwise(0) if ties else F.lit(0)
    df = df.withColumn("_hash", F.md5(text)).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS)).withColumn("_part", part.cast("int"))
    counts = df.groupBy(shard, "_range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(shard, "_range", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(shard, "_range", "_part").orderBy("_hash", key, *ties))
    # 4096 ranges and those without a key for each shard at most, whatever the input: small enough to send to every task
    joined = df.join(F.broadcast(shifts), [shard, "_range", "_part"])
    return joined.withColumn(slot, (F.col("_shift") + place - 1).cast("long")).drop("_hash", "_range", "_part", "_shift")


def assign(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, by law ``key``.

    Size is the text's UTF-8 bytes plus 1; a null text has no bytes and the checksum of the empty text.
    grown_shard is the shard with one more shard: the same one, or the new one.
    """
    now = list(range(shards))
    key = F.col(id_col)
    rows = df.select(
        id_col,
        (utf8_bytes(text_col) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, now).alias("shard"),
        rendezvous(key, [*now, shards]).alias("grown_shard"),
    )
    return numbered(rows, "shard", id_col, ties=("text_crc32", "size")).select(
        id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
