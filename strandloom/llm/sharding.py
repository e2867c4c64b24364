"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions only.

A row's shard follows from its key and the number of shards alone: no ring table, and one
more shard takes rows only into itself (about 1 in n + 1 of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Fixed values of the published algorithm: its 64-bit linear congruential step.
MULTIPLIER = 2862933555777941757
LOW, HIGH, MASK = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32, 0xFFFFFFFF

#: Steps folded for every row; the rare row that needs more goes on to the full bound.
USUAL_STEPS = 64


def _lit(n: int) -> Column:
    return F.lit(n).cast("long")


def _step(s: Column, shards: int) -> Column:
    """One jump. hi and lo are the halves of the unsigned state; products are made of limbs so that none leaves 63 bits."""
    hi, lo = s["hi"], s["lo"]
    p0 = lo.bitwiseAND(_lit(0xFFFF)) * _lit(LOW)
    p1 = F.shiftright(lo, 16) * _lit(LOW)
    t = p0 + F.shiftleft(p1.bitwiseAND(_lit(0xFFFF)), 16) + _lit(1)
    mod = lambda x, c: (x.bitwiseAND(_lit(0xFFFF)) * _lit(c) + F.shiftleft((F.shiftright(x, 16) * _lit(c & 0xFFFF)).bitwiseAND(_lit(0xFFFF)), 16)).bitwiseAND(_lit(MASK))
    new_lo = t.bitwiseAND(_lit(MASK))
    new_hi = (F.shiftright(t, 32) + F.shiftright(p1, 16) + mod(hi, LOW) + mod(lo, HIGH)).bitwiseAND(_lit(MASK))
    ratio = _lit(1 << 31).cast("double") / (F.shiftright(new_hi, 1) + _lit(1)).cast("double")
    jump = ((s["j"] + _lit(1)).cast("double") * ratio).cast("long")
    return F.when(s["j"] < _lit(shards), F.struct(s["j"].alias("b"), jump.alias("j"), new_hi.alias("hi"), new_lo.alias("lo"))).otherwise(s)


def _fold(start: Column, shards: int, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: _step(s, shards))


def _jumps(key: Column, shards: int) -> Column:
    """Struct of the shard b and the next place j >= shards that the key would jump to."""
    zero = F.struct(_lit(0).alias("b"), _lit(0).alias("j"), F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_lit(MASK)).alias("lo"))
    if shards <= USUAL_STEPS:  # j grows by one at least, so so many steps always do
        return _fold(zero, shards, shards)
    usual = _fold(zero, shards, USUAL_STEPS)
    return F.when(usual["j"] >= _lit(shards), usual).otherwise(_fold(zero, shards, shards))


def hash_key(df: DataFrame, key: str) -> Column:
    """The 64-bit state that jumping starts from: integers as they are, other types by xxhash64; null counts as 0."""
    kind = df.schema[key].dataType
    col = F.col(key)
    return F.coalesce(col.cast("long") if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else F.when(col.isNotNull(), F.xxhash64(col)), _lit(0))


def jump_shards(df: DataFrame, key: str, shards: int, *, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with the shard of each row, and the shard it would have with one shard more.

    Null keys count as key 0; equal keys share a shard; an empty table stays empty.
    Columns named like the two outputs are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    # The next jump does not depend on the number of shards: with one more, it is taken if it lands there.
    state = "__jump"
    out = df.withColumn(state, _jumps(hash_key(df, key), shards))
    return out.withColumns({shard: F.col(state)["b"].cast("int"), grown: F.when(F.col(state)["j"] == _lit(shards), _lit(shards)).otherwise(F.col(state)["b"]).cast("int")}).drop(state)


def slots(df: DataFrame, shard: str, order: list[str], *, buckets: int = 1024, slot: str = "slot") -> DataFrame:
    """df with each row's place in its shard, gapless from 0.

    Shards are numbered in two levels, so no task sorts a whole shard: rows are ranked inside
    hash buckets, and the counts of the shard's buckets (shards x buckets numbers, whatever the
    table's size) are added up. Rows equal in all order columns are ranked arbitrarily but once each.
    """
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), _lit(buckets)).cast("int"))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order)).cast("long"))
    sizes = rows.groupBy(shard, "__bucket").agg(F.max("__rank").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(shard).orderBy("__bucket")) - F.col("__n")).drop("__n")
    return rows.join(before, [shard, "__bucket"]).withColumn(slot, F.col("__before") + F.col("__rank") - _lit(1)).drop("__bucket", "__before", "__rank")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 8; a null text has no bytes (size 8, CRC 0). Repeated rows get
    a slot each, null doc_ids count as key 0, further columns are not carried.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    rows = slots(jump_shards(rows, "doc_id", shards), "shard", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
