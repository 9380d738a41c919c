"""Operator 5: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every row gets a global number that depends on the rows alone, not on how they are partitioned.
A Feistel network over a x a numbers (a = ceil(sqrt(N))) permutes them; numbers that fall outside 0..N-1
are walked along their cycle until they fall inside. The permuted number p gives shard p mod S and slot p div S,
so counts of shards differ by one at most and slots have no gaps.

Defined cases: a null text has size 1 and crc 0; a null doc_id sorts as a value of its own; whole repeated rows get
different slots; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

ROUNDS = 6
#: Copies of a row that one task spells out at a time.
COPIES = 65_536
#: More steps than a cycle can need for N below 500; beyond that the odds of needing them are under 1e-40.
WALK = 48


def _network(x: Column, side: Column, key: int) -> Column:
    """One pass of the Feistel network over 0..side*side-1, with addition modulo side in place of xor."""
    start = F.struct(((x - F.pmod(x, side)) / side).cast("long").alias("l"), F.pmod(x, side).alias("r"))
    mixed = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.struct(
            s["r"].alias("l"),
            F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(key)), side), side).alias("r"),
        ),
    )
    return mixed["l"] * side + mixed["r"]


def permuted(number: Column, total: Column, key: int = 0) -> Column:
    """Where row `number` of `total` goes: a permutation of 0..total-1 chosen by key."""
    side = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    side = F.when(side * side < total, side + 1).otherwise(side)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        _network(number, side, key),
        lambda y, _: F.when(y < total, y).otherwise(_network(y, side, key)),
    )
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("the cycle is longer than the walk")).cast("long"))


def numbered(rows: DataFrame, by: list[str], buckets: int = 4096) -> DataFrame:
    """rows with a global `number` from 0 and their `total`, equal for any partitioning.

    Equal rows are counted before the shuffle. Groups go to a fixed number of hash buckets; a number is the rows of
    the buckets before, plus those before in its bucket. The table of bucket offsets has `buckets` rows at most, so
    it may be broadcast.
    """
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_copies"))
    groups = written(groups.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")), "numbered")
    sums = groups.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    everything = Window.partitionBy()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(everything).alias("total"),
    )
    inside = Window.partitionBy("_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), "_bucket")
    # very many copies of a row become ranges first, which other tasks then spell out
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES))).alias("_from")
    parts = placed.select(*by, "total", (F.col("_offset") + F.col("_before")).alias("_at"), "_copies", "_bucket", ranges).repartition("_bucket", "_from")
    copy = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("_copies")) - 1)).alias("_copy")
    return parts.select(*by, "total", "_at", copy).select(*by, "total", (F.col("_at") + F.col("_copy")).alias("number"))


def shard_documents(docs: DataFrame, shards: int = 16, key: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, by the law `rows`."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_text"),
    )
    at = numbered(rows, ["doc_id", "size", "text_crc32", "_text"])
    at = at.withColumn("_place", permuted(F.col("number"), F.col("total"), key))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        ((F.col("_place") - F.pmod("_place", F.lit(shards))) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=16, key=20240601)
