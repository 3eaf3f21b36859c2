"""Weighted rendezvous hashing.

Each shard draws a number from the record's stable key; the largest draw, scaled by the shard's weight,
takes the record. A record's shard depends on its key and the shards alone, and a further shard takes
records only for itself. All of it is whole-stage code: no Python on the way.

Slots count the rows of a shard from 0 without gaps. They come from counts of small buckets (shard x
hash of the row), so no task ever holds a whole shard.

A null key counts as one key of its own; equal ids share a shard; ties of the order are split by
the text's checksum. Null texts are empty; texts of any length are whole, of which size and checksum are all that is kept. Extra columns of any
name are left out. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain

SEED = 20011
#: Sorted windows of a shard, at least: where the session has very many shuffle partitions, a quarter of these.
BUCKETS = 64


def draw(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u) with u in (0, 1) from the key and the shard: 52 bits and a half, which a double holds without rounding up to 1."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED + shard)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (position in `weights`) of a key; shards of weight 0 take nothing."""
    best = F.greatest(*(F.struct(draw(key, s, w).alias("d"), F.lit(s).alias("s")) for s, w in enumerate(weights) if w > 0)) if sum(w > 0 for w in weights) > 1 else F.struct(F.lit(next(s for s, w in enumerate(weights) if w > 0)).alias("s"))
    return best.getField("s").cast("int")


def assign(docs: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard: the shard with one more shard behind the others."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = plain(docs, doc_id=docs.schema["doc_id"].dataType.simpleString(), text="string").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    k = F.col("_key")
    rows = rows.withColumns({"shard": rendezvous(k, weights), "grown_shard": rendezvous(k, [*weights, grown_weight])})
    return rows.drop("_key")


def slots(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """Adds slot: the row's place in its shard. Sorted inside (shard, bucket) and shifted by what smaller buckets hold."""
    buckets = buckets or max(BUCKETS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "_b", "_base")
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("_in", inside)
    # at most shards x buckets rows
    return numbered.join(F.broadcast(base), ["shard", "_b"]).withColumn("slot", (F.col("_base") + F.col("_in")).cast("long")).drop("_b", "_base", "_in")
