"""Weighted rendezvous hashing of record keys over shards.

Every (key, shard) pair has a hash u in (0, 1) and the score weight / -ln(u); a record goes to the
shard of its largest score.  Another shard only adds scores, so the records that move are those
whose largest score is the new shard's.

Defined results.  A null key is the key ''.  Equal keys share a shard, repeated rows too, each in a slot of its own; slots within a
shard follow a hash of the row (key, size, CRC of the text), then doc_id, size and CRC.  A null or empty text has size 1 and the CRC of no
bytes.  Ties of scores go to the larger shard number.  An empty table gives no row.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import positions

SHARDS = 8
_BUCKETS = 4096


def _score(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.lit(weight) / -F.ln(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to len(weights)-1, of a string key; ties go to the larger number."""
    scores = [F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign(docs: DataFrame, weights: list[float] | None = None, grown: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard once one of weight `grown` is added."""
    weights = weights or [1.0] * SHARDS
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shard_of(key, weights).alias("shard"), shard_of(key, [*weights, grown]).alias("grown_shard"))
    row = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("bucket", F.conv(F.substring(row, 1, 6), 16, 10).cast("long") % _BUCKETS)
    return positions(rows, ["shard"], ["bucket"], ["doc_id", "size", "text_crc32"], "slot")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
