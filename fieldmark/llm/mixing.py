"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document expects target / source size copies.  Documents stand in order of
size class, the running sum of their expected copies starts at one random offset, and a document
is emitted once per integer the sum crosses in it.  The order by size makes every stretch of
sizes take its share, so the words taken miss the target by about the size of the source's largest document at most:
a few per cent for sources of hundreds of documents, more where one document holds a fifth of all words.

Targets share the total by weight; a target stops at `most` times its source's size and the excess is
shared again by weight.  That is water filling: with sources by cap / weight, source k is at its cap
when the level that would empty the rest, (total - caps before) / (weights before), reaches cap / weight.

Defined results.  A null source is a source of its own, last in order.  A null or empty text has size 0.  A null
doc_id counts as 0 for the order.  Repeated rows are rows of their own; ties of size go by doc_id, then a hash of the text.  A source
without words gets none; an empty table gives no row.  Columns with other names than doc_id, text and source have no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import positions
from .words import shared_dir

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
_WORD = r"[^\x20\x09-\x0D]+"
#: Words of one size class, and the last class.
_CLASS, _LAST = 64, 4096
#: Parts of a size class.
_PARTS = 64


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, source_size, target) of every source; a row per source, so one task orders them."""
    sources = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy(F.lit(0))
    by_level = everything.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    caps, used = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - caps) / (F.sum("weight").over(everything) - used)
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "source_key", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(final * F.col("weight"))
    return sources.select("source_key", "source_size", target.alias("target"))


def _key():
    return F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source").cast("string"), F.lit("")))


def _size():
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def _crossed(rate, offset):
    """Integers that the running sum of expected copies crosses in a document."""
    return F.floor((F.col("rank") + 1) * rate + offset) - F.floor(F.col("rank") * rate + offset)


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sample(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """(doc_id, source_key, size, text_hash, source_size, target, copies) of every row of docs."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("source_key"), _size().alias("size"), _text_hash().alias("text_hash")).checkpoint()
    placed = rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "class": F.least(F.floor(F.col("size") / _CLASS), F.lit(_LAST))})
    placed = placed.withColumn("part", F.conv(F.substring(F.md5(F.concat_ws(":", "id", "size")), 1, 4), 16, 10).cast("long") % _PARTS)
    ranked = positions(placed, ["source_key"], ["class", "part"], ["size", "id", "text_hash"], "rank")
    ranked = ranked.join(source_targets(rows, weights, most), "source_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source_key"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    ranked = ranked.withColumns({"rate": rate, "offset": offset})
    return ranked.select("doc_id", "source_key", "size", "text_hash", "source_size", "target", _crossed(F.col("rate"), F.col("offset")).alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of docs."""
    own = [F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), _key().alias("source_key"), _size().alias("size"), _text_hash().alias("text_hash"))
    keys = ["id", "source_key", "size", "text_hash"]
    # rows of one id, source and text: the n-th, by what else they hold, takes the n-th's copies
    by = [f"own_{k}" for k, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind and "variant" not in kind]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*by)))
    taken = sample(docs, weights, most, seed).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("copies"))).where("copies > 0").select(*keys, "nth", "copies")
    both = rows.withColumn("nth", nth).join(taken, [*keys, "nth"])
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return both.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return sample(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
