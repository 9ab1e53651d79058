"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. language ID: a document whose text is null or has no letter, or whose language is not told apart from
   the others (score under MIN_SCORE), goes; lang becomes the predicted language.
2. n-gram Jaccard join: of each group of near copies the document with the smallest doc_id stays.
   Rows that repeat a doc_id are told apart by their text: of a group one row stays, the first by doc_id, then text.
   Blank texts have no n-grams; each is its own group.  A row without a doc_id is in no group and stays.
3. secret scan: secrets in a text are masked and n_chars is counted anew; no document goes.
4. mixing: documents are taken as often as their source's target weight asks for.
5. packing: the pieces of all documents and their places in sequences.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm import language_id, mixing, ngram_join, packing, secret_scan
from fieldmark.llm.words import shared_dir

#: Even a short text of known words scores far above this; four languages that a text fits equally share 0.25 each.
MIN_SCORE = 0.3


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of columns clashes with."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    pred, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    told = language_id.annotate(docs, model, pred, score)
    kept = told.where((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= MIN_SCORE))
    return kept.select(*[F.col(pred).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    key, other = fresh("row_key", docs.columns), fresh("other_id", docs.columns)
    id_of = F.col("doc_id").cast("long")
    repeated = docs.where(id_of.isNotNull()).groupBy(id_of.alias(other)).count().where("count > 1").select(other).checkpoint()
    if repeated.isEmpty():
        groups = ngram_join.similar_components(docs)
        gone = groups.where("doc_id is not null and component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
        return docs.join(gone, F.col("doc_id") == F.col(other), "left_anti")

    # rows that repeat a doc_id go by a hash of id and text, so equal rows are one; the others by their id
    hashed = F.xxhash64(id_of, F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = docs.join(repeated, id_of == F.col(other), "left").withColumn(key, F.when(F.col(other).isNotNull(), hashed).otherwise(id_of))
    own = marked.where(F.col(other).isNotNull()).select(F.col(key).alias("own_key"), id_of.alias("own_id"), F.col("text").cast("string").alias("own_text")).distinct()
    groups = ngram_join.similar_components(marked.select(F.col(key).alias("doc_id"), "text")).where("doc_id is not null and component_id is not null").select("doc_id", "component_id").distinct()
    placed = groups.join(own, F.col("doc_id") == F.col("own_key"), "left").select("component_id", F.struct(F.coalesce("own_id", "doc_id").alias("id"), F.col("own_text").alias("text"), F.col("doc_id").alias("key")).alias("place"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first")).select("component_id", F.col("first.key").alias("stays"))
    gone = groups.join(first, "component_id").where("doc_id <> stays").select(F.col("doc_id").alias("gone_key"))
    left = marked.join(gone, F.col(key) == F.col("gone_key"), "left_anti")
    copies = F.col(other).isNotNull() & F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    nth = fresh("row_nth", docs.columns)
    one = left.where(copies).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))).where(F.col(nth) == 1)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return left.where(~copies).select(*names).unionByName(one.select(*names))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_scan.redact(docs, secret_scan.train(words=public_tokenizers.path("word_bpe_49k.json")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", detect_language),
    ("ngram_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but mixing has an SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
