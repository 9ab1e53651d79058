"""Enrichment and verification from captured answers: place details under a budget, and phone lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import ORDER
from . import stateful

# Where each source's raw data holds the id that its details are asked by.
DETAIL_IDS = {"google": "place_id", "yelp": "id"}


def detail_id() -> Column:
    """The id of a record's place at its source, or null."""
    found = F.lit(None).cast("string")
    for source, key in DETAIL_IDS.items():
        found = F.when(F.col("source") == source, F.get_json_object("raw_data", f"$.{key}")).otherwise(found)
    return F.nullif(found, F.lit(""))


def with_details(df: DataFrame, details: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """Blank phones and websites of the sources in caps filled from details (source, source_id, phone, website).

    A record with both, or without an id, asks for nothing.  In row order the first `cap` distinct ids of a source are
    paid for (None: all); a repeated id costs nothing; an id beyond the cap is not asked, and its records stay as
    they are.  Nothing is overwritten; a filled phone is not_checked.
    """
    wanted = F.col("source").isin(list(caps)) & ~(tx.present(F.col("phone")) & tx.present(F.col("website")))
    asked = df.where(wanted).select(ORDER, "source", detail_id().alias("source_id")).where("source_id is not null").withColumn("hit", F.lit(False))
    spent = stateful.spend_budget(asked, caps)
    known = details.groupBy("source", "source_id").agg(F.first("phone", True).alias("__phone"), F.first("website", True).alias("__website"))
    got = spent.where("action <> 'skipped'").join(known, ["source", "source_id"]).select(F.col(ORDER).alias("__at"), "__phone", "__website")
    out = df.join(got, F.col(ORDER) == F.col("__at"), "left")
    fill = {c: tx.blank(F.col(c)) & tx.present(F.col(f"__{c}")) for c in ("phone", "website")}
    fresh = {c: F.when(fill[c], F.col(f"__{c}")).otherwise(F.col(c)) for c in fill}
    if "phone_status" in df.columns:
        fresh["phone_status"] = F.when(fill["phone"], "not_checked").otherwise(F.col("phone_status"))
    return out.select(*[fresh.get(c, F.col(c)).alias(c) for c in df.columns])


def phone_results(df: DataFrame, lookups: DataFrame) -> DataFrame:
    """(_ord, result) of the records whose phone a captured lookup (phone, result) answers."""
    known = lookups.groupBy(tx.digits(F.col("phone")).alias("__phone")).agg(F.max("result").alias("result"))
    return df.where(tx.present(F.col("phone"))).select(ORDER, tx.digits(F.col("phone")).alias("__phone")).join(known, "__phone").select(ORDER, "result")
