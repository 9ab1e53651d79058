"""Delivery: classification, provenance, quality aggregates and export projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import COMPLETENESS, FIELDS, OBSERVABLE, ORDER, STATUSES, TERMINAL, VIEW_FIELDS

_REASONS = ("missing_name", "missing_location", "missing_phone_or_website", "missing_source_url", "missing_observed_at", "stale_observation")


def has_location() -> Column:
    a, c, s = (tx.present(F.col(x)) for x in ("address", "city", "state"))
    return (a & (c | s)) | (c & s)


def stale(as_of: Column, max_age_days: int | None) -> Column:
    if max_age_days is None:
        return F.lit(False)
    return F.coalesce(F.col("observed_at") < as_of - F.make_dt_interval(F.lit(max_age_days)), F.lit(False))


def fill_provenance(df: DataFrame) -> DataFrame:
    """Provenance for every observable field that has a value, where source, address and time are known; what is there stays."""
    known = tx.present(F.col("source")) & tx.present(F.col("source_url")) & F.col("observed_at").isNotNull()
    own = F.struct(F.col("source").alias("source"), F.col("source_url").alias("evidence_url"), F.col("observed_at").alias("observed_at"), F.lit("source_observation").alias("method"))
    entries = [F.when(known & F.coalesce(F.col(f).cast("string") != "", F.lit(False)), F.struct(F.lit(f).alias("key"), own.alias("value"))) for f in OBSERVABLE]
    fill = F.map_from_entries(F.array_compact(F.array(*entries)))
    old = F.coalesce("field_provenance", F.create_map().cast("map<string,struct<source:string,evidence_url:string,observed_at:timestamp,method:string>>"))
    return df.withColumn("field_provenance", F.map_concat(F.map_filter(fill, lambda k, _: ~F.map_contains_key(old, k)), old))


def classify(df: DataFrame, as_of: Column | None = None, max_age_days: int | None = None) -> DataFrame:
    """record_status and quality_reasons of every row; closed, out_of_scope and duplicate rows keep theirs.

    observed_at falls back on scraped_at.  as_of is the clock for staleness, now() unless given.
    """
    df = df.withColumn("observed_at", F.coalesce("observed_at", "scraped_at"))
    if "field_provenance" in df.columns:
        df = fill_provenance(df)
    tests = (
        tx.blank(F.col("name")), ~has_location(), tx.blank(F.col("phone")) & tx.blank(F.col("website")), tx.blank(F.col("source_url")),
        F.col("observed_at").isNull(), stale(as_of if as_of is not None else F.current_timestamp(), max_age_days),
    )
    reasons = F.array_compact(F.array(*[F.when(t, r) for t, r in zip(tests, _REASONS, strict=True)]))
    terminal, known = F.col("record_status").isin(*TERMINAL), F.col("record_status").isin(*STATUSES)
    status = F.when(terminal, F.col("record_status")).when(~known, "needs_review").when(F.size(reasons) == 0, "accepted").otherwise("incomplete")
    why = F.when(terminal, F.col("quality_reasons")).when(~known, F.array(F.lit("unknown_record_status"))).otherwise(reasons)
    return df.withColumns({"record_status": status, "quality_reasons": why})


def accepted(df: DataFrame) -> DataFrame:
    return df.where("record_status = 'accepted'")


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("record_status").agg(F.count("*").alias("n")).orderBy("record_status")


def reason_counts(df: DataFrame) -> DataFrame:
    """(reason, n) over rows that are not accepted; a row without a reason counts as 'status:<status>'."""
    named = F.when(F.size("quality_reasons") > 0, F.col("quality_reasons")).otherwise(F.array(F.concat(F.lit("status:"), "record_status")))
    return df.where("record_status <> 'accepted'").select(F.explode(named).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def completeness(df: DataFrame) -> DataFrame:
    """(field, present, total, percent) of the twelve contact fields, from one pass."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(tx.present(F.col(f))).alias(f) for f in COMPLETENESS])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in COMPLETENESS])).alias("x")
    percent = F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col("x.present") / F.col("total"), 2)).otherwise(0.0)
    return one.select("total", cells).select("x.field", "x.present", "total", percent.alias("percent"))


def summary(df: DataFrame, acquired: int | Column, duplicates: int | Column = 0) -> DataFrame:
    """One row: acquired, classified and delivered records, duplicates, and a count per status."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    counts = [F.count_if(F.col("record_status") == s).alias(f"status_{s}") for s in STATUSES]
    return df.agg(F.count("*").alias("classified"), F.count_if(F.col("record_status") == "accepted").alias("delivered"), *counts).select(lit(acquired).cast("long").alias("acquired"), "classified", "delivered", lit(duplicates).cast("long").alias("duplicates_removed"), *[f"status_{s}" for s in STATUSES])


def evidence(df: DataFrame) -> DataFrame:
    """(_ord, evidence): JSON of name, status, provenance by field and, where there are any, claims."""
    entry = F.array_sort(F.map_entries("field_provenance"))
    claims = F.when(F.size("claims") > 0, F.col("claims"))
    return df.select(ORDER, F.to_json(F.struct("name", "source", "source_url", "record_status", entry.alias("fields"), claims.alias("claims"))).alias("evidence"))


def quality(df: DataFrame) -> DataFrame:
    return df.select(ORDER, "name", "record_status", "quality_reasons", "email_status", "phone_status")


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named fields in order; a name that no record has is null."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def view(df: DataFrame, fields: list[str] | None = None, limit: int | None = 10, populated: str | None = None) -> DataFrame:
    """A read-only preview in input order: empty values as null, rows with `populated` filled."""
    rows = df.where(tx.present(F.col(populated).cast("string"))) if populated else df
    rows = rows.orderBy(ORDER)
    rows = rows.limit(limit) if limit is not None else rows
    return rows.select(*[F.nullif(F.col(f).cast("string"), F.lit("")).alias(f) for f in (fields or VIEW_FIELDS)])


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in input order."""
    return df if limit is None else df.orderBy(ORDER).limit(limit)


def merge_verification(df: DataFrame, results: DataFrame, key: str = ORDER) -> DataFrame:
    """phone_status replaced where a provider gave a result; blank phones are left out, no result keeps the old."""
    found = results.select(F.col(key).alias("__k"), F.col("result").alias("__r"))
    out = df.join(found, (F.col(key) == F.col("__k")) & tx.present(F.col("phone")), "left")
    return out.withColumn("phone_status", F.coalesce("__r", "phone_status")).select(*df.columns)


def country_hint() -> Column:
    """US where a state is given or the country is one of its names."""
    return F.when(tx.present(F.col("state")) | F.lower(tx.strip(F.col("country"))).isin("united states", "usa", "us"), "US")


def unknown_fields(fields: list[str]) -> list[str]:
    return [f for f in fields if f not in FIELDS]
