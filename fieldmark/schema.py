"""The record schema, its field sets, and small builders for claims and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = T.StructType([T.StructField("source", T.StringType()), T.StructField("evidence_url", T.StringType()), T.StructField("observed_at", T.TimestampType()), T.StructField("method", T.StringType())])
#: One of s (string), n (number) or b (boolean) is set; kind names it.
CLAIM_VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("b", T.BooleanType())])
CLAIM = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", CLAIM_VALUE)]
    + [T.StructField(c, T.StringType()) for c in ("source", "source_record_id", "evidence_url")]
    + [T.StructField("observed_at", T.TimestampType()), T.StructField("method", T.StringType()), T.StructField("authority", T.StringType())]
)

TEXT_FIELDS = ("name", "category", "address", "city", "state", "postal_code", "country", "phone", "email", "website", "facebook", "instagram", "linkedin", "twitter")
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT_FIELDS]
    + [T.StructField("rating", T.DoubleType()), T.StructField("review_count", T.LongType())]
    + [T.StructField("source", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("discovery_sources", T.ArrayType(T.StringType()))]
    + [T.StructField("scraped_at", T.TimestampType()), T.StructField("observed_at", T.TimestampType())]
    + [T.StructField("record_status", T.StringType()), T.StructField("quality_reasons", T.ArrayType(T.StringType())), T.StructField("email_status", T.StringType()), T.StructField("phone_status", T.StringType())]
    + [T.StructField("field_provenance", T.MapType(T.StringType(), PROVENANCE)), T.StructField("claims", T.ArrayType(CLAIM)), T.StructField("source_ids", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField("raw_data", T.StringType())]
)
FIELDS = tuple(f.name for f in RECORD)
#: The technical order column that every source adds.
ORDER = "_ord"

# Field sets of the record contract.
OBSERVABLE = TEXT_FIELDS + ("rating", "review_count")
COMPLETENESS = ("name", "address", "city", "state", "postal_code", "phone", "email", "website", "facebook", "instagram", "linkedin", "twitter")
NOT_EXPORTABLE = ("raw_data", "field_provenance", "quality_reasons", "claims", "source_ids")
EXPORTABLE = tuple(f for f in FIELDS if f not in NOT_EXPORTABLE)
VOLATILE = ("raw_data", "scraped_at", "observed_at", "field_provenance", "claims", "source_ids", "discovery_sources")
VIEW_FIELDS = ("name", "category", "address", "city", "state", "phone", "email", "website", "linkedin", "instagram", "facebook", "twitter")
STATUSES = ("accepted", "incomplete", "closed", "out_of_scope", "duplicate", "needs_review")
TERMINAL = ("closed", "out_of_scope", "duplicate")

_DEFAULTS = {"record_status": "needs_review", "email_status": "not_found", "phone_status": "not_found"}


def default(field: str) -> Column:
    """What a record holds where its source says nothing."""
    kind = RECORD[field].dataType
    if isinstance(kind, T.StringType) and field != "raw_data":
        return F.lit(_DEFAULTS.get(field, ""))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        empty = F.array() if isinstance(kind, T.ArrayType) else F.create_map()
        return empty.cast(kind)
    return F.lit(None).cast(kind)


def as_records(df: DataFrame, columns: dict[str, Column], order: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """A full record per row: the given columns, and defaults for the rest; null text becomes ''."""
    out = []
    for field in FIELDS:
        kind = RECORD[field].dataType
        if field in columns:
            value = columns[field].cast(kind)
            if isinstance(kind, T.StringType) and field != "raw_data":
                value = F.coalesce(value, default(field))
            elif isinstance(kind, (T.ArrayType, T.MapType)):
                value = F.coalesce(value, default(field))
        else:
            value = default(field)
        out.append(value.alias(field))
    extra = [order.cast("long").alias(ORDER)] if order is not None else ([F.col(ORDER)] if ORDER in df.columns else [])
    return df.select(*out, *extra, *(keep or []))


def claim_value(value: Column, kind: str) -> Column:
    """Tagged claim value; kind is string, number, boolean or null."""
    slots = {"s": ("string", "string"), "n": ("number", "double"), "b": ("boolean", "boolean")}
    return F.struct(F.lit(kind).alias("kind"), *[(value.cast(t) if kind == k else F.lit(None).cast(t)).alias(n) for n, (k, t) in slots.items()])


def claim(key: str, value: Column, kind: str, source: Column | str, record_id: Column, url: Column, observed_at: Column, method: str = "source_observation", authority: str = "supplemental") -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(
        F.lit(key).alias("key"), claim_value(value, kind).alias("value"), source.cast("string").alias("source"), record_id.cast("string").alias("source_record_id"), url.cast("string").alias("evidence_url"),
        observed_at.cast("timestamp").alias("observed_at"), F.lit(method).alias("method"), F.lit(authority).alias("authority"),
    )


def valid_claim(c: Column) -> Column:
    """Whether a claim has everything that a claim must have."""
    return F.lit(True) & F.forall(F.array(*[c[f] for f in ("key", "source", "source_record_id", "evidence_url", "method", "authority")]), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
