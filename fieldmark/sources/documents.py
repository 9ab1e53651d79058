"""Whole records as JSON objects and back: claims, provenance and ids keep their nesting and their types.

A claim's value is a plain JSON value (text, number, true or false, null) in the object and a tagged one in the record; times
are ISO text in the object.  Writing what was read gives the same bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..schema import FIELDS, ORDER, RECORD, as_records, valid_claim
from .folder import Folder

_TIMES = ("scraped_at", "observed_at")
#: Raw answers of sources are no part of a saved record.
SAVED = tuple(f for f in FIELDS if f != "raw_data")
_CLAIM_TEXTS = ("key", "source", "source_record_id", "evidence_url", "observed_at", "method", "authority")
_PROVENANCE = "struct<source:string,evidence_url:string,observed_at:string,method:string>"
_CLAIM = "struct<key:string,value:variant," + ",".join(f"{f}:string" for f in _CLAIM_TEXTS[1:]) + ">"


def _iso(at: Column) -> Column:
    """ISO text in UTC, with fractions only where there are some."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(at, "SSSSSS")
    return F.concat(whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00"))


def _plain(value: Column) -> Column:
    """A tagged claim value as a variant; a whole number is written without a fraction."""
    number, kind = value["n"], value["kind"]
    whole = (F.abs(number) < float(1 << 53)) & (number == F.floor(number))
    return F.when(kind == "string", value["s"].cast("variant")).when((kind == "number") & whole, number.cast("long").cast("variant")).when(kind == "number", number.cast("variant")).when(kind == "boolean", value["b"].cast("variant"))


def to_documents(df: DataFrame) -> DataFrame:
    """(_ord, json): one object for each record, its fields in the order of the record."""
    claims = F.transform("claims", lambda c: F.struct(c["key"].alias("key"), _plain(c["value"]).alias("value"), *[(_iso(c[f]) if f == "observed_at" else c[f]).alias(f) for f in _CLAIM_TEXTS[1:]]))
    entries = F.array_sort(F.map_entries("field_provenance"))
    provenance = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.struct(*[(_iso(e["value"][f]) if f == "observed_at" else e["value"][f]).alias(f) for f in ("source", "evidence_url", "observed_at", "method")]))))
    made = {c: _iso(F.col(c)) for c in _TIMES} | {"claims": claims, "field_provenance": provenance, "source_ids": F.map_from_entries(F.array_sort(F.map_entries("source_ids")))}
    return df.select(ORDER, F.to_json(F.struct(*[made.get(f, F.col(f)).alias(f) for f in SAVED]), {"ignoreNullFields": "false"}).alias("json"))


def _tagged(value: Column) -> Column:
    """A variant as a tagged claim value."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    name = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(number, "number").when(value.isNull() | (kind == "VOID"), "null")
    # anything else is no claim value
    name = F.coalesce(name, F.raise_error(F.lit("A claim's value is a text, a number, true, false or null.")).cast("string"))
    return F.struct(
        name.alias("kind"), F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).alias("s"), F.when(number, F.try_variant_get(value, "$", "double")).alias("n"),
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).alias("b"),
    )


def from_documents(rows: DataFrame, json: str = "json") -> DataFrame:
    """Records of objects (json, _ord): known fields that are not empty; a registry address tells source, sources and id where they are not given.

    A claim without one of its needed texts is an error.
    """
    kinds = {f: "string" for f in _TIMES} | {"claims": f"array<{_CLAIM}>", "field_provenance": f"map<string,{_PROVENANCE}>", "rating": "string", "review_count": "string"}
    schema = ",".join(f"{f} {kinds.get(f, RECORD[f].dataType.simpleString())}" for f in SAVED)
    d = rows.select(ORDER, F.from_json(json, schema).alias("d")).select(ORDER, "d.*")
    claims = F.transform("claims", lambda c: F.struct(c["key"].alias("key"), _tagged(c["value"]).alias("value"), *[(tx.to_timestamp(c[f]) if f == "observed_at" else F.coalesce(c[f], F.lit("supplemental")) if f == "authority" else c[f]).alias(f) for f in _CLAIM_TEXTS[1:]]))
    provenance = F.transform_values("field_provenance", lambda _, p: F.struct(p["source"].alias("source"), p["evidence_url"].alias("evidence_url"), tx.to_timestamp(p["observed_at"]).alias("observed_at"), p["method"].alias("method")))
    fine = F.forall(F.coalesce(F.col("made_claims"), F.array().cast(RECORD["claims"].dataType)), valid_claim)
    d = d.withColumn("made_claims", claims).withColumn("made_claims", F.when(fine, F.col("made_claims")).otherwise(F.raise_error(F.lit("A claim lacks its key, source, record id, evidence, method or authority.")).cast(RECORD["claims"].dataType)))
    fields = {f: F.nullif(F.col(f), F.lit("")) if isinstance(RECORD[f].dataType, T.StringType) else F.col(f) for f in SAVED}
    fields |= {c: tx.to_timestamp(F.col(c)) for c in _TIMES} | {"claims": F.col("made_claims"), "field_provenance": provenance, "rating": tx.to_float(F.col("rating")), "review_count": tx.to_int(F.col("review_count"))}
    return as_records(d, recovered(fields, {"source", "discovery_sources", "source_ids"}))


def recovered(fields: dict[str, Column], known: set[str]) -> dict[str, Column]:
    """Fields with what a provider registry's address in source_url tells about source, sources and id; known: those that may be given already."""
    npi = F.regexp_extract(F.coalesce(fields.get("source_url", F.lit(None).cast("string")), F.lit("")), r"(?i)npiregistry\.cms\.hhs\.gov/provider-view/(\d{10})(?!\d)", 1)
    told = {"source": F.lit("nppes"), "discovery_sources": F.array(F.lit("nppes")), "source_ids": F.create_map(F.lit("npi"), npi)}
    out = dict(fields)
    for f, value in told.items():
        given = fields[f] if f in known and f in fields else F.lit(None).cast(RECORD[f].dataType)
        has = F.coalesce(given != "", F.lit(False)) if f == "source" else F.coalesce(F.size(given) > 0, F.lit(False)) if f == "discovery_sources" else F.coalesce(F.cardinality(given) > 0, F.lit(False))
        out[f] = F.when(~has & (npi != ""), value).otherwise(given)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files that each hold an array of objects; anything else is an error."""
    from .readers import with_order

    texts = with_order(spark.read.text(path, wholetext=True))
    wrong = F.raise_error(F.lit("A saved result is a list of objects.")).cast("array<variant>")
    listed = F.when(F.substring(F.ltrim("value"), 1, 1) == "[", F.from_json("value", "array<variant>")).otherwise(wrong)
    items = texts.select(F.col(ORDER).alias("file"), F.posexplode(F.coalesce(listed, wrong)).alias("nth", "item"))
    kind = F.schema_of_variant("item")
    text = F.when(kind.startswith("OBJECT"), F.to_json("item")).otherwise(F.raise_error(F.lit("A saved result is a list of objects.")).cast("string"))
    return from_documents(items.select((F.shiftleft("file", 40) + F.col("nth")).alias(ORDER), text.alias("json")))


def write_documents(df: DataFrame, folder: Folder, name: str) -> str:
    """Writes records, in their order, as one JSON array."""
    folder.publish([(folder.make_table(name, to_documents(df).orderBy(ORDER).select("json"), "documents"), name)])
    return folder.at(name)
