"""Validation and normalization of contact fields: one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_TRIMMED = ("name", "category", "address", "city", "state", "postal_code", "country", "facebook", "instagram", "linkedin", "twitter")
#: Per-row flags that validate() adds for counting.
FLAGS = ("invalid_emails", "invalid_phones", "invalid_websites")


def validate(df: DataFrame, flags: bool = False) -> DataFrame:
    """Text trimmed; numbers read; email, phone and website cleaned with their statuses.

    With flags, adds a boolean per field for values that were there and did not hold.
    """
    have = set(df.columns)
    out: dict[str, Column] = {c: F.coalesce(tx.strip(F.col(c)), F.lit("")) for c in _TRIMMED if c in have}
    if "rating" in have:
        out["rating"] = tx.to_float(F.col("rating"))
    if "review_count" in have:
        out["review_count"] = tx.to_int(F.col("review_count"))
    for field, clean, status in (("email", tx.clean_email, tx.email_status), ("phone", tx.clean_phone, tx.phone_status), ("website", tx.clean_website, None)):
        if field in have:
            raw = F.col(field)
            out[field] = clean(raw)
            if status:
                out[f"{field}_status"] = status(raw, clean(raw))
            if flags:
                out[f"invalid_{field}s"] = tx.present(raw) & (clean(raw) == "")
    return df.withColumns(out)


def normalize(df: DataFrame, nfkc: bool = True) -> DataFrame:
    """Every field with a registered normal form brought to it."""
    out = {}
    for field, function in tx.NORMALIZERS.items():
        if field in df.columns:
            plain = function is tx.normalize_text and not nfkc
            out[field] = tx.normalize_text(F.col(field), nfkc=False) if plain else function(F.col(field))
    return df.withColumns(out)


def counters(df: DataFrame) -> DataFrame:
    """(metric, value) of the flags that validate(flags=True) added; a metric that is 0 is left out."""
    sums = df.agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS if f in df.columns])
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).alias("value")) for f in sums.columns])).alias("m")
    return sums.select(stacked).select("m.metric", "m.value").where("value > 0")
