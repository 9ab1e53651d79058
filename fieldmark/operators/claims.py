"""Claims and research sessions: filters, latest values, conjunctive refinements, summaries, flat exports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Claim keys, refinement names and the words that call for them.
ENROLLED, OWNERSHIP, LONGEVITY, STATUS = "program.medi_cal_dental_ffs_enrolled", "ownership.independence_assessment", "business.longevity.minimum_years", "business.operational_status"
INDEPENDENT_WORDS = ("family owned", "family-owned", "independent", "locally owned", "locally-owned", "not corporate", "not a corporation", "not corporation")
ROUTES = (
    ("medi-cal-dental-enrollment", ("medi-cal", "medi cal")),
    ("ownership-evidence", ("family owned", "family-owned", "independent", "locally owned", "locally-owned", "corporate", "corporation")),
    ("longevity-evidence", ("years", "been open", "founded", "established", "long-running")),
    ("operational-status-evidence", ("closed", "retired", "inactive")),
    ("public-socials", ("linkedin", "instagram", "facebook", "twitter", "social")),
    ("public-email", ("email", "contact address")),
)
YEARS = r"\b(\d{1,3})\s*\+?\s*years?\b"
RESEARCH_COLUMNS = (
    "name category address city state postal_code phone phone_status email email_status website linkedin instagram facebook twitter "
    "medi_cal_dental_enrolled ownership_assessment longevity_minimum_years operational_status discovery_sources source_url evidence_urls"
).split()


def has_claim(key: str, test, claims: str = "claims") -> Column:
    """Whether some claim of the key passes test(value struct)."""
    return F.exists(claims, lambda c: (c["key"] == key) & F.coalesce(test(c["value"]), F.lit(False)))


def equals(value) -> object:
    """A test for claim values; booleans only equal booleans."""
    if isinstance(value, bool):
        return lambda v: (v["kind"] == "boolean") & (v["b"] == value)
    if isinstance(value, (int, float)):
        return lambda v: (v["kind"] == "number") & (v["n"] == float(value))
    if value is None:
        return lambda v: v["kind"] == "null"
    return lambda v: (v["kind"] == "string") & (v["s"] == value)


def filter_by_claim(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(has_claim(key, equals(value)))


def append_claim(df: DataFrame, key: str, claim: Column, when: Column | None = None) -> DataFrame:
    """Adds the claim to rows that do not hold its key yet."""
    free = ~F.exists("claims", lambda c: c["key"] == key)
    return df.withColumn("claims", F.when(free & (when if when is not None else F.lit(True)), F.array_append("claims", claim)).otherwise(F.col("claims")))


def latest(key: str, slot: str, claims: str = "claims") -> Column:
    """The last claim's value of the key in order, or null."""
    return F.try_element_at(F.filter(claims, lambda c: c["key"] == key), F.lit(-1))["value"][slot]


def expected_ownership(instruction: str) -> str:
    low = instruction.casefold()
    return "likely_independent" if any(w in low for w in INDEPENDENT_WORDS) else "likely_corporate"


def years_asked(instruction: str) -> int:
    m = re.search(YEARS, instruction)
    return int(m[1]) if m else 10


def predicate(plugin: str, instruction: str) -> Column:
    """What a refinement asks of a record; an unknown refinement asks nothing."""
    if plugin == "medi-cal-dental-enrollment":
        return has_claim(ENROLLED, equals(True))
    if plugin == "ownership-evidence":
        return has_claim(OWNERSHIP, equals(expected_ownership(instruction)))
    if plugin == "longevity-evidence":
        return has_claim(LONGEVITY, lambda v: (v["kind"] == "number") & (v["n"] >= years_asked(instruction)))
    if plugin == "operational-status-evidence":
        return has_claim(STATUS, equals("closed"))
    if plugin == "public-email":
        return tx.present(F.col("email"))
    if plugin == "public-socials":
        return reduce(lambda a, b: a | b, [tx.present(F.col(c)) for c in ("linkedin", "instagram", "facebook", "twitter")])
    return F.lit(True)


def route(instruction: str) -> list[str]:
    """The refinements an instruction calls for, in the order they are applied."""
    low = instruction.casefold()
    found = [plugin for plugin, words in ROUTES if any(w in low for w in words)]
    if not found:
        raise ValueError("No refinement understands this instruction.")
    return found


def latest_steps(steps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of (plugin, instruction) steps in order: the last run with one instruction, until a plugin repeats."""
    out: list[tuple[str, str]] = []
    for plugin, instruction in reversed(steps):
        if out and instruction != out[0][1] or plugin in {p for p, _ in out}:
            break
        out.append((plugin, instruction))
    return out[::-1]


def latest_matches(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Rows that satisfy every one of the latest steps; all rows without one."""
    tests = [predicate(p, i) for p, i in latest_steps(steps)]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def session_summary(df: DataFrame, steps: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row of eleven coverage counts, from one pass."""
    tests = [predicate(p, i) for p, i in latest_steps(steps or [])]
    social = reduce(lambda a, b: a | b, [tx.present(F.col(c)) for c in ("linkedin", "instagram", "facebook", "twitter")])
    counts = {
        "latest_matches": reduce(lambda a, b: a & b, tests, F.lit(True)),
        "with_phone": tx.present(F.col("phone")),
        "with_website": tx.present(F.col("website")),
        "with_email": tx.present(F.col("email")),
        "with_social": social,
        "medi_cal_dental_enrolled": has_claim(ENROLLED, equals(True)),
        "likely_independent": has_claim(OWNERSHIP, equals("likely_independent")),
        "likely_corporate": has_claim(OWNERSHIP, equals("likely_corporate")),
        "with_longevity_evidence": F.exists("claims", lambda c: c["key"] == LONGEVITY),
        "explicitly_closed": has_claim(STATUS, equals("closed")),
    }
    return df.agg(F.count("*").alias("total_records"), *[F.count_if(test).alias(name) for name, test in counts.items()])


def evidence_urls() -> Column:
    """Every address that provenance or a claim names, sorted, joined by ' | '."""
    urls = F.concat(F.transform(F.map_values("field_provenance"), lambda p: p["evidence_url"]), F.transform("claims", lambda c: c["evidence_url"]))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(urls, lambda u: F.coalesce(F.trim(u) != "", F.lit(False))))), " | ")


def research_export(df: DataFrame) -> DataFrame:
    """The 22 flat columns of a research result; claims give their latest values."""
    number = latest(LONGEVITY, "n")
    made = {
        "medi_cal_dental_enrolled": F.coalesce(latest(ENROLLED, "b").cast("string"), F.lit("unknown")),
        "ownership_assessment": F.coalesce(latest(OWNERSHIP, "s"), F.lit("unclear")),
        "longevity_minimum_years": F.coalesce(number.cast("bigint").cast("string"), F.lit("unknown")),
        "operational_status": F.coalesce(latest(STATUS, "s"), F.lit("unknown")),
        "discovery_sources": F.coalesce(F.nullif(F.array_join("discovery_sources", " | "), F.lit("")), F.nullif(F.col("source"), F.lit("")), F.lit("unknown")),
        "evidence_urls": evidence_urls(),
    }
    return df.select(*[made.get(c, F.col(c) if c in df.columns else F.lit("")).alias(c) for c in RESEARCH_COLUMNS])
