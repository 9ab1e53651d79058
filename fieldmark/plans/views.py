"""Deterministic record views over the driver's tables, for Spark and as SQL text for the oracle.

Moduli make collisions, blanks and malformed values on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ORDER, as_records

_KEYS = {"customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to all cores at least: a small file is one split, and work on its rows would be one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def raw_sql(kind: str) -> str:
    """Raw business rows, in SQL that both engines read; columns: k, then text columns."""
    key, nation = _KEYS[kind]
    primary = kind == "customer"
    k = f"cast({key} as bigint)"
    s = f"cast({key} as string)"
    phone = f"concat('(408) 555-', lpad(cast({key} % 997 as string), 4, '0'))" if primary else f"concat('+1 408 555 ', lpad(cast({key} % 997 as string), 4, '0'))"
    site = f"concat('https://www.site', cast({key} % 731 as string), '.example.test/')" if primary else f"concat('http://site', cast({key} % 731 as string), '.example.test')"
    name = f"concat('  Shop  ', cast({key} % 700 as string), ' ')" if primary else f"concat('SHOP ', cast({key} % 700 as string), '.')"
    return f"""select {k} as k, {name} as name, {'c_mktsegment' if primary else "'SUPPLY'"} as category,
 concat(cast({key} % 89 as string), ' Main  St.') as address, n_name as city, r_name as state,
 case when {key} % 13 = 0 then '' when {key} % 17 = 0 then '555-12' else {phone} end as phone,
 case when {key} % 3 = 0 then '' when {key} % 7 = 0 then 'blue broom at example.test' else concat(' User', cast({key} % 500 as string), '@Mail.Example.test ') end as email,
 case when {key} % 5 = 0 then '' when {key} % 23 = 0 then concat('<', {site}, '>') else {site} end as website,
 case when {key} % 4 = 0 then '4.5' when {key} % 4 = 1 then '9/10' when {key} % 4 = 2 then '-2' else 'NA' end as rating,
 case when {key} % 3 = 0 then '1,250' when {key} % 3 = 1 then '3.0' else '17' end as reviews,
 case when {key} % 6 = 0 then cast({key} - {key} % 12 as string) else '' end as npi,
 '{'primary' if primary else 'supp'}' as source,
 case when {key} % 11 = 0 then '' else concat('https://src.example.test/', {s}) end as source_url,
 cast({key} % 400 as int) as age_days
 from {kind} join nation on {nation} = n_nationkey join region on n_regionkey = r_regionkey"""


def raw(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    spread(table(spark, sf_dir, kind), _KEYS[kind][0]).createOrReplaceTempView(f"fieldmark_{kind}")
    for t in ("nation", "region"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"fieldmark_{t}")
    text = raw_sql(kind).replace(f"from {kind} join nation on", f"from fieldmark_{kind} join fieldmark_nation on").replace("join region on", "join fieldmark_region on")
    return spark.sql(text)


AS_OF = "2025-06-01 00:00:00"


def records(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Full records, uncleaned; rating and review_count are still text."""
    rows = raw(spark, sf_dir, kind)
    fields = {c: F.col(c) for c in ("name", "category", "address", "city", "state", "phone", "email", "website", "source", "source_url")}
    fields["observed_at"] = F.when(F.col("source_url") != "", F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.col("age_days")))
    fields["source_ids"] = F.when(F.col("npi") != "", F.create_map(F.lit("npi"), F.col("npi"))).otherwise(F.create_map().cast("map<string,string>"))
    out = as_records(rows, fields, order=F.col("k"), keep=[F.col("rating").alias("raw_rating"), F.col("reviews").alias("raw_reviews")])
    return out.drop("rating", "review_count").withColumnsRenamed({"raw_rating": "rating", "raw_reviews": "review_count"})


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary rows, then supplemental ones, in one order."""
    p, s = records(spark, sf_dir, "customer"), records(spark, sf_dir, "supplier")
    return p.unionByName(s.withColumn(ORDER, F.col(ORDER) + 1_000_000_000_000))


# SQL text of the cleaning functions, for the oracle.
def q_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x},''),'[^0-9]','','g')"


def q_phone(x: str) -> str:
    return f"(case when length({q_digits(x)}) >= 7 then {q_digits(x)} else '' end)"


def q_email(x: str) -> str:
    t = f"lower(trim(coalesce({x},'')))"
    return f"(case when regexp_matches({t}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then {t} else '' end)"


def q_host(t: str) -> str:
    return f"(case when {t} = '' then '' else regexp_extract(case when regexp_matches({t}, '^https?://') then {t} else 'https://'||{t} end, '^https?://([^/?#]*)', 1) end)"


def q_clean_site(x: str) -> str:
    wrapping = "'[](){}<>\"'''"
    return f"replace({q_host(f'trim(lower(trim(coalesce({x},chr(32)))), {wrapping})')}, 'www.', '')"


def q_site(x: str) -> str:
    """Validated, then normalized."""
    t = f"lower(trim(replace(replace({q_clean_site(x)},'[',''),']','')))"
    return f"regexp_replace(regexp_replace({q_host(t)}, '^www\\.', ''), '/+$', '')"


def q_collapse(x: str) -> str:
    return f"regexp_replace(trim(coalesce({x},'')), '\\s+', ' ', 'g')"


def q_match_text(x: str) -> str:
    return q_collapse(f"replace(lower(coalesce({x},'')), '.', ' ')")


def q_match_phone(x: str) -> str:
    d = q_digits(x)
    return f"(case when length({d}) = 11 and {d} like '1%' then substr({d}, 2) else {d} end)"


def q_match_site(x: str) -> str:
    t = f"regexp_replace(trim(lower(coalesce({x},''))), '/+$', '')"
    return f"regexp_replace(regexp_replace(regexp_replace({t}, '^https://', ''), '^http://', ''), '^www\\.', '')"


def q_records(kind: str) -> str:
    """Raw rows as records with _ord and observed_at."""
    return f"(select k as _ord, *, case when source_url <> '' then timestamp '{AS_OF}' - to_days(age_days) end as observed_at from ({raw_sql(kind)}))"


def q_both() -> str:
    return f"(select * from {q_records('customer')} union all select * replace (_ord + 1000000000000 as _ord) from {q_records('supplier')})"


def q_clean(source: str) -> str:
    """Validated and normalized records."""
    return f"""(select _ord, source, source_url, observed_at, npi, {q_collapse('name')} as name, category, {q_collapse('address')} as address, city, state,
 {q_phone('phone')} as phone, {q_email('email')} as email, {q_site('website')} as website,
 case when coalesce(email,'') = '' then 'not_found' when {q_email('email')} <> '' then 'syntax_valid' else 'unknown' end as email_status,
 case when coalesce(phone,'') = '' then 'not_found' when {q_phone('phone')} <> '' then 'format_valid' else 'invalid' end as phone_status,
 case when regexp_matches(rating, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then cast(rating as double) end as rating,
 case when regexp_matches(replace(reviews, ',', ''), '^[+-]?[0-9]+$') then cast(replace(reviews, ',', '') as bigint) end as review_count,
 (coalesce(email,'') <> '' and {q_email('email')} = '') as invalid_emails, (coalesce(phone,'') <> '' and {q_phone('phone')} = '') as invalid_phones
 from {source})"""
