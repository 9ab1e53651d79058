"""Queries over whole tables for the parts of the record contract that the other views do not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts, delivery, history, linkage
from ..schema import ORDER, as_records
from ..sources import documents
from . import record_queries as rq
from . import views as v


def _preset(spark: SparkSession, d: str) -> DataFrame:
    """Clean records of which a third come with a terminal status of their own and a sixth with one that nobody knows."""
    k = F.col(ORDER) % 6
    status = F.when(k == 1, "closed").when(k == 3, "duplicate").when(k == 2, "odd").otherwise(F.col("record_status"))
    rows = contacts.normalize(contacts.validate(v.both(spark, d)), nfkc=False)
    return rows.withColumns({"record_status": status, "quality_reasons": F.when(k.isin(1, 3), F.array(F.lit("kept"))).otherwise(F.col("quality_reasons"))})


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return delivery.classify(_preset(spark, d), as_of=F.lit(v.AS_OF).cast("timestamp"), max_age_days=180)


def classify_preset_status(spark, d):
    return _classified(spark, d).select(F.col(ORDER).alias("k"), "record_status", F.array_join("quality_reasons", ",").alias("reasons"))


def accepted_only(spark, d):
    return delivery.accepted(_classified(spark, d)).select(F.col(ORDER).alias("k"), "name")


def quality_payload(spark, d):
    rows = delivery.quality(_classified(spark, d))
    return rows.select(F.col(ORDER).alias("k"), "name", "record_status", F.array_join("quality_reasons", ",").alias("reasons"), "email_status", "phone_status")


def evidence_payload(spark, d):
    """Evidence documents of all records, read back: identity, status and how many fields carry provenance from where."""
    rows = delivery.evidence(_classified(spark, d))
    read = F.from_json("evidence", "name string, source string, source_url string, record_status string, fields array<struct<key:string,value:struct<source:string,evidence_url:string,observed_at:string,method:string>>>, claims array<string>")
    got = rows.select(F.col(ORDER).alias("k"), read.alias("e")).select("k", "e.*")
    urls = F.array_join(F.array_sort(F.array_distinct(F.transform("fields", lambda f: f["value"]["evidence_url"]))), ",")
    return got.select("k", "name", "source", "record_status", F.size("fields").cast("long").alias("n_fields"), urls.alias("urls"), F.array_join(F.transform("fields", lambda f: f["key"]), ",").alias("fields"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = v.records(spark, d, "supplier")
    return v.records(spark, d, "customer"), s.where(F.col(ORDER) % 2 == 1), s.where(F.col(ORDER) % 2 == 0)


def link_two_sources(spark, d):
    p, odd, even = _halves(spark, d)
    return linkage.matches_in_order(p, [odd, even]).select("src_rank", "p_ord", "s_ord", "decision", "method")


def link_promote_contacts(spark, d):
    """Suppliers as a first-party review: besides websites, blank emails and social addresses are filled from safe matches."""
    p, s = v.records(spark, d, "customer"), v.records(spark, d, "supplier")
    s = s.withColumns({"source": F.lit("manual_first_party_review"), "linkedin": F.concat(F.lit("https://www.linkedin.com/company/s"), F.col(ORDER))})
    out = linkage.promote(p, s, linkage.match(p, s))
    return out.select(F.col(ORDER).alias("k"), "email", "email_status", "linkedin", F.array_join(F.array_sort(F.map_keys("field_provenance")), ",").alias("fields"))


def history_record_lookup(spark, d):
    """The versions of one customer out of three runs over all of them."""
    store = history.HistoryStore(spark, rq.scratch(spark), "customers")
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias(ORDER), F.col("c_name").alias("name"), F.concat("c_custkey", F.lit(" Main St")).alias("address"), F.lit("4085550100").alias("phone"), F.col("c_mktsegment").alias("segment"))
    for day in (1, 2, 3):
        records = as_records(rows.where((F.col(ORDER) + day) % 5 != 0), {"name": F.col("name"), "address": F.col("address"), "phone": F.col("phone"), "category": F.concat("segment", F.lit(f" {day // 2}")), "record_status": F.lit("accepted")})
        store.record_run(f"r{day}", f"2026-01-0{day}", records)
    wanted = rows.where(F.col(ORDER) == 43).select(history.stable_id({"name", "address", "phone"}).alias("id")).first()["id"]
    return store.record_versions(wanted).select("run_id", "name", "category")


def documents_round_trip(spark, d):
    """All records as JSON documents and back."""
    rows = documents.from_documents(documents.to_documents(delivery.fill_provenance(_preset(spark, d))))
    return rows.select(F.col(ORDER).alias("k"), "name", "email", "rating", "review_count", F.coalesce(F.col("source_ids")["npi"], F.lit("")).alias("npi"), F.size("field_provenance").cast("long").alias("n_provenance"), F.coalesce(F.date_format("observed_at", "yyyy-MM-dd"), F.lit("")).alias("observed"), "record_status")


_NAMES = ("classify_preset_status", "accepted_only", "quality_payload", "evidence_payload", "link_two_sources", "link_promote_contacts", "history_record_lookup", "documents_round_trip")
QUERIES = {name: globals()[name] for name in _NAMES}

# ---- SQL ----
_DONE = rq._CLASS.format(src=rq._CB)
_PRESET = f"""(select * replace (case _ord % 6 when 1 then 'closed' when 3 then 'duplicate' when 2 then 'needs_review' else record_status end as record_status,
 case when _ord % 6 in (1, 3) then 'kept' when _ord % 6 = 2 then 'unknown_record_status' else reasons end as reasons) from {_DONE})"""
_FIELDS = ("name", "category", "address", "city", "state", "phone", "email", "website", "rating", "review_count")
_PROVED = ", ".join(f"case when source_url <> '' and observed_at is not null and coalesce(cast({f} as varchar), '') <> '' then '{f}' end" for f in sorted(_FIELDS))
_SAFE = """decision = 'matched' and (fields like '%source_id%' or (fields like '%phone%' and p_name = s_name and p_address = s_address and p_city = s_city and p_state = s_state and p_name <> '' and p_address <> '' and p_city <> '' and p_state <> ''))"""


def _half(rank: int, odd: int) -> str:
    return f"select {rank} as src_rank, * from ({rq._match_sql(f'(select * from {rq._S} where _ord % 2 = {odd})')} select p_ord, s_ord, decision, method from m)"


SQL = {
    "classify_preset_status": f"select _ord as k, record_status, reasons from {_PRESET}",
    "accepted_only": f"select _ord as k, name from {_PRESET} where record_status = 'accepted'",
    "quality_payload": f"select _ord as k, name, record_status, reasons, email_status, phone_status from {_PRESET}",
    "evidence_payload": f"""select _ord as k, name, source, record_status, len(f)::bigint as n_fields, case when len(f) > 0 then source_url else '' end as urls, array_to_string(f, ',') as fields
 from (select *, list_filter([{_PROVED}], lambda x: x is not null) as f from {_PRESET})""",
    "link_two_sources": f"{_half(0, 1)} union all {_half(1, 0)}",
    "link_promote_contacts": f"""{rq._M}, safe as (select m.p_ord, m.s_ord, s0.email as s_email, s0.website as s_site from m join p using (p_ord) join s using (s_ord) join {rq._S} s0 on s0._ord = m.s_ord where {_SAFE}),
 j as (select r._ord as k, r.email, r.website, s_ord, s_email, s_site, (r.email = '' and coalesce(s_email, '') <> '') as fe, (r.website = '' and coalesce(s_site, '') <> '') as fw from {rq._P} r left join safe on r._ord = safe.p_ord)
 select k, case when fe then s_email else email end as email, case when fe then 'not_checked' else 'not_found' end as email_status, case when s_ord is not null then 'https://www.linkedin.com/company/s' || s_ord else '' end as linkedin,
 concat_ws(',', case when fe then 'email' end, case when s_ord is not null then 'linkedin' end, case when fw then 'website' end) as fields from j""",
    "history_record_lookup": "select 'r' || day as run_id, c_name as name, c_mktsegment || ' ' || (day // 2) as category from customer, (values (1), (2), (3)) t(day) where c_custkey = 43 and (c_custkey + day) % 5 <> 0",
    "documents_round_trip": f"""select _ord as k, name, email, rating, review_count, npi, len(list_filter([{_PROVED}], lambda x: x is not null))::bigint as n_provenance, coalesce(strftime(observed_at, '%Y-%m-%d'), '') as observed,
 case _ord % 6 when 1 then 'closed' when 3 then 'duplicate' when 2 then 'odd' else 'needs_review' end as record_status from {rq._CB}""",
}
