"""Queries over business-shaped views: cleaning, deduplication, linkage, delivery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import claims, contacts, dedup, delivery, enrichment, history, linkage, stateful
from ..operators.graph import ensure_checkpoint_dir
from ..schema import COMPLETENESS, ORDER, as_records, claim
from ..sources import readers, registry
from . import views as v


def _clean(spark, d, flags=False):
    return contacts.normalize(contacts.validate(v.both(spark, d), flags), nfkc=False)


def csv_business_projection(spark, d):
    out = contacts.normalize(contacts.validate(v.records(spark, d, "customer")), nfkc=False)
    return out.select(F.col(ORDER).alias("k"), "name", "address", "city", "state", "phone", "email", "website", "rating", "review_count", "email_status", "phone_status")


def contact_status_counts(spark, d):
    out = contacts.validate(v.both(spark, d), flags=True)
    return out.groupBy("email_status", "phone_status").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("invalid_emails", "invalid_phones")])


def pipeline_counters(spark, d):
    return contacts.counters(contacts.validate(v.both(spark, d), flags=True))


def normalize_text_ascii(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.normalize_text(F.col("text"), nfkc=False)).alias("normal_md5"), F.length(tx.normalize_address(F.col("text"))).cast("long").alias("n"))


def normalize_text_nfkc(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("normal_md5"))


def normalize_website_host(spark, d):
    pages = v.table(spark, d, "pages")
    return pages.select("page_id", tx.clean_website(F.col("url")).alias("cleaned"), tx.normalize_website(F.col("url")).alias("host"), tx.match_website(F.col("url")).alias("match_form"), tx.origin(F.col("url")).alias("origin"), tx.slug(F.col("url")).alias("slug"))


def match_keys(spark, d):
    rows = v.both(spark, d)
    return rows.select(F.col(ORDER).alias("k"), tx.match_phone(F.col("phone")).alias("phone_key"), tx.match_website(F.col("website")).alias("site_key"), tx.match_text(F.col("address")).alias("address_key"), tx.fuzzy_name(F.col("name")).alias("fuzzy_key"), tx.identity_text(F.col("name")).alias("identity_key"))


def dedup_identifier_keep_first(spark, d):
    return dedup.keep_first_window(_clean(spark, d)).select(F.col(ORDER).alias("k"), "name", "website", "email", "phone")


def dedup_merge_sources(spark, d):
    return dedup.keep_first(_clean(spark, d)).select(F.col(ORDER).alias("k"), F.array_join("discovery_sources", ",").alias("sources"))


def dedup_exact_v1(spark, d):
    return dedup.keep_first_window(_clean(spark, d), "exact_v1").select(F.col(ORDER).alias("k"), "name", "address", "phone")


def dedup_fuzzy_greedy(spark, d):
    out = dedup.fuzzy_keep_first(_clean(spark, d))
    return out.select(F.col(ORDER).alias("k"), "dedup_decision", F.array_join("discovery_sources", ",").alias("sources"))


def dedup_documents(spark, d):
    docs = v.table(spark, d, "documents")
    return docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _sides(spark, d):
    return v.records(spark, d, "customer"), v.records(spark, d, "supplier")


def link_edges(spark, d):
    return linkage.edges(*_sides(spark, d))


def link_decisions(spark, d):
    return linkage.match(*_sides(spark, d)).select("p_ord", "s_ord", "decision", F.array_join("fields", ",").alias("fields"), "method")


def link_counts(spark, d):
    return linkage.decision_counts(linkage.match(*_sides(spark, d)))


def link_promote_website(spark, d):
    p, s = _sides(spark, d)
    out = linkage.promote(p, s, linkage.match(p, s))
    return out.select(F.col(ORDER).alias("k"), "website", F.array_join("discovery_sources", ",").alias("sources"), F.size("field_provenance").alias("n_provenance"), F.col("field_provenance")["website"]["method"].alias("method"))


def link_review_page(spark, d):
    page = linkage.review_page(linkage.match(*_sides(spark, d)), offset=5, limit=40)
    return page.select("p_ord", "s_ord", "decision", "method")


def link_sources_in_order(spark, d):
    p, s = _sides(spark, d)
    return linkage.matches_in_order(p, [s, s]).select("src_rank", "p_ord", "s_ord", "decision")


def scratch(spark) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/query-{uuid.uuid4().hex}"


def csv_scan(spark, d):
    """Suppliers written as CSV parts and read back as client records, in input order."""
    path = scratch(spark)
    rows = v.table(spark, d, "supplier").orderBy("s_suppkey").select(F.col("s_name").alias("business_name"), F.concat("s_suppkey", F.lit(" Main, St \\ 1")).alias("address"), F.concat(F.lit("408-555-"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0")).alias("phone"), F.concat(F.lit("say \"hi\", "), F.col("s_name")).alias("category"), F.lit("1,204").alias("reviews"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_csv(spark, path).select(F.col(ORDER).alias("k"), "name", "address", "phone", "category", "review_count", "source")


def history_store_record(spark, d):
    """Three runs of customers recorded in a store; the versions of one of them."""
    store = history.HistoryStore(spark, scratch(spark), "customers")
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias(ORDER), F.col("c_name").alias("name"), F.concat("c_custkey", F.lit(" Main St")).alias("address"), F.concat(F.lit("4085550"), "c_custkey").alias("phone"), F.col("c_mktsegment").alias("segment"))
    for day in (1, 2, 3):
        kept = rows.where((F.col(ORDER) + day) % 5 != 0)
        records = as_records(kept, {"name": F.col("name"), "address": F.col("address"), "phone": F.col("phone"), "category": F.when((F.col(ORDER) + day) % 7 == 0, "changed").otherwise(F.col("segment")), "record_status": F.lit("accepted")})
        store.record_run(f"r{day}", f"2026-01-0{day}", records)
    current = store.current()
    return current.groupBy("first_seen_run_id", "last_seen_run_id", "versions", "is_present").agg(F.count("*").alias("n"))


def enrich_details(spark, d):
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias(ORDER), F.when(F.col("c_custkey") % 3 == 0, F.lit("own.example.test")).otherwise("").alias("website"), F.to_json(F.struct(F.concat(F.lit("g"), F.col("c_custkey") % 50).alias("place_id"))).alias("raw"))
    records = as_records(rows, {"source": F.lit("google"), "website": F.col("website"), "raw_data": F.col("raw")})
    details = spark.range(50).select(F.lit("google").alias("source"), F.concat(F.lit("g"), "id").alias("source_id"), F.concat(F.lit("40855501"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("phone"), F.concat(F.lit("site"), "id", F.lit(".example.test")).alias("website"))
    return enrichment.with_details(records, details, {"google": 10}).select(F.col(ORDER).alias("k"), "phone", "website", "phone_status")


def enroll_exact_id_semi_join(spark, d):
    number = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    listed = v.table(spark, d, "orders").where("o_orderstatus = 'F'").select(number("o_custkey").alias("npi"))
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias(ORDER), F.col("c_name").alias("name"), F.create_map(F.lit("npi"), number("c_custkey")).alias("source_ids"))
    records = as_records(rows, {"name": F.col("name"), "source_ids": F.col("source_ids")})
    key = claims.ENROLLED
    made = claim(key, F.lit(True), "boolean", "medi-cal-dental", F.col("source_ids")["npi"], F.lit("https://list.example.test"), F.lit(v.AS_OF).cast("timestamp"))
    out = linkage.enroll_by_id(records, listed, "npi", made, key, most=1 << 40)
    return out.select(F.col(ORDER).alias("c_custkey"), F.exists("claims", lambda c: (c["key"] == key) & c["value"]["b"]).alias("enrolled"))


def _classified(spark, d):
    return delivery.classify(_clean(spark, d), as_of=F.lit(v.AS_OF).cast("timestamp"), max_age_days=180)


def classify_delivery(spark, d):
    return _classified(spark, d).select(F.col(ORDER).alias("k"), "name", "record_status", F.array_join("quality_reasons", ",").alias("reasons"))


def status_counts(spark, d):
    return delivery.status_counts(_classified(spark, d))


def quality_reason_counts(spark, d):
    return delivery.reason_counts(_classified(spark, d))


def field_completeness(spark, d):
    return delivery.completeness(_clean(spark, d)).select("field", "present", "total", F.round("percent", 2).alias("percent"))


def delivery_summary(spark, d):
    kept = dedup.keep_first(_clean(spark, d))
    done = delivery.classify(kept, as_of=F.lit(v.AS_OF).cast("timestamp"), max_age_days=180)
    acquired = v.both(spark, d).agg(F.count("*").alias("acquired"))
    out = delivery.summary(done, 0).drop("acquired", "duplicates_removed")
    return out.join(acquired).select("acquired", "classified", "delivered", (F.col("acquired") - F.col("classified")).alias("duplicates_removed"), "status_accepted", "status_incomplete")


def provenance_fill(spark, d):
    out = delivery.fill_provenance(_clean(spark, d))
    return out.select(F.col(ORDER).alias("k"), F.explode("field_provenance").alias("field", "p")).select("k", "field", F.col("p.source").alias("source"), F.col("p.evidence_url").alias("url"))


def view_preview(spark, d):
    return delivery.view(_clean(spark, d), ["name", "city", "phone", "email", "website"], limit=25, populated="email")


def project_export(spark, d):
    return delivery.project(_clean(spark, d).withColumnRenamed(ORDER, "k"), ["k", "name", "city", "phone", "unknown_field"])


def stable_record_id(spark, d):
    return _clean(spark, d).select(F.col(ORDER).alias("k"), history.stable_id().alias("record_id"))


def record_id_canonical(spark, d):
    return v.both(spark, d).select(F.col(ORDER).alias("k"), linkage.record_id().alias("record_id"))


def parse_us_address(spark, d):
    rows = v.raw(spark, d, "customer")
    k = F.col("k")
    full = F.when(k % 4 == 0, F.concat_ws(", ", F.trim("address"), "city", F.concat(F.lit("CA 9"), F.lpad((k % 1000).cast("string"), 4, "0")), F.lit("USA"))).when(k % 4 == 1, F.concat_ws(", ", "city", F.lit("TX"), F.lit("USA"))).when(k % 4 == 2, F.col("address")).otherwise(F.concat(F.col("city"), F.lit(",,,,x")))
    return rows.select("k", tx.us_address(full).alias("a")).select("k", "a.*")


def phone_verification_merge(spark, d):
    rows = _clean(spark, d)
    results = rows.where(F.col(ORDER) % 3 == 0).select(ORDER, F.when(F.col(ORDER) % 2 == 0, "provider_valid").when(F.col(ORDER) % 9 == 0, F.lit(None).cast("string")).otherwise("provider_invalid").alias("result"))
    return delivery.merge_verification(rows, results).select(F.col(ORDER).alias("k"), "phone_status")


def first_n_rows(spark, d):
    return delivery.first_rows(_clean(spark, d), 100).select(F.col(ORDER).alias("k"), "name")


def aggregate_caps(spark, d):
    rows = v.both(spark, d).withColumn("location", F.col("city"))
    return stateful.cap_rows(rows, total=300, per_source=250, per_location=20).select(F.col(ORDER).alias("k"), "source", "location")


def policy_gate(spark, d):
    return registry.default_registry().frame(spark).select("source", "source_class", "allows_delivery", "allows_live_smoke")


def task_plan_cross(spark, d):
    nations = v.table(spark, d, "nation")
    sources = spark.createDataFrame([("csv", 0), ("nppes", 1), ("wa-li", 2)], "source string, rank int")
    out = sources.join(nations, how="cross").withColumn("task", F.row_number().over(_task_order()) - 1)
    return out.select("source", F.col("n_name").alias("city"), F.col("task").cast("long").alias("task"))


def _task_order():
    from pyspark.sql import Window

    # a plan has as many rows as sources times places: a driver-sized list
    return Window.orderBy("rank", "n_nationkey")


def session_claims(spark, d):
    """Records with claims from labels: documents as records, quality as longevity, toxic as closure."""
    from ..schema import as_records, claim

    docs, labels = v.table(spark, d, "documents").select("doc_id", "source", "lang"), v.table(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left")
    rid, url, at = F.col("doc_id").cast("string"), F.concat(F.lit("https://doc.example.test/"), F.col("doc_id")), F.lit(v.AS_OF).cast("timestamp")
    made = F.array_compact(
        F.array(
            F.when(F.col("quality").isNotNull(), claim(claims.LONGEVITY, F.col("doc_id") % 30, "number", "labels", rid, url, at)),
            F.when(F.col("toxic") == 1, claim(claims.STATUS, F.lit("closed"), "string", "labels", rid, F.concat(url, F.lit("/toxic")), at)),
            F.when(F.col("doc_id") % 4 == 0, claim(claims.OWNERSHIP, F.when(F.col("doc_id") % 8 == 0, "likely_corporate").otherwise("likely_independent"), "string", "labels", rid, url, at)),
            F.when(F.col("doc_id") % 20 == 0, claim(claims.OWNERSHIP, F.lit("likely_independent"), "string", "labels", rid, url, at)),
            F.when(F.col("doc_id") % 6 == 0, claim(claims.ENROLLED, F.col("doc_id") % 12 == 0, "boolean", "labels", rid, url, at)),
        )
    )
    fields = {"name": F.concat(F.lit("Doc "), rid), "category": F.col("lang"), "source": F.col("source"), "source_url": F.when(F.col("doc_id") % 5 == 0, "").otherwise(url), "claims": made, "email": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("d"), rid, F.lit("@example.test"))), "observed_at": at}
    return as_records(rows, fields, order=F.col("doc_id"))


def claims_filter(spark, d):
    return claims.filter_by_claim(session_claims(spark, d), claims.STATUS, "closed").select(F.col(ORDER).alias("k"), "name")


def claims_latest_pivot(spark, d):
    out = session_claims(spark, d)
    return out.select(F.col(ORDER).alias("k"), claims.latest(claims.OWNERSHIP, "s").alias("ownership"), claims.latest(claims.LONGEVITY, "n").cast("long").alias("years"), claims.latest(claims.STATUS, "s").alias("status"), claims.latest(claims.ENROLLED, "b").alias("enrolled"))


def refinement_and_match(spark, d):
    instruction = "independent offices open 12 years"
    steps = [(p, instruction) for p in claims.route(instruction)]
    return claims.latest_matches(session_claims(spark, d), steps).select(F.col(ORDER).alias("k"), "name")


def session_summary(spark, d):
    return claims.session_summary(session_claims(spark, d), [("public-email", "with email")])


def append_claim_if_absent(spark, d):
    from ..schema import claim

    rows = session_claims(spark, d)
    new = claim(claims.OWNERSHIP, F.lit("likely_corporate"), "string", "later", F.col("name"), F.lit("https://later.example.test"), F.lit(v.AS_OF).cast("timestamp"))
    out = claims.append_claim(rows, claims.OWNERSHIP, new)
    return out.select(F.col(ORDER).alias("k"), F.size("claims").cast("long").alias("n"), claims.latest(claims.OWNERSHIP, "s").alias("ownership"))


def evidence_urls_union(spark, d):
    rows = delivery.fill_provenance(session_claims(spark, d))
    return rows.select(F.col(ORDER).alias("k"), claims.evidence_urls().alias("urls"))


def research_export_row(spark, d):
    out = claims.research_export(session_claims(spark, d))
    return out.select("name", "email", "medi_cal_dental_enrolled", "ownership_assessment", "longevity_minimum_years", "operational_status", "discovery_sources", "source_url")


# ---- SQL ----
_B, _P, _S = v.q_both(), v.q_records("customer"), v.q_records("supplier")
_CB, _CP = v.q_clean(_B), v.q_clean(_P)
_KEY = "case when website <> '' then 'website' || chr(31) || website when email <> '' then 'email' || chr(31) || email when phone <> '' and name <> '' then 'phone_name' || chr(31) || phone || chr(31) || lower(name) else 'name_address' || chr(31) || lower(name) || chr(31) || lower(address) end"


def _match_sql(supplemental: str = _S) -> str:
    def side(x, src):
        return f"{x} as (select _ord as {x}_ord, npi as {x}_npi, {v.q_match_phone('phone')} as {x}_phone, {v.q_match_site('website')} as {x}_site, {', '.join(f'{v.q_match_text(c)} as {x}_{c}' for c in ('name', 'address', 'city', 'state'))} from {src})"

    return f"""with {side('p', _P)}, {side('s', supplemental)},
e0 as (select p_ord, s_ord, true as i, false as t, false as w from p join s on p_npi = s_npi where p_npi <> ''
 union all select p_ord, s_ord, false, true, false from p join s on p_phone = s_phone where p_phone <> ''
 union all select p_ord, s_ord, false, false, true from p join s on p_site = s_site where p_site <> ''),
e1 as (select p_ord, s_ord, bool_or(i) as by_id, bool_or(t) as by_phone, bool_or(w) as by_website from e0 group by all),
e2 as (select * exclude (h) from (select *, bool_or(by_id) over (partition by s_ord) as h from e1) where by_id or not h),
e3 as (select *, count(*) over (partition by p_ord) as dp, count(*) over (partition by s_ord) as ds from e2),
e4 as (select *, (by_phone and not by_id and not by_website) as op,
 (p_name = s_name and p_address = s_address and p_city = s_city and p_state = s_state and p_name <> '' and p_address <> '' and p_city <> '' and p_state <> '') as na,
 (p_name <> '' and s_name <> '' and p_name <> s_name and p_address <> '' and p_city <> '' and p_state <> '' and s_address <> '' and s_city <> '' and s_state <> '' and not (p_address = s_address and p_city = s_city and p_state = s_state)) as cf
 from e3 join p using (p_ord) join s using (s_ord)),
r1 as (select p_ord, s_ord, case when dp > 1 or ds > 1 then 'ambiguous' when by_id and cf then 'candidate' when op and not na then 'candidate' else 'matched' end as decision,
 case when dp = 1 and ds = 1 and op and na then 'phone,name,address' else concat_ws(',', case when by_id then 'source_id' end, case when by_phone then 'phone' end, case when by_website then 'website' end) end as fields from e4),
m as (select p_ord, s_ord, decision, fields, 'exact_' || replace(fields, ',', '_and_') || case when decision = 'candidate' then '_candidate' else '' end as method from r1
 union all select p_ord, s_ord, 'candidate', 'name,address', 'exact_name_address_candidate' from p join s on p_name = s_name and p_address = s_address and p_city = s_city and p_state = s_state
 where p_name <> '' and p_address <> '' and p_city <> '' and p_state <> '' and p_ord not in (select p_ord from e2))"""


_M = _match_sql()
_REASONS = """concat_ws(',', case when name = '' then 'missing_name' end, case when not ((address <> '' and (city <> '' or state <> '')) or (city <> '' and state <> '')) then 'missing_location' end,
 case when phone = '' and website = '' then 'missing_phone_or_website' end, case when source_url = '' then 'missing_source_url' end, case when observed_at is null then 'missing_observed_at' end, case when observed_at < timestamp '{as_of}' - to_days(180) then 'stale_observation' end)""".format(as_of=v.AS_OF)
_CLASS = f"(select *, case when reasons = '' then 'accepted' else 'incomplete' end as record_status from (select *, {_REASONS} as reasons from {{src}}))"
_KEPT = f"(select * exclude (rn) from (select *, row_number() over (partition by {_KEY} order by _ord) as rn from {_CB}) where rn = 1)"


def _stable(fields: list[tuple[str, ...]]) -> str:
    ident = lambda c: f"regexp_replace(lower(trim(coalesce({c},''))), '\\s+', ' ', 'g')"
    arms = [f"when {' and '.join(f'{ident(c)} <> chr(0)||chr(0) and {ident(c)} <> {chr(39) * 2}' for c in fs)} then concat_ws(chr(31), {', '.join(ident(c) for c in fs)})" for fs in fields]
    arms = [a.replace("<> chr(0)||chr(0) and ", "<> '' and ") for a in arms]
    return f"case {' '.join(arms)} end"


_SESSION = f"""(select d.doc_id as k, 'Doc ' || d.doc_id as name, d.source, case when d.doc_id % 5 = 0 then '' else 'https://doc.example.test/' || d.doc_id end as source_url, 'https://doc.example.test/' || d.doc_id as url,
 case when d.doc_id % 3 = 0 then 'd' || d.doc_id || '@example.test' else '' end as email, l.quality, l.toxic,
 case when d.doc_id % 20 = 0 then 'likely_independent' when d.doc_id % 4 = 0 then case when d.doc_id % 8 = 0 then 'likely_corporate' else 'likely_independent' end end as ownership,
 case when l.quality is not null then d.doc_id % 30 end as years, case when l.toxic = 1 then 'closed' end as status, case when d.doc_id % 6 = 0 then d.doc_id % 12 = 0 end as enrolled, d.lang
 from documents d left join labels l using (doc_id))"""

SQL = {
    "csv_business_projection": f"select _ord as k, name, address, city, state, phone, email, website, rating, review_count, email_status, phone_status from {_CP}",
    "contact_status_counts": f"select email_status, phone_status, count(*) as n, sum(invalid_emails::int)::bigint as invalid_emails, sum(invalid_phones::int)::bigint as invalid_phones from {_CB} group by all",
    "pipeline_counters": f"select * from (select 'invalid_emails' as metric, sum(invalid_emails::int)::bigint as value from {_CB} union all select 'invalid_phones', sum(invalid_phones::int)::bigint from {_CB}) where value > 0",
    "normalize_text_ascii": f"select doc_id, md5({v.q_collapse('text')}) as normal_md5, length({v.q_collapse('text')})::bigint as n from documents",
    "normalize_website_host": f"select page_id, {v.q_clean_site('url')} as cleaned, regexp_replace(regexp_replace({v.q_host('lower(trim(url))')}, '^www\\.', ''), '/+$', '') as host, {v.q_match_site('url')} as match_form, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) as origin, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from pages",
    "match_keys": f"select _ord as k, {v.q_match_phone('phone')} as phone_key, {v.q_match_site('website')} as site_key, {v.q_match_text('address')} as address_key, {v.q_collapse('replace(lower(name), chr(46), chr(32)[1:0])')} as fuzzy_key, {v.q_collapse('lower(name)')} as identity_key from {_B}",
    "dedup_identifier_keep_first": f"select _ord as k, name, website, email, phone from {_KEPT}",
    "dedup_merge_sources": f"select min(_ord) as k, string_agg(source, ',' order by o) as sources from (select key, source, min(_ord) as o, min(_ord) as _ord from (select *, {_KEY} as key from {_CB}) group by key, source) group by key",
    "dedup_exact_v1": f"select _ord as k, name, address, phone from (select *, row_number() over (partition by lower(name), lower(address), phone order by _ord) as rn from {_CB}) where rn = 1",
    "dedup_documents": "select sha256(coalesce(text, '')) as text_sha, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "link_edges": f"{_M} select p_ord, s_ord, by_id, by_phone, by_website from e2",
    "link_decisions": f"{_M} select p_ord, s_ord, decision, fields, method from m",
    "link_counts": f"{_M} select count(*) filter (decision = 'matched') as matched, count(*) filter (decision = 'candidate') as candidate, count(*) filter (decision = 'ambiguous') as ambiguous from m",
    "link_promote_website": f"""{_M}, safe as (select m.p_ord, m.s_ord, raw_s.website as s_website from m join p using (p_ord) join s using (s_ord) join {_S} raw_s on raw_s._ord = m.s_ord
 where decision = 'matched' and (fields like '%source_id%' or (fields like '%phone%' and p_name = s_name and p_address = s_address and p_city = s_city and p_state = s_state and p_name <> '' and p_address <> '' and p_city <> '' and p_state <> '')))
 select r._ord as k, case when r.website = '' and coalesce(s_website, '') <> '' then s_website else r.website end as website, case when s_ord is not null then 'primary,supp' else '' end as sources,
 (case when r.website = '' and coalesce(s_website, '') <> '' then 1 else 0 end)::int as n_provenance, case when r.website = '' and coalesce(s_website, '') <> '' then 'cross_source_exact_match' end as method from {_P} r left join safe on r._ord = safe.p_ord""",
    "link_review_page": f"{_M} select p_ord, s_ord, decision, method from m order by list_position(['matched','candidate','ambiguous'], decision), p_ord, s_ord limit 40 offset 5",
    "link_sources_in_order": f"{_M} select src_rank, p_ord, s_ord, decision from m, (values (0), (1)) t(src_rank)",
    "csv_scan": "select row_number() over (order by s_suppkey) - 1 as k, s_name as name, s_suppkey || ' Main, St \\ 1' as address, '408-555-' || lpad(s_nationkey::varchar, 4, '0') as phone, 'say \"hi\", ' || s_name as category, 1204::bigint as review_count, 'csv' as source from supplier",
    "history_store_record": "with r as (select c_custkey, day from customer, (values (1), (2), (3)) t(day) where (c_custkey + day) % 5 <> 0), s as (select c_custkey, 'r' || min(day) as f, 'r' || max(day) as l, count(*) as v from r group by 1) select f as first_seen_run_id, l as last_seen_run_id, v as versions, l = 'r3' as is_present, count(*) as n from s group by all",
    "enrich_details": "select c_custkey as k, case when c_custkey % 50 between 0 and 9 then '40855501' || lpad((c_custkey % 50)::varchar, 2, '0') else '' end as phone, case when c_custkey % 3 = 0 then 'own.example.test' when c_custkey % 50 between 0 and 9 then 'site' || (c_custkey % 50) || '.example.test' else '' end as website, case when c_custkey % 50 between 0 and 9 then 'not_checked' else 'not_found' end as phone_status from customer",
    "enroll_exact_id_semi_join": "select c_custkey, c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as enrolled from customer",
    "classify_delivery": f"select _ord as k, name, record_status, reasons from {_CLASS.format(src=_CB)}",
    "status_counts": f"select record_status, count(*) as n from {_CLASS.format(src=_CB)} group by 1",
    "quality_reason_counts": f"select reason, count(*) as n from (select unnest(string_split(reasons, ',')) as reason from {_CLASS.format(src=_CB)} where record_status <> 'accepted') group by 1",
    "field_completeness": "select field, present, total, round(100.0 * present / total, 2) as percent from (" + " union all ".join(f"select '{f}' as field, {'count(*) filter (' + f + chr(32) + '<> ' + chr(39) * 2 + ')' if f in ('name', 'address', 'city', 'state', 'phone', 'email', 'website') else '0::bigint'} as present, count(*) as total from {_CB}" for f in COMPLETENESS) + ")",
    "delivery_summary": f"select (select count(*) from {_B}) as acquired, count(*) as classified, count(*) filter (record_status = 'accepted') as delivered, (select count(*) from {_B}) - count(*) as duplicates_removed, count(*) filter (record_status = 'accepted') as status_accepted, count(*) filter (record_status = 'incomplete') as status_incomplete from {_CLASS.format(src=_KEPT)}",
    "provenance_fill": " union all ".join(f"select _ord as k, '{f}' as field, source, source_url as url from {_CB} where source_url <> '' and observed_at is not null and coalesce(cast({f} as varchar), '') <> ''" for f in ("name", "category", "address", "city", "state", "phone", "email", "website", "rating", "review_count")),
    "view_preview": f"select nullif(name, '') as name, nullif(city, '') as city, nullif(phone, '') as phone, nullif(email, '') as email, nullif(website, '') as website from {_CB} where email <> '' order by _ord limit 25",
    "project_export": f"select _ord as k, name, city, phone, null::varchar as unknown_field from {_CB}",
    "stable_record_id": f"select _ord as k, 'biz_' || substr(sha256({_stable(list(history.IDENTITIES))}), 1, 24) as record_id from {_CB}",
    "record_id_canonical": f"select _ord as k, case when npi <> '' then 'npi:' || npi when source_url <> '' then source_url else 'derived:' || substr(sha256(concat_ws(chr(31), source, name, address, city, state)), 1, 16) end as record_id from {_B}",
    "parse_us_address": f"""select k, case when k % 4 = 0 then trim(address) when k % 4 = 1 then '' when k % 4 = 2 then address else city || ',,,,x' end as address, case when k % 4 <= 1 then city else '' end as city,
 case when k % 4 = 0 then 'CA' when k % 4 = 1 then 'TX' else '' end as state, case when k % 4 = 0 then '9' || lpad((k % 1000)::varchar, 4, '0') else '' end as postal_code, case when k % 4 <= 1 then 'USA' else '' end as country from ({v.raw_sql('customer')})""",
    "phone_verification_merge": f"select _ord as k, case when phone <> '' and _ord % 3 = 0 then case when _ord % 2 = 0 then 'provider_valid' when _ord % 9 = 0 then phone_status else 'provider_invalid' end else phone_status end as phone_status from {_CB}",
    "first_n_rows": f"select _ord as k, name from {_CB} order by _ord limit 100",
    "aggregate_caps": f"with a as (select *, row_number() over (partition by source order by _ord) as n from {_B}), b as (select *, row_number() over (partition by city order by _ord) as n2 from a where n <= 250) select _ord as k, source, city as location from b where n2 <= 20 order by _ord limit 300",
    "policy_gate": "select * from (values ('csv','client_input',true,false),('google','experimental_or_disallowed',false,false),('google-apify','experimental_or_disallowed',false,false),('linkedin-apify','experimental_or_disallowed',false,false),('yelp','experimental_or_disallowed',false,false),('yelp-apify','experimental_or_disallowed',false,false),('yellowpages','experimental_or_disallowed',false,false),('nppes','official_registry',true,true),('wa-li','official_registry',true,true),('ca-dental-board','official_registry',true,true),('overture','licensed',true,false)) t(source, source_class, allows_delivery, allows_live_smoke)",
    "task_plan_cross": "select source, n_name as city, row_number() over (order by rank, n_nationkey) - 1 as task from (values ('csv',0),('nppes',1),('wa-li',2)) t(source, rank) cross join nation",
    "claims_filter": f"select k, name from {_SESSION} where status = 'closed'",
    "claims_latest_pivot": f"select k, ownership, years::bigint as years, status, enrolled from {_SESSION}",
    "refinement_and_match": f"select k, name from {_SESSION} where ownership is not null and (ownership = 'likely_independent' or (k % 4 = 0 and k % 8 <> 0)) and years >= 12",
    "session_summary": f"""select count(*) as total_records, count(*) filter (email <> '') as latest_matches, 0::bigint as with_phone, 0::bigint as with_website, count(*) filter (email <> '') as with_email, 0::bigint as with_social, count(*) filter (enrolled) as medi_cal_dental_enrolled,
 count(*) filter (k % 20 = 0 or (k % 4 = 0 and k % 8 <> 0)) as likely_independent, count(*) filter (k % 8 = 0) as likely_corporate, count(*) filter (years is not null) as with_longevity_evidence, count(*) filter (status = 'closed') as explicitly_closed from {_SESSION}""",
    "append_claim_if_absent": f"select k, (case when years is not null then 1 else 0 end + case when status is not null then 1 else 0 end + case when k % 4 = 0 then 1 else 0 end + case when k % 20 = 0 then 1 else 0 end + case when k % 6 = 0 then 1 else 0 end + case when k % 4 <> 0 then 1 else 0 end)::bigint as n, coalesce(ownership, 'likely_corporate') as ownership from {_SESSION}",
    "evidence_urls_union": f"select k, coalesce((select string_agg(u, ' | ' order by u) from (select distinct unnest([case when source_url <> '' then source_url end, case when years is not null or k % 4 = 0 or k % 6 = 0 then url end, case when status is not null then url || '/toxic' end]) as u) where u is not null), '') as urls from {_SESSION}",
    "research_export_row": f"select name, email, coalesce(enrolled::varchar, 'unknown') as medi_cal_dental_enrolled, coalesce(ownership, 'unclear') as ownership_assessment, coalesce(years::varchar, 'unknown') as longevity_minimum_years, coalesce(status, 'unknown') as operational_status, coalesce(nullif(source, ''), 'unknown') as discovery_sources, source_url from {_SESSION}",
}
SQL["match_keys"] = SQL["match_keys"].replace("chr(32)[1:0]", "''")

NAMES = ["normalize_text_nfkc", "dedup_fuzzy_greedy", *SQL]
QUERIES = {n: globals()[n] for n in NAMES}
