"""Queries over events, pages and parts: history, ordered folds, caches, evidence, snapshots, JSON sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import crawl, evidence, history, snapshot, stateful
from ..schema import ORDER
from ..sources import readers
from . import views as v

_OUTCOME = "case event_type when 'error' then 'retryable_failure' when 'purchase' then 'success' when 'view' then 'empty' when 'click' then 'fatal_failure' else 'skipped' end"


# ---- history: a run per day, a record per user, the day's last event as its content ----
def _runs(spark, d):
    e = v.table(spark, d, "events")
    last = e.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("content_hash"))
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("run_id"), F.col("day").cast("timestamp").alias("recorded_at"), F.concat(F.lit("u"), "user_id").alias("record_id"), "content_hash")


def history_versions(spark, d):
    return history.versions(_runs(spark, d)).select("record_id", "first_seen_run_id", "last_seen_run_id", "content_hash", "versions", "is_present")


def history_run_changes(spark, d):
    return history.run_changes(_runs(spark, d)).groupBy("run_id", "change").agg(F.count("*").alias("n"))


def history_runs_latest(spark, d):
    return history.list_runs(_runs(spark, d), 7).select("run_id", "records")


def _two_states(spark, d):
    """The state of users after the first and after the second half of all events: two snapshots with differences of every kind."""
    e = v.table(spark, d, "events")
    e = e.join(e.agg(F.max("event_id").alias("last"))).withColumn("half", (F.col("event_id") * 2 > F.col("last")).cast("int"))
    state = lambda half: e.where(F.col("half") == half).groupBy(F.concat(F.lit("u"), "user_id").alias("record_id")).agg(F.max_by("event_type", "event_id").alias("kind"), (F.max("event_id") % 3).cast("long").alias("phase"))
    return state(0), state(1)


def history_diff(spark, d):
    a, b = _two_states(spark, d)
    return history.diff(a, b, ["kind", "phase"]).select("record_id", "change", F.array_join("changed", ",").alias("changed"))


def history_change_counts(spark, d):
    a, b = _two_states(spark, d)
    return history.change_counts(history.diff(a, b, ["kind", "phase"]))


# ---- ordered folds ----
def _attempts(spark, d):
    e = v.table(spark, d, "events")
    return e.select("event_id", "ts", F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"), F.expr(_OUTCOME).alias("outcome"))


def source_health_streak(spark, d):
    return stateful.health(_attempts(spark, d)).select("event_id", "consecutive_failures", "health")


def source_health_counts(spark, d):
    return stateful.health_counts(_attempts(spark, d))


def task_row_counts(spark, d):
    return stateful.task_counts(_attempts(spark, d).withColumn("raw_count", F.col("event_id") % 17))


def _cache(spark, d):
    e = v.table(spark, d, "events")
    return e.where("event_id % 2 = 0").select(F.when(F.col("event_id") % 4 == 0, "google").otherwise("yelp").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("value"))


def _asked(spark, d):
    e = v.table(spark, d, "events")
    return e.where("event_id % 2 = 1").select(F.col("event_id").alias(ORDER), F.when(F.col("event_id") % 4 == 1, "google").otherwise("yelp").alias("source"), F.col("user_id").cast("string").alias("source_id"))


def ttl_cache_lookup(spark, d):
    newest = v.table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    cache = stateful.cache_put(_cache(spark, d).where("fetched_at < timestamp'1970-01-01'"), _cache(spark, d))
    asked = _asked(spark, d).join(newest)
    out = stateful.cache_lookup(asked, cache, F.col("as_of"), {"google": 20}, default_ttl=0)
    return out.select(F.col(ORDER).alias("k"), "source", F.col("hit"), F.when(F.col("hit"), F.col("value")).alias("value"))


def _details(spark, d):
    """Every event asks for the details of its user, at one of two sources."""
    e = v.table(spark, d, "events")
    return e.select(F.col("event_id").alias(ORDER), F.when(F.col("event_id") % 4 == 1, "google").otherwise("yelp").alias("source"), F.col("user_id").cast("string").alias("source_id"), (F.col("user_id") % 11 == 0).alias("hit"))


def budget_first_n(spark, d):
    asked = _details(spark, d)
    return stateful.spend_budget(asked, {"google": 25, "yelp": 10}).select(F.col(ORDER).alias("k"), "source", "action")


def cost_rollup(spark, d):
    asked = _details(spark, d)
    paid = stateful.spend_budget(asked, {"google": 25, "yelp": 10}).where("action = 'paid'")
    return stateful.costs(paid)


def pagination_stop(spark, d):
    e = v.table(spark, d, "events")
    return e.select("event_id", tx.follow_next_page(F.col("event_id") % 4, F.col("event_id"), F.lit(300), F.col("event_id") % 9 + 1, F.lit(8)).alias("follow"), tx.search_url("https://listing.example.test", F.col("event_type"), F.concat_ws(", ", F.lit("San Jose"), "event_type"), F.col("event_id") % 3 + 1).alias("url"))


# ---- evidence ----
_SENTENCE = """case k % 10 when 0 then 'We are Family owned and locally owned since 1987, serving families for over 30 years.' when 1 then 'A dental support organization founded in 2001.'
 when 2 then 'Family-owned, with a corporate office.' when 3 then 'Dr. Lee opened her first office downtown in 1995. Established 2050.' when 4 then 'This practice has permanently closed.'
 when 5 then 'Dr. Roy retired last year and the office is now closed.' when 6 then 'Served the valley more than 12 years' when 7 then 'We were established 1799 and opened.' when 8 then 'Independent Practice near you' else 'Nothing to see.' end"""


def _sites(spark, d):
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return rows.select("k", F.expr(_SENTENCE).alias("text"))


def ownership_phrases(spark, d):
    found = evidence.ownership(F.col("text"))
    return _sites(spark, d).select("k", found.alias("o")).where("o is not null").select("k", F.col("o.value").alias("value"), F.col("o.signal").alias("signal"))


def longevity_years(spark, d):
    return _sites(spark, d).select("k", evidence.longevity(F.col("text"), 2025).alias("l")).where("l is not null").select("k", F.col("l.years").cast("long").alias("years"), F.col("l.signal").alias("signal"))


def closure_regex(spark, d):
    return _sites(spark, d).select("k", evidence.closed(F.col("text")).alias("closed"))


_HTML = "concat('<html><head><title>T</title><script>var a = 1;</script></head><body><!-- x --><p>Shop ', cast(k as string), '</p>', case when k % 2 = 0 then concat('<a href=\"mailto:info', cast(k as string), '@shop.example.test?subject=Hi\">Mail</a>') else '' end, case when k % 3 = 0 then '<a href=\"tel:+1-408-555-0100\">Call</a>' else '' end, case when k % 5 = 0 then concat('<a href=\"https://www.facebook.com/shop.', cast(k as string), '\">fb</a>') else '' end, case when k % 7 = 0 then '<a href=\"//x.com/shop_7\">x</a>' else '' end, '<a href=\"/about-us#top\">Who we are</a></body></html>')"


def html_anchor_contacts(spark, d):
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(_HTML).alias("html"))
    return rows.select("k", *[F.coalesce(c, F.lit("")).alias(n) for n, c in evidence.contacts(F.col("html")).items()])


def html_visible_text(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.md5(evidence.visible_text(F.col("html"))).alias("text_md5"))


def html_quick_text(spark, d):
    rows = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(_HTML).alias("html"))
    return rows.select("k", evidence.quick_text(F.col("html")).alias("text"))


def likely_pages(spark, d):
    return crawl.likely_links(v.table(spark, d, "pages").select("url", "html")).select("url", "target", F.col("place").cast("long").alias("place"))


# Thirteen kinds of sites.  Each row is an address under the site, its HTTP status, the failure of its fetch, where it led to and its links.
_SITE_PAGES = (
    (0, "", 200, "", "", "/about /team"), (0, "/about", 200, "", "", "/x1 /x2 /contact-c"), (0, "/team", 200, "", "", "/people-d"), (0, "/contact-c", 200, "", "", ""), (0, "/people-d", 200, "", "", ""),
    (1, "", None, "ReadTimeout: slow", "", ""), (2, "", 200, "", "https://elsewhere.test/", "/about"),
    (3, "", 200, "", "", "/about /contact /team"), (3, "/about", 404, "", "", "/people"), (3, "/contact", 200, "", "", "/staff"), (3, "/team", 200, "", "", "/people"), (3, "/staff", 200, "", "", ""), (3, "/people", 200, "", "", ""),
    (4, "", 200, "", "", "/about"), (5, "", 200, "", "", ""), (6, "", None, "SSLError: bad", "", ""), (7, "", None, "gaierror: no", "", ""), (8, "", None, "ConnectError: refused", "", ""), (9, "", None, "ReadError: reset", "", ""),
    (10, "", 200, "", "", "about/ about/#top mailto:team@x.test"), (10, "/about/", 200, "", "", "../ ../about/ ./staff ../team"), (10, "/about/staff", 500, "", "", ""), (10, "/team", 200, "", "https://elsewhere.test/team", "/people"), (10, "/", 200, "", "", "/about/"),
)
#: What a queue that reads four pages at most makes of them: (kind, visit, address, status).
_SITE_VISITS = (
    (0, 1, "", "success"), (0, 2, "/about", "success"), (0, 3, "/team", "success"), (0, 4, "/contact-c", "success"), (1, 1, "", "timeout"), (2, 1, "", "redirect_blocked"),
    (3, 1, "", "success"), (3, 2, "/about", "http_error"), (3, 3, "/contact", "success"), (3, 4, "/team", "success"), (3, 5, "/staff", "success"), (6, 1, "", "tls_error"), (7, 1, "", "dns_error"), (8, 1, "", "connection_error"), (9, 1, "", "network_error"),
    (10, 1, "", "success"), (10, 2, "/about/", "success"), (10, 3, "/about/staff", "http_error"), (10, 4, "/team", "redirect_blocked"),
)


def _crawled(spark, d):
    """Every customer has a site of one of thirteen kinds; kind 11 has no robots file in the capture, kind 12 no address of the web."""
    k = v.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 13).cast("int").alias("kind"))
    sites = k.select("k", "kind", F.when(F.col("kind") == 12, "ftp://files.test").otherwise(F.concat(F.lit("https://s"), "k", F.lit(".test"))).alias("website"))
    kinds = spark.createDataFrame(list(_SITE_PAGES), "kind int, path string, status int, failed string, final_url string, links string")
    link = lambda x: F.concat(F.lit('<a href="'), x, F.lit('">see</a>'))
    body = F.array_join(F.transform(F.filter(F.split("links", " "), lambda x: x != ""), link), " ")
    pages = sites.join(kinds, "kind").select(F.concat("website", "path").alias("url"), "status", "final_url", body.alias("body"), F.when(F.col("failed") != "", F.array("failed")).alias("error"))
    robots = sites.where("kind < 11").select(F.concat("website", F.lit("/robots.txt")).alias("url"), F.when(F.col("kind") == 5, 404).otherwise(200).alias("status"), F.lit("").alias("final_url"), F.when(F.col("kind") == 4, "User-agent: *\nDisallow: /").otherwise("").alias("body"), F.lit(None).cast("array<string>").alias("error"))
    return sites, crawl.crawl(sites, pages.unionByName(robots))


def crawl_visits(spark, d):
    sites, found = _crawled(spark, d)
    return found.visits.join(sites.select("k", F.col("website").alias("home")), "home").select("k", "n", F.expr("substring(url, length(home) + 1)").alias("path"), "status")


def crawl_outcomes(spark, d):
    sites, found = _crawled(spark, d)
    rows = sites.select("k", F.lit("n").alias("name"), "website", *[F.lit("").alias(c) for c in ("phone", "email", *evidence.SOCIALS)])
    return crawl.audit(rows, found, ("k",)).select("k", "status", "pages_read")


def crawl_histogram(spark, d):
    """Outcomes over all pages, each page its own home and fetched with a status of its own."""
    p = v.table(spark, d, "pages").select("page_id", "url", "html")
    status = F.when(F.col("page_id") % 10 == 0, 503).otherwise(200)
    responses = p.select("url", status.alias("status"), F.when(F.col("page_id") % 7 == 0, "https://elsewhere.test/").otherwise("").alias("final_url"), F.col("html").alias("body"), F.when(F.col("page_id") % 11 == 0, F.array(F.lit("ConnectTimeout: slow"))).alias("error"))
    return crawl.outcome_counts(crawl.crawl(p.select(F.col("url").alias("website")), responses, robots=False).outcomes)


def page_hosts(spark, d):
    pages = v.table(spark, d, "pages")
    return pages.groupBy(tx.normalize_website(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


# ---- snapshot preparation: parts as places ----
_PLACE = """select concat('p', cast(p_partkey as string)) as id, named_struct('primary', p_name) as names,
 named_struct('primary', case when p_size % 5 = 0 then 'dental_clinic' else 'store' end, 'hierarchy', case when p_size % 7 = 0 then array('health', 'dental_clinic') end) as taxonomy,
 array(named_struct('locality', case when p_partkey % 2 = 0 then 'San Jose' else 'Campbell' end, 'region', 'CA')) as addresses,
 array(named_struct('dataset', p_brand, 'license', case when p_size % 3 = 0 then 'CDLA' end, 'provider', p_type)) as sources,
 named_struct('xmin', -122.0 + (p_partkey % 100) / 100.0, 'xmax', -121.99 + (p_partkey % 100) / 100.0, 'ymin', 37.0 + (p_size / 50.0), 'ymax', 37.01 + (p_size / 50.0)) as bbox from parts_in"""
_BOX = (-121.8, 37.2, -121.4, 37.7)


def _places(spark, d):
    v.table(spark, d, "part").createOrReplaceTempView("parts_in")
    return spark.sql(_PLACE)


def bbox_taxonomy_scope(spark, d):
    return snapshot.scope(_places(spark, d), _BOX).select("id").orderBy("id")


def bbox_locality_scope(spark, d):
    return snapshot.scope(_places(spark, d), _BOX, localities=["San Jose", "san jose"]).select("id")


def snapshot_gate(spark, d):
    return snapshot.gate(snapshot.scope(_places(spark, d), _BOX))


def license_inventory(spark, d):
    return snapshot.license_inventory(snapshot.scope(_places(spark, d), _BOX))


def place_projection(spark, d):
    places = _places(spark, d).withColumn(ORDER, F.expr("cast(substring(id, 2) as bigint)"))
    out = readers.place_records(places, "https://ref.example.test", "2025-01", F.lit(v.AS_OF).cast("timestamp"))
    return out.select(F.col("source_ids")["overture_id"].alias("id"), "name", "category", "city", "state", F.size("claims").cast("long").alias("claims"))


# ---- JSON sources ----
def json_source_projection(spark, d):
    c = v.spread(v.table(spark, d, "customer").select("c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    text = F.concat(
        F.lit('{"name": '), F.when(k % 9 == 0, F.lit("null")).otherwise(F.concat(F.lit('" Cafe '), k, F.lit(' "'))), F.lit(', "rating": '), F.when(k % 3 == 0, F.lit("true")).when(k % 3 == 1, F.lit("4.5")).otherwise(F.lit("null")), F.lit(', "reviewCount": '), (k % 50).cast("string"), F.lit(", "),
        F.when(k % 2 == 0, F.lit('"location": {"address1": "1 Elm", "city": "Gilroy", "state": "CA", "zipCode": "95020"}, "categories": [{"title": "Coffee"}]')).otherwise(F.lit('"address": {"street": "2 Oak", "city": "Salinas", "region": "CA", "postalCode": "93901"}, "categories": ["Tea", "Cake"]')), F.lit("}"),
    )
    out = readers.yelp_actor_records(c.select(k.alias(ORDER), text.alias("json")), F.lit(v.AS_OF).cast("timestamp"))
    return out.select(F.col(ORDER).alias("k"), "name", "category", "address", "city", "state", "postal_code", "rating", "review_count")


def json_event_props(spark, d):
    e = v.table(spark, d, "events")
    return e.select("event_id", F.length("props").cast("long").alias("n"), F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


def contractor_registry(spark, d):
    s = v.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(k.alias(ORDER), F.col("s_name").alias("businessname"), F.lit("10 Pine ").alias("address1"), F.when(k % 2 == 0, "Suite 5").otherwise("").alias("address2"), F.when(k % 5 == 0, "").otherwise("Tacoma").alias("city"), F.lit("WA").alias("state"), F.concat(F.lit("LIC"), k).alias("contractorlicensenumber"), F.when(k % 3 == 0, "ACTIVE").otherwise("EXPIRED").alias("contractorlicensestatus"), F.lit("CC").alias("contractorlicensetypecode"))
    test, limit = readers.contractor_scope(["CC"], ["ACTIVE", "EXPIRED"], "tacoma", 250)
    out = readers.contractor_records(rows.where(test).orderBy("contractorlicensenumber").limit(limit), F.lit(v.AS_OF).cast("timestamp"))
    return out.select(F.col(ORDER).alias("k"), "name", "address", F.size("claims").cast("long").alias("claims"), "source_url")


# ---- driver's other tables ----
def label_quality_by_source(spark, d):
    docs, labels = v.table(spark, d, "documents"), v.table(spark, d, "labels")
    return docs.join(labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))


def longest_evidence_per_group(spark, d):
    rows = _sites(spark, d).withColumn("l", evidence.longevity(F.col("text"), 2025)).where("l is not null").withColumn("g", F.col("k") % 25)
    w = Window.partitionBy("g").orderBy(F.desc("l.years"), "k")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("g", "k", F.col("l.years").cast("long").alias("years"))


# ---- SQL ----
_RUNS = "(select strftime(day, '%Y-%m-%d') as run_id, day, 'u' || user_id as record_id, content_hash from (select ts::date as day, user_id, max_by(event_type, (ts, event_id)) as content_hash from events group by 1, 2))"


def _state(half: int) -> str:
    return f"(select 'u' || user_id as record_id, max_by(event_type, event_id) as kind, (max(event_id) % 3)::bigint as phase from events where (event_id * 2 > (select max(event_id) from events))::int = {half} group by 1)"


_DIFF = f"(select coalesce(a.record_id, b.record_id) as record_id, case when a.record_id is null then 'new' when b.record_id is null then 'missing' when a.kind is distinct from b.kind or a.phase is distinct from b.phase then 'updated' else 'unchanged' end as change, case when a.record_id is null or b.record_id is null then '' else concat_ws(',', case when a.kind is distinct from b.kind then 'kind' end, case when a.phase is distinct from b.phase then 'phase' end) end as changed from {_state(0)} a full outer join {_state(1)} b on a.record_id = b.record_id)"
_ATT = f"(select event_id, ts, 'src' || (user_id % 20) as source, {_OUTCOME} as outcome from events)"
_ASKED = "(select event_id as k, case when event_id % 4 = 1 then 'google' else 'yelp' end as source, user_id::varchar as source_id, user_id % 11 = 0 as hit from events)"
_SPENT = f"""(select k, source, case when hit then 'hit' when max(nth) over (partition by source, source_id) > case source when 'google' then 25 else 10 end then 'skipped' when f then 'paid' else 'repeat' end as action from
 (select *, case when f then sum(f::int) over (partition by source order by k) end as nth from (select *, (row_number() over (partition by source, source_id order by k) = 1) and not hit as f from {_ASKED})))"""
_SITES = f"(select k, {_SENTENCE} as text from (select c_custkey as k from customer))"
_LONG = f"""(select k, y as years, s as signal from (select *, row_number() over (partition by k order by y desc, p) as rn from (
 select k, 2025 - try_cast(r as int) as y, 'founded_year:' || r as s, 1 as p from (select k, regexp_extract(text, '(?i)\\b(?:founded|established|since)\\s+(?:in\\s+)?((?:18|19|20)[0-9]{{2}})\\b', 1) as r from {_SITES}) where r <> '' and try_cast(r as int) between 1800 and 2025
 union all select k, 2025 - try_cast(r as int), 'opened_year:' || r, 2 from (select k, regexp_extract(text, '(?i)\\bopened\\b.{{0,80}}?\\b(?:office|practice|business)\\b.{{0,30}}?\\b(?:in\\s+)?((?:18|19|20)[0-9]{{2}})\\b', 1) as r from {_SITES}) where r <> '' and try_cast(r as int) between 1800 and 2025
 union all select k, try_cast(r as int), 'years_serving:' || r, 3 from (select k, regexp_extract(text, '(?i)\\b(?:serving|served)\\b.{{0,80}}?\\b(?:for\\s+)?(?:over|more than)?\\s*([0-9]{{1,3}})\\+?\\s+years\\b', 1) as r from {_SITES}) where r <> '' and try_cast(r as int) between 1 and 200)) where rn = 1)"""
_SCOPE = "(select * from (select 'p' || p_partkey as id, p_brand, p_type, p_size, p_partkey, p_name, case when p_size % 5 = 0 then 'dental_clinic' else 'store' end as prim, -122.0 + (p_partkey % 100) / 100.0 as xmin, -121.99 + (p_partkey % 100) / 100.0 as xmax, 37.0 + (p_size / 50.0) as ymin, 37.01 + (p_size / 50.0) as ymax from part) where xmax >= -121.8 and xmin <= -121.4 and ymax >= 37.2 and ymin <= 37.7 and (prim = 'dental_clinic' or p_size % 7 = 0))"

SQL = {
    "history_versions": f"with r as (select * from {_RUNS}) select record_id, min_by(run_id, run_id) as first_seen_run_id, max(run_id) as last_seen_run_id, max_by(content_hash, run_id) as content_hash, count(*) as versions, max(run_id) = (select max(run_id) from r) as is_present from r group by 1",
    "history_run_changes": f"""with r as (select *, dense_rank() over (order by run_id) as k from {_RUNS}), w as (select *, lag(k) over p as bk, lag(content_hash) over p as bh, lead(k) over p as ak from r window p as (partition by record_id order by k)),
 c as (select run_id, case when bk is null or bk <> k - 1 then 'new' when bh <> content_hash then 'updated' else 'unchanged' end as change from w union all select n.run_id, 'missing' from w join (select distinct run_id, k from r) n on n.k = w.k + 1 where ak is null or ak <> w.k + 1)
 select run_id, change, count(*) as n from c group by all""",
    "history_runs_latest": f"select run_id, count(*) as records from {_RUNS} group by 1 order by 1 desc limit 7",
    "history_diff": f"select * from {_DIFF}",
    "history_change_counts": f"select count(*) filter (change = 'new') as \"new\", count(*) filter (change = 'updated') as updated, count(*) filter (change = 'unchanged') as unchanged, count(*) filter (change = 'missing') as missing from {_DIFF}",
    "source_health_streak": f"""with a as (select *, sum((outcome in ('success','empty'))::int) over (partition by source order by ts, event_id) as g from {_ATT}), b as (select event_id, sum((outcome in ('retryable_failure','fatal_failure'))::int) over (partition by source, g order by ts, event_id)::bigint as consecutive_failures from a)
 select event_id, consecutive_failures, case when consecutive_failures >= 3 then 'threshold' when consecutive_failures > 0 then 'degraded' else 'healthy' end as health from b""",
    "source_health_counts": f"select source, count(*) as attempts, {', '.join(f'''count(*) filter (outcome = '{k}') as {k}''' for k in ('success', 'empty', 'retryable_failure', 'fatal_failure', 'skipped'))} from {_ATT} group by 1",
    "task_row_counts": f"select source, sum(event_id % 17)::bigint as rows from {_ATT} where outcome in ('success', 'empty') group by 1",
    "ttl_cache_lookup": """with c as (select case when event_id % 4 = 0 then 'google' else 'yelp' end as source, user_id, max(ts) as f, max_by(event_type, ts) as value from events where event_id % 2 = 0 group by 1, 2),
 a as (select event_id as k, case when event_id % 4 = 1 then 'google' else 'yelp' end as source, user_id from events where event_id % 2 = 1)
 select k, a.source, c.f is not null as hit, c.value as value from a left join c on a.source = c.source and a.user_id = c.user_id and a.source = 'google' and c.f > (select max(ts) from events) - interval 20 day""",
    "budget_first_n": f"select k, source, action from {_SPENT}",
    "cost_rollup": f"with p as (select source, count(*) as calls, round(count(*) * 0.02::double, 2) as cost from {_SPENT} where action = 'paid' group by 1) select source, calls, cost from p union all select 'total', coalesce(sum(calls), 0)::bigint, round(coalesce(sum(cost), 0.0::double), 2) from p",
    "pagination_stop": "select event_id, (event_id % 4 > 0 and event_id < 300 and event_id % 9 + 1 < 8) as follow, 'https://listing.example.test/search?search_terms=' || event_type || '&geo_location_terms=San+Jose%2C+' || event_type || case when event_id % 3 + 1 >= 2 then '&page=' || (event_id % 3 + 1) else '' end as url from events",
    "ownership_phrases": f"select k, case k % 10 when 1 then 'likely_corporate' else 'likely_independent' end as value, case k % 10 when 0 then 'family_owned' when 1 then 'dental_support_organization' else 'independent_practice' end as signal from {_SITES} where (lower(text) like '%family owned%' or lower(text) like '%family-owned%' or lower(text) like '%independently owned%' or lower(text) like '%independent practice%' or lower(text) like '%locally owned%') <> (lower(text) like '%dental support organization%' or lower(text) like '%corporate office%' or lower(text) like '%nationwide network%' or lower(text) like '%locations nationwide%')",
    "longevity_years": f"select k, years::bigint as years, signal from {_LONG}",
    "closure_regex": f"select k, regexp_matches(text, '(?i)\\b(?:office|practice|business)\\b.{{0,40}}?\\b(?:officially|permanently)\\s+closed\\b|\\bretired\\b.{{0,120}}?\\b(?:office|practice|business)\\b.{{0,40}}?\\bclosed\\b') as closed from {_SITES}",
    "html_anchor_contacts": "select c_custkey as k, case when c_custkey % 2 = 0 then 'info' || c_custkey || '@shop.example.test' else '' end as email, case when c_custkey % 3 = 0 then '+1-408-555-0100' else '' end as phone, '' as linkedin, '' as instagram, case when c_custkey % 5 = 0 then 'https://www.facebook.com/shop.' || c_custkey else '' end as facebook, case when c_custkey % 7 = 0 then 'https://www.x.com/shop_7' else '' end as twitter from customer",
    "html_quick_text": "select c_custkey as k, 'T Shop ' || c_custkey || case when c_custkey % 2 = 0 then ' Mail' else '' end || case when c_custkey % 3 = 0 then ' Call' else '' end || case when c_custkey % 5 = 0 then ' fb' else '' end || case when c_custkey % 7 = 0 then ' x' else '' end || ' Who we are' as text from customer",
    "page_hosts": f"select regexp_replace(regexp_replace({v.q_host('lower(trim(url))')}, '^www\\.', ''), '/+$', '') as host, count(*) as pages, count(distinct url) as urls from pages group by 1",
    "bbox_taxonomy_scope": f"select id from {_SCOPE}",
    "bbox_locality_scope": f"select id from {_SCOPE} where p_partkey % 2 = 0",
    "snapshot_gate": f"select count(*) as n_rows, count(*) filter (id is null or trim(id) = '') as blank_ids, count(distinct id) as distinct_ids from {_SCOPE}",
    "license_inventory": f"select case when p_size % 3 = 0 then 'CDLA' else 'unknown' end as license, p_brand as dataset, p_type as provider, count(*) as observations from {_SCOPE} group by all",
    "place_projection": "select 'p' || p_partkey as id, p_name as name, case when p_size % 5 = 0 then 'dental_clinic' else 'store' end as category, case when p_partkey % 2 = 0 then 'San Jose' else 'Campbell' end as city, 'CA' as state, 2::bigint as claims from part",
    "json_source_projection": "select c_custkey as k, 'Cafe ' || c_custkey as name, case when c_custkey % 2 = 0 then 'Coffee' else 'Tea' end as category, case when c_custkey % 2 = 0 then '1 Elm' else '2 Oak' end as address, case when c_custkey % 2 = 0 then 'Gilroy' else 'Salinas' end as city, 'CA' as state, case when c_custkey % 2 = 0 then '95020' else '93901' end as postal_code, case when c_custkey % 3 = 1 then 4.5::double end as rating, (c_custkey % 50)::bigint as review_count from customer where c_custkey % 9 <> 0",
    "json_event_props": "select event_id, length(props)::bigint as n, json_extract_string(props, '$.k') as k from events",
    "contractor_registry": "select s_suppkey as k, s_name as name, '10 Pine' || case when s_suppkey % 2 = 0 then ' Suite 5' else '' end as address, 2::bigint as claims, 'https://secure.lni.wa.gov/verify/Detail.aspx?LIC=LIC' || s_suppkey as source_url from (select * from supplier where s_suppkey % 5 <> 0 order by 'LIC' || s_suppkey limit 250)",
    "label_quality_by_source": "select source, count(*) as n, sum(quality)::bigint as good, sum(toxic)::bigint as toxic from documents join labels using (doc_id) group by 1",
    "longest_evidence_per_group": f"select g, k, years::bigint as years from (select k % 25 as g, k, years, row_number() over (partition by k % 25 order by years desc, k) as rn from {_LONG}) where rn = 1",
}

_VISITS = ", ".join(f"({k}, {n}, '{path}', '{status}')" for k, n, path, status in _SITE_VISITS)
SQL |= {
    "crawl_visits": f"select c_custkey as k, n, path, status from customer join (values {_VISITS}) t(kind, n, path, status) on c_custkey % 13 = kind",
    "crawl_outcomes": f"""select c_custkey as k, case c_custkey % 13 when 4 then 'robots_denied' when 5 then 'http_error' when 11 then 'robots_unavailable' when 12 then 'invalid_url' else t.status end as status,
 coalesce(p.pages_read, 0)::bigint as pages_read from customer left join (values {_VISITS}) t(kind, n, path, status) on c_custkey % 13 = t.kind and t.n = 1
 left join (select kind, count(*) filter (status = 'success') as pages_read from (values {_VISITS}) t(kind, n, path, status) group by 1) p on c_custkey % 13 = p.kind""",
    "crawl_histogram": "select status, count(*) as n from (select case when page_id % 11 = 0 then 'timeout' when page_id % 10 = 0 then 'http_error' when page_id % 7 = 0 then 'redirect_blocked' else 'success' end as status from pages) group by 1",
}
NAMES = ["html_visible_text", "likely_pages", *SQL]
QUERIES = {n: globals()[n] for n in NAMES}
