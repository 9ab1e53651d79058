"""Jobs, sessions and streaming forms."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import claims, enrichment, history
from fieldmark.plans import job as jobs
from fieldmark.plans.session import Session, list_sessions, page_plugins
from fieldmark.schema import ORDER, as_records
from fieldmark.sources.registry import PolicyError
from fieldmark.streaming import folds

BASE = {"version": 1, "name": "demo", "search": {"query": "cleaning", "cities": ["Denver, CO"], "states": ["CA"]}, "sources": ["csv"], "output": {"fields": ["name", "phone", "website"]}}


def test_plan_and_preflight():
    job = jobs.parse(BASE)
    assert [(t.source, t.city, t.state) for t in jobs.plan(job)] == [("csv", "Denver", "CO"), ("csv", "", "CA")]
    assert jobs.preflight(job)["task_count"] == 2
    assert jobs.plan(jobs.parse(BASE | {"search": {"query": "x"}})) == []
    assert job.fingerprint() == jobs.parse(json.loads(json.dumps(BASE))).fingerprint()


@pytest.mark.parametrize(
    "change,message",
    [
        ({"execution": {"mode": "live_smoke", "max_parallel_tasks": 2, "live_smoke": {"max_tasks": 1}}}, "one task"), ({"budget": {"approval_reference": "A-1"}}, "above 0"), ({"verification": {"phone": {"provider": "other"}}}, "provider"),
        ({"verification": {"phone": {"provider": "twilio_lookup_basic"}}}, "api_key_service"), ({"version": 2}, "version"), ({"name": ""}, "name"), ({"sources": []}, "at least one"), ({"output": {"fields": ["raw_data"]}}, "unknown fields"), ({"limit": 1, "limits": {"total_records": 2}}, "both"),
        ({"execution": {"max_parallel_tasks": 9}}, "at most 8"), ({"execution": {"mode": "live_smoke"}}, "live_smoke"), ({"composition": {"primary_source": "csv", "supplemental_sources": ["nppes"]}}, "listed"),
        ({"source_options": {"google": {"enrich_details": True, "max_enrich": 3}}}, "budget"), ({"output": {"format": "xml", "fields": ["name"]}}, "one of"),
    ],
)
def test_bad_specs(change, message):
    with pytest.raises(ValueError, match=message):
        jobs.parse(BASE | change)


def write_csv(path):
    head = ["business_name", "address", "city", "state", "phone", "website", "source_url", "observed_at"]
    rows = [[f"Shop {k}", "1 A", "Denver", "CO", f"303555010{k}", f"https://s{k % 3}.example.test", "https://r.example.test", "2026-01-01"] for k in range(5)] + [["", "", "", "", "", "", "", ""]]
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([head, *rows])


def test_run_end_to_end_and_resume(spark, tmp_path):
    source = tmp_path / "in.csv"
    write_csv(source)
    spec = BASE | {"search": {"query": "x", "cities": ["Denver, CO"]}, "source_options": {"csv": {"path": str(source)}}}
    runner = jobs.Runner(spark, str(tmp_path / "root"))
    m = runner.run(jobs.parse(spec), "run-1")
    assert m["output"]["record_count"] == 3 and m["output"]["status_counts"] == {"accepted": 3, "incomplete": 1} and m["pipeline_metrics"]["duplicates_removed"] == 2
    with open(m["output"]["destination"], newline="") as f:
        assert [r["name"] for r in csv.DictReader(f)] == ["Shop 0", "Shop 1", "Shop 2"]
    assert m["changes"]["new"] == 3 and "3 records" in jobs.summary_text(m)
    source.unlink()
    _, log = runner.acquire(jobs.parse(spec), "run-1")
    assert [t["outcome"] for t in log] == ["success"]
    _, log = runner.acquire(jobs.parse(spec), "run-2")
    assert log[0]["outcome"].endswith("failure")
    with pytest.raises(PolicyError):
        runner.run(jobs.parse(spec | {"sources": ["google"]}))


def test_enrichment_and_verification_stages(spark, tmp_path):
    details = spark.createDataFrame([("google", "g0", "408-555-0100", "a.test"), ("google", "g1", "408-555-0101", "b.test")], "source string, source_id string, phone string, website string")
    raw = [(0, "A", "google", '{"place_id": "g0"}', ""), (1, "B", "google", '{"place_id": "g0"}', "own.test"), (2, "C", "google", '{"place_id": "g1"}', ""), (3, "D", "csv", "{}", "")]
    rows = as_records(spark.createDataFrame(raw, f"{ORDER} long, name string, source string, raw_data string, website string"), {c: F.col(c) for c in ("name", "source", "raw_data", "website")})
    out = [(r["name"], r["phone"], r["website"]) for r in enrichment.with_details(rows, details, {"google": 1}).orderBy(ORDER).collect()]
    assert out == [("A", "408-555-0100", "a.test"), ("B", "408-555-0100", "own.test"), ("C", "", ""), ("D", "", "")]
    source = tmp_path / "in.csv"
    write_csv(source)
    pages = spark.createDataFrame([("s0.example.test", 0, "https://s0.example.test/", "<a href='mailto:x@s0.example.test'>m</a>")], "website string, n int, url string, html string")
    lookups = spark.createDataFrame([("303-555-0101", "verified")], "phone string, result string")
    spec = BASE | {"processing": {"enrich": True}, "verification": {"phone": {"provider": "twilio_lookup_basic", "api_key_service": "k", "api_secret_service": "s"}}, "source_options": {"csv": {"path": str(source)}}, "search": {"query": "x", "states": ["CO"]}}
    runner = jobs.Runner(spark, str(tmp_path / "root"), pages=pages, lookups=lookups)
    job = jobs.parse(spec)
    kept = {r["name"]: r for r in runner.transform(job, runner.acquire(job, "r")[0]).collect()}
    assert kept["Shop 0"]["email"] == "x@s0.example.test" and kept["Shop 1"]["phone_status"] == "verified" and kept["Shop 2"]["email"] == ""


def test_caps_stop_later_tasks(spark, tmp_path):
    source = tmp_path / "in.csv"
    write_csv(source)
    spec = BASE | {"source_options": {"csv": {"path": str(source)}}, "limits": {"per_source_records": 6, "per_location_records": 4}}
    _, log = jobs.Runner(spark, str(tmp_path / "root")).acquire(jobs.parse(spec), "r")
    assert [t["rows"] for t in log] == [4, 2]
    spec["limits"] = {"total_records": 2}
    _, log = jobs.Runner(spark, str(tmp_path / "other")).acquire(jobs.parse(spec), "r")
    assert [(t["outcome"], t["rows"]) for t in log] == [("success", 2), ("skipped", 0)]


def test_session(spark, tmp_path):
    rows = spark.createDataFrame([(0, "A", "https://a.test", "csv"), (1, "B", "https://b.test", "csv")], f"{ORDER} long, name string, website string, source string")
    records = as_records(rows, {c: F.col(c) for c in ("name", "website", "source")})
    s = Session.create(spark, str(tmp_path / "s1"), "dentists", records)
    pages = spark.createDataFrame([("https://a.test", 0, "https://a.test/", "<p>Family owned since 1990</p><a href='mailto:x@a.test'>m</a>"), ("https://b.test", 0, "https://b.test/", "<p>Corporate office. Our practice has permanently closed</p>")], "website string, n int, url string, html string")
    plugins = page_plugins(pages, 2026, F.lit("2026-01-01").cast("timestamp"))
    s.refine("independent for 20 years", plugins)
    assert [r["name"] for r in s.matches().collect()] == ["A"]
    s.refine("email", plugins)
    again = Session.load(spark, str(tmp_path / "s1"))
    assert [r["email"] for r in again.records.orderBy(ORDER).collect()] == ["x@a.test", ""]
    assert again.summary().first()["likely_corporate"] == 1 and again.export().count() == 2
    assert claims.latest_steps([(x["plugin"], x["instruction"]) for x in again.steps]) == [("public-email", "email")]
    assert list_sessions(spark, str(tmp_path)) == [str(tmp_path / "s1")]


def test_streams(spark, tmp_path):
    rows = [("a", 1, "2026-01-01 00:00:00", "fatal_failure"), ("a", 2, "2026-01-01 00:01:00", "retryable_failure"), ("a", 3, "2026-01-01 00:02:00", "skipped"), ("b", 4, "2026-01-01 00:03:00", "success"), ("a", 5, "2026-01-01 00:04:00", "success")]
    df = spark.createDataFrame(rows, "source string, event_id long, ts string, outcome string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate((df.where("event_id <= 2"), df.where("event_id > 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = folds.health_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        del k
    out = {r["event_id"]: r["consecutive_failures"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: 1, 2: 2, 3: 2, 4: 0, 5: 0}
    from fieldmark.operators.stateful import health

    assert {r["event_id"]: r["consecutive_failures"] for r in health(df).collect()} == out
    assert folds.outcome_windows(df).count() == 2
    store = history.HistoryStore(spark, str(tmp_path / "h"), "j")
    sink = folds.history_sink(store)
    batch = spark.createDataFrame([("n", "a", "p", "accepted")], "name string, address string, phone string, record_status string")
    sink(batch, 0)
    sink(batch, 0)
    assert store.runs().count() == 1
