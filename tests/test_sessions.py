"""Refinements with notes and details, one crawl for all plugins, exports and commands."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from fieldmark import __main__ as cli
from fieldmark.operators import claims, crawl, linkage
from fieldmark.plans.session import Plugins, Refined, Session, enrollment_plugin, page_plugins, web_plugins
from fieldmark.schema import ORDER, as_records

RESPONSES = "url string, status int, final_url string, body string, error array<string>"
WEB = [
    ("https://a.test", 200, None, '<a href="/about">us</a> Family owned', None), ("https://a.test/about", 200, None, 'Founded in 1990 <a href="mailto:x@a.test">m</a><a href="https://facebook.com/a.shop">f</a>', None),
    ("https://b.test", None, None, None, ["ReadTimeout: slow"]), ("https://c.test", 200, None, '<a href="mailto:c@c.test">m</a>', None), *[(f"https://{k}.test/robots.txt", 200, None, "", None) for k in "abc"],
]


@pytest.fixture
def at(spark):
    return F.lit("2026-01-01").cast("timestamp")


def people(spark):
    rows = [(0, "A", "a.test", "", "1"), (1, "B", "https://b.test", "", "2"), (2, "C", "https://c.test", "own@c.test", "3"), (3, "D", "", "", "4"), (4, "A2", "https://a.test", "", "5")]
    df = spark.createDataFrame(rows, f"{ORDER} long, name string, website string, email string, n string")
    return as_records(df, {c: F.col(c) for c in ("name", "website", "email")} | {"source": F.lit("csv"), "source_ids": F.create_map(F.lit("npi"), F.concat(F.lit("100000000"), "n"))})


def test_refinements_share_a_crawl_and_leave_an_audit(spark, tmp_path, at, monkeypatch):
    crawled, real = [], crawl.crawl
    monkeypatch.setattr(crawl, "crawl", lambda *a, **k: (crawled.append(1), real(*a, **k))[1])
    s = Session.create(spark, f"file://{tmp_path}/s", "dentists", people(spark))
    plugins = web_plugins(s.records, spark.createDataFrame(WEB, RESPONSES), 2026, at)
    steps = s.refine("family owned for 20 years with an email and facebook", plugins)
    assert crawled == [1] and [x["plugin"] for x in steps] == ["ownership-evidence", "longevity-evidence", "public-socials", "public-email"] and {(x["before"], x["after"]) for x in steps} == {(5, 5)}
    notes = {x["plugin"]: x["note"] for x in steps}
    assert notes["ownership-evidence"].startswith("2 records gained") and notes["public-email"] == "2 public emails found on first-party pages; 3 records with one now. Crawl outcomes: 2 success, 1 timeout."
    assert notes["public-socials"].startswith("2 social links found on first-party pages; 2 records with one now. Crawl outcomes: 3 success, 1 timeout.")
    assert sorted((r["name"], r["website"], r["status"], r["pages_read"]) for r in s.details().collect()) == [("A", "a.test", "success", 2), ("A2", "https://a.test", "success", 2), ("B", "https://b.test", "timeout", 0)]
    assert s.details(4).count() == 4
    rows = {r["name"]: r for r in Session.load(spark, s.path).records.collect()}
    assert rows["A"]["email"] == "x@a.test" and rows["A"]["email_status"] == "not_checked" and rows["A"]["field_provenance"]["email"]["evidence_url"] == "https://a.test/about"
    assert rows["C"]["email"] == "own@c.test" and rows["B"]["email"] == "" and rows["A2"]["facebook"] == "https://www.facebook.com/a.shop" and [r["name"] for r in s.matches().orderBy(ORDER).collect()] == ["A", "A2"]
    with pytest.raises(ValueError, match="4 steps"):
        s.details(5)


def test_an_email_refinement_fills_emails_only(spark, tmp_path, at):
    s = Session.create(spark, f"file://{tmp_path}/s", "x", people(spark))
    s.refine("email", web_plugins(s.records, spark.createDataFrame(WEB, RESPONSES), 2026, at))
    assert {r["facebook"] for r in s.records.collect()} == {""} and s.steps[0]["applied_at"] > "2026"


def test_plugins_are_given_once(spark, tmp_path, at):
    plugins = Plugins().register("x", lambda rows, instruction: Refined(rows))
    with pytest.raises(ValueError, match="already"):
        plugins.register("x", lambda rows, instruction: Refined(rows))
    s = Session.create(spark, f"file://{tmp_path}/s", "x", people(spark))
    for words, message in (("email", "No plugin"), (" ", "instruction"), ("zzz", "understands")):
        with pytest.raises(ValueError, match=message):
            s.refine(words, plugins)


def test_enrollment_by_id(spark, tmp_path, at):
    s = Session.create(spark, f"file://{tmp_path}/s", "x", people(spark))
    listed = spark.createDataFrame([("1000000001",), (" 1000000003 ",), ("9",)], "npi string")
    plugin = enrollment_plugin(listed, "https://list.test", at)
    s.refine("takes medi-cal", Plugins().register("medi-cal-dental-enrollment", plugin))
    assert [r["name"] for r in s.matches().orderBy(ORDER).collect()] == ["A", "C"] and s.steps[0]["note"].startswith("2 records found")
    found = {r["name"]: r["claims"] for r in s.records.collect()}
    assert (found["A"][0]["source"], found["A"][0]["source_record_id"], found["A"][0]["authority"]) == ("ca-dhcs-medi-cal-dental-ffs", "1000000001", "official_program_directory") and found["B"] == []
    with pytest.raises(ValueError, match="at most 4"):
        linkage.enroll_by_id(s.records, listed, "npi", F.lit(None), claims.ENROLLED, most=4)
    odd = as_records(spark.createDataFrame([(0, "12")], f"{ORDER} long, n string"), {"source_ids": F.create_map(F.lit("npi"), F.col("n"))})
    assert enrollment_plugin(listed, "u", at)(odd, "").rows.first()["claims"] == []


def test_export_files(spark, tmp_path, at):
    s = Session.create(spark, f"file://{tmp_path}/s", "x", people(spark))
    with open(s.write_export(f"file://{tmp_path}/out/r.csv").removeprefix("file://"), newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == claims.RESEARCH_COLUMNS and [r["name"] for r in rows] == ["A", "B", "C", "D", "A2"] and rows[0]["ownership_assessment"] == "unclear"
    assert [r["email"] for r in json.loads(open(s.write_export(f"file://{tmp_path}/out/r.json").removeprefix("file://")).read())] == ["", "", "own@c.test", "", ""]
    s.refine("email", page_plugins(spark.createDataFrame([], "website string, n int, url string, html string"), 2026, at))
    s.steps[0]["instruction"] = "closed"
    s.steps[0]["plugin"] = "operational-status-evidence"
    assert open(s.write_export(f"file://{tmp_path}/out/none.csv", True).removeprefix("file://")).read() == ",".join(claims.RESEARCH_COLUMNS) + "\n"
    with pytest.raises(ValueError):
        s.write_export(f"{tmp_path}/x.txt")


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    root = f"{tmp_path}/sessions"
    (tmp_path / "rows.json").write_text(json.dumps([{"name": n, "website": w, "source": "csv", "address": "1 A", "city": "Reno", "state": "NV", "phone": p} for n, w, p in (("A", "a.test", "775-555-0100"), ("B", "https://b.test", ""))]))
    spark.createDataFrame(WEB, RESPONSES).write.parquet(f"{tmp_path}/web")
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)[1]
    assert "2 records" in run("research-import", f"{tmp_path}/rows.json", "shops", "--session", f"{root}/one")
    assert "1 public email" in run("refine", f"{root}/one", "email", "--responses", f"{tmp_path}/web", "--as-of", "2026-01-01")
    assert run("sessions", root).split()[:2] == ["1", f"{root}/one"]
    assert json.loads(run("view", "--latest", "--root", root, "--fields", "name,email").splitlines()[0]) == {"name": "A", "email": "x@a.test"}
    assert '"status":"timeout"' in run("view", f"{root}/one", "--audit") and '"total_records":2' in run("view", f"{root}/one", "--summary")
    (tmp_path / "more.csv").write_text("name,address,city,state,phone,website,source\nA,1 A,Reno,NV,775-555-0100,https://a-new.test,\n")
    assert "1 matched" in run("compose", f"{tmp_path}/more.csv", "--latest", "--root", root, "--source", "other")
    assert "out.csv" in run("research-export", f"{root}/one", f"{tmp_path}/out.csv")
    with open(f"{tmp_path}/out.csv", newline="") as f:
        assert [r["email"] for r in csv.DictReader(f)] == ["x@a.test", ""]
    with open(f"{tmp_path}/in.csv", "w", newline="") as f:
        csv.writer(f).writerows([["business_name", "address", "city", "state", "website", "phone", "source_url", "observed_at"], ["A", "1 A", "Reno", "NV", "a.test", "775-555-0100", "https://r.test", "2026-01-01"]])
    (tmp_path / "job.yml").write_text(json.dumps({"version": 1, "name": "demo", "search": {"query": "x", "states": ["NV"]}, "sources": ["csv"], "output": {"fields": ["name", "email"]}, "processing": {"enrich": True}, "source_options": {"csv": {"path": f"{tmp_path}/in.csv"}}}))
    assert '"task_count": 1' in run("preflight", f"{tmp_path}/job.yml")
    out = run("run", f"{tmp_path}/job.yml", "--root", f"{tmp_path}/jobs", "--run-id", "r1", "--responses", f"{tmp_path}/web")
    assert "1 records" in out and "not run" not in out
    assert [r["email"] for r in csv.DictReader(open(f"{tmp_path}/jobs/exports/demo/r1/demo.csv"))] == ["x@a.test"]
    assert "pages: not run" in run("run", f"{tmp_path}/job.yml", "--root", f"{tmp_path}/other", "--run-id", "r1")
    assert "csv / NV: 1 rows" in run("resume", f"{tmp_path}/job.yml", "r1", "--root", f"{tmp_path}/other")
    assert "1 records" in run("research", f"{tmp_path}/job.yml", "shops", "--root", f"{tmp_path}/third", "--session", f"{root}/two")
    assert Session.load(spark, f"{root}/two").records.count() == 1
    with pytest.raises(ValueError, match="session"):
        run("refine", "email")
