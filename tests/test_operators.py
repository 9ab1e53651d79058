"""Hand-written cases of the record operators."""

import csv
import datetime
import json

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import text as tx
from fieldmark.operators import claims, contacts, crawl, dedup, delivery, evidence, history, linkage, snapshot, stateful
from fieldmark.schema import ORDER, RECORD, as_records, claim
from fieldmark.sources import readers, registry


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function,text,expected",
    [
        (tx.clean_email, " A@B.co ", "a@b.co"), (tx.clean_email, "blue broom at example.test", ""), (tx.clean_email, "perkup@test", ""),
        (tx.clean_website, "[https://www.daily.example.test](x", ""), (tx.clean_website, "<http://www.a.example.test/b?c>", "a.example.test"), (tx.clean_website, "not-a-url", "not-a-url"), (tx.clean_website, "https://[bad", ""),
        (tx.normalize_website, "HTTP://www.a.www.b.test/x", "a.www.b.test"), (tx.clean_phone, "555-0000", "5550000"), (tx.clean_phone, "555-12", ""), (tx.match_phone, "+1 (408) 555-0100", "4085550100"),
        (tx.match_website, " HTTPS://www.A.test/Path/ ", "a.test/path"), (tx.match_text, " St.  Mary's ", "st mary's"), (tx.fuzzy_name, "Acme Co. LLC", "acme co"), (tx.normalize_text, "Ｃａｆé   X ", "Café X"), (tx.to_int, "1,250", 1250), (tx.to_int, "3,4", 34), (tx.to_int, "3.0", None),
        (tx.to_float, "9/10", None), (tx.to_float, "-2", -2.0), (tx.to_float, "5d", None), (tx.slug, "Hello, World!", "hello-world"), (tx.social_url, "facebook.com/x", "https://www.facebook.com/x"),
    ],
)
def test_text(spark, function, text, expected):
    assert one(spark, function(F.col("v")), v=text) == expected


def test_timestamps(spark):
    at = lambda s: one(spark, tx.to_timestamp(F.col("v")), v=s)
    assert at("2026-01-02") == datetime.datetime(2026, 1, 2)
    assert at("2026-01-02T03:04:05+00:00") == datetime.datetime(2026, 1, 2, 3, 4, 5)
    assert at("2026") is None and at("not-a-date") is None and at(None) is None


def test_us_address(spark):
    full = one(spark, tx.us_address(F.col("v")), v="123 Main St, San Jose, CA 95110, USA")
    assert tuple(full) == ("123 Main St", "San Jose", "CA", "95110", "USA")
    assert tuple(one(spark, tx.us_address(F.col("v")), v="San Jose, CA 95110, USA")) == ("", "San Jose", "CA", "95110", "USA")
    assert tuple(one(spark, tx.us_address(F.col("v")), v="Elsewhere")) == ("Elsewhere", "", "", "", "")


def records(spark, rows, keep=None):
    """Records of dicts; other fields are empty."""
    names = sorted({k for r in rows for k in r} - {"source_ids", "discovery_sources"})
    data = [tuple(r.get(n) for n in names) + (r.get("source_ids"), r.get("discovery_sources"), i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, ", ".join([*(f"{n} string" for n in names), "source_ids map<string,string>", "discovery_sources array<string>", f"{ORDER} long"]))
    return as_records(df, {c: F.col(c) for c in df.columns if c != ORDER}, keep=keep)


def test_csv_to_classified(spark, tmp_path):
    path = tmp_path / "in.csv"
    head = ["business_name", "category", "address", "city", "state", "zip", "phone", "email", "website", "rating", "reviews", "source", "source_url", "observed_at", ""]
    lines = [
        ["Joe's", "Cafe", "1 A St", "X", "CA", "1", "4085550101", "j@x.example.test", "https://www.joe.example.test", "4.5", "1,250", "s", "https://r.example.test/1", "2026-01-01T00:00:00+00:00", ""],
        ["Joe's again", "Cafe", "2 A St", "X", "CA", "1", "4085550102", "", "http://joe.example.test/", "NA", "", "s", "", "", ""],
        ["  Café\tRésumé ", "", "321   Elm St", "Y", "", "", "12", "bad", "", "9/10", "3,4", "", "https://r.example.test/2", "not-a-date", ""],
    ]
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([head, *lines])
    rows = readers.read_csv(spark, str(path))
    assert [f.name for f in rows.schema][: len(RECORD)] == [f.name for f in RECORD]
    valid = contacts.validate(rows, flags=True)
    assert {r["metric"]: r["value"] for r in contacts.counters(valid).collect()} == {"invalid_emails": 1, "invalid_phones": 1}
    kept = dedup.keep_first(contacts.normalize(valid))
    out = delivery.classify(kept).orderBy(ORDER).collect()
    assert [(r["name"], r["record_status"], r["quality_reasons"]) for r in out] == [("Joe's", "accepted", []), ("Café Résumé", "incomplete", ["missing_phone_or_website", "missing_observed_at"])]
    assert out[0]["review_count"] == 1250 and out[1]["review_count"] == 34 and out[0]["website"] == "joe.example.test"
    assert set(out[0]["field_provenance"]) == {"name", "category", "address", "city", "state", "postal_code", "phone", "email", "website", "rating", "review_count"}


def test_exact_duplicates_merge_sources_in_order(spark):
    rows = records(spark, [{"website": "a", "source": "x", "discovery_sources": ["q"]}, {"website": "a", "source": "y"}, {"website": "a", "source": "x"}, {"email": "a", "source": "z"}, {"source": "n"}, {"source": "m"}])
    out = dedup.keep_first(rows).orderBy(ORDER).collect()
    assert [(r[ORDER], r["discovery_sources"]) for r in out] == [(0, ["q", "x", "y"]), (3, ["z"]), (4, ["n", "m"])]


def test_fuzzy_row_is_not_remembered_by_its_key(spark):
    rows = records(
        spark,
        [
            {"name": "Bright Smile Dental Care Center", "address": "1 Main", "phone": "1", "source": "a"},
            {"name": "Bright Smile Dental Care Centre", "address": "1 main ", "phone": "2", "source": "b"},
            {"name": "Bright Smile Dental Care Centre", "address": "9 Other", "phone": "2", "source": "c"},
            {"name": "Other", "address": "1 Main", "phone": "3", "source": "d"},
        ],
    )
    out = dedup.fuzzy_keep_first(rows, threshold=0.93).orderBy(ORDER).collect()
    assert [r["dedup_decision"] for r in out] == ["kept", "fuzzy", "kept", "kept"]


def linked(spark, p, s):
    return sorted((r.p_ord, r.s_ord, r.decision, r.method) for r in linkage.match(records(spark, p), records(spark, s)).collect())


BASE = {"name": "Acme Co.", "address": "1 Main St", "city": "X", "state": "CA", "phone": "408-555-0100"}


def test_linkage_decisions(spark):
    assert linked(spark, [BASE], [BASE | {"name": "acme co"}]) == [(0, 0, "matched", "exact_phone_and_name_and_address")]
    assert linked(spark, [BASE], [BASE | {"city": "Y"}]) == [(0, 0, "candidate", "exact_phone_candidate")]
    assert linked(spark, [BASE], [BASE | {"name": "Other"}]) == [(0, 0, "candidate", "exact_phone_candidate")]
    assert linked(spark, [BASE | {"phone": ""}], [BASE | {"phone": ""}]) == [(0, 0, "candidate", "exact_name_address_candidate")]
    assert [x[2] for x in linked(spark, [BASE, BASE], [BASE])] == ["ambiguous", "ambiguous"]
    ids = {"source_ids": {"npi": "1"}}
    assert linked(spark, [BASE | ids], [BASE | ids | {"phone": "", "name": "Other", "address": "2 Elm"}]) == [(0, 0, "candidate", "exact_source_id_candidate")]


def test_id_outranks_other_keys(spark):
    ids = {"source_ids": {"npi": "1"}}
    p = [BASE | ids, BASE | {"name": "Else", "address": "9 Z"}]
    assert linked(spark, p, [BASE | ids]) == [(0, 0, "matched", "exact_source_id_and_phone")]


def test_promotion_fills_only_blanks(spark):
    p = records(spark, [BASE | {"source": "a", "email": ""}, BASE | {"phone": "408-555-0199", "website": "own.test", "source": "a"}])
    s = records(spark, [BASE | {"source": "manual_first_party_review", "website": "new.test", "email": "e@x.test", "source_url": "u"}, BASE | {"phone": "408-555-0199", "website": "other.test", "source": "manual_first_party_review"}])
    out = linkage.promote(p, s, linkage.match(p, s)).orderBy(ORDER).collect()
    assert (out[0]["website"], out[0]["email"], out[0]["email_status"]) == ("new.test", "e@x.test", "not_checked") and out[1]["website"] == "own.test"
    made = out[0]["field_provenance"]["website"]
    assert (made["method"], made["evidence_url"], made["source"]) == ("cross_source_exact_match", "u", "manual_first_party_review")
    assert out[0]["discovery_sources"] == ["a", "manual_first_party_review"] and set(out[0]["field_provenance"]) == {"website", "email"}


def test_classification_keeps_terminal_and_flags_unknown(spark):
    rows = records(spark, [{"record_status": "closed"}, {"record_status": "odd"}, {"name": "A"}])
    assert [(r["record_status"], r["quality_reasons"][:1]) for r in delivery.classify(rows).orderBy(ORDER).collect()] == [("closed", []), ("needs_review", ["unknown_record_status"]), ("incomplete", ["missing_location"])]


def test_history_store(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path), "job")
    row = lambda n, status="accepted", **k: {"name": n, "address": "1", "phone": "1", "record_status": status} | k
    t = lambda day: datetime.datetime(2026, 1, day)
    first = store.record_run("r1", t(1), records(spark, [row("a"), row("b"), row("c", "incomplete")]))
    assert {(r.change) for r in first.collect()} == {"new"} and first.count() == 2
    second = store.record_run("r2", t(2), records(spark, [row("a", city="X"), row("d")]))
    assert sorted((r.change, tuple(r.changed)) for r in second.collect()) == [("missing", ()), ("new", ()), ("updated", ("city",))]
    third = store.record_run("r3", t(3), records(spark, [row("a", city="X"), row("b")]))
    assert sorted(r.change for r in third.collect()) == ["missing", "new", "unchanged"]
    seen = {r.first_seen_run_id for r in store.current().where("is_present").collect()}
    assert seen == {"r1"} and [r.run_id for r in store.runs(2).collect()] == ["r3", "r2"]
    with pytest.raises(ValueError):
        store.record_run("r3", t(4), records(spark, [row("a")]))


def test_history_retry_after_a_crash(spark, tmp_path, monkeypatch):
    store = history.HistoryStore(spark, str(tmp_path), "job")
    rows = records(spark, [{"name": "a", "address": "1", "phone": "1", "record_status": "accepted"}])
    at = datetime.datetime(2026, 1, 1)
    real = history.diff
    store.record_run("r1", at, rows)
    monkeypatch.setattr(history, "diff", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.record_run("r2", at, rows)
    assert [r.run_id for r in store.runs().collect()] == ["r1"]
    monkeypatch.setattr(history, "diff", real)
    assert [r.change for r in store.record_run("r2", at, rows).collect()] == ["unchanged"]
    assert store.record_versions(store.current().first()["record_id"]).count() == 2 and store.record(store.current().first()["record_id"]).count() == 1


def test_record_lookup_reads_one_bucket_of_each_run(spark, tmp_path):
    store = history.HistoryStore(spark, str(tmp_path), "job", buckets=8)
    make = lambda n, city: records(spark, [{"name": f"n{k}", "address": "1", "phone": "1", "record_status": "accepted", "city": city} for k in range(n)])
    store.record_run("r1", datetime.datetime(2026, 1, 1), make(60, "X"))
    store.record_run("r2", datetime.datetime(2026, 1, 2), make(40, "Y"))
    store.buckets = 4
    store.record_run("r3", datetime.datetime(2026, 1, 3), make(50, "Y"))
    wanted = {r["name"]: r["record_id"] for r in store.latest().collect()}["n7"]
    gone = {r["record_id"] for r in store.current().where("not is_present").collect()}
    assert len(gone) == 10 and store.record(next(iter(gone))).isEmpty()
    # the lookup still works where all other buckets are unreadable
    import glob
    import os

    keep = {n: spark.range(1).select(history._bucket(F.lit(wanted), n)).first()[0] for n in (8, 4)}
    for f in glob.glob(str(tmp_path / "job" / "v3" / "versions" / "*" / "bucket=*" / "*.parquet")):
        if f"bucket={keep[4 if '/run-r3-' in f else 8]}/" not in f:
            os.chmod(f, 0o644)
            open(f, "w").write("broken")
            crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    found = store.record_versions(wanted)
    assert [(r["run_id"], r["city"]) for r in found.collect()] == [("r1", "X"), ("r2", "Y"), ("r3", "Y")]
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()
    one = store.record(wanted).first()
    assert (one["first_seen_run_id"], one["last_seen_run_id"], one["versions"], one["city"], one["name"]) == ("r1", "r3", 3, "Y", "n7")
    with pytest.raises(Exception, match="(?i)parquet"):
        store.current().collect()


def test_history_as_files_overwrites_a_run(spark, tmp_path):
    store = history.HistoryStore(spark, f"file://{tmp_path}", "job", overwrite=True)
    make = lambda *names: records(spark, [{"name": n, "address": "1", "phone": "1", "record_status": "accepted"} for n in names])
    store.record_run("r1", datetime.datetime(2026, 1, 1), make("a", "b"))
    again = store.record_run("r1", datetime.datetime(2026, 1, 2), make("a", "c"))
    assert sorted(r["change"] for r in again.collect()) == ["missing", "new", "unchanged"]
    assert [(r["run_id"], r["records"]) for r in store.runs().collect()] == [("r1", 2)] and {r["name"] for r in store.latest().collect()} == {"a", "c"}
    assert len(list((tmp_path / "job" / "v3" / "versions").iterdir())) == 1
    assert store.record_run("r2", datetime.datetime(2026, 1, 3), make()).count() == 2 and store.runs(1).first()["records"] == 0
    with pytest.raises(ValueError):
        store.runs(0)


def test_files_are_read_in_order_of_name(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    n = 0
    # the scan packs larger files first
    for name, size in (("f0.csv", 2), ("f1.csv", 400), ("f2.csv", 30)):
        lines = ["name"]
        for _ in range(size):
            lines.append(f"shop {n}")
            n += 1
        (folder / name).write_text("\n".join(lines) + "\n")
    out = readers.read_csv(spark, str(folder)).orderBy(ORDER).select("name", ORDER).collect()
    assert [r["name"] for r in out] == [f"shop {k}" for k in range(n)] and [r[ORDER] for r in out] == list(range(n))


def test_registry_sources_keep_to_their_scope(spark, tmp_path):
    from fieldmark.sources.registry import default_registry

    entry = lambda k, city: {"number": f"100000000{k}", "basic": {"organization_name": f"Org {k}"}, "addresses": [{"address_purpose": "LOCATION", "address_1": "1 A", "city": city, "state": "CA", "telephone_number": "4085550100", "postal_code": "9", "country_name": "US"}], "taxonomies": [{"primary": True, "desc": "Dentist", "license": "1", "state": "CA"}]}
    (tmp_path / "p.json").write_text(json.dumps([entry(1, "SAN JOSE"), entry(2, "FRESNO"), entry(3, "San Jose")]))
    r = default_registry()
    got = r.read(spark, "nppes", {"path": str(tmp_path / "p.json"), "city": "San Jose", "state": "CA"})
    assert [x["name"] for x in got.orderBy(ORDER).collect()] == ["Org 1", "Org 3"]
    assert r.read(spark, "nppes", {"path": str(tmp_path / "p.json"), "state": "CA", "limit": 1}).count() == 1
    with pytest.raises(ValueError):
        r.read(spark, "nppes", {"path": str(tmp_path / "p.json"), "city": "San Jose"})
    row = lambda k, city, kind="CC", status="ACTIVE": {"businessname": f"B {k}", "contractorlicensenumber": f"L{k}", "contractorlicensetypecode": kind, "contractorlicensestatus": status, "address1": "1 A", "city": city, "state": "WA"}
    (tmp_path / "c.json").write_text(json.dumps([row(1, "SEATTLE"), row(2, "TACOMA"), row(3, "Seattle", "EL"), row(4, "seattle"), row(5, "SEATTLE", status="EXPIRED")]))
    got = r.read(spark, "wa-li", {"path": str(tmp_path / "c.json"), "city": "Seattle"})
    assert [x["name"] for x in got.orderBy(ORDER).collect()] == ["B 1", "B 4"]


def test_normal_form_of_every_text(spark):
    import unicodedata

    texts = ["plain  text", "\ufb01ne", "\u2460 x", "\uff21\uff22", "e\u0301", "", "  a\u00a0b  "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(tx.normalize_text(F.col("t"))).collect()]
    assert got == [" ".join(unicodedata.normalize("NFKC", t).split()) for t in texts]


def test_claims(spark):
    rows = records(spark, [{"name": "a"}, {"name": "b"}])
    at = F.lit("2026-01-01").cast("timestamp")
    made = claim(claims.LONGEVITY, F.lit(12), "number", "s", F.lit("1"), F.lit("u"), at)
    out = claims.append_claim(rows, claims.LONGEVITY, made, F.col("name") == "a")
    again = claims.append_claim(out, claims.LONGEVITY, made)
    assert [len(r["claims"]) for r in again.orderBy(ORDER).collect()] == [1, 1]
    assert claims.latest_matches(out, [("longevity-evidence", "open 12 years")]).count() == 1
    assert claims.latest_matches(out, [("longevity-evidence", "open 13+ years")]).count() == 0
    assert claims.latest_steps([("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("a", "y")]) == [("b", "y"), ("a", "y")]
    assert claims.route("independent, 10 years, email") == ["ownership-evidence", "longevity-evidence", "public-email"]
    with pytest.raises(ValueError):
        claims.route("nothing here")
    assert len(claims.research_export(out).columns) == 22


def test_evidence(spark):
    page = lambda text: spark.createDataFrame([(text,)], "t string")
    assert page("family owned, corporate office").select(evidence.ownership(F.col("t")).alias("x")).first().x is None
    long = page("Founded in 1990; serving you for over 40 years").select(evidence.longevity(F.col("t"), 2026).alias("x")).first().x
    assert (long.years, long.signal) == (40, "years_serving:40")
    html = "<p>Hi <b>there</b></p><script>x</script><!-- c --><a href='mailto:a%40b@x.test?s=1'>m</a><a href='/about'>Us</a><a href='https://else.test/about'>E</a>"
    df = spark.createDataFrame([("https://s.test/home/index.html", html)], "url string, html string")
    assert df.select(evidence.visible_text(F.col("html")).alias("x")).first().x == "Hi there m Us E"
    assert [r.target for r in crawl.likely_links(df).collect()] == ["https://s.test/about"]
    assert df.select(evidence.contacts(F.col("html"))["email"].alias("x")).first().x == "a@b@x.test"


def test_budget_and_caps(spark):
    df = spark.createDataFrame([(k, "google", i, False) for k, i in enumerate("aabcad")], f"{ORDER} long, source string, source_id string, hit boolean")
    assert [r.action for r in stateful.spend_budget(df, 2).orderBy(ORDER).collect()] == ["paid", "repeat", "paid", "skipped", "repeat", "skipped"]
    assert stateful.remaining({"total": 5, "source": 3}, {"total": 1, "source": 3}, None) == (None, "source records cap reached")
    assert stateful.remaining({"total": 5}, {"total": 1}, 10) == (4, None) and stateful.capped(0, 0)


def test_policy_gate():
    r = registry.default_registry()
    r.require(["csv", "nppes"])
    with pytest.raises(registry.PolicyError, match="google, yelp"):
        r.require(["csv", "google", "yelp"])
    with pytest.raises(ValueError):
        r.register("csv", "file", registry.CLIENT)


def test_snapshot_round_trip(spark, tmp_path):
    rows = [("z", "Z", "dental_clinic", None, -121.9), ("a", "A", "store", ["dental_clinic"], -121.8), ("out", "O", "dental_clinic", None, -100.0), ("no", "N", "store", None, -121.9)]
    df = spark.createDataFrame(rows, "id string, n string, p string, h array<string>, x double")
    df = df.selectExpr("id", "named_struct('primary', n) names", "named_struct('primary', p, 'hierarchy', h) taxonomy", "array(named_struct('locality','San Jose','freeform','1 A')) addresses", "array(named_struct('dataset','d','license','L','provider','P')) sources", "named_struct('xmin',x,'ymin',37.1D,'xmax',x,'ymax',37.1D) bbox", "0.5D confidence")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out.parquet")
    made = snapshot.prepare(spark, [str(tmp_path / "in" / "*.parquet")], out, (-122, 37, -121.7, 37.5), "2026-01", "2026-01-01T00:00:00+00:00", "https://r.example.test", "X")
    assert made["row_count"] == 2 and made["license"] == "L"
    with pytest.raises(ValueError, match="not reviewed"):
        snapshot.read_snapshot(spark, out)
    manifest = json.loads((tmp_path / "out.parquet.manifest.json").read_text())
    (tmp_path / "out.parquet.manifest.json").write_text(json.dumps(manifest | {"review_status": "reviewed"}))
    got = snapshot.read_snapshot(spark, out).collect()
    assert sorted(r["name"] for r in got) == ["A", "Z"] and len(got[0]["claims"]) == 3
    with pytest.raises(ValueError):
        snapshot.checked_box((10, 0, -10, 5))


def test_license_and_profile_rows(spark):
    good = spark.createDataFrame([("1", "Dr A", "ACTIVE", "u", "2026-01-01", 0)], f"license_number string, licensee_name string, license_status string, evidence_url string, observed_at string, {ORDER} long")
    row = readers.license_records(good).first()
    assert (row["category"], row["state"], len(row["claims"])) == ("Dentist", "CA", 2)
    with pytest.raises(Exception, match="is missing: licensee_name"):
        readers.license_records(good.withColumn("licensee_name", F.lit(" "))).collect()
    with pytest.raises(ValueError):
        readers.license_records(good.drop("observed_at"))
    items = spark.createDataFrame([("https://example.test/x", "https://www.linkedin.com/in/a", "A", 0)], f"profileUrl string, url string, name string, {ORDER} long")
    assert readers.profile_records(items, F.current_timestamp()).first()["linkedin"] == "https://www.linkedin.com/in/a"


def test_fixture_admission(tmp_path):
    import hashlib

    from fieldmark.sources import fixtures

    def put(name, payload):
        data = json.dumps(payload).encode()
        (tmp_path / name).write_bytes(data)
        return {"source": "s", "path": name, "sha256": hashlib.sha256(data).hexdigest(), "sanitization": "synthetic", "contains_real_contact_data": False}

    good = put("a.json", [{"url": "https://x.example.test/a"}])
    assert fixtures.admit(good, "sanitized_only", tmp_path) == (tmp_path / "a.json").resolve()
    for bad in (put("b.json", {"url": "https://real.com"}), put("c.json", {"deep": [{"Token": "x"}]}), good | {"path": "../x"}, good | {"sha256": "0" * 64}, good | {"sanitization": "none"}):
        with pytest.raises(fixtures.FixtureError):
            fixtures.admit(bad, "sanitized_only", tmp_path)
    with pytest.raises(fixtures.FixtureError):
        fixtures.admit(good, "prohibited", tmp_path)


def test_safe_names():
    assert history.safe_name("../my job!") == "my-job"
    with pytest.raises(ValueError):
        history.safe_name("///")


def test_command_line(tmp_path, capsys):
    from fieldmark.__main__ import main

    (tmp_path / "j.yaml").write_text("version: 1\nname: n\nsearch: {query: q, states: [CA]}\nsources: [csv]\noutput: {fields: [name]}\n")
    assert main(["preflight", str(tmp_path / "j.yaml")]) == 0
    assert json.loads(capsys.readouterr().out)["task_count"] == 1


def _brute_edges(p, s):
    ids = lambda r: {f"{k}:{x}" for k, x in r[1].items()}
    found = {(a[0], b[0]): (bool(ids(a) & ids(b)), a[2] == b[2] != "", a[3] == b[3] != "") for a in p for b in s}
    found = {k: v for k, v in found.items() if any(v)}
    by_id = {k[1] for k, v in found.items() if v[0]}
    return sorted((*k, *v) for k, v in found.items() if v[0] or k[1] not in by_id)


def _linked_side(spark, rows):
    made = spark.createDataFrame(rows, f"{ORDER} long, source_ids map<string,string>, phone string, website string, name string, address string, city string, state string")
    return as_records(made, {c: F.col(c) for c in made.columns if c != ORDER})


def test_crowded_keys_are_linked_in_cells(spark):
    """Keys that many records share give all pairs once, in cells, and no pair is shuffled."""
    import random

    rng = random.Random(5)

    def made(n):
        return [(i, {k: str(rng.randrange(40)) for k in ("npi", "tax") if rng.random() < 0.15}, rng.choice(["", "4085550001", "4085550001", f"40855500{rng.randrange(10, 40)}"]), rng.choice(["", "hot.test", f"s{rng.randrange(30)}.test"]), rng.choice("ab"), "x", "y", "z") for i in range(n)]

    p, s = made(90), made(60)
    a, b = _linked_side(spark, p), _linked_side(spark, s)
    e = linkage.edges(a, b, cell=4)
    assert sorted(tuple(r) for r in e.collect()) == _brute_edges(p, s)
    assert sorted(tuple(r) for r in linkage.match(a, b, cell=4).collect()) == sorted(tuple(r) for r in linkage.match(a, b).collect())
    ordered = linkage.in_order(linkage.match_sources(a, [b, b.where(F.col(ORDER) % 3 > 0)])).collect()
    assert linkage.matches_in_order(a, [b, b.where(F.col(ORDER) % 3 > 0)], parts=5, cell=4).collect() == ordered
    plan = linkage.edges(a, b)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [x for x in plan.split("\n\n") if ") Exchange" in x]
    assert exchanges and not [x for x in exchanges if "p_ord#" in x and "s_ord#" in x]


@pytest.mark.parametrize("name", ["documents_round_trip", "json_source_projection"])
def test_rows_of_a_small_file_are_dealt_out(spark, name):
    """Work on the rows of a table that is one split is shared by all cores."""
    from fieldmark.plans import catalog

    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
