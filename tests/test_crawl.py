"""Crawls level by level against a plain queue, robots rules and outcomes."""

import random
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import crawl
from fieldmark.schema import ORDER, as_records

RESPONSES = "url string, status int, final_url string, body string, error array<string>"


def page(*links):
    return "<html>" + "".join(f'<p><a class="x" href="{href}">{label}</a></p>' for href, label in links) + "</html>"


def origin(url):
    m = re.match(r"(?i)https?://[^/?#]+", url or "")
    return m[0].lower() if m else ""


def queue(home, web, most=4):
    """Visits (url, status) of one home page by a plain queue."""
    pending, visited, out, read = [home], set(), [], 0
    while pending and read < most:
        url = pending.pop(0)
        if url in visited:
            continue
        visited.add(url)
        status, final, links = web.get(url, ("network_error", None, []))
        if status == "success" and origin(final or url) != origin(home):
            status = "redirect_blocked"
        out.append((url, status))
        if status != "success":
            if not read:
                break
            continue
        read += 1
        for href, label in links:
            target = urljoin(url, href.strip().replace("&amp;", "&"))
            if origin(target) == origin(home) and any(w in f"{label.lower()} {urlparse(target).path.lower()}" for w in ("contact", "about", "team", "staff", "people")):
                target = target.split("#", 1)[0]
                if target not in visited and target not in pending:
                    pending.append(target)
    return out


def captured(spark, web):
    rows = [(url, 200 if status == "success" else 404 if status == "http_error" else None, final, page(*links), None if status in ("success", "http_error") else [f"{ERRORS[status]}: no"]) for url, (status, final, links) in web.items()]
    return spark.createDataFrame(rows, RESPONSES)


ERRORS = {"timeout": "ReadTimeout", "connection_error": "ConnectError", "network_error": "ReadError"}


def visits(found):
    out = {}
    for r in found.visits.orderBy("home", "n").collect():
        out.setdefault(r["home"], []).append((r["url"], r["status"]))
    return out


def test_queue_keeps_the_place_of_the_linking_page(spark):
    web = {
        "https://s.test/": ("success", None, [("/about", "a"), ("/team", "t")]), "https://s.test/about": ("success", None, [("/x", "x"), ("/y", "y"), ("/contact-c", "c")]),
        "https://s.test/team": ("success", None, [("/people-d", "d")]), "https://s.test/contact-c": ("success", None, []), "https://s.test/people-d": ("success", None, []),
    }
    found = crawl.crawl(spark.createDataFrame([("https://s.test/",), (" https://s.test/ ",)], "website string"), captured(spark, web), robots=False)
    assert visits(found) == {"https://s.test/": queue("https://s.test/", web)} and visits(found)["https://s.test/"][-1][0].endswith("contact-c")
    assert [(r["n"], r["url"]) for r in found.pages().orderBy("n").collect()] == [(k + 1, u) for k, (u, _) in enumerate(queue("https://s.test/", web))]


@pytest.mark.parametrize("most", [1, 2, 4, 7])
def test_random_sites(spark, most):
    rng = random.Random(most)
    words = ["about", "team", "x", "staff/me", "people", "contact", "../team/", "./about?a=1", "?team=2", "q/../contact#f", "//s{k}.test/staff", "http://other.test/about", "mailto:team@x", "#about", "", "/Team;p", "/a//b/about", "https://S{k}.test/about"]
    web, homes = {}, []
    for k in range(25):
        home = f"https://s{k}.test" + rng.choice(["", "/", "/d/index.html", "/d/"])
        homes.append(home)
        known = [home]
        for _ in range(12):
            url = known.pop(rng.randrange(len(known))) if known else None
            if url is None or url in web:
                continue
            links = [(rng.choice(words).replace("{k}", str(k)), rng.choice(["Us", "Our TEAM", "x", "Contact  us"])) for _ in range(rng.randrange(6))]
            status = "success" if url == home or rng.random() < 0.7 else rng.choice(["http_error", "timeout", "connection_error"])
            web[url] = (status, rng.choice([None, None, url, "https://else.test/"]) if url != home else None, links)
            known += [urljoin(url, h).split("#")[0] for h, _ in links if urljoin(url, h).startswith("http")]
    found = crawl.crawl(spark.createDataFrame([(h,) for h in homes], "website string"), captured(spark, web), most, robots=False)
    assert visits(found) == {h: queue(h, web, most) for h in homes}
    read = {r["home"]: (r["status"], r["pages_read"]) for r in found.outcomes.collect()}
    assert read == {h: (q[0][1], sum(s == "success" for _, s in q)) for h in homes for q in [queue(h, web, most)]}


def test_resolved_links(spark):
    bases = ["https://a.test", "https://a.test/", "https://a.test/x/y.html?q=1#f", "http://A.test/x/y/", "https://a.test?z=1"]
    hrefs = ["", "#t", "?p=1", "about", "/about", "../about", "../../../about", "./a/./b/../c/", "//b.test/x", "//b.test", "http://b.test/c?d#e", "a//b", "/a//b", "..", ".", "a?x=../y", "/..", "x/..", "/a/b/../..", "q?"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    found = {(r["b"], r["h"]): r["x"] for r in df.select("b", "h", crawl.resolve(F.col("b"), F.col("h")).alias("x")).collect()}
    assert {k: v for k, v in found.items() if v != urljoin(*k).split("#", 1)[0]} == {}
    gone = spark.createDataFrame([("mailto:a@b",), ("javascript:x",), ("tel:1",), ("ftp://x/y",)], "h string")
    assert {r[0] for r in gone.select(crawl.resolve(F.lit("https://a.test"), F.col("h"))).collect()} == {None}


def test_every_outcome(spark):
    made = {
        "success": (200, None), "timeout": (None, ["ConnectTimeout: slow", "gaierror: x"]), "http_error": (503, None), "tls_error": (None, ["ConnectError: bad", "SSLCertVerificationError: x"]), "dns_error": (None, ["ConnectError: bad", "gaierror: x"]),
        "connection_error": (None, ["ConnectError: refused", "OSError: x"]), "network_error": (None, ["ReadError: reset"]),
    }
    rows = [(f"https://{k.replace('_', '-')}.test", s, None, "", e) for k, (s, e) in made.items()] + [("https://redirect-blocked.test", 200, "https://else.test/", "", None), ("https://robots-denied.test", 200, None, "", None)]
    rows += [(f"{r[0]}/robots.txt", 200, None, "User-agent: *\nDisallow: /" if "denied" in r[0] else "", None) for r in rows] + [("https://robots-unavailable.test", 200, None, "", None)]
    names = [*made, "redirect_blocked", "robots_denied", "robots_unavailable"]
    records = as_records(spark.createDataFrame([(k, n, n.replace("_", "-") + ".test") for k, n in enumerate(names)] + [(20, "invalid_url", "ftp://x.test"), (21, "none", "")], f"{ORDER} long, name string, website string"), {"name": F.col("name"), "website": F.col("website")})
    found = crawl.crawl(records, spark.createDataFrame(rows, RESPONSES))
    details = crawl.audit(records, found)
    assert {r["name"]: r["status"] for r in details.collect()} == {n: n for n in crawl.OUTCOMES}
    assert {r["name"]: r["pages_read"] for r in details.collect()} == {n: int(n == "success") for n in crawl.OUTCOMES}
    assert {r["status"]: r["n"] for r in crawl.outcome_counts(details).collect()} == dict.fromkeys(crawl.OUTCOMES, 1)
    assert crawl.outcome_note(details.where("name in ('timeout', 'success')")) == " Crawl outcomes: 1 success, 1 timeout." and crawl.outcome_note(details.where("false")) == ""
    certificate = spark.createDataFrame([(["ConnectError: certificate verify failed: x"],)], "e array<string>")
    assert certificate.select(crawl.failure(F.lit(None).cast("int"), F.col("e"))).first()[0] == "tls_error"


def test_failed_robots_file_bars_with_its_failure(spark):
    rows = [("https://a.test", 200, None, "", None), ("https://a.test/robots.txt", 404, None, "", None)]
    assert crawl.crawl(spark.createDataFrame([("a.test",)], "website string"), spark.createDataFrame(rows, RESPONSES)).outcomes.first().asDict() == {"home": "https://a.test", "status": "http_error", "pages_read": 0}


FILES = {
    "plain": "User-agent: *\nDisallow: /private\nAllow: /private/ok\n", "longer": "User-agent: *\nAllow: /private/ok\nDisallow: /private", "empty": "", "open": "User-agent: *\nDisallow:\nDisallow: /", "named": "User-agent: other\nDisallow: /\n\nUser-agent: FieldMark\nDisallow: /private\n\nUser-agent: *\nDisallow: /",
    "together": "User-agent: a\nUser-agent: fieldmark\nDisallow: /private\nUser-agent: *\nAllow: /", "blank": "User-agent: fieldmark\n\nDisallow: /", "comment": "# all\nUser-agent: * # us\n# x\nDisallow: /private # y\r\nDisallow: /b", "delay": "User-agent: fieldmark\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /", "orphan": "Disallow: /\nUser-agent: *\nDisallow: /b",
    "encoded": "User-agent: *\nDisallow: /priv%61te", "query": "User-agent: *\nDisallow: /?private", "star": "User-agent: *\nDisallow: *", "two": "User-agent: *\nDisallow: /b\n\nUser-agent: *\nDisallow: /private",
}


def test_robots_rules_like_the_standard_parser(spark):
    from urllib.robotparser import RobotFileParser

    paths = ["", "/", "/private", "/private/ok", "/private/ok/x", "/b", "/?private=1", "/other", "?private"]
    files = spark.createDataFrame([(f"https://{k}.test", t) for k, t in FILES.items()], "origin string, text string")
    homes = spark.createDataFrame([(f"https://{k}.test{p}", f"https://{k}.test") for k in FILES for p in paths], "home string, origin string")
    found = {r["home"]: r["allowed"] for r in crawl.robots_allow(homes, crawl.robots_rules(files)).collect()}
    expected = {}
    for k, text in FILES.items():
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        expected |= {f"https://{k}.test{p}": parser.can_fetch("fieldmark", f"https://{k}.test{p}") for p in paths if p != "?private"}
    assert {u: a for u, a in found.items() if u in expected and a != expected[u]} == {}


def test_robots_longest_rule(spark):
    files = spark.createDataFrame([(f"https://{k}.test", t) for k, t in FILES.items() if k in ("plain", "longer", "open")], "origin string, text string")
    homes = spark.createDataFrame([(f"https://{k}.test{p}", f"https://{k}.test") for k in ("plain", "longer", "open") for p in ("/private/ok", "/private", "/")], "home string, origin string")
    found = {r["home"]: r["allowed"] for r in crawl.robots_allow(homes, crawl.robots_rules(files), "longest").collect()}
    assert found == {f"https://{k}.test{p}": a for k, three in {"plain": (True, False, True), "longer": (True, False, True), "open": (False, False, False)}.items() for p, a in zip(("/private/ok", "/private", "/"), three, strict=True)}
