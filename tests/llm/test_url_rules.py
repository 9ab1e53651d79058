"""URL filters against plain readings of the rules and a plain count of all combinations."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest

from fieldmark.llm import url_rules

SCHEMA = "page_id long, url string, html string, host string, tokens string, verdict string, n long, item string"
URLS = [
    None, "", "x.net/a", "http://a.net/", "http://a.net", "http://a.net?x/", "HTTP://WWW.Example.NET/en/1?Q=1&b=2&&=3#top", "https://example.net/en/", "https://example.net/EN/", "https://myexample.net/en/x", "https://a.example.com/de/x?y#z",
    "https://example.com/de", "ftp://a.org/fr/", "http://org/fr/x", "http://borg/fr/x", "http://u:p@h.org:80/fr/", "a://b://c.net/", "http://É.NET/é", "http://x.net/a\nb?c\nd#e\nf", "http:///x", "://net/", "http://net", "http://cheap-pills.example.com/de/1", "http://x.com/" + "a/" * 20000,
]


def split(url):
    m = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[2]), m[3]) if m else ("", "")


def by_rules(host, path, rules=url_rules.RULES):
    best = None
    for text, says in rules:
        own, rest = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return best or (None, None)


def judged(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, "h", "x", "t", "v", 1, "i") for i, u in rows], SCHEMA)
    return sorted((tuple(r) for r in url_rules.judge(pages, **options).collect()), key=repr)


def test_hosts_paths_and_rules(spark):
    rows = [*enumerate(URLS), (3, "http://a.net/"), (None, "http://a.net/"), (None, None)]
    found = judged(spark, rows, confidence=2.0)
    expected = [(i, *split(u), *by_rules(*split(u))) for i, u in rows]
    assert found == sorted([(i, h, p, r, v or "allow") for i, h, p, r, v in expected], key=repr)
    assert judged(spark, []) == []


def tokens(url):
    """The parts of a well-formed test URL."""
    m = re.fullmatch(r"(\w+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?", url)
    host = m[2].split(".")
    words = re.split("[.-]", m[2]) if "-" in m[2] else []
    path = [re.sub("[0-9]+", "#", x) for x in m[3].split("/") if x]
    query = [x.split("=")[0] for x in (m[4] or "").split("&") if x]
    return sorted({f"scheme:{m[1]}", *(f"host:{x}" for x in host), *(f"word:{x}" for x in words), *(f"path:{x}" for x in path), *(f"query:{x}" for x in query), *(["fragment:"] if m[5] else [])})


def brute_rules(labelled, support, confidence):
    need = math.ceil(support * len(labelled))
    single = Counter(t for u, _ in labelled for t in tokens(u))
    total, own = Counter(), Counter()
    for u, v in labelled:
        held = [t for t in tokens(u) if single[t] >= need]
        for k in range(1, len(held) + 1):
            for part in combinations(held, k):
                total[part] += 1
                own[part, v] += 1
    return {(part, v): (n / total[part], n) for (part, v), n in own.items() if n >= need and n / total[part] >= confidence}, {t for t, n in single.items() if n >= need}


def brute_verdict(url, rules, frequent, default):
    held, best = [t for t in tokens(url) if t in frequent], None
    for k in range(1, len(held) + 1):
        for part in combinations(held, k):
            for v in ("allow", "block"):
                if (part, v) in rules:
                    best = max(best or (0, 0, ""), (*rules[part, v], v))
    return best[2] if best else default


def made(seed, n):
    rng = random.Random(seed)
    hosts = ["a.com", "b.com", "spam-a.com", "spam-b.org", "news.org", "shop.c.de"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['x', 'y', 'z'])}/{rng.randrange(99)}{rng.choice(['', '.html', '?q=1&p=2', '#t'])}" for _ in range(n)]
    return [(u, "block" if ("spam" in u) != (rng.random() < 0.1) else "allow") for u in urls]


@pytest.mark.parametrize("support, confidence", [(0.01, 0.8), (0.1, 0.6), (0.03, 0.95)])
def test_mined_rules(spark, support, confidence):
    labelled = made(1, 300)
    rules, frequent = brute_rules(labelled, support, confidence)
    open_ = [u for u, _ in made(2, 120)] + ["http://new.example/q", "gopher://a.com/x?zz=1"]
    taught = spark.createDataFrame(labelled, "url string, verdict string")
    found = judged(spark, list(enumerate(open_)), rules=(), support=support, confidence=confidence, labelled=taught)
    assert found == sorted([(i, *split(u), None, brute_verdict(u, rules, frequent, "allow")) for i, u in enumerate(open_)], key=repr)
    kept, vocabulary = url_rules.mine(taught.select(url_rules.tokens_of(taught["url"]).alias("tokens"), "verdict"), support, confidence)
    twins = {r["token"]: r["item"] for r in vocabulary.collect()}
    plain = {(tuple(sorted({twins[t] for t in part})), v): x for (part, v), x in rules.items()}
    for r in kept.collect():
        assert plain[tuple(r["antecedent"]), r["verdict"]] == (r["confidence"], r["support"]) and r["anchor"] in r["antecedent"]


def test_copies_of_a_long_url(spark):
    long = "http://a.com/" + "/".join(f"p{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(200))
    labelled = [(long, "block")] * 50 + made(3, 100)
    found = judged(spark, [(1, long), (2, "http://n.net/pa"), (3, "http://zz.zz/")], rules=(), labelled=spark.createDataFrame(labelled, "url string, verdict string"))
    assert [r[4] for r in found] == ["block", "block", "allow"]


def test_mining_bound(spark):
    """Beyond the bound only the most frequent items of a labelled URL are mined."""
    labelled = spark.createDataFrame([(["a", "b", "c"], "block")] * 3 + [(["a", "b"], "block")] * 3 + [(["a"], "block")], "tokens array<string>, verdict string")
    rules, _ = url_rules.mine(labelled, 0.1, 0.5, items=2)
    assert {tuple(r["antecedent"]) for r in rules.collect()} <= {("a",), ("b",)}


def test_rare_items_of_many(spark):
    """A URL's items beyond the most frequent ones count like the others, also those with both verdicts."""
    many = [f"i{k:02d}" for k in range(18)]
    rows = [([*many, "pure", "rare"], "block")] * 5 + [([x, "odd"], "allow") for x in many for _ in range(20)] + [(["rare"], "block")] * 13 + [(["rare", "odd"], "allow")] * 2 + [(["pure"], "block")] * 12
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules, _ = url_rules.mine(labelled, 0.04, 0.8)
    found = {(tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert found[("pure",), "block"] == (1.0, 17) and found[("rare",), "block"] == (18 / 20, 18) and found[("odd",), "allow"] == (1.0, 362)
