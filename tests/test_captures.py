"""Listing cards, captures of many pages, and rows of sources that no query reads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldmark.schema import ORDER
from fieldmark.sources import cards, paged, readers, registry


def render(node):
    if isinstance(node, str):
        return node
    tag, classes, attrs, inside = node
    extra = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return f'<{tag} class="{" ".join(classes)}"{extra}>' + "".join(map(render, inside)) + f"</{tag}>"


def elements(node):
    """The element and all elements in it, in document order."""
    if not isinstance(node, str):
        yield node
        for x in node[3]:
            yield from elements(x)


def picked(card):
    out = {}
    for name, cls, attribute in cards.PARTS:
        values = [e[2].get(attribute, "") for e in elements(card) if cls in e[1]] if attribute else texts(card, cls)
        out[name] = values[0].strip() if values else ""
    return out


def texts(card, cls):
    """Texts that stand directly in an element of the class, in document order."""
    found = []

    def walk(e):
        for x in e[3]:
            if isinstance(x, str):
                if cls in e[1]:
                    found.append(x)
            else:
                walk(x)

    walk(card)
    return found


def random_page(rng, depth=0):
    classes = [c for c in ("result", "business-name", "categories", "street-address", "phones", "track-visit-website", "count", "resulting", "x") if rng.random() < 0.16]
    attrs = {"href": f" /v{rng.randrange(99)} "} if rng.random() < 0.5 else {}
    inside = []
    for _ in range(rng.randrange(4)):
        if inside and isinstance(inside[-1], str) or rng.random() < 0.6:
            inside.append(random_page(rng, depth + 1) if depth < 6 else ("b", [], {}, []))
        else:
            inside.append(rng.choice([" Acme ", "x &amp; y", "  ", "5 stars"]))
    return (rng.choice(["div", "span", "a", "section"]), classes, attrs, inside)


def plain(card):
    return {k: v.replace("&amp;", "&") for k, v in card.items()}


def test_cards_of_random_pages():
    rng = random.Random(2)
    found = 0
    for _ in range(400):
        page = ("html", [], {}, [random_page(rng) for _ in range(4)])
        expected = [plain(picked(e)) for e in elements(page) if "result" in e[1]]
        found += len(expected)
        assert cards.read_cards(render(page)) == expected
    assert found > 300


PAGE = """<!DOCTYPE html><html><body><script>var x = '<div class="result"><a class="business-name">no</a></div>';</script>
<div class="search-results"><div class="other"><span class="phones">none</span></div>
<div class="v-card result sponsored"><p class="count">(12)<p class="phones">408-555-0100<br><img src=x>
 <div class="info"><h2><a class="business-name" href="/x">Blue <b>Broom</b></a></h2><div class="categories">Cleaning, <a>Windows</a></div></div>
 <!-- x --><a class="track-visit-website" href="https://blue.test">Site</a><div class="street-address">1 Main</div><div class="result-rating">4.5</div>
 <div class='result'><a class=business-name>Inner</a></div></div>
<div class="result"><div class="phones"><b>hidden</b></div></div></div></body></html>"""


def test_card_records(spark):
    pages = spark.createDataFrame([(1, "https://d.test/2", PAGE), (0, "https://d.test/1", None), (2, "https://d.test/3", "")], f"{ORDER} long, url string, html string")
    rows = cards.card_records(pages).orderBy(ORDER).collect()
    assert [(r["name"], r["category"], r["address"], r["phone"], r["website"], r["rating"], r["source_url"], r["country"], r["city"]) for r in rows] == [
        ("Blue", "Cleaning,", "1 Main", "408-555-0100", "https://blue.test", 4.5, "https://d.test/2", "USA", ""), ("Inner", "", "", "", "", None, "https://d.test/2", "USA", ""), ("", "", "", "", "", None, "https://d.test/2", "USA", ""),
    ]


@pytest.fixture
def capture(tmp_path):
    """Ten pages, the ninth empty; page 10 is never asked for."""
    sizes = [3, 1, 4, 1, 5, 9, 2, 6, 0, 7]
    for k, n in enumerate(sizes, 1):
        (tmp_path / f"page-{k}.json").write_text(json.dumps([{"title": f"p{k} {j}", "k": k} for j in range(n)]))
    return tmp_path, sizes


def serial(sizes, limit, max_pages):
    out, page = [], 0
    while page < len(sizes):
        page += 1
        out += [f"p{page} {j}" for j in range(sizes[page - 1])]
        if not paged.follows(page, sizes[page - 1], len(out), limit, max_pages):
            break
    return (out if limit is None else out[:limit]), page


@pytest.mark.parametrize("limit, max_pages", [(None, None), (8, None), (1, None), (23, 20), (None, 3), (100, 9), (25, 10)])
def test_pages_as_a_serial_reader_gets_them(spark, capture, limit, max_pages):
    path, sizes = capture
    expected, pages = serial(sizes, limit, max_pages)
    rows = paged.read_pages(spark, str(path), limit=limit, max_pages=max_pages)
    assert [r["title"] for r in rows.orderBy(ORDER).collect()] == expected
    assert len(paged.asked_pages(spark, str(path), limit, max_pages)) == pages


def test_pages_are_read_in_waves(spark, capture, monkeypatch):
    path, _ = capture
    read, real = [], paged._texts
    monkeypatch.setattr(paged, "_texts", lambda spark, files: (read.append(len(files)), real(spark, files))[1])
    assert len(paged.asked_pages(spark, str(path), limit=2)) == 1 and read == [4]
    read.clear()
    assert len(paged.asked_pages(spark, str(path))) == 9 and read == [4, 6]
    rows = paged.read_pages(spark, str(path))
    assert rows.rdd.getNumPartitions() > 1


def test_odd_captures(spark, tmp_path):
    assert paged.read_pages(spark, str(tmp_path / "none")).count() == 0
    for k, text in ((1, '[{"title": "a b"}]'), (2, "no json"), (3, '[{"title": "c"}]'), (5, "[]")):
        (tmp_path / f"a b+{k}.json").write_text(text)
    assert [r["title"] for r in paged.read_pages(spark, str(tmp_path)).collect()] == ["a b"]
    (tmp_path / "a b+2.json").write_text('[{"title": "b"}]')
    assert [r["title"] for r in paged.read_pages(spark, str(tmp_path)).orderBy(ORDER).collect()] == ["a b", "b", "c"]


def test_actors_give_a_bounded_number_of_items(spark, tmp_path):
    r = registry.default_registry()
    (tmp_path / "page-1.json").write_text(json.dumps([{"title": f"n{k}" if k != 1 else "", "street": "1 A"} for k in range(150)]))
    (tmp_path / "page-2.json").write_text(json.dumps([{"title": f"m{k}", "totalScore": 4.5} for k in range(150)]))
    rows = r.read(spark, "google-apify", {"pages": str(tmp_path)}).orderBy(ORDER).collect()
    assert len(rows) == 199 and rows[-1]["name"] == "m49" and rows[-1]["rating"] == 4.5
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.json").write_text(json.dumps([{"title": f"n{k}"} for k in range(250)]))
    assert r.read(spark, "google-apify", {"path": str(tmp_path / "one")}).count() == 200
    assert r.read(spark, "google-apify", {"path": str(tmp_path / "one"), "limit": 5}).count() == 5


def test_providers_are_dentists_unless_asked(spark, tmp_path):
    entry = lambda n, what: {"number": f"100000000{n}", "basic": {"organization_name": f"O{n}", "first_name": "", "middle_name": "", "last_name": ""}, "addresses": [{"address_purpose": "LOCATION", "city": "RENO", "state": "NV", "address_1": "1 A", "telephone_number": "775-555-0100", "postal_code": "8", "country_name": "US"}], "taxonomies": [{"desc": what, "primary": True, "license": "L", "state": "NV"}]}
    (tmp_path / "p.json").write_text(json.dumps([entry(0, "Dentist, General Practice"), entry(1, "Physician")]))
    read = lambda **o: [x["category"] for x in registry.default_registry().read(spark, "nppes", {"path": str(tmp_path / "p.json"), "state": "NV", **o}).collect()]
    assert read() == ["Dentist, General Practice"] and read(category="physician") == ["Physician"]
    with pytest.raises(ValueError, match="state"):
        read(state="")


def test_text_search_and_listing_search(spark):
    google = spark.createDataFrame([(0, "A", "1 Main St, San Jose, CA 95112, USA", 4.5, 12, "p1", ["point_of_interest", "dentist"]), (1, "", "", None, None, "p2", None)], f"{ORDER} long, name string, formatted_address string, rating double, user_ratings_total long, place_id string, types array<string>")
    rows = readers.google_records(google, F.lit("2026-01-01").cast("timestamp")).orderBy(ORDER).collect()
    assert (rows[0]["name"], rows[0]["city"], rows[0]["state"], rows[0]["postal_code"], rows[0]["rating"], rows[0]["category"]) == ("A", "San Jose", "CA", "95112", 4.5, "Dentist")
