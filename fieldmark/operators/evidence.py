"""Evidence from pages (url, html): visible text, ownership, longevity, closure, contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Phrases and patterns of the evidence rules.
INDEPENDENT = {"family owned": "family_owned", "family-owned": "family_owned", "independently owned": "independently_owned", "independent practice": "independent_practice", "locally owned": "locally_owned"}
CORPORATE = {"dental support organization": "dental_support_organization", "corporate office": "corporate_office", "nationwide network": "nationwide_network", "locations nationwide": "locations_nationwide"}
FOUNDED = r"(?iu)\b(?:founded|established|since)\s+(?:in\s+)?((?:18|19|20)\d{2})\b"
OPENED = r"(?iud)\bopened\b.{0,80}?\b(?:office|practice|business)\b.{0,30}?\b(?:in\s+)?((?:18|19|20)\d{2})\b"
SERVING = r"(?iud)\b(?:serving|served)\b.{0,80}?\b(?:for\s+)?(?:over|more than)?\s*(\d{1,3})\+?\s+years\b"
CLOSED = r"(?iud)\b(?:office|practice|business)\b.{0,40}?\b(?:officially|permanently)\s+closed\b|\bretired\b.{0,120}?\b(?:office|practice|business)\b.{0,40}?\bclosed\b"
SOCIALS = {"linkedin": r"(?i)linkedin\.com/company/[\w\-\.]+", "instagram": r"(?i)instagram\.com/[\w\.]+", "facebook": r"(?i)facebook\.com/[\w\.\-]+", "twitter": r"(?i)(?:twitter|x)\.com/[\w]+"}
_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"


@F.pandas_udf(T.StringType())
def visible_text(pages):
    """Text outside tags, comments, scripts and styles; pieces stripped and joined by one space."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.hidden:
                self.hidden -= 1

        def handle_data(self, data):
            if not self.hidden and data.strip():
                self.parts.append(data.strip())

    def read(html):
        if html is None:
            return None
        reader = Reader()
        reader.feed(html)
        reader.close()
        return " ".join(reader.parts)

    return pages.map(read, na_action="ignore")


def quick_text(html: Column) -> Column:
    """Visible text by patterns alone, inside the JVM: for pages whose entities are the five of XML and &nbsp;."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return tx.collapse(t)


def ownership(text: Column) -> Column:
    """struct(value, signal) of the first phrase found when all found agree, else null."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.struct(F.lit(value).alias("value"), F.lit(signal).alias("signal"))) for value, phrases in (("likely_independent", INDEPENDENT), ("likely_corporate", CORPORATE)) for p, signal in phrases.items()]))
    return F.when(F.size(F.array_distinct(F.transform(found, lambda x: x["value"]))) == 1, found[0])


def ownership_of_pages(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per record: the first match in page order when no page speaks for the other side."""
    low = F.lower(F.col("text"))
    options = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.struct(F.lit(k).alias("k"), F.lit(value).alias("value"), F.lit(signal).alias("signal"))) for k, (value, p, signal) in enumerate((v, p, s) for v, d in (("likely_independent", INDEPENDENT), ("likely_corporate", CORPORATE)) for p, s in d.items())]))
    hits = pages.select(*keys, order, "url", F.explode(options).alias("m"))
    per = hits.groupBy(*keys).agg(F.min(F.struct(order, F.col("m.k").alias("k"), F.col("m.value").alias("value"), F.col("m.signal").alias("signal"), F.col("url").alias("url"))).alias("first"), F.count_distinct("m.value").alias("sides"))
    return per.where("sides = 1").select(*keys, F.col("first.value").alias("value"), F.col("first.signal").alias("signal"), F.col("first.url").alias("url"))


def longevity(text: Column, as_of_year: int) -> Column:
    """struct(years, signal) of the longest evidence, the first on ties; null without any."""

    def years_since(pattern: str, name: str) -> Column:
        years = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda y: y.cast("int"))
        return F.transform(F.filter(years, lambda y: (y >= 1800) & (y <= as_of_year)), lambda y: F.struct((F.lit(as_of_year) - y).alias("years"), F.concat(F.lit(f"{name}:"), y).alias("signal")))

    served = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SERVING), 1), lambda y: y.cast("int")), lambda y: (y >= 1) & (y <= 200))
    all_found = F.concat(years_since(FOUNDED, "founded_year"), years_since(OPENED, "opened_year"), F.transform(served, lambda y: F.struct(y.alias("years"), F.concat(F.lit("years_serving:"), y).alias("signal"))))
    placed = F.transform(all_found, lambda x, i: F.struct(x["years"].alias("years"), (-i).alias("place"), x["signal"].alias("signal")))
    return F.when(F.size(all_found) > 0, F.array_max(placed))


def closed(text: Column) -> Column:
    return F.regexp_like(text, F.lit(CLOSED))


def anchors(html: Column) -> Column:
    """array of struct(href, label) in page order."""
    whole = F.regexp_extract_all(html, F.lit(_ANCHOR), 0)
    return F.filter(
        F.transform(whole, lambda a: F.struct(F.regexp_extract(a, _HREF, 1).alias("href"), tx.collapse(F.regexp_replace(F.regexp_extract(a, _ANCHOR, 2), "<[^>]*>", " ")).alias("label"))),
        lambda x: x["href"] != "",
    )


def _unquote(c: Column) -> Column:
    """Percent-decoded; '+' stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def contacts(html: Column) -> dict[str, Column]:
    """email, phone and four social addresses: the first of each in page order, or null."""
    hrefs = F.transform(anchors(html), lambda a: a["href"])

    def first(keep, value) -> Column:
        return F.try_element_at(F.transform(F.filter(hrefs, keep), value), F.lit(1))

    out = {
        "email": first(lambda h: F.lower(h).startswith("mailto:"), lambda h: _unquote(F.regexp_replace(F.substring(h, 8, 1 << 20), r"\?.*$", ""))),
        "phone": first(lambda h: F.lower(h).startswith("tel:"), lambda h: _unquote(F.substring(h, 5, 1 << 20))),
    }
    return out | {name: _social(hrefs, pattern) for name, pattern in SOCIALS.items()}


def _social(hrefs: Column, pattern: str) -> Column:
    found = F.filter(hrefs, lambda h: h.rlike(pattern))
    return F.try_element_at(F.transform(found, lambda h: tx.social_url(F.regexp_extract(h, pattern, 0))), F.lit(1))


def contacts_of_pages(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per record: each contact's first value in page order and, where pages have an url, the page it stands on (<contact>_url)."""
    place = ["url"] if "url" in pages.columns else []
    found = pages.select(*keys, order, *place, *[c.alias(n) for n, c in contacts(F.col("html")).items()])
    first = {c: F.when(tx.present(F.col(c)), F.col(order)) for c in ("email", "phone", *SOCIALS)}
    return found.groupBy(*keys).agg(*[F.min_by(c, at).alias(c) for c, at in first.items()], *[F.min_by("url", at).alias(f"{c}_url") for c, at in first.items() if place])


def needs_crawl() -> Column:
    """A website is known and one of phone, email and the four socials is missing."""
    return tx.present(F.col("website")) & reduce(lambda a, b: a | b, [tx.blank(F.col(c)) for c in ("phone", "email", *SOCIALS)])


def fill_contacts(df: DataFrame, found: DataFrame, key: str, url: Column | None = None, observed_at: Column | None = None, names: tuple[str, ...] = ("email", "phone", *SOCIALS)) -> DataFrame:
    """Blank contacts among names filled from found, with provenance; new emails and phones are not_checked.

    The evidence is the page that a contact stands on, where found tells it, else url or the record's site.
    """
    placed = [c for c in names if f"{c}_url" in found.columns]
    got = found.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in names], *[F.col(f"{c}_url").alias(f"__{c}_url") for c in placed])
    out = df.join(got, F.col(key) == F.col("__k"), "left")
    fills = {c: needs_crawl() & tx.blank(F.col(c)) & tx.present(F.col(f"__{c}")) for c in names}
    made = {c: F.when(fills[c], F.col(f"__{c}")).otherwise(F.col(c)) for c in names}
    for c in ("email", "phone"):
        if c in names and f"{c}_status" in df.columns:
            made[f"{c}_status"] = F.when(fills[c], "not_checked").otherwise(F.col(f"{c}_status"))
    if "field_provenance" in df.columns:
        place = url if url is not None else tx.site_url(F.col("website"))
        at = observed_at if observed_at is not None else F.current_timestamp()
        page = {c: F.coalesce(f"__{c}_url", place) if c in placed else place for c in names}
        entry = [F.when(fills[c], F.struct(F.lit(c).alias("key"), F.struct(F.lit("first_party_web").alias("source"), page[c].alias("evidence_url"), at.alias("observed_at"), F.lit("public_link").alias("method")).alias("value"))) for c in names]
        added = F.map_from_entries(F.array_compact(F.array(*entry)))
        made["field_provenance"] = F.map_concat(F.map_filter("field_provenance", lambda k, _: ~F.map_contains_key(added, k)), added)
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in df.columns])
