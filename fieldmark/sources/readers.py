"""Readers: every source becomes full records with an order column.  Captured files stand for live services."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import FIELDS, ORDER, as_records, claim

# Types that say nothing about a business, and addresses of public registries.
GENERIC_TYPES = ("point_of_interest", "establishment", "store", "food", "health", "finance", "local_government_office", "political", "sublocality", "sublocality_level_1", "geocode")
NPI_URL = "https://npiregistry.cms.hhs.gov/provider-view/"
WA_VERIFY_URL = "https://secure.lni.wa.gov/verify/Detail.aspx?LIC="
GOOGLE_SEARCH_URL = "https://maps.googleapis.com/maps/api/place/textsearch/json"
LICENSE_REQUIRED = ("license_number", "licensee_name", "license_status", "evidence_url", "observed_at")
LICENSE_COLUMNS = ("license_number", "licensee_name", "license_type", "license_status", "expiration_date", "address", "city", "state", "zip", "evidence_url", "observed_at")


def with_order(df: DataFrame) -> DataFrame:
    """Adds _ord, 0, 1, 2, ...: rows of files by path, then by place in the file.

    Scans pack files by size, so rows are counted per file block first; the counts (a row for each block) give each
    block its first number.  Rows that come from no file, or have gone through a join or an aggregate since, have no such order: an error.
    """
    nth = F.monotonically_increasing_id().alias("__nth")
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), nth)
    except AnalysisException as e:
        raise ValueError("Input order is that of files: number the rows of a scan.") from e
    blocks = placed.groupBy("__file", "__block").agg(F.min("__nth").alias("__least"), F.count("*").alias("__rows"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select(F.col("__file").alias("__f"), F.col("__block").alias("__b"), (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__least")).alias("__first"))
    out = placed.join(first, (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return out.withColumn(ORDER, F.col("__first") + F.col("__nth")).drop("__file", "__block", "__nth", "__f", "__b", "__first")


def _text(c: Column) -> Column:
    return tx.strip(F.coalesce(c.cast("string"), F.lit("")))


def _first_text(*options: Column) -> Column:
    """The first option that is not blank, stripped, or ''."""
    return F.coalesce(*[F.nullif(_text(o), F.lit("")) for o in options], F.lit(""))


def _col(df: DataFrame, name: str) -> Column:
    """The column, or an empty one where the file has none."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _nested(df: DataFrame, path: str) -> Column:
    """A nested field, or null where the schema has none."""
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return F.lit(None).cast("string")
        kind = kind[part].dataType
    return F.col(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text by header name; BOM removed, quotes doubled, ragged rows allowed, unnamed columns dropped."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8", inferSchema=False)
    names = [n.lstrip("﻿").strip() for n in raw.columns]
    seen: set[str] = set()
    keep = []
    for k, n in enumerate(names):
        if n and not n.startswith("_c") and n not in seen:
            seen.add(n)
            keep.append((raw.columns[k], n))
    return with_order(raw).select(*[F.col(f"`{a}`").alias(b) for a, b in keep], ORDER)


def csv_records(df: DataFrame) -> DataFrame:
    """Records of a client's CSV columns; 'name' is read only where there is no 'business_name' column."""
    own = [c for c in df.columns if c != ORDER]
    named = "business_name" if "business_name" in df.columns else "name"
    fields = {c: _col(df, c) for c in ("category", "address", "city", "state", "phone", "email", "website", "source_url")}
    fields |= {"name": _col(df, named), "postal_code": _col(df, "zip"), "rating": tx.to_float(_col(df, "rating")), "review_count": tx.to_int(_col(df, "reviews"))}
    fields |= {"source": F.lit("csv"), "observed_at": tx.to_timestamp(_col(df, "observed_at")), "raw_data": F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))}
    return as_records(df, fields)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_records(read_csv_text(spark, path))


def license_records(df: DataFrame, source: str = "ca-dental-board", line: Column | None = None) -> DataFrame:
    """Records of reviewed license rows; a missing column is an error here, a missing cell when the row is read."""
    missing = sorted(set(LICENSE_REQUIRED) - set(df.columns))
    if missing:
        raise ValueError("License evidence is missing required columns: " + ", ".join(missing))
    v = {c: _text(_col(df, c)) for c in LICENSE_COLUMNS}
    number = (line if line is not None else F.col(ORDER) + 2).cast("string")
    gone = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(v[c] == "", F.lit(c)) for c in LICENSE_REQUIRED]))), ", ")
    at = tx.to_timestamp(v["observed_at"])
    wrong = F.when(gone != "", F.concat(F.lit("License evidence row "), number, F.lit(" is missing: "), gone)).when(at.isNull(), F.concat(F.lit("License evidence row "), number, F.lit(": observed_at is no time.")))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(v["license_number"])
    made = [claim(f"registry.ca_dental_board.{k}", v[c], "string", source, v["license_number"], v["evidence_url"], at, "manual_board_evidence_import", "official_registry") for k, c in (("license_number", "license_number"), ("license_status", "license_status"), ("license_type", "license_type"), ("expiration_date", "expiration_date"))]
    fields = {
        "name": v["licensee_name"], "category": _first_text(v["license_type"], F.lit("Dentist")), "address": v["address"], "city": v["city"], "state": _first_text(v["state"], F.lit("CA")), "postal_code": v["zip"],
        "country": F.lit("US"), "source": F.lit(source), "source_url": v["evidence_url"], "observed_at": at, "claims": F.filter(F.array(*made), lambda c: c["value"]["s"] != ""),
        "source_ids": F.create_map(F.lit("ca_dental_license"), checked), "raw_data": F.to_json(F.struct(*[F.nullif(v[c], F.lit("")).alias(c) for c in LICENSE_COLUMNS])),
    }
    return as_records(df, fields)


def nppes_records(df: DataFrame, observed_at: Column) -> DataFrame:
    """Records of national provider entries; rows without name, address, city, state or phone are left out."""
    org = _text(_nested(df, "basic.organization_name"))
    person = F.concat_ws(" ", *[F.nullif(_text(_nested(df, f"basic.{c}")), F.lit("")) for c in ("first_name", "middle_name", "last_name")])
    place = F.try_element_at(F.filter("addresses", lambda a: a["address_purpose"] == "LOCATION"), F.lit(1))
    taxonomy = F.try_element_at(F.filter("taxonomies", lambda t: F.coalesce(t["primary"].cast("boolean"), F.lit(False))), F.lit(1))
    rows = df.select("*", place.alias("__place"), taxonomy.alias("__tax"))
    part = lambda c: _text(F.col(f"__place.{c}"))
    tax = lambda c: _text(F.col(f"__tax.{c}"))
    number, url = _text(F.col("number")), F.concat(F.lit(NPI_URL), _text(F.col("number")))
    state = F.upper(tax("state"))
    made = [
        claim("registry.nppes.npi", number, "string", "nppes", number, url, observed_at, authority="official_registry"),
        claim("registry.nppes.license_number", tax("license"), "string", "nppes", number, url, observed_at, authority="source_observation"),
        claim("registry.nppes.license_state", state, "string", "nppes", number, url, observed_at, authority="source_observation"),
    ]
    dentist = (tax("license") != "") & (state == "CA") & F.contains(F.lower(tax("desc")), F.lit("dentist"))
    ids = F.when(dentist, F.create_map(F.lit("npi"), number, F.lit("ca_dental_license"), tax("license"))).otherwise(F.create_map(F.lit("npi"), number))
    fields = {
        "name": F.when(org != "", org).otherwise(person), "category": tax("desc"), "address": part("address_1"), "city": part("city"), "state": part("state"), "postal_code": part("postal_code"), "country": part("country_name"),
        "phone": part("telephone_number"), "source": F.lit("nppes"), "source_url": url, "observed_at": observed_at, "claims": F.filter(F.array(*made), lambda c: c["value"]["s"] != ""), "source_ids": ids, "raw_data": F.to_json(F.struct(*df.columns)),
    }
    out = as_records(rows, fields)
    return out.where(" and ".join(f"{c} <> ''" for c in ("name", "address", "city", "state", "phone")))


def in_scope(city: str = "", state: str = "", category: str = "") -> Column:
    """City and state equal without case, category contained; an empty argument asks nothing."""
    tests = [F.lower(c) == v.lower() for c, v in (("city", city), ("state", state)) if v]
    tests += [F.contains(F.lower("category"), F.lit(category.lower()))] if category else []
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def contractor_scope(types: list[str], statuses: list[str], city: str, limit: int | None = None) -> tuple[Column, int]:
    """The registry query as a predicate that a scan can push down, and its row limit (1 to 250, 100 by default)."""
    import re

    for code in [*types, *statuses]:
        if not re.fullmatch(r"[A-Z0-9 -]+", code):
            raise ValueError("Registry codes hold capitals, digits, spaces and hyphens.")
    limit = 100 if limit is None else limit
    if not 1 <= limit <= 250:
        raise ValueError("limit must be between 1 and 250.")
    test = F.col("contractorlicensetypecode").isin(types) & F.upper("contractorlicensestatus").isin(statuses)
    return (test & (F.upper("city") == city.upper()) if city else test), limit


def contractor_records(df: DataFrame, observed_at: Column, source: str = "wa-li") -> DataFrame:
    v = lambda c: _text(_col(df, c))
    number, url = v("contractorlicensenumber"), F.concat(F.lit(WA_VERIFY_URL), v("contractorlicensenumber"))
    named = (("license_number", "contractorlicensenumber"), ("license_status", "contractorlicensestatus"), ("license_type", "contractorlicensetypecodedesc"), ("license_effective_date", "licenseeffectivedate"), ("license_expiration_date", "licenseexpirationdate"))
    made = [claim(f"registry.wa_li.{k}", v(c), "string", source, number, url, observed_at, authority="official_registry") for k, c in named]
    kept = [c for c in ("businessname", "contractorlicensenumber", "contractorlicensetypecode", "contractorlicensetypecodedesc", "contractorlicensestatus", "address1", "address2", "city", "state", "zip", "phonenumber", "licenseeffectivedate", "licenseexpirationdate") if c in df.columns]
    fields = {
        "name": v("businessname"), "category": v("contractorlicensetypecodedesc"), "address": F.concat_ws(" ", F.nullif(v("address1"), F.lit("")), F.nullif(v("address2"), F.lit(""))), "city": v("city"), "state": v("state"), "postal_code": v("zip"),
        "country": F.lit("US"), "phone": v("phonenumber"), "source": F.lit(source), "source_url": url, "observed_at": observed_at, "claims": F.filter(F.array(*made), lambda c: c["value"]["s"] != ""),
        "source_ids": F.create_map(F.lit("wa_li_contractor_license"), number), "raw_data": F.to_json(F.struct(*kept)),
    }
    return as_records(df, fields).where("name <> '' and address <> '' and city <> '' and state <> '' and source_ids['wa_li_contractor_license'] <> ''")


def google_records(df: DataFrame, scraped_at: Column, limit: int | None = None) -> DataFrame:
    """Text search results; the category is the first type that says something."""
    kind = F.try_element_at(F.filter("types", lambda t: ~t.isin(*GENERIC_TYPES)), F.lit(1))
    rows = (df.orderBy(ORDER).limit(limit or 10)).withColumn("__a", tx.us_address(F.col("formatted_address")))
    fields = {c: F.col(f"__a.{c}") for c in ("address", "city", "state", "postal_code", "country")}
    fields |= {"name": F.col("name"), "category": F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), "rating": F.col("rating").cast("double"), "review_count": F.col("user_ratings_total").cast("long"), "source": F.lit("google"), "source_url": F.lit(GOOGLE_SEARCH_URL), "scraped_at": scraped_at, "raw_data": F.to_json(F.struct(*df.columns))}
    return as_records(rows, fields)


def google_actor_records(df: DataFrame, scraped_at: Column) -> DataFrame:
    named = {"name": "title", "category": "categoryName", "address": "street", "city": "city", "state": "state", "postal_code": "postalCode", "country": "countryCode", "phone": "phone", "website": "website", "source_url": "url"}
    fields = {k: _col(df, c) for k, c in named.items()}
    fields |= {"rating": _col(df, "totalScore").cast("double"), "review_count": _col(df, "reviewsCount").cast("long"), "source": F.lit("google-apify"), "scraped_at": scraped_at, "raw_data": F.to_json(F.struct(*[c for c in df.columns if c != ORDER]))}
    return as_records(df, fields).where("name <> ''")


def yelp_records(df: DataFrame, scraped_at: Column, limit: int | None = None) -> DataFrame:
    rows = df.orderBy(ORDER).limit(min(limit or 50, 50))
    fields = {"name": F.col("name"), "category": F.try_element_at("categories", F.lit(1))["title"], "address": F.col("location.address1"), "city": F.col("location.city"), "state": F.col("location.state"), "postal_code": F.col("location.zip_code"), "country": F.col("location.country")}
    fields |= {"phone": F.col("display_phone"), "rating": F.col("rating").cast("double"), "review_count": F.col("review_count").cast("long"), "source": F.lit("yelp"), "source_url": F.col("url"), "scraped_at": scraped_at, "raw_data": F.to_json(F.struct(*[c for c in df.columns if c != ORDER]))}
    return as_records(rows, fields)


def yelp_actor_records(df: DataFrame, scraped_at: Column, json: str = "json") -> DataFrame:
    """Items as JSON text, whose fields differ in kind: location or address structs, categories as strings or structs."""
    df, v = df.withColumn("__item", F.try_parse_json(json)), F.col("__item")

    def text(path: str) -> Column:
        """A string at the path, stripped; anything else is ''."""
        return F.when(F.schema_of_variant(F.variant_get(v, path, "variant")) == "STRING", tx.strip(F.try_variant_get(v, path, "string"))).otherwise("")

    def number(path: str, kind: str) -> Column:
        plain = F.schema_of_variant(F.variant_get(v, path, "variant")) != "BOOLEAN"
        return F.when(F.coalesce(plain, F.lit(False)), F.try_variant_get(v, path, kind))

    nested = F.coalesce(F.startswith(F.schema_of_variant(F.variant_get(v, "$.location", "variant")), F.lit("OBJECT")), F.lit(False))
    either = lambda a, b: F.when(nested, _first_text(text(f"$.location.{a}"), text(f"$.location.{b}"))).otherwise(_first_text(text(f"$.address.{a}"), text(f"$.address.{b}")))
    fields = {"name": text("$.name"), "category": _first_text(text("$.categories[0]"), text("$.categories[0].title")), "address": either("address1", "street"), "city": either("city", "city"), "state": either("state", "region"), "postal_code": either("zipCode", "postalCode"), "country": either("country", "country")}
    fields |= {"phone": text("$.phone"), "website": text("$.website"), "rating": number("$.rating", "double"), "review_count": number("$.reviewCount", "long"), "source": F.lit("yelp-apify"), "source_url": text("$.url"), "scraped_at": scraped_at, "raw_data": F.col(json)}
    return as_records(df, fields).where("name <> ''")


def profile_url_ok(c: Column) -> Column:
    """A public profile address: https, the site itself or www, a path under /in/."""
    return F.coalesce(c.rlike(r"^https://(?i:(www\.)?linkedin\.com)/in/"), F.lit(False))


def profile_urls(urls: list[str], limit: int | None = None) -> list[str]:
    """The explicit profile list of a run: 1 to 100 public addresses, the first `limit` of them."""
    import re

    if not isinstance(urls, list) or not urls:
        raise ValueError("A profile run names its addresses in profile_urls.")
    if len(urls) > 100:
        raise ValueError("At most 100 profile URLs per run.")
    urls = urls[:limit] if limit is not None and limit < len(urls) else urls
    for u in urls:
        if not re.match(r"https://(?i:(www\.)?linkedin\.com)/in/", str(u).strip()):
            raise ValueError(f"No public profile address: {u}")
    return [u.strip() for u in urls]


def profile_records(df: DataFrame, observed_at: Column, source: str = "linkedin-apify") -> DataFrame:
    options = [_text(_col(df, c)) for c in ("profileUrl", "profile_url", "url")]
    url = F.coalesce(*[F.when(profile_url_ok(o), o) for o in options], F.lit(""))
    name, headline = _first_text(_col(df, "fullName"), _col(df, "name")), _text(_col(df, "headline"))
    made = claim("social.linkedin.profile_url", url, "string", source, url, url, observed_at, "apify_public_profile_actor", "source_observation")
    fields = {"name": name, "category": headline, "linkedin": url, "source": F.lit(source), "source_url": url, "observed_at": observed_at, "claims": F.array(made), "source_ids": F.create_map(F.lit("linkedin_profile_url"), url), "raw_data": F.to_json(F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(headline, F.lit("")).alias("headline")))}
    return as_records(df, fields).where("name <> '' and linkedin <> ''")


def place_records(df: DataFrame, reference: str, release: str, retrieved_at: Column, source: str = "overture") -> DataFrame:
    """Records of a places snapshot; a row without id or name is an error when read."""
    field = lambda p: _nested(df, p)
    rid, name = _text(field("id")), _first_text(field("names.primary"), field("name"))
    fail = lambda c, what: F.when(c == "", F.raise_error(F.concat(F.lit(f"A snapshot row has no {what}: row "), F.col(ORDER).cast("string"))).cast("string")).otherwise(c)
    address = F.try_element_at("addresses", F.lit(1)) if "addresses" in df.columns else None
    kinds = df.schema["addresses"].dataType.elementType.fieldNames() if address is not None else []
    part = lambda *names: _first_text(*[address[n] for n in names if n in kinds], F.lit("")) if address is not None else F.lit("")
    listed = lambda c: F.coalesce(F.try_element_at(F.filter(F.transform(c, tx.strip), lambda x: F.coalesce(x != "", F.lit(False))), F.lit(1)), F.lit("")) if c in df.columns else F.lit("")
    url, made = F.lit(reference), []
    confidence = _nested(df, "confidence").cast("double")
    for key, value, kind in (("id", rid, "string"), ("release", F.lit(release), "string"), ("confidence", confidence, "number")):
        made.append(F.when(value.isNotNull(), claim(f"candidate.overture.{key}", value, kind, source, rid, url, retrieved_at, "offline_geoparquet_snapshot", "source_observation")))
    fields = {
        "name": fail(name, "name"), "category": _first_text(*[field(p) for p in ("taxonomy.primary", "basic_category", "categories.primary", "category")]), "address": part("freeform", "address"), "city": part("locality", "city"), "state": part("region", "state"),
        "postal_code": part("postcode", "postal_code"), "country": part("country"), "phone": listed("phones"), "website": listed("websites"), "source": F.lit(source), "source_url": url, "observed_at": retrieved_at, "claims": F.array_compact(F.array(*made)),
        "source_ids": F.create_map(F.lit("overture_id"), fail(rid, "id")),
    }
    return as_records(df, fields)


def imported_records(df: DataFrame) -> DataFrame:
    """Records of a saved table: known flat fields that are not empty; a registry address tells source and id."""
    from .documents import recovered

    nested = ("discovery_sources", "quality_reasons", "field_provenance", "claims", "source_ids", "raw_data")
    fields = {c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns if c in FIELDS and c not in nested}
    for c in ("scraped_at", "observed_at"):
        if c in fields:
            fields[c] = tx.to_timestamp(F.col(c))
    for c, number in (("rating", tx.to_float), ("review_count", tx.to_int)):
        if c in fields:
            fields[c] = number(F.col(c))
    return as_records(df, recovered(fields, {"source"}))


def with_source(df: DataFrame, source: str | None) -> DataFrame:
    """Records that name no source get this one."""
    return df if not source else df.withColumn("source", F.when(F.col("source") == "", source).otherwise(F.col("source")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A saved result, CSV or a JSON list of objects."""
    if path.endswith(".csv"):
        return imported_records(read_csv_text(spark, path))
    if path.endswith(".json"):
        from .documents import read_documents

        return read_documents(spark, path)
    raise ValueError("Only .csv and .json results can be imported.")
