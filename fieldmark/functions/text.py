"""Cleaning, normalizing and matching forms of contact fields, as column expressions.

Empty text stands for a missing value throughout; null is taken as missing where a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WS = r"(?U)\s+"
_WRAPPING = "[](){}<>\"'"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
_FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)$"
_INT = r"^[+-]?\d+$"
_ISO = r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Null or empty."""
    return F.coalesce(c, F.lit("")) == ""


def present(c: Column) -> Column:
    return ~blank(c)


def collapse(c: Column) -> Column:
    """Stripped, with every run of white space as one space; null becomes ''."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), _WS, " ")


def to_float(c: Column) -> Column:
    """A number where the text is one (nan and inf are), else null."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(_FLOAT), t.try_cast("double"))


def to_int(c: Column) -> Column:
    """An integer once commas are gone, else null."""
    t = strip(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    return F.when(t.rlike(_INT), t.try_cast("bigint"))


def to_timestamp(c: Column) -> Column:
    """ISO date or time, else null; without an offset it is UTC (the session's zone)."""
    t = strip(c.cast("string"))
    basic = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    return F.when(t.rlike(_ISO), basic.try_cast("timestamp"))


# The functions below name their argument once each: nested, they stay as small as they read.
def clean_email(c: Column) -> Column:
    """Lower case, or '' where the form is no address."""
    return F.regexp_extract(F.lower(strip(F.coalesce(c, F.lit("")))), EMAIL, 0)


def _host(c: Column) -> Column:
    """What stands between the scheme, if any, and the first of / ? #."""
    return F.regexp_extract(c, r"^(?:https?://)?([^/?#]*)", 1)


def clean_website(c: Column) -> Column:
    """Host without wrapping characters and without any 'www.'; '' where it has square brackets of one kind only."""
    bare = F.btrim(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit(_WRAPPING))
    paired = F.regexp_replace(_host(bare), r"^[^\[]*\][^\[]*$|^[^\]]*\[[^\]]*$", "")
    return F.replace(paired, F.lit("www."), F.lit(""))


def normalize_website(c: Column) -> Column:
    """Host without square brackets, one leading 'www.' and closing slashes."""
    t = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "[]", "")
    return F.regexp_replace(F.regexp_replace(_host(t), r"^www\.", ""), "/+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{Nd}]", "")


def clean_phone(c: Column) -> Column:
    """Digits, or '' for fewer than seven."""
    return F.regexp_extract(digits(c), r"^\p{Nd}{7,}$", 0)


normalize_phone = clean_phone


def normalize_email(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def email_status(raw: Column, cleaned: Column) -> Column:
    return F.when(blank(raw), "not_found").when(cleaned != "", "syntax_valid").otherwise("unknown")


def phone_status(raw: Column, cleaned: Column) -> Column:
    return F.when(blank(raw), "not_found").when(cleaned != "", "format_valid").otherwise("invalid")


@F.pandas_udf(T.StringType())
def _nfkc(values):
    import unicodedata

    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_text(c: Column, nfkc: bool = True) -> Column:
    """Compatibility-composed, stripped, spaces collapsed; null becomes ''.

    Spark has no Unicode normalization, so text beyond ASCII passes an Arrow function (other rows send it a null);
    nfkc=False leaves it out.
    """
    t = F.coalesce(c, F.lit(""))
    beyond = F.when(t.rlike(r"[^\x00-\x7F]"), t)
    return collapse(F.coalesce(_nfkc(beyond), t)) if nfkc else collapse(t)


def normalize_address(c: Column) -> Column:
    return collapse(c)


def match_phone(c: Column) -> Column:
    """Digits, without the leading 1 of eleven."""
    return F.regexp_replace(digits(c), r"^1(\p{Nd}{10})$", "$1")


def match_website(c: Column) -> Column:
    """Lower case without closing slashes, scheme and one leading 'www.'; the path stays."""
    t = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), "/+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^https://", ""), "^http://", ""), r"^www\.", "")


def match_text(c: Column) -> Column:
    """Lower case with dots as spaces, collapsed."""
    return collapse(F.translate(F.lower(F.coalesce(c, F.lit(""))), ".", " "))


def fuzzy_name(c: Column) -> Column:
    """Lower case without dots and without the words llc, inc, ltd."""
    words = F.split(collapse(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("."), F.lit(""))), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("llc", "inc", "ltd")), " ")


def identity_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), _WS, " ")


def social_url(c: Column) -> Column:
    """A bare match as an https://www. address; one with a scheme stays."""
    return F.when(c.rlike(r"(?i)^[a-z]+:"), c).otherwise(F.concat(F.lit("https://www."), c))


def site_url(c: Column) -> Column:
    """A site as an address with scheme and without a fragment."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").otherwise(F.regexp_replace(F.when(t.rlike(r"(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t)), "#.*$", ""))


def origin(c: Column) -> Column:
    """Scheme and host, lower case; '' where there is none."""
    return F.lower(F.regexp_extract(c, r"(?i)^(https?://[^/?#]+)", 1))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def search_url(base: str, terms: Column, place: Column, page: Column) -> Column:
    """A search address; the page is named from the second on."""
    url = F.concat(F.lit(f"{base}/search?search_terms="), F.url_encode(terms), F.lit("&geo_location_terms="), F.url_encode(place))
    return F.when(page >= 2, F.concat(url, F.lit("&page="), page.cast("string"))).otherwise(url)


def follow_next_page(found: Column, seen: Column, limit: Column, page: Column, max_pages: Column) -> Column:
    """Whether another page is to be read: this one had results and no bound is reached (null: no bound)."""
    return (found > 0) & F.coalesce(seen < limit, F.lit(True)) & F.coalesce(page < max_pages, F.lit(True))


def us_address(c: Column) -> Column:
    """struct(address, city, state, postal_code, country) of 'street, city, ST zip, country' and its short forms."""
    p = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    full, short = F.size(p) == 4, F.size(p) == 3
    words = F.split(F.when(full, F.get(p, F.lit(2))).when(short, F.get(p, F.lit(1))).otherwise(""), _WS)
    return F.struct(
        F.when(full, F.get(p, F.lit(0))).when(short, "").otherwise(F.coalesce(c, F.lit(""))).alias("address"),
        F.when(full, F.get(p, F.lit(1))).when(short, F.get(p, F.lit(0))).otherwise("").alias("city"),
        F.when(full | short, F.get(words, F.lit(0))).otherwise("").alias("state"),
        F.when(full | short, F.coalesce(F.get(words, F.lit(1)), F.lit(""))).otherwise("").alias("postal_code"),
        F.when(full, F.get(p, F.lit(3))).when(short, F.get(p, F.lit(2))).otherwise("").alias("country"),
    )


#: Normal form of each field that has one, by field (postal code, social addresses and urls have none).
NORMALIZERS = {"name": normalize_text, "category": normalize_text, "address": normalize_address, "city": normalize_text, "state": normalize_text, "country": normalize_text, "phone": normalize_phone, "email": normalize_email, "website": normalize_website}


def register_normalizer(field: str, function) -> None:
    NORMALIZERS[field] = function
