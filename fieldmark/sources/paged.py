"""Captures of many pages: pages are read side by side, in waves, until the pagination rule says stop."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ORDER
from .folder import Folder

_NUMBER = re.compile(r"(\d+)\D*$")


def follows(page: int, found: int, seen: int, limit: int | None, max_pages: int | None) -> bool:
    """Whether a page after this one is asked for: it had items, and neither the limit nor the number of pages is reached."""
    return found > 0 and (limit is None or seen < limit) and (max_pages is None or page < max_pages)


def page_files(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(page, file) of a capture's pages, by the last number in each file's name."""
    folder = Folder(spark, path)
    numbered = [(_NUMBER.search(name.rsplit(".", 1)[0]), name) for name, _ in folder.names() if not name.startswith((".", "_"))]
    return sorted((int(m[1]), folder.at(name)) for m, name in numbered if m)


def asked_pages(spark: SparkSession, path: str, limit: int | None = None, max_pages: int | None = None, first_wave: int = 4) -> list[str]:
    """The files of the pages that a reader going page by page would ask for.

    Each page is a JSON array.  A wave counts the items of its pages (one row a page comes to the driver), the rule is applied in page order, and
    the next wave, twice as large, begins only where the rule still follows: at most as many pages are read in vain as were
    needed, and four more.  A missing page number, or a page that is no array, ends the capture.
    """
    files, kept, seen, wave, at = page_files(spark, path), [], 0, first_wave, 0
    while at < len(files):
        batch = files[at : at + (wave if max_pages is None else min(wave, max(1, max_pages - at)))]
        counted = _texts(spark, [f for _, f in batch]).select(_name("file"), F.json_array_length("value").alias("n"))
        counts = {r["name"]: r["n"] or 0 for r in counted.collect()}
        for page, file in batch:
            if page != files[0][0] + len(kept):
                return kept
            found = counts[_last(file)]
            kept.append(file)
            seen += found
            if not follows(len(kept), found, seen, limit, max_pages):
                return kept
        at, wave = at + len(batch), 2 * wave
    return kept


def read_pages(spark: SparkSession, path: str, schema: T.StructType | None = None, limit: int | None = None, max_pages: int | None = None) -> DataFrame:
    """The items of the asked pages with _ord, in page order and then as in their page; the limit also cuts the last page's items.

    Without a schema it is inferred from the asked pages.
    """
    kept = asked_pages(spark, path, limit, max_pages)
    schema = schema or (spark.read.json(kept, multiLine=True).schema if kept else T.StructType())
    if not kept or not len(schema):
        return spark.createDataFrame([], schema.add(ORDER, "long"))
    places = F.create_map(*[F.lit(x) for k, f in enumerate(kept) for x in (_last(f), k)])
    items = _texts(spark, kept).select(_name("file"), F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("nth", "item")).where("item is not null")
    rows = items.select("item.*", (F.shiftleft(places[F.col("name")].cast("long"), 32) + F.col("nth")).alias(ORDER))
    return rows if limit is None else rows.orderBy(ORDER).limit(limit)


def _last(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _name(column: str):
    return F.url_decode(F.replace(F.substring_index(column, "/", -1), F.lit("+"), F.lit("%2B"))).alias("name")


def _texts(spark: SparkSession, files: list[str]) -> DataFrame:
    """(value, file): a page is one text, handled by the task that reads it."""
    return spark.read.text(files, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
