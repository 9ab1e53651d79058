"""Preparing and reading reviewed Parquet snapshots of places."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import Folder

#: Rows of one file of a snapshot, so that a task can hash a file whole.
PART_ROWS = 250_000
ROOT = "dental_clinic"
REQUIRED = ("bbox", "id", "names", "taxonomy")
_MANIFEST = ("schema_version", "source", "release", "retrieved_at", "source_reference", "geography", "taxonomy_filters", "license", "attribution", "row_count", "sha256", "review_status")


def checked_paths(patterns: list[str]) -> list[str]:
    """Local Parquet paths that the patterns name, sorted; remote, blank and unmatched ones are errors."""
    import glob

    found: set[str] = set()
    for p in patterns:
        if not p.strip() or "\0" in p or "://" in p:
            raise ValueError("Snapshot inputs are local Parquet paths.")
        hits = glob.glob(p)
        if not hits:
            raise ValueError(f"No file matches {p}.")
        found |= set(hits)
    if any(Path(f).suffix not in (".parquet", ".geoparquet") for f in found):
        raise ValueError("Snapshot inputs must be .parquet or .geoparquet.")
    return sorted(found)


def checked_box(box) -> tuple[float, float, float, float]:
    """(west, south, east, north) in degrees, not across the antimeridian."""
    if len(box) != 4 or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in box):
        raise ValueError("A bounding box has four numbers.")
    w, s, e, n = map(float, box)
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError("A bounding box is west < east, south < north, in degrees.")
    return w, s, e, n


def checked_time(text: str) -> datetime.datetime:
    at = datetime.datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("A snapshot time needs an offset.")
    return at


def overlaps(box) -> Column:
    """Touches the box, borders included; plain comparisons on nested fields, which Parquet scans push down."""
    w, s, e, n = checked_box(box)
    return (F.col("bbox.xmax") >= w) & (F.col("bbox.xmin") <= e) & (F.col("bbox.ymax") >= s) & (F.col("bbox.ymin") <= n)


def in_taxonomy(root: str = ROOT) -> Column:
    return (F.col("taxonomy.primary") == root) | F.coalesce(F.array_contains("taxonomy.hierarchy", root), F.lit(False))


def in_localities(names: list[str]) -> Column:
    names = list(dict.fromkeys(n.casefold() for n in names))
    return F.lower(F.get("addresses", F.lit(0))["locality"]).isin(names)


def scope(df: DataFrame, box, root: str = ROOT, localities: list[str] | None = None) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError("Snapshot input is missing columns: " + ", ".join(missing))
    out = df.where(overlaps(box)).where(in_taxonomy(root))
    return out.where(in_localities(localities)) if localities else out


def gate(df: DataFrame) -> DataFrame:
    """One row: rows, blank ids, distinct ids."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("id").isNull() | (F.trim("id") == "")).alias("blank_ids"), F.count_distinct("id").alias("distinct_ids"))


def pass_gate(df: DataFrame) -> int:
    g = gate(df).first()
    if g["n_rows"] == 0:
        raise ValueError("The scope holds no row.")
    if g["blank_ids"]:
        raise ValueError("The scope holds a blank id.")
    if g["distinct_ids"] != g["n_rows"]:
        raise ValueError("The scope holds a duplicate id.")
    return g["n_rows"]


def license_inventory(df: DataFrame) -> DataFrame:
    """(license, dataset, provider, observations), most first; null is 'unknown'."""
    s = df.select(F.explode("sources").alias("s"))
    keys = [F.coalesce(F.col(f"s.{c}"), F.lit("unknown")).alias(c) for c in ("license", "dataset", "provider")]
    return s.select(*keys).groupBy("license", "dataset", "provider").agg(F.count("*").alias("observations")).orderBy(F.desc("observations"), "license", "dataset", "provider")


def parts_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and SHA-256 of a snapshot's files, each hashed in a task of its own; one row a file is collected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    each = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha256")).collect()
    return hashlib.sha256("".join(f"{r['name']} {r['sha256']}\n" for r in sorted(each)).encode()).hexdigest()


def prepare(spark: SparkSession, patterns: list[str], output: str, box, release: str, retrieved_at: str, reference: str, geography: str, localities: list[str] | None = None, root: str = ROOT, license: str | None = None, attribution: str | None = None, manifest: str | None = None) -> dict:
    """Writes the scope, ordered by id, as compressed Parquet with a manifest; nothing is overwritten, and both are there or neither.

    The parts are ranges of ids, sorted and of at most PART_ROWS rows, written side by side.  A snapshot counts as
    reviewed when its license and attribution are stated; else the inventory's are noted and it stays unreviewed.
    """
    if root != ROOT:
        raise ValueError(f"Only {ROOT} snapshots are prepared.")
    if not re.search(r"\.(geo)?parquet$", output, re.I):
        raise ValueError("A snapshot's name ends in .parquet or .geoparquet.")
    checked_time(retrieved_at)
    named = {"release": release, "reference": reference, "geography": geography} | {k: v for k, v in (("license", license), ("attribution", attribution)) if v is not None}
    if blank := [k for k, v in named.items() if not v.strip()]:
        raise ValueError("A snapshot states its " + ", ".join(blank) + ".")
    manifest, folder = manifest or f"{output}.manifest.json", Folder(spark, output.rsplit("/", 1)[0] if "/" in output else ".")
    folder.recover()
    inputs = checked_paths(patterns)
    if manifest == output or {output, manifest} & set(inputs):
        raise ValueError("A snapshot, its manifest and its inputs are different files.")
    if folder.exists(output) or folder.exists(manifest):
        raise FileExistsError(output)
    rows = scope(spark.read.parquet(*inputs), box, root, localities)
    n = pass_gate(rows)
    licenses = [r.asDict() for r in license_inventory(rows).collect()] if "sources" in rows.columns else []
    made = folder.at(f".{uuid.uuid4().hex}.snapshot")
    rows.orderBy("id").write.option("compression", "zstd").option("maxRecordsPerFile", PART_ROWS).parquet(made)
    w, s, e, north = checked_box(box)
    record = {
        "schema_version": 1, "source": "overture", "release": release, "retrieved_at": retrieved_at, "source_reference": reference, "geography": geography, "bbox": [w, s, e, north], "localities": localities or [], "taxonomy_filters": [root],
        "license": license or "; ".join(sorted({x["license"] for x in licenses})) or "unknown", "attribution": attribution or "; ".join(sorted({x["provider"] for x in licenses})) or "unknown",
        "row_count": n, "sha256": parts_hash(spark, made), "review_status": "reviewed" if license and attribution else "unreviewed", "license_inventory": licenses, "delivery_approved": False,
    }
    folder.publish([(made, output), (folder.make(manifest, json.dumps(record, indent=2, sort_keys=True)), manifest)], over=False)
    return record


def load_manifest(spark: SparkSession, path: str) -> dict:
    m = json.loads(Folder(spark, ".").read(path))
    missing = [k for k in _MANIFEST if k not in m]
    if missing:
        raise ValueError("Snapshot manifest is missing: " + ", ".join(missing))
    if m["schema_version"] != 1 or m["source"] != "overture":
        raise ValueError("Snapshot manifest has another version or source.")
    if m["review_status"] != "reviewed":
        raise ValueError("Snapshot is not reviewed.")
    checked_time(m["retrieved_at"])
    if not re.fullmatch(r"[0-9a-f]{64}", m["sha256"]):
        raise ValueError("Snapshot manifest has no SHA-256.")
    return m


def read_snapshot(spark: SparkSession, path: str, manifest_path: str | None = None) -> DataFrame:
    """Records of a reviewed snapshot whose hash and row count equal its manifest's."""
    from ..sources.readers import place_records, with_order

    m = load_manifest(spark, manifest_path or f"{path}.manifest.json")
    if parts_hash(spark, path) != m["sha256"]:
        raise ValueError("Snapshot differs from its manifest.")
    rows = spark.read.parquet(path)
    if rows.count() != m["row_count"]:
        raise ValueError("Snapshot has another number of rows than its manifest.")
    return place_records(with_order(rows), m["source_reference"], m["release"], F.lit(m["retrieved_at"]).cast("timestamp"))
