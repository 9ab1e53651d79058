"""Whole records out and in again."""

import json

import pytest
from pyspark.sql import functions as F

from fieldmark.schema import ORDER, as_records, claim
from fieldmark.sources import documents, readers
from fieldmark.sources.folder import Folder

def rows(spark):
    at = F.lit("2026-01-02 03:04:05.678").cast("timestamp")
    df = spark.range(6, numPartitions=3).withColumnRenamed("id", ORDER)
    made = lambda key, value, kind: claim(key, value, kind, "s", F.lit("r1"), F.lit("https://e.test"), at)
    claims = F.array(made("t", F.lit("12"), "string"), made("n", F.lit(12), "number"), made("f", F.lit(0.5), "number"), made("b", F.lit(True), "boolean"), made("z", F.lit(None), "null"), made("q", F.lit('say "é" \n'), "string"))
    provenance = F.map_from_arrays(F.array(F.lit("phone"), F.lit("email")), F.array(*[F.struct(F.lit("first_party_web").alias("source"), F.lit("https://p.test").alias("evidence_url"), at.alias("observed_at"), F.lit(m).alias("method")) for m in ("public_link", "x")]))
    odd = F.col(ORDER) % 2 == 1
    fields = {
        "name": F.concat(F.lit("N "), ORDER), "rating": F.when(odd, F.lit(4.5)), "review_count": F.when(odd, F.lit(7)), "observed_at": F.when(odd, at), "scraped_at": F.lit("2026-01-02 00:00:00").cast("timestamp"), "claims": F.when(odd, claims), "field_provenance": F.when(odd, provenance),
        "source_ids": F.when(odd, F.create_map(F.lit("npi"), F.lit("1"), F.lit("a"), F.lit("2"))), "discovery_sources": F.when(odd, F.array(F.lit("x"), F.lit("y"))), "quality_reasons": F.array(F.lit("q")), "raw_data": F.lit("{}"), "source": F.lit("csv"),
    }
    return as_records(df, fields)


def test_export_import_export(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}")
    first = documents.write_documents(rows(spark), folder, "a.json")
    again = readers.read_records(spark, first)
    documents.write_documents(again, folder, "b.json")
    assert folder.read("a.json") == folder.read("b.json")
    data = json.loads(folder.read("a.json"))
    assert [r["name"] for r in data] == [f"N {k}" for k in range(6)] and "raw_data" not in data[0]
    assert [c["value"] for c in data[1]["claims"]] == ["12", 12, 0.5, True, None, 'say "é" \n'] and data[0]["claims"] == []
    assert data[1]["observed_at"] == "2026-01-02T03:04:05.678000+00:00" and data[1]["scraped_at"] == "2026-01-02T00:00:00+00:00" and data[0]["observed_at"] is None
    assert list(data[1]["field_provenance"]) == ["email", "phone"] and data[1]["field_provenance"]["phone"]["method"] == "public_link" and data[1]["source_ids"] == {"a": "2", "npi": "1"}
    a, b = (sorted((r.asDict(True) for r in x.drop("raw_data", ORDER).collect()), key=lambda r: r["name"]) for x in (rows(spark), again))
    assert a == b


@pytest.mark.parametrize(
    "text, message",
    [
        ('{"name": "x"}', "list"), ("[1]", "list"), ("no", "list"), ("[", "list"), ('[{"claims": [{"key": "k", "value": 1, "source": "s", "source_record_id": "", "evidence_url": "u", "method": "m"}]}]', "lacks"),
        ('[{"claims": [{"key": "k", "value": {"a": 1}, "source": "s", "source_record_id": "r", "evidence_url": "u", "method": "m"}]}]', "value"),
    ],
)
def test_bad_documents(spark, tmp_path, text, message):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match=message):
        readers.read_records(spark, str(tmp_path / "x.json")).collect()
    with pytest.raises(ValueError, match="csv and .json"):
        readers.read_records(spark, "x.txt")


NPI = "https://npiregistry.cms.hhs.gov/provider-view/1234567890"


def test_imported_registry_addresses(spark, tmp_path):
    made = [{"name": "A", "source_url": NPI}, {"name": "B", "source_url": NPI.upper() + "/x", "source": "own", "source_ids": {"x": "1"}, "unknown": 1, "phone": ""}, {"name": "C", "source_url": NPI + "1"}, {"name": "D", "rating": 4, "review_count": "12", "observed_at": "2026-01-01T00:00:00+00:00"}]
    (tmp_path / "x.json").write_text(json.dumps(made))
    found = readers.read_records(spark, str(tmp_path / "x.json")).orderBy(ORDER).collect()
    assert [(r["source"], r["discovery_sources"], r["source_ids"]) for r in found] == [("nppes", ["nppes"], {"npi": "1234567890"}), ("own", ["nppes"], {"x": "1"}), ("", [], {}), ("", [], {})]
    assert (found[3]["rating"], found[3]["review_count"], found[3]["observed_at"].year) == (4.0, 12, 2026)
    (tmp_path / "x.csv").write_text(f"name,source_url,source,rating,odd\nA,{NPI},,4.5,1\nB,{NPI}?y,own,,\n")
    found = readers.read_records(spark, str(tmp_path / "x.csv")).orderBy(ORDER).collect()
    assert [(r["name"], r["source"], r["source_ids"], r["rating"]) for r in found] == [("A", "nppes", {"npi": "1234567890"}, 4.5), ("B", "own", {"npi": "1234567890"}, None)]
