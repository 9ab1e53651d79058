"""Record identity, snapshot differences and versioned history in Parquet."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..schema import VOLATILE
from ..sources.folder import Folder

# What identifies a record, first complete one wins.
IDENTITIES = (("name", "address", "phone"), ("name", "address", "website"), ("name", "city", "state", "phone"), ("name", "city", "state", "website"), ("name", "source_url"))


def stable_id(columns: set[str] | None = None) -> Column:
    """'biz_' and 24 hex digits of the first identity whose values are all there; null without one."""
    options = []
    for fields in IDENTITIES:
        if columns is not None and not set(fields) <= columns:
            continue
        values = [tx.identity_text(F.col(f)) for f in fields]
        complete = reduce(lambda a, b: a & b, [v != "" for v in values])
        options.append(F.when(complete, F.concat_ws(chr(31), *values)))
    return F.concat(F.lit("biz_"), F.substring(F.sha2(F.coalesce(*options), 256), 1, 24))


def snapshot(df: DataFrame) -> DataFrame:
    """record_id, the comparable fields sorted by name, and their hash; a row without an id is an error when read."""
    fields = sorted(c for c in df.columns if c not in VOLATILE and not c.startswith("_") and c != "record_id")
    rid = stable_id(set(df.columns))
    rid = F.coalesce(rid, F.raise_error(F.lit("A history record has no stable identity.")).cast("string"))
    packed = F.to_json(F.struct(*[F.col(f).alias(f) for f in fields]), {"ignoreNullFields": "false"})
    return df.select(rid.alias("record_id"), *fields, F.sha2(packed, 256).alias("content_hash"))


def assert_unique(df: DataFrame, key: str = "record_id") -> None:
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("History records must have unique identities.")


def diff(previous: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """(record_id, change, changed): new, missing, updated with the sorted names of changed fields, or unchanged.

    One full outer join on record_id; both sides shuffle on it once.
    """
    a = previous.select(F.col("record_id").alias("a_id"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = current.select(F.col("record_id").alias("b_id"), *[F.col(f).alias(f"b_{f}") for f in fields])
    j = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in sorted(fields)]))
    change = F.when(F.col("a_id").isNull(), "new").when(F.col("b_id").isNull(), "missing").when(F.size(names) > 0, "updated").otherwise("unchanged")
    out = j.select(F.coalesce("a_id", "b_id").alias("record_id"), change.alias("change"), names.alias("names"))
    return out.select("record_id", "change", F.when(F.col("change") == "updated", F.col("names")).otherwise(F.array().cast("array<string>")).alias("changed"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "unchanged", "missing")])


def versions(runs: DataFrame) -> DataFrame:
    """runs(run_id, recorded_at, record_id, content_hash, ...) with first and last run of each record, from the versions alone.

    first_seen keeps the record's first run, also after it was missing; is_present says whether the latest
    run has it.
    """
    latest = runs.agg(F.max(F.struct("recorded_at", "run_id")).alias("m")).select(F.col("m.run_id").alias("latest_run"))
    at = F.struct("recorded_at", "run_id")
    per = runs.groupBy("record_id").agg(F.min_by("run_id", at).alias("first_seen_run_id"), F.max_by("run_id", at).alias("last_seen_run_id"), F.max_by("content_hash", at).alias("content_hash"), F.count("*").alias("versions"))
    return per.join(F.broadcast(latest)).withColumn("is_present", F.col("last_seen_run_id") == F.col("latest_run")).drop("latest_run")


def run_changes(runs: DataFrame) -> DataFrame:
    """(run_id, record_id, change) of every record in every run: against the run just before; a returning record is new."""
    order = runs.select("run_id", "recorded_at").distinct().withColumn("k", F.row_number().over(Window.orderBy("recorded_at", "run_id")))
    placed = runs.join(order.select("run_id", "k"), "run_id")
    w = Window.partitionBy("record_id").orderBy("k")
    seen = placed.withColumn("before", F.lag("k").over(w)).withColumn("hash_before", F.lag("content_hash").over(w)).withColumn("after", F.lead("k").over(w))
    kind = F.when(F.coalesce(F.col("before") != F.col("k") - 1, F.lit(True)), "new").when(F.col("hash_before") != F.col("content_hash"), "updated").otherwise("unchanged")
    here = seen.select("run_id", "record_id", kind.alias("change"))
    gone = seen.where(F.coalesce(F.col("after") != F.col("k") + 1, F.lit(True))).select((F.col("k") + 1).alias("k"), "record_id").join(order.select("run_id", "k"), "k").select("run_id", "record_id", F.lit("missing").alias("change"))
    return here.union(gone)


def list_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1.")
    out = runs.groupBy("run_id", "recorded_at").agg(F.count("*").alias("records")).orderBy(F.desc("recorded_at"), F.desc("run_id"))
    return out if limit is None else out.limit(limit)


def safe_name(text: str) -> str:
    """A path component of letters, digits, dots, underscores and hyphens."""
    name = re.sub(r"[^A-Za-z0-9._-]+", "-", text).strip(".-")
    if not name:
        raise ValueError("A job or run name needs a safe path character.")
    return name


class HistoryStore:
    """Versioned records of one job under a folder (any that Spark's readers open), a part for each run.

    A run's versions and changes are written to folders of their own; one small file, `latest.json`, names the parts of all runs and is
    replaced last and in one step, so a failed attempt leaves nothing that is read.  The current state is derived from the
    versions, so nothing is updated in place and a lost task only rewrites its own files.

    Inside a run, versions lie in buckets by a hash of the record id, sorted by it: looking one record up reads one bucket of each run.
    A recorded id cannot be used again, unless `overwrite` is set: then the new part takes the old one's place.
    """

    VERSION = 3

    def __init__(self, spark: SparkSession, path: str, job: str, buckets: int = 64, overwrite: bool = False):
        self.spark, self.folder, self.buckets, self.overwrite = spark, Folder(spark, f"{str(path).rstrip('/')}/{safe_name(job)}/v{self.VERSION}"), buckets, overwrite

    def _entries(self) -> list[dict]:
        """Of each run, oldest first: run_id, recorded_at, part, buckets, records and the fields of its versions."""
        return json.loads(self.folder.read("latest.json"))["runs"] if self.folder.exists("latest.json") else []

    def _paths(self, name: str, entries: list[dict]) -> list[str]:
        return [self.folder.at(f"{name}/{e['part']}") for e in entries]

    def _versions(self, entries: list[dict]) -> DataFrame:
        """Versions of runs; a field that a run did not have is null there."""
        if not entries:
            raise ValueError("The history has no run.")
        fields: dict[str, T.StructField] = {}
        for e in entries:
            for f in T.StructType.fromJson(e["fields"]):
                fields.setdefault(f.name, f)
        placed = [T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())]
        reader = self.spark.read.schema(T.StructType([*fields.values(), *placed])).option("basePath", self.folder.at("versions"))
        return reader.parquet(*self._paths("versions", entries)).drop("part")

    def record_run(self, run_id: str, recorded_at, records: DataFrame) -> DataFrame:
        """Writes the accepted records as a run and returns its changes against the run before."""
        rows = records.where("record_status = 'accepted'") if "record_status" in records.columns else records
        snap = snapshot(rows)
        assert_unique(snap)
        entries = self._entries()
        before = [e for e in entries if safe_name(e["run_id"]) == safe_name(run_id)]
        if before and not self.overwrite:
            raise ValueError(f"Run {run_id} is already recorded.")
        fields = [c for c in snap.columns if c not in ("record_id", "content_hash")]
        stamped = [F.lit(run_id).alias("run_id"), F.lit(recorded_at).cast("timestamp").alias("recorded_at")]
        entry = {"run_id": run_id, "part": f"part=run-{safe_name(run_id)}-{uuid.uuid4().hex[:12]}", "buckets": self.buckets}
        made = snap.select(*stamped, "*")
        entry["fields"] = made.schema.jsonValue()
        placed = made.withColumn("bucket", _bucket(F.col("record_id"), self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "record_id")
        placed.write.partitionBy("bucket").parquet(self.folder.at(f"versions/{entry['part']}"))
        written = self._versions([entry])
        if not entries:
            changes = written.select("record_id", F.lit("new").alias("change"), F.array().cast("array<string>").alias("changed"))
        else:
            old = self._versions(entries[-1:])
            changes = diff(old, written, [f for f in fields if f in old.columns])
        changes.select(*stamped, "*").write.parquet(self.folder.at(f"changes/{entry['part']}"))
        known = self.spark.range(1).select(F.date_format(stamped[1], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at")).first()["at"]
        entry |= {"recorded_at": known, "records": written.count()}
        kept = [e for e in entries if e not in before]
        self.folder.write("latest.json", json.dumps({"version": self.VERSION, "runs": sorted([*kept, entry], key=lambda e: (e["recorded_at"], e["run_id"]))}))
        for e in before:
            for name in ("versions", "changes"):
                self.folder.delete(f"{name}/{e['part']}")
        return self.changes(run_id)

    def latest(self) -> DataFrame:
        """The records of the latest run."""
        return self._versions(self._entries()[-1:]).drop("bucket")

    def runs(self, limit: int | None = None) -> DataFrame:
        """run_id, recorded_at and number of records of the runs, newest first."""
        if limit is not None and limit < 1:
            raise ValueError("limit must be at least 1.")
        rows = [(e["run_id"], e["recorded_at"], e["records"]) for e in self._entries()]
        out = self.spark.createDataFrame(rows, "run_id string, recorded_at string, records long").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
        out = out.orderBy(F.desc("recorded_at"), F.desc("run_id"))
        return out if limit is None else out.limit(limit)

    def changes(self, run_id: str) -> DataFrame:
        own = [e for e in self._entries() if e["run_id"] == run_id]
        if not own:
            raise ValueError(f"Run {run_id} is not recorded.")
        return self.spark.read.parquet(*self._paths("changes", own))

    def current(self) -> DataFrame:
        return versions(self._versions(self._entries()).drop("bucket"))

    def record_versions(self, record_id: str) -> DataFrame:
        """All versions of one record, oldest first; of each run only the record's bucket is read."""
        entries = self._entries()
        found = []
        for n in sorted({e["buckets"] for e in entries}):
            rows = self._versions([e for e in entries if e["buckets"] == n])
            found.append(rows.where((F.col("bucket") == _bucket(F.lit(record_id), n)) & (F.col("record_id") == record_id)).drop("bucket"))
        if not found:
            raise ValueError("The history has no run.")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).orderBy("recorded_at", "run_id")

    def record(self, record_id: str) -> DataFrame:
        """The record if the latest run has it: first and last run, its content and how many versions there are."""
        latest, own = self._entries()[-1]["run_id"], self.record_versions(record_id)
        at = F.struct("recorded_at", "run_id")
        rest = [c for c in own.columns if c not in ("record_id", "run_id", "recorded_at")]
        per = own.groupBy("record_id").agg(F.min_by("run_id", at).alias("first_seen_run_id"), F.max_by("run_id", at).alias("last_seen_run_id"), F.count("*").alias("versions"), *[F.max_by(c, at).alias(c) for c in rest])
        return per.where(F.col("last_seen_run_id") == latest)


def _bucket(record_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(buckets)).cast("int")
