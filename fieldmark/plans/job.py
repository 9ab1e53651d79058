"""The job language: a YAML document is checked, planned into tasks, and compiled into one DataFrame chain.

Every setting is a row of RULES: where it stands, what it may be and what it is unless given.  A plan is
sources times places, in order; a task is read on its own, so a failed one is retried without the others.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import time
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts, crawl, dedup, delivery, enrichment, evidence, history, linkage, stateful
from ..schema import EXPORTABLE, ORDER
from ..sources.folder import Folder
from ..sources.registry import PolicyError, Registry, default_registry
from .dispatch import dispatch

_NEEDED = object()
# The providers that phone numbers can be checked with.
PHONE_PROVIDERS = ("twilio_lookup_basic",)


def _text(v, where):
    if not isinstance(v, str) or not v.strip():
        raise ValueError(f"Job {where}: a text is needed, not {v!r}.")
    return v


def _maybe_text(v, where):
    return "" if v is None else _text(v, where) if v != "" else ""


def _texts(v, where):
    if not isinstance(v, list) or any(not isinstance(x, str) or not x.strip() for x in v):
        raise ValueError(f"Job {where}: a list of texts is needed.")
    return list(v)


def _flag(v, where):
    if not isinstance(v, bool):
        raise ValueError(f"Job {where} must be true or false.")
    return v


def _count(most=None):
    def check(v, where):
        if v is None:
            return None
        if isinstance(v, bool) or not isinstance(v, int) or v < 1 or most is not None and v > most:
            raise ValueError(f"Job {where}: a whole number above 0 is needed" + (f", at most {most}." if most else "."))
        return v

    return check


def _money(v, where):
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0:
        raise ValueError(f"Job {where} must be a number of at least 0.")
    return float(v)


def _one_of(*options):
    def check(v, where):
        if v not in options:
            raise ValueError(f"Job {where} must be one of: " + ", ".join(options))
        return v

    return check


def _zero(v, where):
    if v != 0 or isinstance(v, bool):
        raise ValueError(f"Job {where} must be 0.")
    return 0


def _output_fields(v, where):
    unknown = [f for f in _texts(v, where) if f not in EXPORTABLE]
    if unknown:
        raise ValueError(f"Job {where} has unknown fields: " + ", ".join(unknown))
    return list(v)


#: (path, check, default)
RULES = (
    ("name", _text, _NEEDED), ("sources", _texts, _NEEDED), ("search.query", _text, _NEEDED), ("search.cities", _texts, []), ("search.states", _texts, []), ("search.radius_miles", _count(), None),
    ("output.format", _one_of("csv", "json"), "csv"), ("output.fields", _output_fields, _NEEDED), ("output.destination", _maybe_text, ""),
    ("processing.deduplicate", _flag, True), ("processing.fuzzy_deduplicate", _flag, False), ("processing.enrich", _flag, False),
    ("delivery.profile", _one_of("standard"), "standard"), ("delivery.include_non_accepted", _flag, False), ("delivery.include_sidecars", _flag, True), ("delivery.max_age_days", _count(), None),
    ("execution.mode", _one_of("delivery", "live_smoke"), "delivery"), ("execution.max_parallel_tasks", _count(8), 1),
    ("execution.live_smoke.max_tasks", _count(3), 1), ("execution.live_smoke.max_records_per_task", _count(25), 10), ("execution.live_smoke.max_attempts", _count(3), 2),
    ("execution.live_smoke.retry_backoff_seconds", _count(5), 1), ("execution.live_smoke.failure_threshold", _count(3), 2), ("execution.live_smoke.max_cost_usd", _zero, 0),
    ("limits.total_records", _count(), None), ("limits.per_source_records", _count(), None), ("limits.per_location_records", _count(), None),
    ("budget.max_total_usd", _money, 0.0), ("budget.approval_reference", _maybe_text, ""), ("verification.phone.provider", _maybe_text, ""),
    ("composition.primary_source", _maybe_text, ""), ("composition.supplemental_sources", _texts, []),
)


@dataclass(frozen=True)
class Job:
    """Checked settings by path, and the options of each source."""

    settings: dict
    options: dict = field(default_factory=dict)

    def __getitem__(self, path: str):
        return self.settings[path]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps({"settings": self.settings, "options": self.options}, sort_keys=True).encode()).hexdigest()


def parse(data: dict) -> Job:
    """A job from a parsed document; the first thing that is wrong is named."""
    if not isinstance(data, dict) or data.get("version") != 1:
        raise ValueError("Job version must be 1.")
    settings = {}
    for path, check, default in RULES:
        at = data
        parts = path.split(".")
        for k, part in enumerate(parts[:-1]):
            at = at.get(part, {}) or {}
            if not isinstance(at, dict):
                raise ValueError(f"Job {'.'.join(parts[: k + 1])} must be a mapping.")
        if parts[-1] in at:
            settings[path] = check(at[parts[-1]], path)
        elif default is _NEEDED:
            raise ValueError(f"Job {path} is required.")
        else:
            settings[path] = default
    if "limit" in data:
        if data.get("limits"):
            raise ValueError("Job limit and limits cannot both be given.")
        settings["limits.total_records"] = _count()(data["limit"], "limit")
    options = data.get("source_options", {}) or {}
    if not isinstance(options, dict) or any(not isinstance(v, dict) for v in options.values()):
        raise ValueError("Job source_options must map sources to mappings.")
    job = Job(settings, options)
    _check_together(job, data)
    return job


def _check_together(job: Job, data: dict) -> None:
    if not job["sources"]:
        raise ValueError("A job names at least one source.")
    primary, supplemental = job["composition.primary_source"], job["composition.supplemental_sources"]
    if data.get("composition"):
        if not primary or not supplemental:
            raise ValueError("Job composition needs a primary source and supplemental sources.")
        if {primary, *supplemental} - set(job["sources"]):
            raise ValueError("Composition takes only sources that are listed under sources.")
        if primary in supplemental or len(set(supplemental)) != len(supplemental):
            raise ValueError("Composition names a source once.")
        if not job["delivery.include_sidecars"]:
            raise ValueError("Composition is reported in sidecars: set delivery.include_sidecars.")
    for source, options in job.options.items():
        if options.get("enrich_details"):
            cap = options.get("max_enrich")
            if isinstance(cap, bool) or not isinstance(cap, int) or cap < 0:
                raise ValueError(f"Job source_options.{source}: enrich_details needs max_enrich, a whole number from 0.")
            if cap and (job["budget.max_total_usd"] <= 0 or not job["budget.approval_reference"]):
                raise ValueError("Paid enrichment requires budget.max_total_usd and budget.approval_reference.")
    if job["execution.mode"] == "live_smoke" and job["execution.max_parallel_tasks"] != 1:
        raise ValueError("A live_smoke job runs one task at a time: execution.max_parallel_tasks is 1.")
    if job["budget.approval_reference"] and job["budget.max_total_usd"] <= 0:
        raise ValueError("budget.approval_reference goes with a budget.max_total_usd above 0.")
    _check_verification(job, (data.get("verification") or {}).get("phone"))
    smoke = (data.get("execution") or {}).get("live_smoke")
    if (job["execution.mode"] == "live_smoke") != bool(smoke):
        raise ValueError("Job execution.live_smoke goes with execution.mode live_smoke.")


#: Settings that name where a phone provider's credentials are kept; one of these sets goes with a provider.
_PHONE_ACCOUNTS = (("credential_service", "api_key_account", "api_secret_account"), ("api_key_service", "api_secret_service"))


def _check_verification(job: Job, phone: dict | None) -> None:
    provider = job["verification.phone.provider"]
    if not provider:
        if phone:
            raise ValueError("verification.phone names its provider.")
        return
    if provider not in PHONE_PROVIDERS:
        raise ValueError(f"Unknown phone provider {provider}.")
    names = _PHONE_ACCOUNTS[0] if any(n in phone for n in _PHONE_ACCOUNTS[0]) else _PHONE_ACCOUNTS[1]
    for n in names:
        _text(phone.get(n), f"verification.phone.{n}")


def load(path: str) -> Job:
    import yaml

    return parse(yaml.safe_load(Path(path).read_text()))


@dataclass(frozen=True)
class Task:
    index: int
    source: str
    city: str
    state: str
    limit: int | None
    options: dict

    @property
    def place(self) -> str:
        return ", ".join(x for x in (self.city, self.state) if x)


def plan(job: Job) -> list[Task]:
    """Sources times places, cities before states; a job without a place has no task."""
    places = []
    for text in job["search.cities"]:
        city, _, state = text.partition(",")
        places.append((city.strip(), state.strip()))
    places += [("", s) for s in job["search.states"]]
    limit = job["execution.live_smoke.max_records_per_task"] if job["execution.mode"] == "live_smoke" else None
    return [Task(k, s, c, t, limit, job.options.get(s, {})) for k, (s, c, t) in enumerate((s, c, t) for s in job["sources"] for c, t in places)]


def preflight(job: Job, registry: Registry | None = None) -> dict:
    """What a run would do at most, without reading anything."""
    registry, tasks = registry or default_registry(), plan(job)
    attempts = job["execution.live_smoke.max_attempts"] if job["execution.mode"] == "live_smoke" else 1
    calls, spend, open_ended = 0, 0.0, []
    for s in job["sources"]:
        options = job.options.get(s, {})
        if options.get("enrich_details"):
            cap = options.get("max_enrich")
            if cap is None:
                open_ended.append(s)
            else:
                calls += cap
                spend += cap * stateful.COST_PER_CALL.get(s, 0.0)
    caps = [c for c in (job["limits.total_records"], job["limits.per_source_records"] and job["limits.per_source_records"] * len(job["sources"]), tasks and tasks[0].limit and tasks[0].limit * len(tasks)) if c]
    models = {s: registry.sources[s].policy.cost_model if s in registry.sources else "unregistered" for s in job["sources"]}
    return {"job_name": job["name"], "task_count": len(tasks), "maximum_source_invocations": len(tasks) * attempts, "maximum_acquisition_records": min(caps) if caps else None, "maximum_enrichment_calls": calls, "estimated_max_enrichment_spend": round(spend, 2), "unbounded_cost_sources": sorted(open_ended), "source_cost_models": models}


#: Outcomes that a later run under the same id keeps; other tasks are tried again.
KEPT = ("success", "empty")


class Runner:
    """Runs a job: tasks to Parquet, then one lazy chain to files and history, all in a folder that the cluster shares.

    Tasks are Spark jobs submitted from a few threads, one per source at a time (see dispatch); each writes its own folder
    and is marked in task order, so a rerun after a failure reads what is there and only runs the rest.  Results join in task order.
    """

    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None, as_of: str | None = None, pause=time.sleep, details: DataFrame | None = None, pages: DataFrame | None = None, lookups: DataFrame | None = None, responses: DataFrame | None = None):
        """details, pages and lookups are captured answers of place details, web pages (by website) and phone providers.

        responses are captured web responses (see operators.crawl): home pages are crawled over them, instead of pages read.
        """
        self.spark, self.folder, self.registry, self.as_of, self.pause = spark, Folder(spark, root), registry or default_registry(), as_of, pause
        self.details, self.pages, self.lookups, self.responses = details, pages, lookups, responses

    def _tasks_at(self, job: Job, run_id: str) -> str:
        return f"runs/{job.fingerprint()[:16]}/{history.safe_name(run_id)}"

    def acquire(self, job: Job, run_id: str) -> tuple[DataFrame | None, list[dict]]:
        """Records of all tasks in order, and a row for each task."""
        at = self._tasks_at(job, run_id)
        smoke = job["execution.mode"] == "live_smoke"
        tasks = plan(job)
        if smoke:
            tasks = tasks[: job["execution.live_smoke.max_tasks"]]
        limits = {"total": job["limits.total_records"], "source": job["limits.per_source_records"], "location": job["limits.per_location_records"]}
        attempts = job["execution.live_smoke.max_attempts"] if smoke else 1

        marks = {name for name, _ in self.folder.names(at)}
        known = {k: json.loads(self.folder.read(f"{at}/task-{t.index}.json")) for k, t in enumerate(tasks) if f"task-{t.index}.json" in marks}

        def run(task: Task, limit: int | None) -> dict:
            return self._attempt(job, task, limit, f"{at}/task-{task.index}", attempts)

        def committed(k: int, result: dict) -> None:
            self.folder.write(f"{at}/task-{tasks[k].index}.json", json.dumps(result))

        threshold = job["execution.live_smoke.failure_threshold"] if smoke else 3
        done = dispatch(tasks, limits, job["execution.max_parallel_tasks"], run, threshold, {k: r for k, r in known.items() if r["outcome"] in KEPT}, committed)
        frames = [self.spark.read.parquet(self.folder.at(f"{at}/task-{t.index}")).withColumn(ORDER, F.col(ORDER) + (t.index << 50)) for t, r in zip(tasks, done, strict=True) if r["outcome"] == "success"]
        log = [{"index": t.index, "source": t.source, "location": t.place, **{k: r[k] for k in ("outcome", "detail", "rows")}} for t, r in zip(tasks, done, strict=True)]
        return (reduce(DataFrame.unionByName, frames) if frames else None), log

    def _attempt(self, job: Job, task: Task, limit: int | None, at: str, attempts: int) -> dict:
        for k in range(attempts):
            try:
                rows = self.registry.read(self.spark, task.source, {"city": task.city, "state": task.state, **task.options})
                delivery.first_rows(rows, limit).write.mode("overwrite").parquet(self.folder.at(at))
                n = self.spark.read.parquet(self.folder.at(at)).count()
                return {"outcome": "success" if n else "empty", "detail": "", "rows": n}
            except (PolicyError, KeyError, ValueError) as e:
                return {"outcome": "fatal_failure", "detail": str(e), "rows": 0}
            except Exception as e:  # noqa: BLE001  a source may fail in any way; the task reports it
                detail = str(e).splitlines()[0] if str(e) else type(e).__name__
                if k + 1 < attempts:
                    self.pause(job["execution.live_smoke.retry_backoff_seconds"])
        return {"outcome": "retryable_failure", "detail": detail, "rows": 0}

    def stages(self, job: Job) -> list[dict]:
        """(stage, asked, answers) of the enrichments; one that is asked for without captured answers cannot run."""
        details = any(job.options.get(s, {}).get("enrich_details") for s in job["sources"])
        asked = (("details", details, self.details), ("pages", job["processing.enrich"], self.pages if self.responses is None else self.responses), ("lookups", bool(job["verification.phone.provider"]), self.lookups))
        return [{"stage": name, "status": "run" if have is not None else "no captured answers"} for name, wanted, have in asked if wanted]

    def transform(self, job: Job, rows: DataFrame) -> DataFrame:
        """validate, normalize, deduplicate, limit, enrich, verify, classify: one plan."""
        clean = contacts.normalize(contacts.validate(rows))
        kept = dedup.fuzzy_keep_first(clean).where("dedup_decision = 'kept'").drop("dedup_decision") if job["processing.fuzzy_deduplicate"] else dedup.keep_first(clean)
        kept = delivery.first_rows(kept, job["limits.total_records"])
        caps = {s: job.options[s].get("max_enrich") for s in job["sources"] if job.options.get(s, {}).get("enrich_details")}
        if caps and self.details is not None:
            kept = enrichment.with_details(kept, self.details, caps)
        if job["processing.enrich"] and self.responses is not None:
            pages = crawl.crawl(kept.where(evidence.needs_crawl()), self.responses).pages()
            found = evidence.contacts_of_pages(pages.withColumnRenamed("home", "__home"), ["__home"], "n")
            kept = evidence.fill_contacts(kept.withColumn("__home", crawl.homepage(F.col("website"))), found, "__home").drop("__home")
        elif job["processing.enrich"] and self.pages is not None:
            kept = evidence.fill_contacts(kept, evidence.contacts_of_pages(self.pages, ["website"], "n"), "website")
        if job["verification.phone.provider"] and self.lookups is not None:
            kept = delivery.merge_verification(kept, enrichment.phone_results(kept, self.lookups))
        clock = F.lit(self.as_of).cast("timestamp") if self.as_of else None
        return delivery.classify(kept, clock, job["delivery.max_age_days"])

    def fuzzy_count(self, job: Job, rows: DataFrame) -> int:
        """Rows that went because their name is like that of a kept row at the same address."""
        if not job["processing.fuzzy_deduplicate"]:
            return 0
        return dedup.fuzzy_keep_first(contacts.normalize(contacts.validate(rows))).where("dedup_decision = 'fuzzy'").count()

    def matches(self, job: Job, rows: DataFrame) -> DataFrame | None:
        """Links between the primary and the supplemental sources' rows as they were acquired."""
        if not job["composition.primary_source"]:
            return None
        of = lambda s: rows.where(F.col("source") == s)
        return linkage.match_sources(of(job["composition.primary_source"]), [of(s) for s in job["composition.supplemental_sources"]])

    def run(self, job: Job, run_id: str | None = None) -> dict:
        """Runs the job and returns its manifest."""
        self.registry.require(job["sources"], "live_smoke" if job["execution.mode"] == "live_smoke" else "delivery")
        ahead = preflight(job, self.registry)
        if ahead["estimated_max_enrichment_spend"] > job["budget.max_total_usd"] and ahead["maximum_enrichment_calls"]:
            raise ValueError("Planned enrichment costs more than budget.max_total_usd.")
        self.folder.recover()
        run_id = run_id or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ")
        rows, log = self.acquire(job, run_id)
        manifest = {"job_name": job["name"], "run_id": run_id, "fingerprint": job.fingerprint(), "tasks": log, "preflight": ahead, "enrichment": self.stages(job)}
        if rows is not None:
            out = self.transform(job, rows).persist()
            try:
                flags = {r["metric"]: r["value"] for r in contacts.counters(contacts.validate(rows, flags=True)).collect()}
                before, after = sum(t["rows"] for t in log), out.count()
                if before > after and job["limits.total_records"] is None:
                    fuzzy = self.fuzzy_count(job, rows)
                    flags |= {k: n for k, n in (("duplicates_removed", before - after - fuzzy), ("fuzzy_duplicates_removed", fuzzy)) if n}
                manifest["pipeline_metrics"] = flags
                manifest["output"] = export(job, out, self.folder, run_id, before, self.matches(job, rows))
                done = delivery.accepted(out)
                if not done.isEmpty():
                    store = history.HistoryStore(self.spark, self.folder.at("history"), job["name"], overwrite=True)
                    manifest["changes"] = history.change_counts(store.record_run(run_id, datetime.datetime.now(datetime.UTC), done)).first().asDict()
            finally:
                out.unpersist()
        self.folder.write(f"runs/{history.safe_name(run_id)}.json", json.dumps(manifest, indent=2, default=str))
        return manifest

    def resume(self, job: Job, run_id: str) -> dict:
        """Goes on with a run of the same job: tasks that succeeded or found nothing are kept, the others tried again."""
        if not self.folder.exists(self._tasks_at(job, run_id)):
            raise ValueError(f"Run {run_id} has nothing of this job to go on from.")
        return self.run(job, run_id)


def destination(job: Job, folder: Folder, run_id: str) -> str:
    """Where the delivery file goes: a file straight under exports gets a folder of its own for each run."""
    name = job["output.destination"] or f"{job['name']}.{job['output.format']}"
    if folder.at(name) == name:
        return name
    return f"exports/{history.safe_name(job['name'])}/{history.safe_name(run_id)}/{name}" if "/" not in name else f"exports/{name}"


def export(job: Job, out: DataFrame, folder: Folder, run_id: str, acquired: int, matches: DataFrame | None = None) -> dict:
    """The delivery file in the requested fields, with sidecars over all rows; they take their names together.  An empty CSV delivery is an empty file."""
    fmt, target = job["output.format"], destination(job, folder, run_id)
    stem = target.rsplit("/", 1)[0] + "/" + target.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    side = lambda name: f"{stem}.{name}.json"
    rows = (out if job["delivery.include_non_accepted"] else delivery.accepted(out)).orderBy(ORDER)
    n = rows.count()
    files = []
    if n or fmt == "json":
        flat = delivery.project(rows, job["output.fields"])
        nested = [c for c, k in flat.dtypes if k.startswith("array")]
        files.append((folder.make_table(target, flat.withColumns({c: F.array_join(c, "|") for c in nested}) if nested and fmt == "csv" else flat, fmt), target))
    else:
        files.append((folder.make(target, ""), target))
    counts = {r["record_status"]: r["n"] for r in delivery.status_counts(out).collect()}
    summary = delivery.summary(out, acquired).first().asDict() | {"reasons": {r["reason"]: r["n"] for r in delivery.reason_counts(out).collect()}, "completeness": [r.asDict() for r in delivery.completeness(out).collect()]}
    files.append((folder.make(target, json.dumps(summary, indent=2)), side("summary")))
    if job["delivery.include_sidecars"]:
        tables = {"quality": delivery.quality(out).orderBy(ORDER).drop(ORDER), "evidence": delivery.evidence(out).orderBy(ORDER).select("evidence")}
        if matches is not None:
            tables["composition"] = linkage.in_order(matches)
        files += [(folder.make_table(target, df, "json"), side(name)) for name, df in tables.items()]
    folder.publish(files)
    return {"destination": folder.at(target), "record_count": n, "status_counts": counts, "summary_destination": folder.at(side("summary"))}


def summary_text(manifest: dict) -> str:
    """A run in a few lines."""
    lines = [f"Job: {manifest['job_name']} ({manifest['run_id']})"]
    for t in manifest["tasks"]:
        what = f"{t['rows']} rows" if t["outcome"] in ("success", "empty") else f"{t['outcome']}: {t['detail']}"
        lines.append(f"  - {t['source']} / {t['location'] or 'any'}: {what}")
    for k, v in sorted(manifest.get("pipeline_metrics", {}).items()):
        lines.append(f"  {k}: {v}")
    for stage in manifest.get("enrichment", []):
        if stage["status"] != "run":
            lines.append(f"  {stage['stage']}: not run, {stage['status']}")
    if out := manifest.get("output"):
        lines.append(f"Output: {out['record_count']} records -> {out['destination']}")
        lines.append("Quality: " + ", ".join(f"{k}={v}" for k, v in sorted(out["status_counts"].items())))
    return "\n".join(lines)
