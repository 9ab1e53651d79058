"""Command line: jobs, research sessions and snapshots, all over captured files."""

from __future__ import annotations

import argparse
import datetime
import json

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("fieldmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldmark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options) -> argparse.ArgumentParser:
        q = sub.add_parser(name)
        for n in names:
            q.add_argument(n)
        for option, how in options.items():
            q.add_argument("--" + option.replace("_", "-"), **how)
        return q

    root = {"default": "."}
    answers = {name: {"metavar": "PARQUET"} for name in ("responses", "details", "lookups")}
    newest = {"nargs": "?", "const": 1, "type": int, "metavar": "N"}
    command("preflight", "job")
    command("run", "job", root=root, run_id={}, **answers)
    command("resume", "job", "run_id", root=root, **answers)
    command("research", "job", "request", root=root, run_id={}, session={"required": True}, **answers)
    command("research-import", "source", "request", session={"required": True})
    command("refine", latest=newest, root=root, responses={}, directory={}, directory_url={"default": ""}, as_of={}).add_argument("arguments", nargs="+", help="SESSION INSTRUCTION, or INSTRUCTION with --latest")
    command("compose", latest=newest, root=root, source={}).add_argument("arguments", nargs="+", help="SESSION FILE..., or FILE... with --latest")
    command("research-export", latest=newest, root=root, matches={"action": "store_true"}).add_argument("arguments", nargs="+", help="SESSION DESTINATION, or DESTINATION with --latest")
    command("sessions", "root")
    view = command("view", latest=newest, root=root, limit={"type": int, "default": 20}, all={"action": "store_true"}, summary={"action": "store_true"}, audit=newest, fields={"default": "name,phone"})
    view.add_argument("session", nargs="?")
    view.add_argument("--with", dest="populated")
    review = command("snapshot-review", "snapshot", latest=newest, root=root, manifest={}, limit={"type": int, "default": 20}, offset={"type": int, "default": 0}, decision={"choices": ("matched", "candidate", "ambiguous")})
    review.add_argument("session", nargs="?")
    needed = {"required": True}
    make = command("snapshot", input=needed | {"action": "append"}, output=needed, release=needed, retrieved_at=needed, reference=needed, geography=needed, license={}, attribution={}, manifest={}, locality={"action": "append"})
    make.add_argument("--box", nargs=4, type=float, required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)

    from .operators import delivery, linkage, snapshot
    from .plans import job as jobs
    from .plans.session import Session, list_sessions, nth_session
    from .sources import readers

    def show(df) -> None:
        for r in df.toJSON().toLocalIterator():
            print(r)

    def runner(spark: SparkSession) -> jobs.Runner:
        table = lambda path: spark.read.parquet(path) if path else None
        return jobs.Runner(spark, a.root, details=table(a.details), responses=table(a.responses), lookups=table(a.lookups))

    def chosen(spark: SparkSession, arguments: list[str], rest: int) -> tuple[Session, list[str]]:
        """The session that --latest or the first argument names, and the other arguments, of which there must be `rest` at least."""
        named = [] if a.latest else arguments[:1]
        others = arguments if a.latest else arguments[1:]
        if len(others) < rest or not (a.latest or named):
            raise ValueError("Name a session, or take one with --latest.")
        return (nth_session(spark, a.root, a.latest) if a.latest else Session.load(spark, named[0])), others

    if a.command == "preflight":
        print(json.dumps(jobs.preflight(jobs.load(a.job)), indent=2))
        return 0
    spark = session()
    if a.command == "run":
        print(jobs.summary_text(runner(spark).run(jobs.load(a.job), a.run_id)))
    elif a.command == "resume":
        print(jobs.summary_text(runner(spark).resume(jobs.load(a.job), a.run_id)))
    elif a.command == "research":
        job, run = jobs.load(a.job), runner(spark)
        manifest = run.run(job, a.run_id)
        print(jobs.summary_text(manifest))
        rows, _ = run.acquire(job, manifest["run_id"])
        if rows is None:
            raise ValueError("The job gave no record to go on with.")
        s = Session.create(spark, a.session, a.request, delivery.accepted(run.transform(job, rows)))
        print(f"{s.path}: {s.records.count()} records")
    elif a.command == "research-import":
        s = Session.create(spark, a.session, a.request, readers.read_records(spark, a.source))
        print(f"{s.path}: {s.records.count()} records")
    elif a.command == "refine":
        s, (instruction, *_) = chosen(spark, a.arguments, 1)
        done = len(s.steps)
        for step in s.refine(instruction, _plugins(spark, s, a))[done:]:
            print(f"{step['plugin']}: {step['before']} -> {step['after']} records. {step['note']}")
    elif a.command == "compose":
        s, files = chosen(spark, a.arguments, 1)
        for f in files:
            counts = s.compose(readers.with_source(readers.read_records(spark, f), a.source))
            print(f"{f}: " + ", ".join(f"{n} {k}" for k, n in counts.items()))
    elif a.command == "research-export":
        s, (destination, *_) = chosen(spark, a.arguments, 1)
        print(s.write_export(destination, a.matches))
    elif a.command == "sessions":
        for k, path in enumerate(list_sessions(spark, a.root), 1):
            print(k, path)
    elif a.command == "view":
        s, _ = chosen(spark, [a.session] if a.session else [], 0)
        if a.summary:
            show(s.summary())
        elif a.audit is not None:
            show(s.details(a.audit or 1))
        else:
            show(delivery.view(s.records if a.all or a.populated else s.matches(), a.fields.split(","), a.limit, a.populated))
    elif a.command == "snapshot-review":
        s, _ = chosen(spark, [a.session] if a.session else [], 0)
        found = linkage.match(s.records, snapshot.read_snapshot(spark, a.snapshot, a.manifest))
        show(linkage.decision_counts(found))
        show(linkage.review_page(found, a.decision, a.offset, a.limit))
    else:
        print(json.dumps(snapshot.prepare(spark, a.input, a.output, a.box, a.release, a.retrieved_at, a.reference, a.geography, a.locality, license=a.license, attribution=a.attribution, manifest=a.manifest), indent=2))
    return 0


def _plugins(spark: SparkSession, s, a: argparse.Namespace):
    """The refinements that the given captures allow."""
    from pyspark.sql import functions as F

    from .plans.session import Plugins, enrollment_plugin, web_plugins

    at = datetime.datetime.fromisoformat(a.as_of) if a.as_of else datetime.datetime.now(datetime.UTC)
    clock = F.lit(at.isoformat()).cast("timestamp")
    made = web_plugins(s.records, spark.read.parquet(a.responses), at.year, clock) if a.responses else Plugins()
    if a.directory:
        made.register("medi-cal-dental-enrollment", enrollment_plugin(spark.read.parquet(a.directory), a.directory_url or a.directory, clock))
    return made


if __name__ == "__main__":
    raise SystemExit(main())
