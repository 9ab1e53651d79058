"""Files that are published together, and tasks of a job side by side."""

import itertools
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import snapshot
from fieldmark.operators.stateful import FAILURES, RESETS, remaining
from fieldmark.plans import job as jobs
from fieldmark.plans.dispatch import dispatch
from fieldmark.plans.session import Session, list_sessions, nth_session
from fieldmark.schema import ORDER, as_records
from fieldmark.sources.folder import Folder
from fieldmark.sources.registry import CLIENT, Registry


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, f"file://{tmp_path}/top")


def test_small_files(folder):
    folder.write("a/b.json", "one")
    folder.write("a/b.json", "zwölf")
    assert folder.read("a/b.json") == "zwölf" and [n for n, _ in folder.names("a")] == ["b.json"]
    assert folder.names("none") == [] and not folder.exists("c") and folder.at("hdfs://x/y") == "hdfs://x/y"
    with pytest.raises(FileNotFoundError):
        folder.read("c")


def test_publish_all_or_none(folder, monkeypatch):
    folder.write("x/data", "old")
    files = lambda: [(folder.make("x/data", "new"), "x/data"), (folder.make("x/manifest", "m"), "x/manifest")]
    real = Folder.rename

    def failing(self, name, to, over=False):
        if to.endswith("manifest"):
            raise OSError("full")
        real(self, name, to, over)

    monkeypatch.setattr(Folder, "rename", failing)
    with pytest.raises(OSError):
        folder.publish(files())
    monkeypatch.setattr(Folder, "rename", real)
    assert folder.read("x/data") == "old" and [n for n, _ in folder.names("x")] == ["data"]
    folder.publish(files())
    assert folder.read("x/data") == "new" and [n for n, _ in folder.names("x")] == ["data", "manifest"] and [n for n, _ in folder.names()] == ["x"]
    with pytest.raises(FileExistsError):
        folder.publish(files(), over=False)
    assert [n for n, _ in folder.names("x")] == ["data", "manifest"]


@pytest.mark.parametrize("before", [None, "old"])
def test_dead_driver_leaves_neither(folder, monkeypatch, before):
    """The driver dies between two renames: nothing is undone then, but the next one undoes it."""
    if before:
        folder.write("data", before)
    real, undo = Folder.rename, Folder._undo

    def dying(self, name, to, over=False):
        if to.endswith("manifest"):
            raise KeyboardInterrupt
        real(self, name, to, over)

    monkeypatch.setattr(Folder, "rename", dying)
    monkeypatch.setattr(Folder, "_undo", lambda *a: None)
    with pytest.raises(KeyboardInterrupt):
        folder.publish([(folder.make("data", "new"), "data"), (folder.make("manifest", "m"), "manifest")])
    assert folder.read("data") == "new"
    monkeypatch.setattr(Folder, "rename", real)
    monkeypatch.setattr(Folder, "_undo", undo)
    assert folder.recover() == 1 and folder.recover() == 0
    assert [n for n, _ in folder.names()] == (["data"] if before else []) and (not before or folder.read("data") == "old")


@pytest.mark.parametrize("parts", [1, 5])
def test_joined_tables(spark, folder, parts):
    df = spark.range(0, 40, 1, parts).select(F.col("id"), F.concat(F.lit('a "b", '), "id").alias("text"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("odd"))
    rows = json.loads(folder.read(folder.make_table("t.json", df, "json")))
    assert rows == [r.asDict() for r in df.collect()]
    assert json.loads(folder.read(folder.make_table("t.json", df.where("id < 0"), "json"))) == []
    import csv
    import io

    lines = list(csv.reader(io.StringIO(folder.read(folder.make_table("t.csv", df, "csv"))), escapechar=None, doublequote=True))
    assert lines[0] == ["id", "text", "odd"] and [r[0] for r in lines[1:]] == [str(k) for k in range(40)] and lines[1][1] == 'a "b", 0'


class Task:
    def __init__(self, source, place, limit=None):
        self.source, self.place, self.limit = source, place, limit


def serially(tasks, limits, found, threshold):
    used, failures, out = {}, {}, []
    for k, t in enumerate(tasks):
        keys = {"total": "", "source": t.source, "location": t.place}
        limit, why = remaining(limits, {n: used.get((n, v), 0) for n, v in keys.items()}, t.limit)
        why = why or ("source health threshold reached" if failures.get(t.source, 0) >= threshold else None)
        r = {"outcome": "skipped", "detail": why, "rows": 0} if why else found(k, limit)
        failures[t.source] = failures.get(t.source, 0) + 1 if r["outcome"] in FAILURES else 0 if r["outcome"] in RESETS else failures.get(t.source, 0)
        for key in keys.items():
            used[key] = used.get(key, 0) + r["rows"]
        out.append(r)
    return out


def test_dispatch_equals_serial_run():
    rng = random.Random(7)
    for _ in range(40):
        sources, places = "abcd"[: rng.randrange(1, 5)], "xyz"[: rng.randrange(1, 4)]
        tasks = [Task(s, p, rng.choice([None, 3, 8])) for s, p in itertools.product(sources, places)]
        limits = {"total": rng.choice([None, 5, 20]), "source": rng.choice([None, 4, 9]), "location": rng.choice([None, 6])}
        has = [rng.choice([0, 0, 2, 7, 30, "retryable_failure", "fatal_failure"]) for _ in tasks]

        def found(k, limit):
            if isinstance(has[k], str):
                return {"outcome": has[k], "detail": "", "rows": 0}
            n = has[k] if limit is None else min(has[k], limit)
            return {"outcome": "success" if n else "empty", "detail": "", "rows": n}

        busy, lock, order = set(), threading.Lock(), []
        place = {id(t): k for k, t in enumerate(tasks)}

        def run(t, limit):
            with lock:
                assert t.source not in busy and len(busy) < 8
                busy.add(t.source)
            time.sleep(rng.random() / 500)
            with lock:
                busy.remove(t.source)
            return found(place[id(t)], limit)

        assert dispatch(tasks, limits, 8, run, 2, committed=lambda k, r: order.append(k)) == serially(tasks, limits, found, 2)
        assert order == list(range(len(tasks)))


def test_capped_tasks_overlap():
    """Caps that a task in flight cannot reach do not hold others back; caps that it can do."""
    def most_at_once(limits, limit):
        now, most, lock = [0], [0], threading.Lock()

        def run(t, n):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.05)
            with lock:
                now[0] -= 1
            return {"outcome": "success", "detail": "", "rows": n}

        out = dispatch([Task(s, "x", limit) for s in "abcdefgh"], limits, 8, run, 3)
        return most[0], sum(r["rows"] for r in out)

    assert most_at_once({"source": 10}, 5) == (8, 40)
    assert most_at_once({"total": 100}, 5) == (8, 40)
    assert most_at_once({"total": 10}, 5) == (2, 10)
    assert most_at_once({"total": 10}, None) == (1, 10)


class Delayed(Registry):
    """Sources of made rows; earlier ones take longer."""

    def read(self, spark, name, options):
        time.sleep(0.6 - int(name[1]) / 10)
        if options.get("fail") and not self.mended:
            raise RuntimeError("later")
        rows = spark.range(int(options["rows"])).select(F.col("id").alias(ORDER), F.concat(F.lit(f"{name} "), "id").alias("name"), F.lit(name).alias("source"), F.lit("https://a.test").alias("website"), F.lit("1 A").alias("address"))
        return as_records(rows, {c: F.col(c) for c in ("name", "source", "website", "address")})


def registry():
    r = Delayed()
    r.mended = False
    for k in range(5):
        r.register(f"s{k}", "file", CLIENT)
    return r


def spec(width, **more):
    return jobs.parse(
        {"version": 1, "name": "demo", "search": {"query": "x", "cities": ["Denver, CO", "Reno, NV"]}, "sources": [f"s{k}" for k in range(5)], "output": {"fields": ["name"]}, "execution": {"max_parallel_tasks": width}, "processing": {"deduplicate": False}}
        | {"source_options": {f"s{k}": {"rows": 3 + k} for k in range(5)}} | more
    )


def test_job_side_by_side(spark, tmp_path):
    caps = {"per_source_records": 5, "per_location_records": 17}
    logs = []
    for width in (1, 8):
        rows, log = jobs.Runner(spark, f"file://{tmp_path}/w{width}", registry()).acquire(spec(width, limits=caps), "r")
        logs.append((log, [r["name"] for r in rows.orderBy(ORDER).collect()]))
    assert logs[0] == logs[1] and sum(t["rows"] for t in logs[0][0]) == len(logs[0][1])


def test_resume_tries_failed_tasks_again(spark, tmp_path):
    r = registry()
    job = spec(4, source_options={f"s{k}": {"rows": 2} | ({"fail": True} if k == 1 else {}) for k in range(5)})
    runner = jobs.Runner(spark, f"file://{tmp_path}/root", r)
    with pytest.raises(ValueError, match="nothing"):
        runner.resume(job, "r")
    first = runner.run(job, "r")
    assert [t["outcome"] for t in first["tasks"]] == ["success"] * 2 + ["retryable_failure"] * 2 + ["success"] * 6
    r.mended = True
    read = []
    real = r.read
    r.read = lambda spark, name, options: (read.append(name), real(spark, name, options))[1]
    rows, log = runner.acquire(job, "r")
    assert {t["outcome"] for t in log} == {"success"} and read == ["s1", "s1"] and rows.count() == 20


def test_missing_answers_are_named(spark, tmp_path):
    job = spec(1, processing={"enrich": True}, sources=["s0"])
    made = jobs.Runner(spark, f"file://{tmp_path}/root", registry()).run(job, "r")
    assert made["enrichment"] == [{"stage": "pages", "status": "no captured answers"}] and "pages: not run" in jobs.summary_text(made)
    assert made["output"]["destination"] == f"file://{tmp_path}/root/exports/demo/r/demo.csv"


def test_sessions_of_a_shared_folder(spark, tmp_path):
    records = as_records(spark.createDataFrame([(0, "A")], f"{ORDER} long, name string"), {"name": F.col("name")})
    for name in ("one", "two"):
        Session.create(spark, f"file://{tmp_path}/{name}", name, records)
        time.sleep(0.05)
    Folder(spark, f"file://{tmp_path}").write("bad/session.json", "{")
    assert [s.rsplit("/", 1)[1] for s in list_sessions(spark, f"file://{tmp_path}")] == ["two", "one"]
    assert nth_session(spark, f"file://{tmp_path}", 2).request == "one"
    with pytest.raises(ValueError, match="2 sessions"):
        nth_session(spark, f"file://{tmp_path}", 3)


def test_snapshot_is_there_with_its_manifest_or_not(spark, tmp_path, monkeypatch):
    df = spark.range(50).selectExpr("format_string('%04d', 49 - id) id", "named_struct('primary', 'n') names", "named_struct('primary', 'dental_clinic', 'hierarchy', cast(null as array<string>)) taxonomy", "array(named_struct('locality','San Jose','freeform','1 A')) addresses", "named_struct('xmin',-121.8D,'ymin',37.1D,'xmax',-121.8D,'ymax',37.1D) bbox")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    make = lambda out, **more: snapshot.prepare(spark, [str(tmp_path / "in" / "*.parquet")], out, (-122, 37, -121.7, 37.5), "2026-01", "2026-01-01T00:00:00+00:00", "https://r.example.test", "X", **more)
    out, real = f"file://{tmp_path}/out/s.parquet", Folder.rename

    def failing(self, name, to, over=False):
        if to.endswith("m.json"):
            raise OSError("full")
        real(self, name, to, over)

    monkeypatch.setattr(Folder, "rename", failing)
    with pytest.raises(OSError):
        make(out, manifest=f"file://{tmp_path}/out/m.json", license="L", attribution="A")
    monkeypatch.setattr(Folder, "rename", real)
    assert Folder(spark, f"file://{tmp_path}/out").names() == []
    monkeypatch.setattr(snapshot, "PART_ROWS", 10)
    made = make(out, manifest=f"file://{tmp_path}/out/m.json", license="L", attribution="A")
    assert (made["license"], made["attribution"], made["review_status"], made["row_count"]) == ("L", "A", "reviewed", 50)
    got = snapshot.read_snapshot(spark, out, f"file://{tmp_path}/out/m.json")
    assert got.count() == 50 and len(got.inputFiles()) >= 5
    assert [r["id"] for r in spark.read.parquet(out).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()] == [f"{k:04d}" for k in range(50)]
    with pytest.raises(FileExistsError):
        make(out, manifest=f"file://{tmp_path}/out/other.json")
    for bad in ({"license": " "}, {"manifest": out}):
        with pytest.raises(ValueError):
            make(f"file://{tmp_path}/out/t.parquet" if "manifest" not in bad else out, **bad)
