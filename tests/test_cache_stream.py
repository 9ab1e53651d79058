"""The expiring cache as keyed state: replacement, expiry and restart."""

import datetime
import random

from fieldmark.streaming import folds

DAY0 = datetime.datetime(2026, 1, 1)
SCHEMA = "source string, source_id string, at timestamp, kind string, value string"


def run(spark, tmp_path, rows, n, **options):
    """One more file of events, then a fresh query on the same checkpoint until all is read."""
    made = [(s, i, DAY0 + datetime.timedelta(days=d), k, v) for s, i, d, k, v in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    out = folds.cache_stream(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), **options)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def seen(spark, tmp_path):
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((r["source"], r["source_id"], (r["at"] - DAY0).total_seconds() / 86400, r["action"], r["value"]) for r in rows if r["source"] != "clock")


def test_replacement_expiry_and_restart(spark, tmp_path):
    life = {"ttl_days": {"short": 10, "none": 0}}
    run(spark, tmp_path, [("short", "a", 0, "set", "v1"), ("short", "a", 1, "get", None), ("short", "a", 2, "set", "v2"), ("none", "a", 0, "set", "x"), ("none", "a", 1, "get", None), ("long", "a", 0, "set", "y")], 0, **life)
    first = [("long", "a", 0, "stored", "y"), ("none", "a", 0, "refused", "x"), ("none", "a", 1, "miss", None), ("short", "a", 0, "stored", "v1"), ("short", "a", 1, "hit", "v1"), ("short", "a", 2, "stored", "v2")]
    assert seen(spark, tmp_path) == sorted(first)
    # the entry of the first query is there after the restart; one that is older than it does not replace it
    run(spark, tmp_path, [("short", "a", 11.5, "get", None), ("short", "b", 3, "set", "w"), ("short", "a", 1.99, "set", "old")], 1, **life)
    second = [*first, ("short", "a", 11.5, "hit", "v2"), ("short", "b", 3, "stored", "w")]
    assert [r for r in seen(spark, tmp_path) if r[3] not in ("expired", "late")] == sorted(second)
    # event time goes on: both entries end by their timers, and each is reported once
    run(spark, tmp_path, [("clock", "c", 30, "get", None)], 2, **life)
    run(spark, tmp_path, [("clock", "c", 31, "get", None), ("short", "a", 31, "get", None)], 3, **life)
    found = seen(spark, tmp_path)
    assert [r for r in found if r[3] == "expired"] == [("short", "a", 12, "expired", "v2"), ("short", "b", 13, "expired", "w")]
    assert ("short", "a", 31, "miss", None) in found and not any(r[0] == "long" and r[3] == "expired" for r in found)


def test_equals_plain_cache(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.choice(["short", "long"]), rng.choice("ab"), d, rng.choice(["set", "get"]), f"v{d}") for d in range(0, 80, 2)]
    held, expected = {}, []
    for s, i, d, kind, v in events:
        if kind == "set":
            held[s, i] = (d, v)
            expected.append((s, i, d, "stored", v))
        elif (s, i) in held and held[s, i][0] > d - (9 if s == "short" else 90):
            expected.append((s, i, d, "hit", held[s, i][1]))
        else:
            expected.append((s, i, d, "miss", None))
    for n in range(3):
        run(spark, tmp_path, [e for e in events if n * 30 <= e[2] < n * 30 + 30], n, ttl_days={"short": 9})
    assert sorted((r for r in seen(spark, tmp_path) if r[3] != "expired"), key=repr) == sorted(((s, i, float(d), a, v) for s, i, d, a, v in expected), key=repr)
