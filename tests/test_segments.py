"""Ordered folds over segments against plain loops, with a source that holds nearly all rows."""

import random

import pytest

from fieldmark.operators import stateful
from fieldmark.schema import ORDER


def events(seed, n):
    rng = random.Random(seed)
    kinds = ["success", "empty", "retryable_failure", "fatal_failure", "skipped"]
    weights = rng.choice([[1, 1, 1, 1, 1], [0, 0, 5, 5, 1], [1, 0, 60, 60, 5]])
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), k, rng.randrange(n), rng.choices(kinds, weights)[0]) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_health_in_segments(spark, seed):
    rows = events(seed, 700)
    streaks, expected = {}, {}
    for source, event_id, ts, outcome in sorted(rows, key=lambda r: (r[2], r[1])):
        s = streaks.get(source, 0)
        s = s + 1 if outcome in stateful.FAILURES else 0 if outcome in stateful.RESETS else s
        streaks[source] = s
        expected[event_id] = (s, "threshold" if s >= 3 else "degraded" if s else "healthy")
    df = spark.createDataFrame(rows, "source string, event_id long, ts long, outcome string")
    assert {r["event_id"]: (r["consecutive_failures"], r["health"]) for r in stateful.health(df).collect()} == expected


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("caps", [5, 0, {"hot": 40, "a": 1, "b": None}, {"hot": None}, {}])
def test_budget_in_segments(spark, seed, caps):
    rng = random.Random(seed)
    rows = [(k, "hot" if rng.random() < 0.9 else rng.choice("abc"), f"i{rng.randrange(90)}", rng.random() < 0.1) for k in range(500)]
    spent, paid, refused, known, expected = {}, set(), set(), set(), {}
    for k, source, i, hit in rows:
        cap = caps if isinstance(caps, int) else caps.get(source, 0)
        if hit:
            expected[k] = "hit"
            known.add((source, i))
            continue
        if (source, i) not in known:
            known.add((source, i))
            if cap is None or spent.get(source, 0) < cap:
                spent[source] = spent.get(source, 0) + 1
                paid.add((source, i))
                expected[k] = "paid"
                continue
            refused.add((source, i))
        expected[k] = "skipped" if (source, i) in refused else "repeat"
    df = spark.createDataFrame(rows, f"{ORDER} long, source string, source_id string, hit boolean")
    assert {r[ORDER]: r["action"] for r in stateful.spend_budget(df, caps).collect()} == expected


def test_a_hot_key_lies_in_many_segments(spark):
    df = spark.range(4000).selectExpr("'hot' as k", "id as at", "1 as v")
    placed = stateful.segmented(df, "k", ["at"])
    sizes = [r["count"] for r in placed.groupBy("__seg").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1500
    out = stateful.running_sum(df, "v", "k", ["at"], "n")
    assert out.where("n <> at + 1").isEmpty() and out.columns == ["k", "at", "v", "n"]


def test_empty(spark):
    df = spark.createDataFrame([], "source string, event_id long, ts long, outcome string")
    assert stateful.health(df).isEmpty()
