"""Streaming forms of the ordered folds: state per source, changes per micro-batch, windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stateful import FAILURES, RESETS


def health_stream(events: DataFrame, threshold: int = 3) -> DataFrame:
    """events(source, event_id, ts, outcome) with each source's failure streak, kept as state between batches."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        streaks = []
        for outcome in rows["outcome"]:
            streak = streak + 1 if outcome in FAILURES else 0 if outcome in RESETS else streak
            streaks.append(streak)
        state.update((streak,))
        health = ["threshold" if s >= threshold else "degraded" if s else "healthy" for s in streaks]
        yield pd.DataFrame({"source": key[0], "event_id": rows["event_id"].values, "consecutive_failures": streaks, "health": health})

    return events.groupBy("source").applyInPandasWithState(fold, "source string, event_id long, consecutive_failures long, health string", "streak long", "append", GroupStateTimeout.NoTimeout)


class _Cache(StatefulProcessor):
    """One cached answer of a key, with a timer at the end of its life."""

    def __init__(self, ttl_days: dict[str, int], default_ttl: int):
        self.ttl_days, self.default_ttl = ttl_days, default_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "fetched_us long, value string")

    def _life(self, source: str) -> int:
        return self.ttl_days.get(source, self.default_ttl) * 86_400_000_000

    def _drop(self, key: tuple) -> None:
        if self.held.exists():
            self.handle.deleteTimer(self._timer(self.held.get()[0] + self._life(key[0])))
            self.held.clear()

    @staticmethod
    def _timer(us: int) -> int:
        """The first whole millisecond at which a life that ends at `us` is over."""
        return -(-us // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        life, out = self._life(key[0]), []
        for at, kind, value in zip(events["at"].astype("datetime64[us]").astype("int64"), events["kind"], events["value"], strict=True):
            fresh = self.held.get() if self.held.exists() else None
            if kind == "set":
                late = fresh is not None and fresh[0] > at
                if life > 0 and not late:
                    self._drop(key)
                    self.held.update((at, value))
                    self.handle.registerTimer(self._timer(at + life))
                out.append((at, "late" if late else "stored" if life > 0 else "refused", value))
            elif fresh is not None and fresh[0] + life > at:
                out.append((at, "hit", fresh[1]))
            else:
                self._drop(key)
                out.append((at, "miss", None))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            ends = self.held.get()[0] + self._life(key[0])
            if self._timer(ends) <= expiredTimerInfo.getExpiryTimeInMs():
                value = self.held.get()[1]
                self.held.clear()
                yield self._rows(key, [(ends, "expired", value)])

    @staticmethod
    def _rows(key: tuple, out: list) -> pd.DataFrame:
        at = pd.Series([x[0] for x in out], dtype="int64").astype("datetime64[us]")
        return pd.DataFrame({"source": key[0], "source_id": key[1], "at": at, "action": [x[1] for x in out], "value": pd.Series([x[2] for x in out], dtype="object")})

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, ttl_days: dict[str, int] | None = None, default_ttl: int = 90, late: str = "1 hour") -> DataFrame:
    """(source, source_id, at, action, value) of an expiring cache kept as keyed state.

    events: source, source_id, at, kind (set or get), value.  A set replaces what the key holds (action stored; late where the key
    holds a later one, which stays); a get is a hit while the entry is younger than its source's time to live, else a miss that deletes it.
    A time to live of 0 or less stores nothing (refused).  When event time passes an entry's end it is deleted and reported once as expired.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.select("source", "source_id", "at", "kind", "value").withWatermark("at", late).groupBy("source", "source_id")
    return keyed.transformWithStateInPandas(_Cache(ttl_days or {}, default_ttl), "source string, source_id string, at timestamp, action string, value string", "append", "eventTime")


def outcome_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Outcome counts per source and event-time window; a window is final once the watermark passes it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "source").agg(F.count("*").alias("attempts"), *[F.count_if(F.col("outcome") == k).alias(k) for k in (*RESETS, *FAILURES)])


def history_sink(store, to_records=lambda df: df):
    """A foreachBatch function that records each micro-batch as a run; a batch that is retried is not recorded twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        import datetime

        try:
            store.record_run(f"batch-{epoch:012d}", datetime.datetime.now(datetime.UTC), to_records(batch))
        except ValueError as e:
            if "already recorded" not in str(e):
                raise

    return write
