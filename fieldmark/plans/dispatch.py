"""Tasks of a job side by side, with the results that running them one after another would give.

Caps (total, per source, per location) make a task's limit depend on the rows of the tasks before it.  The ledger therefore
knows two limits of every task: what it may take if the earlier tasks that are not settled take all that they may, and what it may
take if they take nothing.  Where both agree nothing in flight can change the task, and it starts; else it waits until
an earlier one settles with the rows it really found.  A source has one task in flight and its tasks keep their order, so its failure streak
is that of a serial run too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from ..operators.stateful import FAILURES, RESETS, remaining


@dataclass
class Ledger:
    """tasks: objects with source, place and limit; limits: total, source and location (None: no cap)."""

    tasks: Sequence
    limits: dict[str, int | None]
    settled: dict[int, int] = field(default_factory=dict)
    #: rows of tasks that were done before this run; they count for every other task
    kept: dict[int, int] = field(default_factory=dict)

    def bounds(self) -> list[tuple[tuple[int | None, str | None], tuple[int | None, str | None]]]:
        """Of each task (limit, reason to skip) with all reservations of earlier tasks, and without."""
        full, real, out = {}, {}, []
        for k, rows in self.kept.items():
            for key in self._keys(self.tasks[k]):
                full[key] = real[key] = real.get(key, 0) + rows
        for k, t in enumerate(self.tasks):
            keys = self._keys(t)
            least, most = (remaining(self.limits, {n: used.get((n, v), 0) for n, v in keys}, t.limit) for used in (full, real))
            out.append((least, most))
            if k in self.kept:
                continue
            rows = self.settled.get(k)
            reserved = rows if rows is not None else 0 if most[1] else float("inf") if most[0] is None else most[0]
            for key in keys:
                full[key] = full.get(key, 0) + reserved
                real[key] = real.get(key, 0) + (rows or 0)
        return out

    def _keys(self, task) -> tuple[tuple[str, str], ...]:
        return ("total", ""), ("source", task.source), ("location", task.place)


def dispatch(tasks: Sequence, limits: dict[str, int | None], width: int, run: Callable[[object, int | None], dict], threshold: int, kept: dict[int, dict] | None = None, committed: Callable[[int, dict], None] = lambda k, result: None) -> list[dict]:
    """Results (outcome, detail, rows) of all tasks, in their order; `run` is given a task and its limit, at most `width` at once.

    kept: results of tasks that an earlier run has done.  `committed` is called in task order, as soon as a task and all before it are done.
    """
    done, failures = dict(kept or {}), {}
    ledger = Ledger(tasks, limits, kept={k: r["rows"] for k, r in done.items()})
    running: dict[Future, int] = {}
    shown = 0

    def settle(k: int, result: dict) -> None:
        source = tasks[k].source
        done[k] = result
        ledger.settled[k] = result["rows"]
        if result["outcome"] in FAILURES:
            failures[source] = failures.get(source, 0) + 1
        elif result["outcome"] in RESETS:
            failures[source] = 0

    with ThreadPoolExecutor(width) as pool:
        while len(done) < len(tasks):
            busy, moved = {tasks[k].source for k in running.values()}, False
            for k, (least, most) in enumerate(ledger.bounds()):
                source = tasks[k].source
                if k in done or source in busy:
                    continue
                busy.add(source)  # later tasks of the source wait behind this one
                if least != most:
                    continue
                why = least[1] or ("source health threshold reached" if failures.get(source, 0) >= threshold else None)
                if why:
                    settle(k, {"outcome": "skipped", "detail": why, "rows": 0})
                    moved = True
                elif len(running) < width:
                    running[pool.submit(run, tasks[k], least[0])] = k
            while shown in done:
                committed(shown, done[shown])
                shown += 1
            if running and not moved:
                finished, _ = wait(tuple(running), return_when=FIRST_COMPLETED)
                for future in sorted(finished, key=running.__getitem__):
                    settle(running.pop(future), future.result())
        while shown in done:
            committed(shown, done[shown])
            shown += 1
    return [done[k] for k in range(len(tasks))]
