"""The dead-link machine as a stateful stream over the runs on a catalog.

A row is what one run found of one URL: (url, run, seen, state, stock). The state of a URL is the number
of runs in a row that missed it and the last run that counted. A run counts once: a row of the last
run or an earlier one, as comes from a run that is sent again after a failure, changes nothing and
gives no outcome, and a URL of several cards gets one miss a run. Rows of several runs in one batch
are taken in the order of the runs, so any split of the runs into batches gives the same outcomes.
Runs of one URL must arrive in order over batches.

A URL that was seen has no misses; one that was missed ``MISSES`` times in a row is invalid. Of a seen
URL another state than A is rejected, a missing stock unknown. A URL's state expires after
``keep_days`` without a run, so links that are gone don't stay for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradewise.operators.stock import MISSES
from gradewise.streaming.state import DAY_MS, combined, distinct_rows

OUTCOMES = "url string, run bigint, outcome string, misses int, stock double"
KEEP_DAYS = 400


class DeadLinks(StatefulProcessor):
    def __init__(self, keep_days: int):
        self.keep_ms = keep_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.link = handle.getValueState("link", "misses int, run bigint", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        misses, last = self.link.get() if self.link.exists() else (0, None)
        runs: dict[int, Row] = {}  # what a run found of a URL is one fact, however often it is sent
        for r in rows:
            if r["run"] is not None and (last is None or r["run"] > last):
                runs[r["run"]] = max(runs.get(r["run"], r), r, key=_strength)
        for run in sorted(runs):
            r = runs[run]
            misses = 0 if r["seen"] else misses + 1
            if r["seen"]:
                outcome = "rejected" if (r["state"] or "A").upper() != "A" else "unknown" if r["stock"] is None else "ok"
            else:
                outcome = "invalid" if misses >= MISSES else "missed"
            yield Row(url=key[0], run=run, outcome=outcome, misses=misses, stock=r["stock"] if outcome == "ok" else None)
        if runs:
            self.link.update((misses, max(runs)))

    def close(self) -> None:
        pass


def _strength(r: Row) -> tuple:
    """Of differing rows of one URL and run: seen before missed, then the first state, then the larger stock."""
    letters = tuple(-ord(c) for c in (r["state"] or "A").upper())
    return bool(r["seen"]), letters, r["stock"] is not None, r["stock"] or 0.0


def outcomes(found: DataFrame, keep_days: int = KEEP_DAYS) -> DataFrame:
    """The stream of outcomes (url, run, outcome, misses, stock) of a stream of ``found`` rows."""
    # What a run found of a URL comes once for each card that it links: equal rows go to the state once.
    rows = combined(found.where("url IS NOT NULL").select("url", "run", "seen", "state", "stock"), distinct_rows)
    return rows.groupBy("url").transformWithState(DeadLinks(keep_days), OUTCOMES, "append", "processingTime")
