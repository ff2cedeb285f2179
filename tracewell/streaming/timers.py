"""Monitors of running jobs as a stream of states and timers.

A monitor gathers its job's lines into batches, ends on a flood, on its timeout or
with the job, and gives out what it holds before it tells of its end.  Each batch and
each timeout is a registered timer: nothing waits for a later row of the same job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Span of a batch, lines of a notice, lines and span of a flood, and the longest timeout.
BATCH_MS, NOTICE_LINES = 200, 20
FLOOD_LINES, FLOOD_MS = 120, 60_000
MOST_SECONDS = 1800

RESULT = "job string, kind string, reason string, at_ms long, lines array<string>, omitted long"
COLUMNS = ["job", "kind", "reason", "at_ms", "lines", "omitted"]


class Monitor:
    """What a monitor holds, and what it gives out when something comes or a time is reached.

    ends is the time of its timeout, None before its start and after its end; due that
    of the open batch; recent the times of the lines of the last FLOOD_MS.
    """

    def __init__(self, ends: int | None = None, due: int | None = None, lines: list[str] | None = None, omitted: int = 0, recent: list[int] | None = None):
        self.ends, self.due, self.lines, self.omitted, self.recent = ends, due, lines or [], omitted, recent or []

    def flush(self, at: int) -> list[tuple]:
        out = [("events", None, at, self.lines, self.omitted)] if self.due is not None else []
        self.due, self.lines, self.omitted = None, [], 0
        return out

    def stop(self, reason: str | None, at: int) -> list[tuple]:
        """Held lines first, then the notice of the end; a job that ends by itself gives its own."""
        out = self.flush(at) + ([("stopped", reason, at, [], 0)] if reason else [])
        self.ends, self.recent = None, []
        return out

    def reach(self, now: int) -> list[tuple]:
        """Timers up to ``now``, in their order; a batch and the timeout at one time are one end."""
        out = []
        if self.due is not None and self.due <= now and (self.ends is None or self.due < self.ends):
            out += self.flush(self.due)
        if self.ends is not None and self.ends <= now:
            out += self.stop("timeout", self.ends)
        return out

    def take(self, kind: str, ms: int, value: str | None) -> list[tuple]:
        """A row of the job: start (value: seconds), line, exit, or cancel, which drops what is held.

        An exit at the very time of the timeout is the job's own end.
        """
        out = self.reach(ms - 1 if kind == "exit" else ms)
        if kind == "start" and self.ends is None:
            seconds = int(value) if (value or "").isascii() and (value or "").isdigit() else 0
            if 1 <= seconds <= MOST_SECONDS:
                self.ends = ms + seconds * 1000
        elif kind == "exit" and self.ends is not None:
            out += self.stop(None, ms)
        elif kind == "cancel":
            self.due, self.lines, self.omitted = None, [], 0
            self.stop(None, ms)
        elif kind == "line" and self.ends is not None and (value or "").strip():
            self.recent = [t for t in self.recent if ms - t < FLOOD_MS] + [ms]
            self.due = ms + BATCH_MS if self.due is None else self.due
            if len(self.lines) < NOTICE_LINES:
                self.lines.append(value)
            else:
                self.omitted += 1
            if len(self.recent) > FLOOD_LINES:
                out += self.stop("flood", ms)
        return out


class MonitorProcessor(StatefulProcessor):
    """State of a job: a Monitor in one value, and a timer for the next time that it waits for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("monitor", "ends long, due long, lines array<string>, omitted long, recent array<long>")

    def _load(self) -> Monitor:
        if not self.held.exists():
            return Monitor()
        ends, due, lines, omitted, recent = self.held.get()
        return Monitor(ends, due, list(lines), omitted, list(recent))

    def _store(self, m: Monitor) -> None:
        """A monitor that has ended leaves no state and no timer."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if m.ends is None:
            self.held.clear()
        else:
            self.held.update((m.ends, m.due, m.lines, m.omitted, m.recent))
            self.handle.registerTimer(m.ends if m.due is None else min(m.ends, m.due))

    def _told(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).dropna(subset=["ms", "kind"]).sort_values(["ms", "kind"], ascending=[True, False], kind="stable")
        m, out = self._load(), []
        for kind, ms, value in zip(frame["kind"], frame["ms"], frame["value"], strict=True):
            out += m.take(kind, int(ms), value)
        self._store(m)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        m = self._load()
        out = m.reach(expiredTimerInfo.getExpiryTimeInMs())
        self._store(m)
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def monitors(events: DataFrame) -> DataFrame:
    """Notices (job, kind, reason, at_ms, lines, omitted) of a stream (job, kind, ms, value, ts) with a watermark on ts.

    kind: start, line, exit or cancel; ms: the time in milliseconds, ts the same as a
    timestamp.  The first line that is not blank opens a batch, given out BATCH_MS
    later with its first NOTICE_LINES lines and a count of the rest.  More than
    FLOOD_LINES lines in FLOOD_MS, or the seconds that the start names (1 to
    MOST_SECONDS, else the monitor does not start), stop the monitor: held lines
    first, then a notice "stopped".  The job's own exit wins over a timeout of the
    same time and gives held lines only.  After its end a monitor tells nothing, unless
    its job is started again.
    Timers fire as the watermark passes them.  Rows with a null job, kind or ms are
    left out.  Needs the RocksDB state store.
    """
    keyed = events.where("job is not null and kind is not null and ms is not null")
    return keyed.groupBy("job").transformWithStateInPandas(MonitorProcessor(), RESULT, "Append", "EventTime")


def monitors_batch(events: DataFrame) -> DataFrame:
    """``monitors`` of a finite table, each job to its end: a fold over rows sorted by job and time, which carries one monitor.

    A job's rows never meet as a group: they pass one after the other, so a job of any length takes the memory of its monitor.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, m = None, Monitor()
        for frame in frames:
            out = []
            for name, kind, ms, value in zip(frame["job"], frame["kind"], frame["ms"], frame["value"], strict=True):
                if name != job:
                    out += [(job, *x) for x in m.reach(1 << 62)] if job is not None else []
                    job, m = name, Monitor()
                out += [(job, *x) for x in m.take(kind, int(ms), value)]
            yield pd.DataFrame(out, columns=COLUMNS)
        if job is not None:
            yield pd.DataFrame([(job, *x) for x in m.reach(1 << 62)], columns=COLUMNS)

    rows = events.where("job is not null and kind is not null and ms is not null").select("job", "kind", "ms", "value")
    # At one time a start comes before lines, and an exit after them.
    return rows.repartition("job").sortWithinPartitions("job", "ms", rows.kind.desc(), "value").mapInPandas(run, RESULT)
