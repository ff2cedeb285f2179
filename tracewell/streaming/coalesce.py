"""Occurrences of sessions, coalesced by priority into one notification at a time, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TTL_MS, WINDOW_MS, INTERVAL_MS, REMEMBERED = 2000, 150, 1000, 256
RESULT = "session string, key string, priority int, at_ms long"
STATE = "key string, priority int, ready_ms long, expires_ms long, last_ms long, seen array<string>"


def fold(events: list[tuple[int, str, int, int]], state: tuple) -> tuple[list[tuple[str, int, int]], tuple]:
    """What is given out while ``events`` (now, key, priority, occurred) arrive in order, and the state after them.

    One notification waits at a time.  One of equal or higher priority takes its
    place and keeps the time at which it is ready; it comes no sooner than the
    minimum interval after the one before, and is dropped when its time to live is
    over.  A key counts once while it is remembered.
    """
    key, priority, ready, expires, last, seen = state
    out, seen = [], list(seen)
    for now, name, rank, occurred in events:
        if key is not None:
            due = max(ready, last + INTERVAL_MS)
            if due <= now and due < expires:
                out.append((key, priority, due))
                key, last = None, due
            elif now >= expires:
                key = None
        if name in seen:
            continue
        seen = [*seen, name][-REMEMBERED:]
        if occurred > now or now >= occurred + TTL_MS or (key is not None and rank < priority):
            continue
        ready = ready if key is not None else now + WINDOW_MS
        key, priority, expires = name, rank, occurred + TTL_MS
    return out, (key, priority, ready, expires, last, seen)


START = (None, 0, 0, 0, -(1 << 40), [])


def coalesced(occurrences: DataFrame) -> DataFrame:
    """Notifications (session, key, priority, at_ms) of a stream of occurrences (session, now_ms, key, priority, occurred_ms).

    Occurrences of a micro-batch are taken in order of now_ms.  What waits when no
    more come is given out after the time to live by processing time.  Rows with a
    null are left out.  The state of a session is one notification and the keys
    remembered.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else START
        if state.hasTimedOut:
            end = held[3] if held[0] is not None else 0
            done, held = fold([(end - 1, "\u0000", -1, end)], held)  # an arrival that is not taken, just before the end
            held = (None, *held[1:5], [k for k in held[5] if k != "\u0000"])
        else:
            rows = pd.concat(list(frames)).dropna().sort_values("now_ms", kind="stable")
            events = [(int(n), k, int(p), int(o)) for n, k, p, o in zip(rows["now_ms"], rows["key"], rows["priority"], rows["occurred_ms"], strict=True)]
            done, held = fold(events, held)
        state.update(held)
        if held[0] is not None:
            state.setTimeoutDuration(TTL_MS)
        yield pd.DataFrame([(key[0], *x) for x in done], columns=["session", "key", "priority", "at_ms"])

    return occurrences.groupBy("session").applyInPandasWithState(run, RESULT, STATE, "append", "ProcessingTimeTimeout")


def coalesced_batch(occurrences: DataFrame) -> DataFrame:
    """``coalesced`` of a finite table, each session to its end."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        session = rows["session"].iloc[0]
        rows = rows.dropna().sort_values("now_ms", kind="stable")
        events = [(int(n), k, int(p), int(o)) for n, k, p, o in zip(rows["now_ms"], rows["key"], rows["priority"], rows["occurred_ms"], strict=True)]
        done, held = fold(events, START)
        done += fold([(held[3] - 1, "\u0000", -1, held[3])], held)[0] if held[0] is not None else []
        return pd.DataFrame([(session, *x) for x in done], columns=["session", "key", "priority", "at_ms"])

    return occurrences.where("session is not null").groupBy("session").applyInPandas(run, RESULT)
