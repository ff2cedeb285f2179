"""Lines of running jobs, gathered into small batches by a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SPAN_MS = 200
MOST_LINES = 20
RESULT = "job string, opened_ms long, lines array<string>, omitted long"
STATE = "opened_ms long, lines array<string>, omitted long"


def line_batches(lines: DataFrame, span_ms: int = SPAN_MS, most: int = MOST_LINES) -> DataFrame:
    """Batches of a stream (job, ms, line): job, opened_ms, lines, omitted.

    The first line that is not blank opens a batch, which takes the lines of the
    next ``span_ms`` milliseconds and does not move with them, unlike a session
    window.  It keeps ``most`` lines and counts the rest.  Lines of a micro-batch
    are taken in order of time.  A batch is given out when a later line closes it
    or, if none comes, after ``span_ms`` of processing time.  Null and blank lines
    open and join nothing.  The state of a job is one open batch.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, held, omitted = state.get if state.exists else (None, [], 0)
        held, done = list(held), []
        if state.hasTimedOut:
            done.append((key[0], opened, held, omitted))
            state.remove()
        else:
            rows = pd.concat(list(frames)).dropna(subset=["ms", "line"])
            rows = rows[rows["line"].str.strip() != ""].sort_values("ms", kind="stable")
            for ms, line in zip(rows["ms"], rows["line"], strict=True):
                if opened is not None and ms >= opened + span_ms:
                    done.append((key[0], opened, held, omitted))
                    opened, held, omitted = None, [], 0
                opened = int(ms) if opened is None else opened
                if len(held) < most:
                    held.append(line)
                else:
                    omitted += 1
            if opened is not None:
                state.update((opened, held, omitted))
                state.setTimeoutDuration(span_ms)
        yield pd.DataFrame(done, columns=["job", "opened_ms", "lines", "omitted"])

    return lines.groupBy("job").applyInPandasWithState(run, RESULT, STATE, "append", "ProcessingTimeTimeout")
