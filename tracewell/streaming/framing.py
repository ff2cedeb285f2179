"""Chunks of a job's output as its lines: a line may span chunks, and the last one ends with the job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.agent_events import tail

#: Fixed value: characters of a line that are kept, its last ones.
WIDTH = 2000


def frame(partial: str, text: str, end: bool) -> tuple[list[str], str]:
    """Lines that ``text`` completes, and what is left of the last one, but for what a cut line would not show."""
    *done, rest = (partial + text).split("\n")
    if end:
        done, rest = [*done, rest], ""
    cut = lambda s: s if len(s) <= WIDTH else "…" + s[-WIDTH:]
    return [cut(s.removesuffix("\r")) for s in done], rest[-WIDTH - 2 :]


def lines_of(chunks: DataFrame) -> DataFrame:
    """(job, line_no, line) of finished jobs' chunks (job, seq, chunk), lines numbered from 0.

    A chunk's fragments are placed by the line ends before it, and fragments of one
    number are one line; of a long line only the fragments that hold its kept end are
    gathered.  A carriage return at a line's end goes; what follows the last line end
    is a line too, empty where nothing does.  Null chunks count as empty.
    """
    parts = F.split(F.coalesce("chunk", F.lit("")), "\n")
    step = W.partitionBy("job").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = chunks.select("job", "seq", parts.alias("parts")).withColumn("before", F.coalesce(F.sum(F.size("parts") - 1).over(step), F.lit(0)))
    each = rows.select("job", "seq", "before", F.posexplode("parts").alias("at", "part")).select("job", "seq", (F.col("before") + F.col("at")).cast("long").alias("line_no"), "part")
    after = F.coalesce(F.sum(F.char_length("part")).over(W.partitionBy("job", "line_no").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = each.withColumn("after", after).where(F.col("after") <= WIDTH + 2).groupBy("job", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "").alias("line"))
    return kept.select("job", "line_no", tail(F.regexp_replace("line", "\r$", ""), WIDTH + 1).alias("line"))


class FramingProcessor(StatefulProcessor):
    """State of a job: the beginning of a line that is not complete."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("partial", "partial string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        partial = self.held.get()[0] if self.held.exists() else ""
        out: list[str] = []
        ended = False
        for chunk, end in (x for df in [pd.concat(list(rows)).sort_values("seq", kind="stable")] for x in zip(df["chunk"], df["end"], strict=True)):
            done, partial = frame(partial, chunk or "", bool(end))
            out, ended = out + done, bool(end)
        self.held.clear() if ended else self.held.update((partial,))
        yield pd.DataFrame([(key[0], x) for x in out], columns=["job", "line"])

    def close(self) -> None:
        pass


def line_stream(chunks: DataFrame) -> DataFrame:
    """Lines (job, line) of a stream of chunks (job, seq, chunk, end), as ``lines_of``; ``end`` marks a job's last chunk.

    Chunks of a micro-batch are taken by seq.  The state of a job is at most a line's kept end.  Needs the RocksDB state store.
    """
    return chunks.where("job is not null").groupBy("job").transformWithStateInPandas(FramingProcessor(), "job string, line string", "Append", "None")
