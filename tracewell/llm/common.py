"""Shared helpers: table reading, durable intermediate tables, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, which the session must name.

    Where the session names none, a session of one process gets a temporary folder;
    on a cluster that is an error, as such a folder would be seen by the driver alone.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths written by ``settle`` inside the innermost ``tidy``.
_scratch: list[list[str]] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet into the shared folder and reads it back.

    Later jobs read the files, so a lost executor costs a re-read, not a
    recomputation of everything before.  Inside ``tidy`` the files go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tracewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes at its end what ``settle`` wrote inside it, but for tables settled by the function it yields."""
    mine: list[str] = []
    _scratch.append(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = settle(df, name)
        path = mine.pop()
        if len(_scratch) > 1:
            _scratch[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _scratch.pop()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in mine:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Bytes of text that a task turns into Python strings at once, unless one text alone is longer.
BLOCK_BYTES = 1 << 22


def blocks(batch: pa.RecordBatch, rows: int = 500, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and BLOCK_BYTES of text; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + BLOCK_BYTES, side="right"))), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def map_texts(rows: DataFrame, make: Callable[[], Callable[[list[str]], list]], schema: str, block: int = 500) -> DataFrame:
    """The columns of ``rows`` but ``text``, unchanged, and those of ``schema``, computed from ``text`` in Arrow batches.

    make() is called once per task and gives a function from at most ``block`` texts,
    of BLOCK_BYTES together, to a list of columns.  The other columns never become pandas values, so that null
    ids and ids above 2**53 stay what they are.
    """
    new = StructType.fromDDL(schema)
    rest = [c for c in rows.columns if c != "text"]
    out = StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name != "text"] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in blocks(batch, block):
                columns = work(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[*rest, *new.names])

    return rows.mapInArrow(run, out)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text only; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b); component is the smallest id reachable.

    Large-star and small-star steps (Kiveris et al., 2014) until only stars are
    left.  Minima are taken with map-side combination and written before
    the join, so the join's sides are plain exchanges that AQE can split at hubs.
    Null ends and loops are left out.  No edge: an empty result.
    """
    e = settle(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )

    def are_stars(df: DataFrame) -> bool:
        """Whether every leaf u has one centre v and no centre is a leaf; as v < u, each centre is the smallest of its star."""
        roles = df.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(df.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        return roles.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf + centre > 1").count() == 0

    for _ in range(rounds):
        if are_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct(), "large")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str, *, settled=settle) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 in its group by ``order`` (nulls first), and ``n``, the group's rows, both long.

    No group meets in one task: rows are dealt by ranges of (group, order, position
    in the input), so that a group of any size, or of equal rows, spreads over as
    many tasks as it needs; counts per task and group, at most one row for each task
    that a group touches, give the places before each task by a running sum.
    """
    keys = [*group, *order]
    placed = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    placed = settled(placed.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__at", 33))
    mine = W.partitionBy(*group)
    spans = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__count"))
    spans = spans.select(*group, "__part", "__first", F.sum("__count").over(mine).alias("n"), F.coalesce(F.sum("__count").over(mine.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(spans, [*group, "__part"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII string expression, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x::BIGINT) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"


class Memo:
    """Bounded memory of a Python worker: at most ``size`` entries of the current generation and of the one before."""

    def __init__(self, size: int):
        self.size = size
        self.now: dict = {}
        self.before: dict = {}

    def missing(self, need: set) -> set:
        """Keys of ``need`` to be put into ``now``; the others are there already."""
        now = self.now
        new = {k for k in need if k not in now}
        if len(self.now) + len(new) > self.size:
            self.now, self.before = {}, self.now
            new = need
        found = self.before.keys() & new
        self.now.update({k: self.before[k] for k in found})
        return new - found
