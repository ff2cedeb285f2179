"""Differences of two snapshots, and the graph that depends on them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: After so many levels those found are written together, so that a plan stays short.
MERGE_LEVELS = 16


def delta(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, sha): added, deleted, modified or untouched."""
    b, c = base.select("path", F.col("sha").alias("old")), candidate.select("path", F.col("sha").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("untouched")
    return b.join(c, "path", "full_outer").select("path", change.alias("change"))


def overlay(status: DataFrame, numstat: DataFrame) -> DataFrame:
    """Left join of changed paths with their line counts; missing counts are 0.

    Of counts that repeat a path the one of the largest pos holds, where there is such
    a column, else the largest; untracked copies of installed packages are left out.
    """
    at = F.struct(*[F.col(c) for c in (["pos"] if "pos" in numstat.columns else []) + ["added", "deleted"]])
    once = numstat.groupBy("path").agg(F.max_by(F.struct("added", "deleted"), at).alias("n")).select("path", "n.added", "n.deleted")
    kept = status.where(~F.col("path").rlike(r"(^|/)node_modules\.backup-")) if "state" not in status.columns else status.where(~(F.col("path").rlike(r"(^|/)node_modules\.backup-") & (F.col("state") == "??")))
    return kept.join(once, "path", "left").na.fill(0, ["added", "deleted"])


def index_delta(previous: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, change) of previous hashes (path, sha) against a scan (path, sha, status); a scanned status "deleted" wins."""
    b, c = previous.select("path", F.col("sha").alias("old")), scan.select("path", F.col("sha").alias("new"), "status")
    gone = F.coalesce(F.col("status") == "deleted", F.lit(False)) | F.col("new").isNull()
    change = F.when(gone, "deleted").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "modified").otherwise("untouched")
    # What is scanned as deleted and was never there is no change.
    return b.join(c, "path", "full_outer").where(~(gone & F.col("old").isNull())).select("path", change.alias("change"))


def change_rollup(changes: DataFrame) -> DataFrame:
    """Per root: files, lines added and deleted."""
    return changes.groupBy("root").agg(F.count_distinct("path").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def flat_changes(changes: DataFrame) -> DataFrame:
    """(path, added, deleted) over all roots; the path begins with the root's name only where there are several roots."""
    several = F.broadcast(changes.agg((F.count_distinct("root") > 1).alias("several")))  # one row
    path = F.when(F.col("several"), F.concat_ws("/", "root", "path")).otherwise(F.col("path"))
    return changes.crossJoin(several).select(path.alias("path"), "added", "deleted")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a session of one process gets a temporary folder; on
    a cluster that is an error, as the executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """Writes a level into the shared folder and reads it back."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def dependents(edges: DataFrame, targets: DataFrame, transitive: bool = True) -> DataFrame:
    """(importer, depth, via) of everything that reaches ``targets`` (path) over edges (edge_index, importer, target).

    Level by level until one is empty, which comes as each level adds new nodes; an
    importer is taken at its least depth, and within a level the edge of largest
    index names ``via``.  Targets themselves are left out.
    """
    seen = frontier = targets.select("path").distinct()
    found, depth = None, 0
    while True:
        depth += 1
        step = edges.join(frontier.withColumnRenamed("path", "target"), "target").join(seen.withColumnRenamed("path", "importer"), "importer", "left_anti")
        level = _cut(step.groupBy("importer").agg(F.max_by("target", "edge_index").alias("via")).withColumn("depth", F.lit(depth).cast("long")))
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        frontier = level.select(F.col("importer").alias("path"))
        seen = seen.unionByName(frontier)
        if not transitive:
            break
        if depth % MERGE_LEVELS == 0:
            found, seen = _cut(found), _cut(seen)
    if found is None:
        found = edges.limit(0).select("importer", F.col("target").alias("via"), F.lit(0).cast("long").alias("depth"))
    return found.select("importer", "depth", "via")
