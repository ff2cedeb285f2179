"""Trees that are told by parents: ancestors, and what holds on a branch as of an entry.

Pointers are doubled: after k rounds a row reaches 2**k steps up, so that a chain of
any length takes a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import language
from .snapshots import _cut


def closure(parents: DataFrame, kept: DataFrame) -> DataFrame:
    """(id) of everything that must stay: ``kept`` (id) and all their ancestors over ``parents`` (id, parent).

    A round takes in what lies one jump above anything kept so far, and doubles the
    jumps: all that lies up to 2**k - 1 steps above is kept after k rounds, and a
    round that finds nothing new is the last, as a nearest missing ancestor would lie
    one jump above one that is kept.  Cycles end likewise.  Rows may name several
    parents of an id.
    """
    seen = _cut(kept.select("id").where("id is not null").distinct())
    jumps = _cut(parents.where("parent is not null and id <> parent").select("id", "parent").distinct())
    while True:
        above = jumps.join(seen, "id", "left_semi").select(F.col("parent").alias("id")).distinct()
        fresh = _cut(above.join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = _cut(seen.unionByName(fresh))
        onward = jumps.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        jumps = _cut(jumps.join(onward, "parent").where("id <> next").select("id", F.col("next").alias("parent")).distinct())


def as_of(entries: DataFrame) -> DataFrame:
    """(id, receipt, steps): of each entry (id, parent, receipt) the nearest receipt on its branch, and how many steps up it is.

    The entry's own receipt is nearest; null where the branch has none.  An entry
    whose parent is not there begins a branch; one that leads round a circle has none.
    """
    known = entries.select("id", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("far"), "receipt", F.when(F.col("receipt").isNotNull(), F.lit(0)).cast("long").alias("steps"))
    known = _cut(known)
    for _ in range(known.count().bit_length() + 1):
        open_ = known.where("receipt is null and jump is not null")
        if open_.isEmpty():
            break
        there = known.select(F.col("id").alias("t_id"), F.col("jump").alias("t_jump"), F.col("far").alias("t_far"), F.col("receipt").alias("t_receipt"), F.col("steps").alias("t_steps"))
        step = open_.join(there, open_.jump == there.t_id, "left").select("id", F.col("t_jump").alias("jump"), (F.col("far") + F.coalesce("t_far", F.lit(0))).alias("far"), F.col("t_receipt").alias("receipt"), (F.col("far") + F.col("t_steps")).alias("steps"))
        known = _cut(known.where("receipt is not null or jump is null").unionByName(step))
    return known.select("id", "receipt", "steps")


def history(heads: DataFrame, entries: DataFrame, snapshots: DataFrame, symbols: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Facts of the last snapshot on each branch: what held when it was recorded, not now.

    heads: head, id - the last entry of a branch.  entries: id, parent, receipt.
    snapshots: receipt, path.  symbols: receipt, path, name, kind, start_line.
    Without ``names``: (head, status, receipt, path, symbols, language), the files of
    the snapshot.  With ``names`` (name): (head, status, receipt, name, path, kind,
    start_line) of the symbols of these names, in any case.  A branch without a
    receipt is one row with status "unavailable".
    """
    at = heads.join(as_of(entries).select("id", "receipt"), "id", "left").select("head", "receipt", F.when(F.col("receipt").isNull(), "unavailable").otherwise("historical").alias("status"))
    if names is None:
        counts = symbols.groupBy("receipt", "path").agg(F.count("*").alias("symbols"))
        files = snapshots.select("receipt", "path").join(counts, ["receipt", "path"], "left").select("receipt", "path", F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"), language(F.col("path")).alias("language"))
        return at.join(files, "receipt", "left").select("head", "status", "receipt", "path", "symbols", "language")
    asked = names.select(F.lower("name").alias("low")).distinct()
    found = symbols.withColumn("low", F.lower("name")).join(asked, "low").select("receipt", "name", "path", "kind", "start_line")
    return at.join(found, "receipt", "left").where("status = 'unavailable' or path is not null").select("head", "status", "receipt", "name", "path", "kind", "start_line")
