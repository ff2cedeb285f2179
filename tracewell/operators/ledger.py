"""Ledgers that grow by batches: advisories, memories, prompt stores, generations of snapshots.

Every operator returns the new state as a DataFrame; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import trimmed

ADVICE = ("key", "identity", "manifest", "location", "status", "occurrences", "last_seen")


def record_findings(ledger: DataFrame, findings: DataFrame, manifest: str, now: int, most: int = 500) -> DataFrame:
    """The ledger (key, identity, manifest, location, status, occurrences, last_seen) after findings (key, identity, location) of one manifest.

    A known key is touched; a known identity of another manifest moves to the new key
    and counts one occurrence more; anything else is new.  The ``most`` seen last stay.
    A finding repeated in one batch counts once.
    """
    once = findings.groupBy("key").agg(F.min("identity").alias("identity"), F.min("location").alias("location"))
    touched = ledger.join(once.select("key"), "key", "left_semi").withColumn("last_seen", F.lit(now).cast("long"))
    fresh = once.join(ledger.select("key"), "key", "left_anti")
    prior = ledger.join(once.select("key"), "key", "left_anti").where(F.col("manifest") != manifest)
    old = prior.groupBy("identity").agg(F.max_by(F.struct("key", "occurrences"), F.struct("last_seen", "key")).alias("old"))
    new = fresh.join(old, "identity", "left").withColumn("__n", F.row_number().over(W.partitionBy("identity").orderBy("key")))
    moved = F.col("old").isNotNull() & (F.col("__n") == 1)
    added = new.select("key", "identity", F.lit(manifest).alias("manifest"), "location", F.lit("open").alias("status"), F.when(moved, F.col("old.occurrences") + 1).otherwise(1).cast("long").alias("occurrences"), F.lit(now).cast("long").alias("last_seen"))
    gone = new.where(moved).select(F.col("old.key").alias("key"))
    rest = ledger.join(once.select("key"), "key", "left_anti").join(gone, "key", "left_anti")
    cast = lambda df: df.select("key", "identity", "manifest", "location", "status", F.col("occurrences").cast("long").alias("occurrences"), F.col("last_seen").cast("long").alias("last_seen"))
    return cast(rest).unionByName(cast(touched)).unionByName(cast(added)).orderBy(F.desc("last_seen"), "key").limit(most)


def mark_fixed(ledger: DataFrame, findings: DataFrame, locations: DataFrame, manifest: str) -> DataFrame:
    """The ledger with open advisories of earlier manifests marked fixed where their location is still there and their identity is found no more."""
    seen = findings.select("identity").distinct().withColumn("__found", F.lit(True))
    there = locations.select("location").distinct().withColumn("__there", F.lit(True))
    both = ledger.join(seen, "identity", "left").join(there, "location", "left")
    fixed = (F.col("status") == "open") & (F.col("manifest") != manifest) & F.col("__there").isNotNull() & F.col("__found").isNull()
    return both.withColumn("status", F.when(fixed, "fixed").otherwise(F.col("status"))).select(ledger.columns)


def memories(lines: DataFrame, session: str, branches: DataFrame | None = None) -> DataFrame:
    """The last line of each id (id, session, branch, observed_at, pos, summary) of one session, of the given branches alone."""
    rows = lines.where(F.col("session") == session).where("id is not null")
    if branches is not None:
        rows = rows.join(branches.select("branch").distinct(), "branch", "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in lines.columns])
    return rows.groupBy(F.col("id").alias("__id")).agg(F.max_by(whole, "pos").alias("__row")).select("__row.*").orderBy(F.desc("observed_at"), "id")


def memory_search(records: DataFrame, query: str) -> DataFrame:
    """Records whose summary contains the query, in any case; a blank query keeps all."""
    q = query.strip().lower()
    return records.where(F.lower("summary").contains(q)) if q else records


def authored_lines(changes: DataFrame, keys: list[str], golden: str) -> DataFrame:
    """Per key: lines added and deleted but in golden paths, binaries (null counts) and mode changes."""
    own = ~F.col("path").rlike(golden) & F.col("added").isNotNull() & F.col("deleted").isNotNull()
    return changes.groupBy(*keys).agg(F.sum(F.when(own, F.col("added") + F.col("deleted")).otherwise(0)).cast("long").alias("lines"))


def publish(parent: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest (path, op, sha) of a new generation against its parent's files (path, sha): upserts and deletes; empty where nothing changed."""
    old = parent.select("path", F.col("sha").alias("old"))
    both = old.join(files.select("path", "sha"), "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("sha")))
    return both.select("path", F.when(F.col("sha").isNull(), "delete").otherwise("upsert").alias("op"), "sha")


def load_generation(manifests: DataFrame, upto: int) -> DataFrame:
    """(path, sha) after all manifests (generation, path, op, sha) up to one generation: the last word on each path holds."""
    last = manifests.where(F.col("generation") <= upto).groupBy("path").agg(F.max_by(F.struct("op", "sha"), "generation").alias("x"))
    return last.where("x.op = 'upsert'").select("path", "x.sha")


def dropped_paths(parent: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of the parent that is no more."""
    return parent.select("path").distinct().join(files.select("path"), "path", "left_anti")


def append_artifact(ledger: DataFrame, proofs: DataFrame) -> DataFrame:
    """``proofs`` (fingerprint, status) with the next seq of each fingerprint in the ledger (fingerprint, seq), from 1; its largest seq is current."""
    last = ledger.groupBy("fingerprint").agg(F.max("seq").alias("last"))
    step = F.row_number().over(W.partitionBy("fingerprint").orderBy("status"))
    return proofs.join(last, "fingerprint", "left").select("fingerprint", (F.coalesce("last", F.lit(0)) + step).cast("long").alias("seq"), "status")


def append_prompts(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Prompts that a store takes: not null, not blank, no /command."""
    return prompts.where((trimmed(text) != "") & ~trimmed(text, "left").startswith("/"))


def compaction(files: DataFrame, entries: DataFrame, hidden: DataFrame, newest: int = 10, most_files: int = 50, most_entries: int = 5000) -> DataFrame:
    """(text, ts) that a compacted file of each project would hold; files (project, file, key, seed), entries (project, file, text, ts), hidden (text).

    A project is due beyond ``most_files`` files or ``most_entries`` entries; all but its
    newest files and seeds are merged, at least two, without what is hidden.
    """
    size = files.groupBy("project").agg(F.count("*").alias("files")).join(entries.groupBy("project").agg(F.count("*").alias("entries")), "project", "left")
    due = size.where((F.col("files") > most_files) | (F.coalesce("entries", F.lit(0)) > most_entries)).select("project")
    rank = F.row_number().over(W.partitionBy("project").orderBy(F.desc("key"), "file"))
    old = files.join(due, "project", "left_semi").withColumn("__rank", rank).where(F.col("__rank") > newest).where(~F.coalesce("seed", F.lit(False)))
    enough = old.groupBy("project").agg(F.count("*").alias("n")).where("n >= 2").select("project")
    return entries.join(old.join(enough, "project", "left_semi").select("project", "file"), ["project", "file"], "left_semi").join(hidden.select("text").distinct(), "text", "left_anti").select("project", "text", "ts")


def sweep(entries: DataFrame, gone: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """Entries without those whose key equals that of a text in ``gone``, and one row: affected files and removed entries.

    key: a function of a column, such as the prompt identity.
    """
    names = gone.select(key(F.col("text")).alias("__key")).distinct()
    keyed = entries.withColumn("__key", key(F.col("text")))
    hit = keyed.join(names, "__key", "left_semi")
    return keyed.join(names, "__key", "left_anti").drop("__key"), hit.agg(F.count_distinct("file").alias("files"), F.count("*").alias("removed"))


def seed(sessions: DataFrame, present: DataFrame, hidden: DataFrame, key, target: int) -> DataFrame:
    """Prompts that fill a store up to ``target``: the newest of sessions (text, ts) not present and not hidden, each once, oldest first."""
    have = present.select(key(F.col("text")).alias("__key")).unionByName(hidden.select(key(F.col("text")).alias("__key"))).distinct()
    newest = sessions.select(key(F.col("text")).alias("__key"), "text", "ts").where(F.col("__key") != "").groupBy("__key").agg(F.max_by(F.struct("text", "ts"), F.struct("ts", "text")).alias("r"))
    room = max(0, target - present.count())
    return newest.join(have, "__key", "left_anti").select("r.text", "r.ts").orderBy(F.desc("ts"), "text").limit(room).orderBy("ts", "text")


def export_rows(rows: DataFrame, batch: str, most_rows: int = 32, most_bytes: int = 16_384) -> DataFrame:
    """(batch, payload) of rows as JSON lines; a batch of too many rows or bytes is left out whole."""
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns) if c != batch]))
    size = rows.groupBy(batch).agg(F.count("*").alias("n"), F.sum(F.octet_length(whole)).alias("bytes")).where((F.col("n") <= most_rows) & (F.col("bytes") <= most_bytes))
    return rows.join(size.select(batch), batch, "left_semi").select(F.col(batch), whole.alias("payload"))


def merged_batches(a: DataFrame, b: DataFrame, most: int = 20) -> DataFrame:
    """Batches (job, lines, omitted) of two sources merged by job under one cap: the lines of a come first, what exceeds ``most`` is counted."""
    both = a.select("job", F.col("lines").alias("la"), F.col("omitted").alias("oa")).join(b.select("job", F.col("lines").alias("lb"), F.col("omitted").alias("ob")), "job", "full_outer")
    none = F.array().cast("array<string>")
    lines = F.concat(F.coalesce("la", none), F.coalesce("lb", none))
    return both.select("job", F.slice(lines, 1, most).alias("lines"), (F.coalesce("oa", F.lit(0)) + F.coalesce("ob", F.lit(0)) + F.greatest(F.lit(0), F.size(lines) - most)).cast("long").alias("omitted"))


def todo_state(entries: DataFrame) -> DataFrame:
    """Per branch: the state of the last tool result without an error (branch, pos, is_error, state)."""
    return entries.where(~F.coalesce("is_error", F.lit(False))).where("state is not null").groupBy("branch").agg(F.max_by("state", "pos").alias("state"))


def task_records(events: DataFrame) -> DataFrame:
    """Per task: messages, tools, tokens, the last status and the last step (task, pos, kind, status, step, tokens)."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("pos"), F.col(c).alias("v"))))["v"].alias(c)
    return events.groupBy("task").agg(F.count_if(F.col("kind") == "message").alias("messages"), F.count_if(F.col("kind") == "tool").alias("tools"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), last("status"), last("step"))


def threads(events: DataFrame, most: int) -> DataFrame:
    """The last ``most`` events of each task's thread with dropped, the number before them."""
    n = F.count("*").over(W.partitionBy("task"))
    at = F.row_number().over(W.partitionBy("task").orderBy("pos"))
    out = events.withColumn("__n", n).withColumn("__at", at).where(F.col("__at") > F.col("__n") - most)
    return out.withColumn("dropped", F.greatest(F.lit(0), F.col("__n") - most).cast("long")).drop("__n", "__at")


def progress(deltas: DataFrame) -> DataFrame:
    """Deltas (message, block, pos, text) that are progress: the first of each fingerprint within its message and block."""
    whole = F.struct(*[F.col(f"`{c}`") for c in deltas.columns])
    return deltas.groupBy(F.col("message").alias("__m"), F.col("block").alias("__b"), F.sha2("text", 256).alias("__t")).agg(F.min_by(whole, "pos").alias("__row")).select("__row.*")


def changed_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(path) of files (path, size, mtime) that are new or differ in size or time from those read last."""
    return listing.join(manifest.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti").select("path")
