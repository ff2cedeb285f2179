"""Texts of version-control commands and manifests, one per row, as rows: counts, states, work trees, coverage, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import renamed

#: What the letters of a porcelain record stand for.
STATUS = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "added", "?": "untracked"}
#: Lock files of package managers, the first that is there decides.
LOCKS = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm"))


def numstat(texts: DataFrame, text: str = "text") -> DataFrame:
    """key columns, pos, path, added, deleted of "added<tab>deleted<tab>path" lines; "-" counts 0, lines of another form are left out."""
    keys = [c for c in texts.columns if c != text]
    lines = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    part = lambda n: F.regexp_extract("line", r"^([^\t]*)\t([^\t]*)\t(.*)$", n)
    count = lambda n: F.coalesce(F.regexp_extract("line", r"^\s*([+-]?\d+)[^\t]*\t" if n == 1 else r"^[^\t]*\t\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))
    return lines.where(F.col("line").rlike(r"^[^\t]*\t[^\t]*\t")).select(*keys, "pos", renamed(part(3)).alias("path"), count(1).alias("added"), count(2).alias("deleted"))


def porcelain(texts: DataFrame, text: str = "text") -> DataFrame:
    """key columns, path, status of NUL-separated "XY path" records; a rename takes the next record, its old path, along; directories are left out, of repeats the last counts."""
    keys = [c for c in texts.columns if c != text]
    records = F.filter(F.split(text, "\u0000"), lambda x: x != "")
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, x: F.when(acc["skip"], F.struct(F.lit(False).alias("skip"), acc["out"].alias("out"))).otherwise(F.struct(F.substring(x, 1, 1).isin("R", "C").alias("skip"), F.concat(acc["out"], F.array(x)).alias("out")))
    kept = texts.select(*keys, F.posexplode(F.aggregate(records, start, step, lambda acc: acc["out"])).alias("pos", "record"))
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    of = lambda i: F.try_element_at(names, F.substring("record", i, 1))
    rows = kept.select(*keys, "pos", F.expr("substring(record, 4)").alias("path"), F.coalesce(of(1), of(2), F.lit("modified")).alias("status")).where(~F.col("path").endswith("/"))
    return rows.groupBy(*keys, "path").agg(F.max_by("status", "pos").alias("status"))


def worktrees(texts: DataFrame, text: str = "text") -> DataFrame:
    """key columns, root, branch of work tree records, fields apart by one NUL and records by two; bare and prunable ones are left out."""
    keys = [c for c in texts.columns if c != text]
    fields = texts.select(*keys, F.explode(F.split(text, "\u0000\u0000")).alias("record")).select(*keys, F.split("record", "\u0000").alias("f"))
    value = lambda word: F.get(F.filter("f", lambda x: x.startswith(word + " ")), F.lit(0))
    bad = F.exists("f", lambda x: (x == "bare") | x.startswith("prunable"))
    rows = fields.where(~bad).select(*keys, F.regexp_replace(value("worktree"), "^worktree ", "").alias("root"), F.regexp_replace(F.regexp_replace(value("branch"), "^branch ", ""), "^refs/heads/", "").alias("branch"))
    return rows.where("root is not null and root <> ''")


def coverage(scripts: DataFrame, root: str, most_bytes: int = 65_536) -> DataFrame:
    """(run, path, truncated) of script URLs (run, url) below a root, distinct and in order, cut where the paths exceed ``most_bytes`` together; installed packages are left out."""
    from pyspark.sql import Window as W

    base = "file://" + root.rstrip("/") + "/"
    rows = scripts.where(F.col("url").startswith(base)).select("run", F.substring("url", len(base) + 1, 1 << 20).alias("path")).where(~F.concat(F.lit("/"), "path").contains("/node_modules/")).distinct()
    upto = F.sum(F.octet_length("path")).over(W.partitionBy("run").orderBy("path"))
    whole = F.sum(F.octet_length("path")).over(W.partitionBy("run"))
    return rows.withColumn("upto", upto).withColumn("truncated", whole > most_bytes).where(F.col("upto") <= most_bytes).select("run", "path", "truncated")


def package_managers(files: DataFrame) -> DataFrame:
    """(dir, manager) of listed files (path, declared): what the manifest declares, else by lock file in a fixed order, else npm; for each directory with a manifest."""
    at = files.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "declared")
    rank = F.coalesce(*[F.when(F.col("name") == lock, F.struct(F.lit(i).alias("i"), F.lit(manager).alias("manager"))) for i, (lock, manager) in enumerate(LOCKS)])
    both = at.groupBy("dir").agg(F.max(F.when(F.col("name") == "package.json", F.regexp_extract(F.coalesce("declared", F.lit("")), "^([a-z]+)", 1))).alias("declared"), F.min(rank)["manager"].alias("lock"))
    return both.where("declared is not null").select("dir", F.when(F.col("declared") != "", F.col("declared")).otherwise(F.coalesce("lock", F.lit("npm"))).alias("manager"))


def rate_limits(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """(snapshot, name, used_percent, seconds, reset_at) of quota payloads (snapshot, raw JSON): the primary and secondary windows; windows without a length or a use are dropped."""
    j = lambda w, f: F.get_json_object(raw, f"$.rate_limit.{w}_window.{f}").try_cast("double")
    window = lambda w: F.struct(F.lit(w).alias("name"), j(w, "used_percent").alias("used_percent"), j(w, "limit_window_seconds").alias("seconds"), j(w, "reset_at").alias("reset_at"))
    rows = payloads.select("snapshot", F.explode(F.array(window("primary"), window("secondary"))).alias("w")).select("snapshot", "w.*")
    return rows.where("used_percent is not null and seconds > 0")


def header_limits(headers: DataFrame, prefix: str) -> DataFrame:
    """(snapshot, name, used_percent, seconds) of response headers (snapshot, headers map): <prefix>-primary-used-percent and -window-minutes, and so for secondary."""
    h = lambda w, f: F.try_element_at("headers", F.lit(f"{prefix}-{w}-{f}")).try_cast("double")
    window = lambda w: F.struct(F.lit(w).alias("name"), h(w, "used-percent").alias("used_percent"), (h(w, "window-minutes") * 60).alias("seconds"))
    rows = headers.select("snapshot", F.explode(F.array(window("primary"), window("secondary"))).alias("w")).select("snapshot", "w.*")
    return rows.where("used_percent is not null and seconds > 0")


def quota_rows(rows: DataFrame) -> DataFrame:
    """Metered rows (snapshot, name, metered, used, budget) of snapshots all of whose metered rows can be read; one that cannot voids its snapshot."""
    bad = F.col("metered") & (F.col("used").isNull() | F.col("budget").isNull() | (F.col("budget") <= 0))
    void = rows.groupBy("snapshot").agg(F.bool_or(F.coalesce(bad, F.lit(True))).alias("void")).where(~F.col("void"))
    return rows.join(void.select("snapshot"), "snapshot", "left_semi").where("metered")


def presence(records: DataFrame, now_ms: int, recent_ms: int = 15_000) -> DataFrame:
    """``records`` (heartbeat, ...) with recent: the heartbeat is not in the future and at most ``recent_ms`` old."""
    age = F.lit(now_ms) - F.col("heartbeat")
    return records.withColumn("recent", F.coalesce((age >= 0) & (age <= recent_ms), F.lit(False)))


def transcript(lines: DataFrame) -> DataFrame:
    """(file, markdown) of messages (file, pos, role, kind, text): a section per message of a role, tool output as its last 2000 characters, thinking left out."""
    tail = F.when(F.char_length("text") > 2000, F.expr("right(text, 2000)")).otherwise(F.col("text"))
    body = F.when(F.col("kind") == "tool", F.concat(F.lit("```\n"), tail, F.lit("\n```"))).otherwise(F.col("text"))
    rows = lines.where("kind <> 'thinking' and text is not null").select("file", F.struct("pos", F.concat(F.lit("## "), "role", F.lit("\n\n"), body).alias("md")).alias("one"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["md"]), "\n\n").alias("markdown"))


def finished_tasks(records: DataFrame, keep: int = 100) -> tuple[DataFrame, DataFrame]:
    """Finished tasks (id, ended, legacy) newest first, and those to be pruned: beyond ``keep``, but for records of the old form."""
    newest = records.orderBy(F.desc("ended"), "id")
    kept = newest.limit(keep).select("id")
    return newest, records.join(kept, "id", "left_anti").where(~F.coalesce("legacy", F.lit(False)))


def readable(listing: DataFrame, most_bytes: int, budget: int) -> DataFrame:
    """Files (path, size) in order that fit ``most_bytes`` each and ``budget`` together."""
    from pyspark.sql import Window as W

    fits = listing.where(F.col("size") <= most_bytes)
    return fits.withColumn("__upto", F.sum("size").over(W.orderBy("path"))).where(F.col("__upto") <= budget).drop("__upto")  # a listing, not its contents


def task_events(raw: DataFrame) -> DataFrame:
    """(task, pos, n, kind, text) of raw agent events (task, pos, raw JSON): none, one or several each, in order."""
    j = lambda p: F.get_json_object("raw", p)
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    kind = j("$.type")
    made = (
        F.when(kind == "agent_start", F.array(event("status", F.lit("running")))).when(kind == "agent_end", F.array(event("status", F.lit("finished"))))
        .when(kind == "message_end", F.array(event("message", j("$.message.text")), event("usage", j("$.message.usage.totalTokens"))))
        .when(kind == "tool_execution_start", F.array(event("tool", j("$.toolName")))).when(kind == "error", F.array(event("error", j("$.message"))))
    )
    rows = raw.select("task", "pos", F.posexplode(made).alias("n", "e"))
    return rows.where("e.text is not null").select("task", "pos", "n", "e.kind", "e.text")
