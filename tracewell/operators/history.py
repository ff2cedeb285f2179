"""Prompt history: dedup, tombstones, filters, drains and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import dedup_key, identity, trimmed


def keep_first(entries: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """The first entry of each key (120 characters, in any case) in ``order``; blank and null texts are dropped.

    A minimum with map-side combination, so that a prompt of a third of all rows needs no task of its own.
    """
    whole, at = F.struct(*[F.col(f"`{c}`") for c in entries.columns]), F.struct(*[F.col(c) for c in order])
    kept = entries.where(dedup_key(F.col(text)) != "").groupBy(dedup_key(F.col(text)).alias("__key")).agg(F.min_by(whole, at).alias("__row"))
    return kept.select("__row.*")


def visible(entries: DataFrame, tombstones: DataFrame, text: str = "text") -> DataFrame:
    """Entries whose identity no tombstone names, by its SHA-256 or its first 120 characters (column key)."""
    keyed = entries.withColumn("__sha", F.concat(F.lit("sha256:"), F.sha2(identity(F.col(text)), 256))).withColumn("__old", dedup_key(F.col(text)))
    for name in ("__sha", "__old"):
        keyed = keyed.join(tombstones.select(F.col("key").alias(name)), name, "left_anti")
    return keyed.select(entries.columns)


def token_filter(entries: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Entries that contain every word of ``query``, in any case; a blank query keeps all."""
    out = entries
    for word in query.lower().split():
        out = out.where(F.lower(text).contains(word))
    return out


def context_budget(messages: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Messages, bytes and estimated tokens (a quarter of the bytes, rounded up) by role, with headroom."""
    size = F.sum(F.octet_length("text")).cast("long")
    tokens = F.ceil(size / 4).cast("long")
    return messages.groupBy(*keys, "role").agg(F.count("*").alias("messages"), size.alias("bytes"), tokens.alias("tokens"), F.greatest(F.lit(0), limit - tokens).cast("long").alias("headroom"), (tokens > limit).alias("exceeded"))


#: What a role counts as; all others are "other".
BUCKETS = {"system": "system", "user": "user", "assistant": "assistant", "toolResult": "tool_results"}


def context_status(messages: DataFrame, keys: list[str], window: int, reserve: int, target: int) -> DataFrame:
    """Per context (keys) of messages (role, and the other columns of a message): bytes and messages by bucket, and how it stands to its limits.

    A message's size is that of its JSON; the whole is the JSON of all of them in a
    list.  tokens: a quarter of the bytes, rounded up.  capacity is ``window`` less
    ``reserve``; the target is at most that.  status: within_target, above_target or
    overflow.
    """
    own = [c for c in messages.columns if c not in keys]
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in own])))
    names = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])
    bucket = F.coalesce(F.try_element_at(names, F.col("role")), F.lit("other"))
    parts = [x for b in [*BUCKETS.values(), "other"] for x in (F.count_if(bucket == b).alias(f"{b}_messages"), F.coalesce(F.sum(F.when(bucket == b, size)), F.lit(0)).alias(f"{b}_bytes"))]
    capacity = window - reserve
    target = min(target, capacity)
    frame = len('{"messages":[]}') - 1  # and a comma for each message but the first
    out = messages.groupBy(*keys).agg(*parts, (F.sum(size) + F.count("*") + frame).alias("bytes")).withColumn("tokens", F.ceil(F.col("bytes") / 4).cast("long"))
    status = F.when(F.col("tokens") <= target, "within_target").when(F.col("tokens") <= capacity, "above_target").otherwise("overflow")
    return out.withColumns({"headroom": F.greatest(F.lit(0), capacity - F.col("tokens")), "excess": F.greatest(F.lit(0), F.col("tokens") - target), "status": status})


def last_record(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key in ``order``."""
    whole, at = F.struct(*[F.col(f"`{c}`") for c in records.columns]), F.struct(*[F.col(c) for c in order])
    return records.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(whole, at).alias("__row")).select("__row.*")


def continuity(changes: DataFrame, keys: list[str], order: str, id_col: str | None = None) -> DataFrame:
    """Per key: first before, last after, steps, and whether each before equals the previous after.

    Of records that share an id the first counts; a record that changes nothing is
    left out; null is a state of its own, so a null after is followed by a null before.
    """
    if id_col:
        whole = F.struct(*[F.col(f"`{c}`") for c in changes.columns])
        changes = changes.groupBy(F.col(id_col).alias("__id")).agg(F.min_by(whole, order).alias("__row")).select("__row.*")
    step = W.partitionBy(*keys).orderBy(order)
    moved = changes.where(~F.col("before").eqNullSafe(F.col("after")))
    broken = (F.row_number().over(step) > 1) & ~F.lag("after").over(step).eqNullSafe(F.col("before"))
    marked = moved.withColumn("__broken", broken)
    return marked.groupBy(*keys).agg(F.min_by("before", order).alias("before"), F.max_by("after", order).alias("after"), F.count("*").alias("steps"), (~F.bool_or("__broken")).alias("continuous"))


def drain(entries: DataFrame, file: str = "file", line: str = "line_no", at: str = "ts", fallback: str = "mtime") -> DataFrame:
    """Entries by file, the file of the newest entry first, and within a file the last line first: key __file_at, then file, then line down.

    A file without any time goes by its own (``fallback``).
    """
    newest = entries.groupBy(file).agg(F.coalesce(F.max(at), F.max(fallback)).alias("file_at"))
    return entries.join(newest, file).orderBy(F.desc("file_at"), file, F.desc(line))


#: Characters of the longest prompt that is taken, and the newest version of session logs that is read.
LONGEST_PROMPT, VERSION = 16_384, 3


def prompts(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """(file, line_no, text, ts) of user prompts in session logs (file, line_no, raw JSON, mtime in milliseconds).

    A log begins with a session line of a version up to VERSION; others are left out.
    A prompt is a user message whose content is a string, or the text blocks of a
    list, joined by a space and trimmed; its time is the message's, else the line's,
    else the log's, else the file's.  Malformed lines, and prompts that are blank or
    longer than LONGEST_PROMPT, are left out; ``skipped_lines`` counts the former.
    """
    j = lambda p: F.get_json_object(raw, p)
    millis = lambda p: F.coalesce(j(p).try_cast("long"), F.unix_millis(F.try_to_timestamp(j(p))))
    first = lines.where(trimmed(raw) != "").groupBy("file").agg(F.min_by(F.struct(j("$.type").alias("kind"), j("$.version").try_cast("long").alias("version"), millis("$.timestamp").alias("ts")), "line_no").alias("head"))
    logs = first.where("head.kind = 'session'").where(F.coalesce("head.version", F.lit(1)) <= VERSION).select("file", F.col("head.ts").alias("head_ts"))
    blocks = F.from_json(j("$.message.content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    text = trimmed(F.when(j("$.message.content").startswith("["), joined).otherwise(j("$.message.content")))
    rows = lines.where(j("$.type") == "message").where(j("$.message.role") == "user").join(logs, "file")
    rows = rows.select("file", "line_no", text.alias("text"), F.coalesce(millis("$.message.timestamp"), millis("$.timestamp"), "head_ts", "mtime").alias("ts"))
    return rows.where((F.col("text") != "") & (F.char_length("text") <= LONGEST_PROMPT))


def skipped_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """(file, skipped): lines that look like user messages and are no JSON, per file that has any."""
    bad = F.try_parse_json(raw).isNull() & F.col(raw).contains('"role":"user"')
    return lines.where(bad).groupBy("file").agg(F.count("*").alias("skipped"))
