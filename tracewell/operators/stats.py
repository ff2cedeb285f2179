"""Usage statistics over (session, model, day, ts, tokens, cost)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import half_up


def in_range(usage: DataFrame, today: str, days: int | None) -> DataFrame:
    """Only a lower bound on the day: later days stay."""
    return usage if days is None else usage.where(F.col("day") >= F.date_sub(F.lit(today).cast("date"), days - 1))


#: Token measures, where usage has them.
MEASURES = ("input", "output", "cache_read", "cache_write", "tokens")


def cost_of(cost: Column) -> Column:
    """A cost as a double, rounded to nine digits."""
    return half_up(cost.cast("double"), 9)


def in_scope(usage: DataFrame, cwd: str | None) -> DataFrame:
    """Usage of one working directory; None takes all."""
    return usage if cwd is None else usage.where(F.col("cwd") == cwd)


def totals(usage: DataFrame) -> DataFrame:
    """Sums of all measures, cost, messages, sessions and active days; one row, zeros where there is no usage."""
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES if m in usage.columns]
    return usage.agg(*sums, cost_of(F.coalesce(F.sum("cost"), F.lit(0))).alias("cost"), F.count("*").alias("messages"), F.count_distinct("session").alias("sessions"), F.count_distinct("day").alias("active_days"))


def preferred_copies(sessions: DataFrame) -> DataFrame:
    """Of sessions (id, path, messages, last_at) that share an id, the one with most messages, then the latest, then the least path; id "unknown" is never merged."""
    whole = F.struct(*[F.col(f"`{c}`") for c in sessions.columns])
    key = F.when(F.col("id") == "unknown", F.concat_ws("\n", F.lit("unknown"), "path")).otherwise(F.col("id"))
    least = F.struct(-F.col("messages"), -F.coalesce(F.col("last_at"), F.lit(0)), F.col("path"))
    return sessions.groupBy(key.alias("__key")).agg(F.min_by(whole, least).alias("__row")).select("__row.*")


def longest_from_start(usage: DataFrame, starts: DataFrame) -> DataFrame:
    """The session (session, ms) of the most milliseconds from its start (starts: session, started_at, pos) to its last message in range.

    A null start and a start after the last message count as 0; of equals the first in pos.
    """
    last = usage.groupBy("session").agg(F.max("ms").alias("last"))
    length = F.coalesce(F.greatest(F.lit(0), F.col("last") - F.col("started_at")), F.lit(0)).cast("long")
    return last.join(starts, "session").select("session", length.alias("ms"), "pos").orderBy(F.desc("ms"), "pos").limit(1).select("session", "ms")


def live_session(usage: DataFrame, now_ms: int) -> DataFrame:
    """Per session: messages, tokens, the last model that is known, and milliseconds since the first message."""
    known = F.when(F.coalesce(F.col("model"), F.lit("unknown")) != "unknown", F.struct("ms", "event_id", "model"))
    return usage.groupBy("session").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.max(known)["model"].alias("model"), F.greatest(F.lit(0), F.lit(now_ms) - F.min("ms")).cast("long").alias("ms"))


def calendar(usage: DataFrame, first: str, last: str, levels: int = 4) -> DataFrame:
    """Every day from the Monday on or before ``first`` to ``last``: week (from 0), weekday (Monday is 0), tokens and level (0 without usage)."""
    start = F.trunc(F.lit(first).cast("date"), "week")
    days = usage.sparkSession.range(1).select(F.explode(F.sequence(start, F.lit(last).cast("date"))).alias("day"))
    step = F.datediff("day", start)
    out = F.broadcast(days).join(heat(usage, levels), "day", "left")
    return out.select("day", F.floor(step / 7).cast("long").alias("week"), F.pmod(step, F.lit(7)).cast("long").alias("weekday"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def by_model(usage: DataFrame) -> DataFrame:
    """Tokens, cost, messages and share of all tokens (0 where there are none) by model."""
    sums = usage.groupBy("model").agg(F.sum("tokens").alias("tokens"), cost_of(F.sum("cost")).alias("cost"), F.count("*").alias("messages"))
    whole = F.sum("tokens").over(W.partitionBy())  # one row per model
    share = F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)
    return sums.withColumn("share", half_up(share, 6)).orderBy(F.desc("tokens"), F.desc("messages"), "model")


def by_day(usage: DataFrame) -> DataFrame:
    return usage.groupBy("day").agg(F.sum("tokens").alias("tokens"))


def top_day(usage: DataFrame) -> DataFrame:
    """The day of most tokens, the earliest of equals."""
    return by_day(usage).orderBy(F.desc("tokens"), "day").limit(1)


def longest_sessions(usage: DataFrame, top: int = 10) -> DataFrame:
    """Sessions by the seconds from first to last message."""
    spans = usage.groupBy("session").agg((F.max("second") - F.min("second")).alias("seconds"))
    return spans.orderBy(F.desc("seconds"), "session").limit(top)


def islands(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive active days within ``keys``: first day, last day, number of days."""
    days = usage.select(*keys, "day").distinct()
    step = W.partitionBy(*keys).orderBy("day")
    return days.withColumn("run", F.date_sub("day", F.row_number().over(step))).groupBy(*keys, "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("run")


def streaks(usage: DataFrame, keys: list[str], today: str) -> DataFrame:
    """Longest run, and the run that ends today or yesterday (0 where none does)."""
    now = F.lit(today).cast("date")
    current = F.when(F.col("last_day") >= F.date_sub(now, 1), F.datediff(F.least("last_day", now), F.col("first_day")) + 1).otherwise(0)
    return islands(usage, keys).groupBy(*keys).agg(F.max("days").alias("longest"), F.max(current).cast("long").alias("current"))


def heat(usage: DataFrame, levels: int = 4) -> DataFrame:
    """Heat level of each active day, 1 to ``levels``."""
    most = F.max("tokens").over(W.partitionBy())  # one row per day
    level = F.when(most > 0, F.least(F.lit(levels), F.greatest(F.lit(1), F.ceil(F.lit(levels) * F.col("tokens") / most)))).otherwise(1)
    return by_day(usage).select("day", "tokens", level.cast("long").alias("level"))
