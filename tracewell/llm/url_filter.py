"""Operator 6: URL filters as a temporal list join.

Dated list entries (key, action, listed_at) become validity intervals: an entry
holds until the next entry of the same key.  A capture is looked up under every
suffix of its host, as of its fetch time; the longest suffix with an active
entry decides.

The look-up is one as-of pass: entries and captures of a key stand in one order of
time, and a capture takes the last entry before it.  They are dealt by ranges of (key,
time), so that a key with very many entries or captures spreads over many tasks; the
last entry of each range is handed on to the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, settle

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    """Lower-case host of a URL column; empty where there is none, null stays empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) of dated entries (key, action, listed_at).

    Of entries with one key and time the greatest action holds.  valid_to is null
    for the last; "remove" ends an interval and starts none.  Null keys or times
    are left out.
    """
    one = entries.where("key is not null and listed_at is not null").groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    step = W.partitionBy("key").orderBy("listed_at")
    return one.select("key", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(step).alias("valid_to")).where("action <> 'remove'")


def as_of(asked: DataFrame, entries: DataFrame, name: str = "url-times") -> DataFrame:
    """``asked`` (key, at, host) with the action of the key's last entry at or before ``at``; null where there is none.

    Of entries with one key and time the greatest action holds, before captures of that time.
    """
    listed = entries.where("key is not null and listed_at is not null").groupBy("key", F.col("listed_at").alias("at")).agg(F.max("action").alias("action"))
    order = ["key", "at", "kind", "host"]
    rows = listed.select("key", "at", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "action").unionByName(asked.select("key", "at", F.lit(1).alias("kind"), "host", F.lit(None).cast("string").alias("action")))
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), name)
    last = placed.where("kind = 0").groupBy("key", "part").agg(F.max_by("action", "at").alias("last"))
    parts = placed.select("key", "part").distinct().join(last, ["key", "part"], "left")
    carried = parts.withColumn("before", F.last("last", ignorenulls=True).over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("key", "part", "before")
    own = F.last("action", ignorenulls=True).over(W.partitionBy("key", "part").orderBy("at", "kind", "host").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("own", own).where("kind = 1").join(carried, ["key", "part"]).select("key", "at", "host", F.coalesce("own", "before").alias("action"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched_at): host, matched_key, verdict, kept.

    Captures that match nothing, or have no host or fetch time, are "unlisted"
    and kept.  Every distinct host and time is looked up once, under each suffix of
    the host, in one as-of pass.  "remove" ends what an entry before it said.
    Repeated rows each get their own verdict.  An empty list leaves every capture
    unlisted, no capture gives no row; columns other than the three are ignored.
    """
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # The verdict depends on host and time alone: evaluate each distinct pair once.
    pairs = rows.where("host <> '' and fetched_at is not null").select("host", "fetched_at").distinct()
    asked = pairs.select(F.explode(suffixes).alias("key"), F.col("fetched_at").alias("at"), "host")
    # A suffix that no entry names is not looked up.
    asked = asked.join(entries.select("key").distinct(), "key", "left_semi")
    hit = as_of(asked, entries).where("action <> 'remove'").withColumnRenamed("at", "fetched_at")
    best = hit.groupBy("host", "fetched_at").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action")).alias("best"))
    best = best.select("host", "fetched_at", F.col("best.key").alias("matched_key"), F.col("best.action").alias("verdict"))
    out = rows.join(best, ["host", "fetched_at"], "left")
    return out.select("page_id", "host", "fetched_at", "matched_key", F.coalesce("verdict", F.lit("unlisted")).alias("verdict"), (F.coalesce("verdict", F.lit("unlisted")) != "block").alias("kept"))


#: A small dated list, as one is kept by hand: key, action, day of 2024 on which it was listed (at six in the morning).
LIST = (
    ("free-bets.example.com", "block", 20), ("cheap-pills.example.com", "block", 1), ("cheap-pills.example.com", "remove", 200), ("casino-win.example.com", "block", 45), ("casino-win.example.com", "allow", 300),
    ("ads-track.example.com", "block", 0), ("spam-farm.example.com", "block", 10), ("spam-farm.example.com", "remove", 90), ("spam-farm.example.com", "block", 120), ("adult-x.example.net", "block", 5),
)


def listed_entries(spark) -> DataFrame:
    """LIST as entries (key, action, listed_at)."""
    rows = spark.createDataFrame(list(LIST), "key string, action string, day int")
    return rows.select("key", "action", (F.expr("timestamp_ntz'2024-01-01 06:00:00'") + F.make_dt_interval("day")).alias("listed_at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts of ``pages``, as the tables hold no list.

    A number read from the MD5 of a key says when it is listed, whether it is
    blocked or allowed, and whether the entry is withdrawn 60 days later.
    """
    host = host_of(F.col("url"))
    keys = pages.select(host.alias("key")).unionByName(pages.select(F.substring_index(host, ".", -3).alias("key"))).where("key <> ''").distinct()
    k = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    listed = keys.select("key", k.alias("k")).where("k % 3 = 0").select("key", "k", (day + F.make_dt_interval((F.col("k") % 300).cast("int"))).alias("listed_at"))
    put = listed.select("key", F.when(F.col("k") % 4 == 1, "allow").otherwise("block").alias("action"), "listed_at")
    gone = listed.where("k % 2 = 0").select("key", F.lit("remove").alias("action"), (F.col("listed_at") + F.make_dt_interval(F.lit(60))).alias("listed_at"))
    return put.unionByName(gone)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages; their fetch time is derived from page_id, as the table has none."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval((F.col("page_id") * 37 % 366).cast("int"))
    return filter_captures(pages.select("page_id", "url", at.alias("fetched_at")), demo_entries(pages).unionByName(listed_entries(spark)))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         TIMESTAMP '2024-01-01 00:00:00' + (page_id * 37 % 366) * INTERVAL 1 DAY AS fetched_at
  FROM pages
), keys AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM p
    UNION ALL
    SELECT array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.') FROM p
  ) WHERE key <> ''
), k AS (
  SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS k FROM keys
), listed AS (
  SELECT key, k, TIMESTAMP '2024-01-01 00:00:00' + (k % 300) * INTERVAL 1 DAY AS listed_at FROM k WHERE k % 3 = 0
), entries AS (
  SELECT key, CASE WHEN k % 4 = 1 THEN 'allow' ELSE 'block' END AS action, listed_at FROM listed
  UNION ALL
  SELECT key, 'remove', listed_at + INTERVAL 60 DAY FROM listed WHERE k % 2 = 0
  UNION ALL
  SELECT key, action, TIMESTAMP '2024-01-01 06:00:00' + day * INTERVAL 1 DAY FROM (VALUES """ + ", ".join(map(str, LIST)) + r""") AS x(key, action, day)
), held AS (
  SELECT * FROM (SELECT key, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS valid_to FROM entries) WHERE action <> 'remove'
), hit AS (
  SELECT p.page_id, h.key, h.action FROM p JOIN held h
  ON (p.host = h.key OR ends_with(p.host, '.' || h.key)) AND h.valid_from <= p.fetched_at AND (h.valid_to IS NULL OR p.fetched_at < h.valid_to)
), best AS (
  SELECT page_id, arg_max(key, length(key)) AS matched_key, arg_max(action, length(key)) AS verdict FROM hit GROUP BY page_id
)
SELECT p.page_id, p.host, p.fetched_at, b.matched_key, coalesce(b.verdict, 'unlisted') AS verdict, coalesce(b.verdict, 'unlisted') <> 'block' AS kept
FROM p LEFT JOIN best b USING (page_id)
"""
