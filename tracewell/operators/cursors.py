"""Pages of results that stay as they were: frozen rows, cursors bound to their content, and what is kept of them.

A frozen result is written once per generation with a number for each row.  A cursor
names the result, its query and a place; a page reads only its own range of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .snapshots import _cut

#: Entries of a catalog's page, and most bytes, results and milliseconds that a session keeps.
CATALOG_PAGE = 8
MOST_BYTES, MOST_RESULTS, TTL_MS = 8 * 1024 * 1024, 128, 5 * 60_000


def numbered(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` with row_no, the place from 0 in the order of all rows; equal rows in any order.

    Rows are dealt by ranges and sorted in place; the sum of the counts before a range
    gives its first number, so that no task sees more than its range.  All columns
    break ties, so that many rows of one key spread over several ranges.
    """
    if "row_no" in rows.columns:
        raise ValueError("rows already have a column row_no")
    keys = [F.col(o) if isinstance(o, str) else o for o in order] + [F.col(f"`{c}`") for c in rows.columns]
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    placed = _cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(whole).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect()  # a row for each task
    before, starts = 0, []
    for c in counts:
        starts.append((c["part"], before - c["first"]))
        before += c["n"]
    moved = F.broadcast(placed.sparkSession.createDataFrame(starts, "part long, shift long"))
    return placed.withColumn("part", part).join(moved, "part").select("row.*", (F.col("at") + F.col("shift")).alias("row_no"))


def content_digest(rows: DataFrame) -> str:
    """Digest that tells two tables of the same columns apart, whatever their order: SHA-256 of the count and of sums of the rows' hashes, 128 bits a row."""
    names = sorted(rows.columns)
    part = lambda k: F.sum(F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").isNull() for c in names]).cast("decimal(38,0)"))
    found = rows.agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b"))
    return found.select(F.sha2(F.concat_ws(":", F.lit(",".join(names)), *[F.col(c).cast("string") for c in found.columns]), 256)).first()[0]


def freeze(rows: DataFrame, order: list[str | Column], store: str) -> tuple[str, int]:
    """Writes the numbered rows below ``store``, in their order, under the digest of their content; gives (generation, rows).

    The same content is written once, whatever its order when it comes in.
    """
    generation = content_digest(rows)
    spark = rows.sparkSession
    path = f"{store.rstrip('/')}/generation={generation}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        numbered(rows, order).write.mode("overwrite").parquet(path)
    return generation, spark.read.parquet(path).count()


def cursor(generation: str | Column, query: str | Column, offset: Column) -> Column:
    """Token of a place in a frozen result, bound to generation and query."""
    of = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws(":", F.sha2(F.concat_ws("\n", of(generation), of(query)), 256), offset.cast("string"))


def resume(asked: DataFrame, query: str, generation: str, frozen: DataFrame, total: int, limit: int) -> DataFrame:
    """Pages of many cursors at once: (id, status, row_no, next, the columns of ``frozen``).

    asked: id, cursor.  A cursor of another result or query, or without a number, is
    "unknown", one behind the last row "invalid"; both give one row without columns.
    Each cursor becomes the row numbers of its page, which meet the frozen rows by an
    equality; next is the cursor of the following page, null at the end.
    """
    head, place = F.substring_index("cursor", ":", 1), F.substring_index("cursor", ":", -1)
    own = F.sha2(F.concat_ws("\n", F.lit(generation), F.lit(query)), 256)
    known = (head == own) & place.rlike("^[0-9]+$")
    status = F.when(~F.coalesce(known, F.lit(False)), "unknown").when(F.length(place) > 15, "invalid").when(place.cast("long") >= total, "invalid").otherwise("page")
    told = asked.withColumn("status", status).withColumn("offset", F.when(F.col("status") == "page", place.cast("long")))
    last = F.least(F.col("offset") + limit, F.lit(total))
    pages = told.select("id", "status", F.when(last < total, cursor(generation, query, last)).alias("next"), F.explode_outer(F.when(F.col("offset").isNotNull(), F.sequence("offset", last - 1))).alias("row_no"))
    return pages.join(frozen, "row_no", "left").select("id", "status", "row_no", "next", *[f"`{c}`" for c in frozen.columns if c != "row_no"])


def retained(results: DataFrame, now: int | Column, keys: list[str], ttl: int = TTL_MS, most: int = MOST_RESULTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Results (keys, started, bytes, ...) that are still there at ``now``, by session.

    A result goes when its time is over, and the oldest go first while there are more
    than ``most`` results or ``most_bytes`` bytes: what is left is the newest run that
    fits.  Results that start together count in the order of the other columns.
    """
    rest = [F.col(f"`{c}`").desc() for c in results.columns if c not in (*keys, "started")]
    newest = W.partitionBy(*keys).orderBy(F.desc("started"), *rest).rowsBetween(W.unboundedPreceding, 0)
    live = results.where(F.col("started") + ttl > now)
    return live.withColumns({"__n": F.count("*").over(newest), "__bytes": F.sum("bytes").over(newest)}).where((F.col("__n") <= most) & (F.col("__bytes") <= most_bytes)).drop("__n", "__bytes")


def catalog_pages(entries: DataFrame, page: int = CATALOG_PAGE) -> DataFrame:
    """(session, list, pos, public, page, cursor) of catalogs: entries (session, activation, list, pos, public).

    Pages cut every list of a session at the same places.  cursor leads to the page
    after it, and is null on a session's last page.  It is bound to the session, its
    activation and the digest of all public fields: a changed catalog knows none of
    the cursors given out before.
    """
    line = F.sha2(F.concat_ws("\n", "list", F.col("pos").cast("string"), "public"), 256)
    bound = entries.groupBy("session", "activation").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"), F.max("pos").alias("last"))
    at = F.floor(F.col("pos") / page)
    token = F.base64(F.to_binary(F.concat_ws("\n", F.col("session").cast("string"), F.col("activation").cast("string"), "digest", ((at + 1) * page).cast("string")), F.lit("utf-8")))
    url = F.regexp_replace(F.translate(token, "+/", "-_"), "[=\\r\\n]", "")
    return entries.join(bound, ["session", "activation"]).select("session", "list", "pos", "public", at.alias("page"), F.when((at + 1) * page <= F.col("last"), url).alias("cursor"))


def catalog_resume(asked: DataFrame, entries: DataFrame, page: int = CATALOG_PAGE) -> DataFrame:
    """(id, list, pos, public) of the page that each cursor (id, session, cursor) leads to; a cursor that no page gives out leads nowhere: one row of nulls."""
    pages = catalog_pages(entries, page)
    ends = pages.where("cursor is not null").select("session", "cursor", (F.col("page") + 1).alias("page")).distinct()
    led = asked.join(ends, ["session", "cursor"], "left").select("id", "session", "page")
    return led.join(pages.drop("cursor"), ["session", "page"], "left").select("id", "list", "pos", "public")
