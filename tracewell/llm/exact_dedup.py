"""Operator 8: exact duplicates by skew-safe combining, all in DataFrame functions.

Three stages, each grouping by the digest *and* the full text, so a digest
collision can never merge two texts:

1. local: the salt is the number of the input partition, so that the map side of
   the first aggregation merges all equal texts of a partition before the shuffle;
2. salted: equal (salt, digest, text) groups meet; a text that a third of all rows
   hold is spread over as many salts as there are, one row from each partition;
3. global: the winners of the salts - at most one row per salt and text - meet by
   (digest, text).

The number of salts follows the row count, so an id list kept by a salt group
stays bounded however hot a text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, settle, texts

MIN_SALTS = 64
GROUP_ROWS = 1_000_000


def _salts(docs: DataFrame) -> int:
    return max(MIN_SALTS, docs.count() // GROUP_ROWS + 1)


def _digests(rows: DataFrame, salts: int) -> DataFrame:
    """``rows`` (text, ...) with the digest of the text and a salt, the same for all rows of a partition."""
    return rows.withColumn("text_sha256", F.sha2("text", 256)).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))


def local_groups(rows: DataFrame, salts: int) -> DataFrame:
    """(salt, text_sha256, text, ids, winner) of rows (doc_id, text): equal texts merged in their partition, then in their salt."""
    groups = _digests(rows, salts).groupBy("salt", "text_sha256", "text").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    return groups.withColumn("winner", F.array_max("ids")["doc_id"])


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows with one text, the one with the largest id, with all its columns.

    The three stages as above, with whole rows in place of ids, so that no verdict
    must be joined back.  Texts are equal when identical; null counts as empty; null
    ids rank lowest; of rows with the same id and text any one stays.  Columns of any
    name stay as they are, and an empty table gives an empty result.
    """
    # The cells are a struct of their own, so that their names clash with none of these.
    cells = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    whole = F.struct(cells.alias("cells"), F.col(f"`{text_col}`").isNull().alias("blank"))
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), whole.alias("row"), F.struct(F.col(f"`{id_col}`").alias("id")).alias("rank"))
    merged = lambda df, *keys: df.groupBy(*keys, "text_sha256", "text").agg(F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"))
    kept = merged(merged(_digests(rows, _salts(docs)), "salt"))
    return kept.select(*[F.when(~F.col("row.blank"), F.col("text")).alias(c) if c == text_col else F.col(f"row.cells.`{c}`").alias(c) for c in docs.columns])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanned: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    largest id stays; null ids rank lowest.  Where rows repeat with the same id
    and text, exactly one of them is kept.  An empty table gives an empty result;
    columns other than the two named are ignored.

    The plan runs over its input twice, and a row's salt is its partition.  Therefore
    the two columns are written once, unless ``scanned`` says that ``docs`` is a plain
    scan of files, which is cut into the same partitions whenever it runs.
    """
    rows = texts(docs, id_col, text_col)
    salted = local_groups(rows if scanned else settle(rows, "exact-rows"), _salts(docs))
    same = W.partitionBy("text_sha256", "text")
    # Both uses of ``salted`` take the same aggregate, and the join infers no filter, so that its shuffle of texts is made once.
    verdict = salted.select("salt", "text_sha256", "text", "winner", F.size("ids").cast("long").alias("n")).select(
        F.col("salt").alias("g_salt"), F.col("text_sha256").alias("g_sha"), F.xxhash64("text").alias("g_hash"), F.max(F.struct("winner", "salt")).over(same).alias("keep"), F.sum("n").over(same).alias("group_size")
    )
    # The verdict goes back to the group it was made from: texts were compared above, and a group is told by salt and 320 bits of digests.
    found = salted.withColumn("hash", F.xxhash64("text")).drop("text")
    found = found.join(verdict, found.salt.eqNullSafe(verdict.g_salt) & found.text_sha256.eqNullSafe(verdict.g_sha) & found.hash.eqNullSafe(verdict.g_hash))
    ids = F.array_sort("ids")
    # Of equal (id, text) rows in several salts, the highest salt holds the one that stays.
    holds = F.when(F.col("salt") == F.col("keep.salt"), F.array_position(ids, F.struct(F.col("keep.winner").alias("doc_id"))))
    return (
        found.select(F.col("keep.winner").alias("keep_id"), "group_size", "text_sha256", F.posexplode(ids).alias("at", "id"), holds.alias("first_at"))
        .select(
            F.col("id.doc_id").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("id.doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("at") + 1 == F.col("first_at"), F.lit(False))).alias("kept"),
            "text_sha256",
        )
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"), scanned=True)


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
