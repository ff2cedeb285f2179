"""A corpus through five stages: toxicity, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept
and returns the columns of ``documents``; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, near_dup, packing, secrets, toxicity
from tracewell.llm.common import read, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 3 rejects go; the labels are those of the corpus.

    Null texts count as empty and stay, as do all rows where there are no labels;
    repeated rows stay or go together; columns of any name stay as they are.
    """
    return toxicity.keep_clean(docs, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays (operator 8); null counts as empty, null ids rank lowest.

    Of rows that repeat id and text any one stays; columns of any name stay as they are.
    """
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the row with the smallest id stays (operator 2); null ids rank last, of equal ids any one stays.

    Every row gets a key, written once, so that a verdict is of one row and not of
    all that share an id or have none.  The row goes along as one struct, so that
    columns of any name stay as they are.  Null and empty texts link with nothing,
    repeated rows are near duplicates, and an empty table gives an empty result.
    """
    keyed = settle(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows-near")
    verdict = near_dup.near_duplicates(keyed, id_col="key", text_col="row.text").select(F.col("doc_id").alias("key"), "class_id")
    ranked = verdict.join(keyed.select("key", F.col("row.doc_id").alias("id")).hint("merge"), "key").select("class_id", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("best"))
    best = ranked.groupBy("class_id").agg(F.min("best").alias("best")).select(F.col("best.key").alias("key"))
    return keyed.join(best.hint("merge"), "key", "left_semi").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; no document goes (operator 10).

    Null texts stay null, repeated rows repeat, and columns of any name stay as they are.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences (operator 9).

    A null or empty text is the end id alone; repeated rows are packed as documents of
    their own; other columns than doc_id and text are ignored; no row gives no piece.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: Toxicity scores and near duplicates have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
