"""Session logs (JSON lines) as usage rows, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import trimmed


def session_lines(spark: SparkSession, root: str) -> DataFrame:
    """file, block, row, line: the lines that are not blank of ``root/*/*.jsonl``, one directory deep.

    (block, row) orders the lines of a file; files stay splittable.
    """
    raw = spark.read.text(f"{root}/*/*.jsonl")
    at = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), trimmed("value").alias("line"))
    return at.where("line <> ''")


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def _number(path: str) -> Column:
    """A JSON number that is not negative, else null; a string is no number."""
    kind = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    n = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("v", path, "double"))
    return F.when((n >= 0) & (n < float("inf")), n)


def session_usage(lines: DataFrame) -> DataFrame:
    """Usage rows of session_lines: file, session, cwd, ts, provider, model, four token counts, total, cost.

    A file whose first line is no session header is left out.  Lines that do not
    parse, have no usage or no valid time are skipped; what is no number of zero or
    more counts as 0; the total is the given one or the sum of the four counts; a
    provider or model that is missing is ``unknown``.  No files: no rows.
    """
    first = lines.groupBy("file").agg(F.min_by("line", F.struct("block", "row")).alias("line")).withColumn("v", F.try_parse_json("line"))
    head = first.where(_text("$.type") == "session").select("file", _text("$.id").alias("session"), _text("$.cwd").alias("cwd"))
    said = lines.where(F.contains("line", F.lit('"assistant"'))).withColumn("v", F.try_parse_json("line"))
    parts = {c: F.coalesce(_number(f"$.message.usage.{j}"), F.lit(0.0)) for c, j in (("input", "input"), ("output", "output"), ("cache_read", "cacheRead"), ("cache_write", "cacheWrite"))}
    total = F.coalesce(_number("$.message.usage.totalTokens"), sum(parts.values(), F.lit(0.0)))
    ts = F.try_to_timestamp(_text("$.timestamp"))
    kept = said.where((_text("$.type") == "message") & (_text("$.message.role") == "assistant") & F.try_variant_get("v", "$.message.usage", "variant").isNotNull() & ts.isNotNull())
    rows = kept.select(
        "file", "block", "row", ts.alias("ts"), *[F.coalesce(_text(f"$.message.{c}"), F.lit("unknown")).alias(c) for c in ("provider", "model")],
        *[x.alias(c) for c, x in parts.items()], total.alias("total"), F.coalesce(_number("$.message.usage.cost.total"), F.lit(0.0)).alias("cost"),
    )
    return rows.join(head, "file").drop("block", "row")


def prompts(lines: DataFrame) -> DataFrame:
    """v, text, ts of stored prompts: the text must be a JSON string that is not blank; v is 1 if missing."""
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    is_text = F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")) == "STRING"
    stored = parsed.where(is_text & (trimmed(_text("$.text")) != ""))
    return stored.select("file", "block", "row", F.coalesce(_number("$.v").cast("int"), F.lit(1)).alias("v"), _text("$.text").alias("text"), _number("$.ts").cast("long").alias("ts"))
