"""Operator 10: secret scans over an incremental blob ledger, all in DataFrame functions.

Every version of every path is content-addressed (SHA-256 of its text).  A blob
is scanned once per rule version: pairs that the ledger already holds are left
out by an anti join, and equal blobs are merged (digest and full text) before
the patterns run.  The new ledger rows are written to the shared folder and
joined back to all paths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, settle, shared_dir, texts

#: kind, pattern, group whose length counts, least length, and a pattern that any kept match contains.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
     r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
RULE_VERSION = "base-1"


def _lengths(kind_no: int, pattern: str, group: int, least: int, hint: str):
    """Array of (kind, at, gap before, length, long enough) of one kind's matches in ``text``."""
    text = F.col("text")
    size = lambda a: F.transform(a, lambda x: F.char_length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.transform(
        F.arrays_zip(size(whole).alias("n"), size(value).alias("v"), F.slice(size(F.split(text, pattern, -1)), 1, F.size(whole)).alias("gap")),
        lambda x, i: F.struct(F.lit(kind_no).alias("kind_no"), i.alias("at"), x["gap"].alias("gap"), x["n"].alias("n"), (x["v"] >= least).alias("ok")),
    )
    return F.when(text.rlike(hint), rows)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, findings) of each blob (blob, text); findings is empty where there are none.

    findings: array of (start, kind_no, end), sorted; code points, end exclusive.
    Matches are leftmost and non-overlapping per kind; those too short are dropped
    after matching.  Start positions are running sums over the gaps and matches.
    """
    found = F.flatten(F.array_compact(F.array(*[_lengths(i, *rule[1:]) for i, rule in enumerate(rules)])))
    each = blobs.select("blob", F.explode_outer(found).alias("x")).select("blob", "x.*").repartition("blob")
    before = W.partitionBy("blob", "kind_no").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("n")).alias("start"), "kind_no", "end"))
    return each.withColumn("end", end).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("findings"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for pairs the ledger has not seen.

    versions: (blob, text), with repeats.  A scanned blob without a finding also
    gets a row, so that it is not scanned again.
    """
    seen = versions.withColumn("rule_version", F.lit(rule_version))
    if ledger is not None:
        seen = seen.join(ledger.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
    fresh = seen.select("blob", "text").distinct()
    return scan_blobs(fresh, rules).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


LEDGER = "blob string, rule_version string, findings array<struct<start: long, kind_no: int, end: long>>"


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger below ``path``, empty where none was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan_history(versions: DataFrame, ledger: DataFrame | str | None = None, path_col: str = "doc_id", text_col: str = "text", rules=RULES, rule_version: str = RULE_VERSION):
    """Scans every historical version; returns (rows per version, ledger rows that were new).

    ledger: the folder of a ledger, which is read and gets the new rows, so that the
    next run - of more versions, or of another rule version - scans what it has not
    seen; or a table of ledger rows, to which the caller appends; or none.  Null texts
    count as empty, null paths are kept as rows.  Repeated versions share one blob and
    give one row each; a path may have several versions.  Other columns are ignored; no
    row gives no row.
    """
    spark = versions.sparkSession
    rows = texts(versions, path_col, text_col).withColumn("blob", F.sha2("text", 256))
    seen = read_ledger(spark, ledger) if isinstance(ledger, str) else ledger
    fresh = settle(update_ledger(rows.select("blob", "text"), seen, rules, rule_version), "secret-ledger")
    if isinstance(ledger, str):
        fresh.select(*[F.col(c).cast(t) for c, t in spark.createDataFrame([], LEDGER).dtypes]).write.mode("append").parquet(ledger)
    known = fresh if seen is None else fresh.unionByName(seen.where(F.col("rule_version") == rule_version).select(fresh.columns))
    back = rows.select("doc_id", "blob").join(known.select("blob", "findings"), "blob", "left")
    return back.select("doc_id", "blob", F.coalesce("findings", F.array().cast(known.schema["findings"].dataType)).alias("findings")), fresh


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; no row is dropped.

    Overlapping spans are merged.  n_chars, where present, is counted again for
    changed texts.  Needs the column text; the scan runs once per distinct text.
    Null texts stay null, repeated rows repeat, and columns of any name stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    known = settle(update_ledger(rows.select("blob", "text")), "secret-ledger").select("blob", "findings")
    upto = lambda acc: acc["upto"].cast("int")
    cut = F.aggregate(
        "findings",
        F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            F.when(s["start"] >= acc["upto"], F.concat(acc["out"], F.array(F.substring(F.col("text"), upto(acc) + 1, (s["start"] - acc["upto"]).cast("int")), F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), upto(acc) + 1, F.char_length("text"))),
    )
    changed = F.size("findings") > 0
    out = rows.join(known, "blob", "left").select("row", changed.alias("changed"), F.when(changed, cut).alias("new"))
    named = {"text": F.when(F.col("changed"), F.col("new")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.when(F.col("changed"), F.char_length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[(named[c] if c in named else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_secret_scan(spark, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """All documents, in two runs over one ledger: an earlier state of the corpus, then the whole, which scans what is new alone.

    ledger: its folder; one of its own where none is named.  Odd rows as ``scan_history`` states.
    """
    docs = read(spark, sf_dir, "documents")
    ledger = ledger or f"{shared_dir(spark).rstrip('/')}/tracewell/ledger-{uuid.uuid4().hex}"
    # The earlier state: documents whose id has an even digest, as if the others had come since.
    scan_history(docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0), ledger)
    found, _ = scan_history(docs, ledger)
    kinds = F.array(*[F.lit(r[0]) for r in RULES])
    of = lambda k: F.size(F.filter("findings", lambda s: s["kind_no"] == k)).cast("long")
    spans = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
