"""Operator 7: quality by an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text (rows labelled quality 1), per language and
over all languages, which is the lowest level that every language's model backs
off to.  N-grams are of four characters of the whole alphabet, as they are, so text
of any script can be judged.

Trusted text is counted in tasks and summed by Spark; counts, continuations and
contexts are tables keyed by model and n-gram, and probabilities come from joins
of them, order by order, once per distinct n-gram.  Documents are dealt into blocks
of bounded size.  Each block asks for its distinct n-grams, the shards of the table
answer, and the answers come back to the block, which sums the log probabilities of
each document.  So what is shuffled is the distinct n-grams of blocks, not the
n-grams of documents, nothing of the model passes through the driver, and nothing
is broadcast but a row per language, behind a check of their number.

One in ten trusted documents, told by a hash of their text, is not trained on; of a
language with less than a hundred, ten or the half, and one at least.  These give
each language's mean and the quantile above which documents are rejected.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import read, settle, shared_dir, tidy

ORDER = 4
#: Share of a language's held-out trusted documents that lie below the threshold.
QUANTILE = 0.99
#: Characters of average trusted text that every document is taken to have besides its own.
PRIOR = 60
#: One in so many trusted documents is held out, and so many of a language that has less than the square of it.
HELD = 10
#: Characters of a block of documents, and of the pieces in which a task works on it.
BLOCK_CHARS = 32_000_000
PIECE_CHARS = 2_000_000
#: Rows of a table with a row per language that may be broadcast; beyond it the join merges.
FEW_ROWS = 10_000
START = "\n" * (ORDER - 1)
#: The model of all languages; those of languages begin with "=".
ALL = "*"


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(text's place, number of the n-gram) of each character and the distinct n-grams, piece by piece; whole texts.

    A character's n-gram is itself and the three before it; START comes before a text.
    """
    parts: list[str] = []
    place: list[int] = []
    size: list[int] = []
    total = 0

    def work() -> tuple[np.ndarray, np.ndarray, list[str]]:
        joined = "".join(parts)
        n = np.array(size)
        first = np.cumsum(n + ORDER - 1) - n  # where each part's own characters begin
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        gram = pd.factorize(code[at])[0].astype(np.int64)
        for back in range(1, ORDER):
            gram = pd.factorize(gram * 0x110000 + code[at - back])[0].astype(np.int64)
        one = np.zeros(gram.max() + 1, np.int64)
        one[gram[::-1]] = at[::-1]
        return np.repeat(np.array(place), n), gram, [joined[i - ORDER + 1 : i + 1] for i in one.tolist()]

    for i, text in enumerate(texts):
        for start in range(0, len(text), PIECE_CHARS):
            parts += [text[start - ORDER + 1 : start] if start else START, text[start : start + PIECE_CHARS]]
            place.append(i)
            size.append(len(parts[-1]))
            total += size[-1]
            if total >= PIECE_CHARS:
                yield work()
                parts, place, size, total = [], [], [], 0
    if size:
        yield work()


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (text, ...) with block, the same for neighbours of one partition with about BLOCK_CHARS characters together."""
    out = StructType([*rows.schema, StructField("block", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = upto + np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            upto = int(ends[-1])
            block = (batch.column("part")[0].as_py() << 24) + ends // BLOCK_CHARS
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=out.names)

    return rows.mapInArrow(run, out)


@contextlib.contextmanager
def _in_buckets(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` written into the shared folder as a table in buckets by ``key``, so that it meets others by that key without a shuffle; dropped at the end."""
    spark = df.sparkSession
    name = f"tracewell_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/tracewell/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def few(df: DataFrame) -> DataFrame:
    """A written table with a row per language: broadcast while it is known to be small, else merged."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df.hint("merge")


def count_trusted(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(name, gram, n) over the texts of ``blocks`` (block, row, lang, text) that ``trusted`` (block, row) names."""

    def count(docs: pa.Table, known: pa.Table) -> pa.Table:
        rows = docs.filter(pc.is_in(docs.column("row"), known.column("row").combine_chunks()))
        out = []
        for lang in pc.unique(rows.column("lang")).to_pylist():
            sums: dict[str, int] = {}
            for _, gram, names in pieces(rows.filter(pc.equal(rows.column("lang"), lang)).column("text").to_pylist()):
                for g, n in zip(names, np.bincount(gram).tolist(), strict=True):
                    sums[g] = sums.get(g, 0) + n
            out.append(pa.table({"name": pa.array(["=" + lang] * len(sums)), "gram": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({"name": pa.array([], pa.string()), "gram": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    rows = blocks.select("block", "row", "lang", "text").groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(count, "name string, gram string, n long")
    return rows.groupBy("name", "gram").agg(F.sum("n").alias("n"))


def tables(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Of each order: (name, gram, own), the discounted count, and (name, context, total, mass), what contexts have and give away.

    counts: (name, gram, n) of order ORDER.  Counts of the highest order are
    occurrences, those below tell before how many characters an n-gram stands.
    """
    out, level = {}, settle(counts, f"gram-counts-{ORDER}")
    for k in range(ORDER, 0, -1):
        of = level.groupBy("name").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # Of short texts a ratio may be missing or at its end; a little mass always goes to what was not seen.
        ratio = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(0.5)
        discounts = settle(of.select("name", *[ratio(i).alias(f"d{i}") for i in (1, 2, 3)]), f"gram-discounts-{k}")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cuts = level.join(few(discounts), "name").select("name", "gram", "n", cut.alias("cut"))
        contexts = cuts.groupBy("name", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"), F.count("*").alias("types"))
        out[k] = (settle(cuts.select("name", "gram", (F.col("n") - F.col("cut")).alias("own")), f"gram-own-{k}"), settle(contexts, f"gram-contexts-{k}"))
        if k > 1:
            level = settle(level.groupBy("name", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n")), f"gram-counts-{k - 1}")
    return out


def probabilities(counts: DataFrame, needed: DataFrame) -> DataFrame:
    """(name, gram, p) of the n-grams ``needed`` (name, gram) under the models of ``counts``; ALL must be among them.

    The lowest order of a language goes on to that of all languages, and that to the
    even share of its characters and one more.  Joins merge at every size.
    """
    found, p = tables(counts), None
    needs = {ORDER: settle(needed.distinct(), f"gram-needed-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        needs[k] = settle(needs[k + 1].select("name", F.substring("gram", 2, k).alias("gram")).distinct(), f"gram-needed-{k}")
    own, one = found[1]
    rest = one.select("name", "total", "mass", (1.0 / (F.col("types") + 1)).alias("even"))
    chars = needs[1].join(own.hint("merge"), ["name", "gram"], "left").join(few(rest), "name", "left")
    in_all = own.where(F.col("name") == ALL).select("gram", F.col("own").alias("own_all"))
    of_all = few(rest.where(F.col("name") == ALL).select(F.col("total").alias("total_all"), F.col("mass").alias("mass_all"), F.col("even").alias("even_all")))
    chars = chars.join(in_all.hint("merge"), "gram", "left").join(of_all, how="left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = (zero("own_all") + F.col("mass_all") * F.col("even_all")) / F.col("total_all")
    p = F.when((F.col("name") == ALL) | F.col("total").isNull(), base).otherwise((zero("own") + F.col("mass") * base) / F.col("total"))
    p = settle(chars.select("name", "gram", p.alias("p")), "gram-p-1")
    for k in range(2, ORDER + 1):
        own, context = found[k]
        below = p.select("name", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        want = needs[k].withColumn("suffix", F.substring("gram", 2, k - 1)).withColumn("context", F.substring("gram", 1, k - 1))
        want = want.join(own.hint("merge"), ["name", "gram"], "left").join(context.hint("merge"), ["name", "context"], "left").join(below.hint("merge"), ["name", "suffix"])
        value = F.when(F.col("total").isNull(), F.col("lower")).otherwise((zero("own") + F.col("mass") * F.col("lower")) / F.col("total"))
        p = settle(want.select("name", "gram", value.alias("p")), f"gram-p-{k}")
    return p


def _models(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """(name, rows) of a block: each row under its own model, and the held-out ones under that of all languages too."""
    for name in pc.unique(table.column("name")).to_pylist():
        yield name, table.filter(pc.equal(table.column("name"), name))
    both = table.filter(pc.and_(table.column("held"), pc.not_equal(table.column("name"), ALL)))
    if both.num_rows:
        yield ALL, both


def requests(blocks: DataFrame) -> DataFrame:
    """(block, name, gram): the distinct n-grams of each block (block, name, held, text) and model."""

    def ask(table: pa.Table) -> pa.Table:
        grams: dict[str, set[str]] = {}
        for name, rows in _models(table):
            for _, _, names in pieces(rows.column("text").to_pylist()):
                grams.setdefault(name, set()).update(names)
        block = table.column("block")[0].as_py()
        out = [pa.table({"block": pa.array([block] * len(g), pa.int64()), "name": pa.array([name] * len(g)), "gram": pa.array(sorted(g), pa.string())}) for name, g in grams.items()]
        return pa.concat_tables(out) if out else pa.table({"block": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "gram": pa.array([], pa.string())})

    return blocks.select("block", "name", "held", "text").groupBy("block").applyInArrow(ask, "block long, name string, gram string")


def sums(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(row, name, total, n_grams): summed log probability of each document of a block (block, row, name, held, text); answers: (block, name, gram, log_p)."""

    def add(table: pa.Table, told: pa.Table) -> pa.Table:
        out = [pa.table({"row": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "total": pa.array([], pa.float64()), "n_grams": pa.array([], pa.int64())})]
        for name, rows in _models(table):
            mine = told.filter(pc.equal(told.column("name"), name))
            known = dict(zip(mine.column("gram").to_pylist(), mine.column("log_p").to_pylist(), strict=True))
            total, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for place, gram, names in pieces(rows.column("text").to_pylist()):
                value = np.fromiter(map(known.__getitem__, names), float, len(names))
                total += np.bincount(place, value[gram], len(total))
                n += np.bincount(place, minlength=len(n))
            out.append(pa.table({"row": rows.column("row").combine_chunks(), "name": pa.array([name] * len(n)), "total": pa.array(total), "n_grams": pa.array(n)}))
        return pa.concat_tables(out)

    held = blocks.select("block", "row", "name", "held", "text")
    return held.groupBy("block").cogroup(answers.select("block", "name", "gram", "log_p").groupBy("block")).applyInArrow(add, "row long, name string, total double, n_grams long")


def score_documents(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, n_grams (characters), perplexity, threshold, trusted, kept.

    trusted: ids of trusted documents (doc_id).  Null texts count as empty and get
    the perplexity of the average held-out trusted text.  Null languages, and those
    with less than two trusted texts, go by the model of all
    languages, whose mean and threshold come from all held-out trusted documents.
    Repeated rows repeat; without any held-out trusted text every document is kept.
    Other columns are ignored; no row gives no row.
    """
    text, lang = F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang")
    rows = docs.select(F.col(id_col).alias("doc_id"), text, lang, F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("part"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("held", F.pmod("hash", F.lit(HELD)) == 0)
    with tidy(docs.sparkSession) as keep, _in_buckets(_blocked(rows).drop("part"), "block") as blocks:
        known = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
        about = blocks.select("block", "row", "doc_id", "lang", "hash", "held").join(known.hint("merge"), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        about = settle(about, "quality-labels")
        share = F.greatest(F.lit(1.0 / HELD), F.least(F.lit(0.5), HELD / F.count("*")))
        least = settle(about.where("trusted").groupBy("lang").agg(F.min("hash").alias("least"), share.alias("share")), "quality-least")
        # The shares are nested: who is held out of a tenth is held out of any share.
        place = (F.floor(F.pmod(F.col("hash"), F.lit(1000 * HELD)) / HELD) + 1000 * F.pmod("hash", F.lit(HELD))) / (1000 * HELD)
        out = F.col("held") | F.coalesce((place < F.col("share")) | (F.col("hash") == F.col("least")), F.lit(False))
        about = settle(about.join(few(least), "lang", "left").withColumn("out", out).drop("hash", "least", "share"), "quality-rows")
        own = settle(count_trusted(blocks, about.where("trusted and not out").select("block", "row")), "gram-counts")
        counts = own.unionByName(own.groupBy(F.lit(ALL).alias("name"), "gram").agg(F.sum("n").alias("n")))
        # A language has a model of its own where it has trusted text to train on; one text is always held out.
        trained = about.where("trusted and lang <> ''").groupBy("lang").agg(F.bool_or(~F.col("out")).alias("some")).where("some")
        named = settle(trained.select("lang", F.concat(F.lit("="), "lang").alias("name")), "quality-languages")
        name = lambda df: df.join(few(named), "lang", "left").withColumn("name", F.coalesce("name", F.lit(ALL)))
        asked = settle(requests(name(blocks)), "gram-requests")
        p = probabilities(counts, asked.select("name", "gram"))
        # Without trusted text there is no model: every n-gram is as likely as any other.
        answers = asked.join(p.hint("merge"), ["name", "gram"], "left").select("block", "name", "gram", F.coalesce(F.log("p"), F.lit(0.0)).alias("log_p"))
        found = settle(sums(name(blocks), answers), "quality-sums")
        own_rows = name(about)
        both = own_rows.withColumn("own", F.lit(True)).unionByName(own_rows.where(f"held and name <> '{ALL}'").withColumn("name", F.lit(ALL)).withColumn("own", F.lit(False)))
        scored = settle(both.join(found.hint("merge"), ["row", "name"], "left").na.fill({"total": 0.0, "n_grams": 0}), "quality-scores")
        fair = f"trusted and case when name = '{ALL}' then held else out end"
        mean = settle(scored.where(fair).where("n_grams > 0").groupBy("name").agg((F.sum("total") / F.sum("n_grams")).alias("mean")), "quality-means")
        smooth = F.exp(-(F.col("total") + PRIOR * F.coalesce("mean", F.lit(0.0))) / (F.col("n_grams") + PRIOR))
        judged = scored.join(few(mean), "name", "left").withColumn("perplexity", smooth)
        limit = settle(judged.where(fair).groupBy("name").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")), "quality-limits")
        kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
        return keep(judged.where("own").join(few(limit), "name", "left").select("doc_id", "lang", "n_grams", "perplexity", "threshold", "trusted", kept.alias("kept")), "quality-done")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return score_documents(read(spark, sf_dir, "documents"), labels.where("quality = 1"))
