"""Ordered lists: pages, top rows, ranks, budgets, first-seen unions and groups of tasks.

Reserved column names begin with two underscores; input columns of any other name stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import WHITE, fold, fold_all


def page_of(rows: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, int | None]:
    """One page and the next offset, None at the end; the limit is held between 1 and 50."""
    limit, offset = min(50, max(1, limit)), max(0, offset)
    found = rows.orderBy(*order).offset(offset).limit(limit)
    more = bool(rows.orderBy(*order).offset(offset + limit).limit(1).take(1))
    return found, offset + limit if more else None


def pages(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with page (from 0) and place (from 1) within each group of ``keys``, pages of ``size`` rows."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).withColumn("page", F.floor((F.col("place") - 1) / size).cast("long"))


def text_pages(texts: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Each text in pieces of ``size`` code points: page (from 0) and piece in place of the text; null and empty texts give none."""
    n = F.ceil(F.char_length(text) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = texts.select(*[F.col(f"`{c}`") for c in texts.columns], F.explode(F.coalesce(starts, F.array().cast("array<int>"))).alias("page"))
    return out.withColumn("piece", F.substring(F.col(text), F.col("page") * size + 1, F.lit(size))).drop(text)


def tail_lines(outputs: DataFrame, most: int = 20, width: int = 2000, text: str = "text") -> DataFrame:
    """``outputs`` with their last ``most`` non-final-empty lines, each cut to ``width`` code points and an ellipsis; null counts as empty."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\n$", ""), "\n")
    last = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - most + 1), most)
    return outputs.withColumn("tail", F.array_join(F.transform(last, lambda x: F.when(F.char_length(x) > width, F.concat(F.substring(x, 1, width), F.lit("…"))).otherwise(x)), "\n"))


def palette(commands: DataFrame, query: str) -> DataFrame:
    """Commands (grp, pos, label, command, description) that match, with rank and place in their group.

    Label that begins with the query 0, contains it 1, holds its letters in order 2,
    command that contains it 3, description 4; equals stay in order; case is ignored;
    a blank query keeps all at 0.
    """
    q = query.strip().lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    letters = ".*".join(c if c.isalnum() else "\\" + c for c in q)
    rank = F.lit(0) if not q else F.when(low("label").startswith(q), 0).when(low("label").contains(q), 1).when(low("label").rlike(f"(?s){letters}"), 2).when(low("command").contains(q), 3).when(low("description").contains(q), 4)
    found = commands.withColumn("rank", rank.cast("long")).where("rank is not null")
    return found.withColumn("place", F.row_number().over(W.partitionBy("grp").orderBy("rank", "pos")).cast("long"))


def first_seen(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Distinct values of each key in the order of their first ``pos``: keys, value, pos."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(pos).alias(pos))


def tagged_union(parts: dict[str, DataFrame | None], tag: str = "repository") -> DataFrame:
    """Rows of all parts with the name of each; a part that failed (None) gives one row of nulls with failed true."""
    known = next(p for p in parts.values() if p is not None)
    out = None
    for name, part in parts.items():
        rows = known.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema]) if part is None else part.select(known.columns)
        rows = rows.withColumn(tag, F.lit(name)).withColumn("failed", F.lit(part is None))
        out = rows if out is None else out.unionByName(rows)
    return out


def by_name(entries: DataFrame) -> DataFrame:
    """Of entries (name, project, pos) with one name, the first of a project, else the first; by minima, so hot names need no task."""
    whole = F.struct(*[F.col(f"`{c}`") for c in entries.columns])
    return entries.groupBy(F.col("name").alias("__name")).agg(F.min_by(whole, F.struct(~F.coalesce("project", F.lit(False)), "pos")).alias("__row")).select("__row.*")


def recent(entries: DataFrame, most: int, at: str = "last_seen", tie: str = "key") -> DataFrame:
    """The ``most`` entries seen last; what is evicted is what comes after them."""
    return entries.orderBy(F.desc(at), tie).limit(most)


def task_groups(tasks: DataFrame, finished: int = 5) -> DataFrame:
    """Tasks (id, session, active, created, ended) with grp and place: by session, a blank one alone; active ones first, newest first, then those that ended last, at most ``finished``."""
    group = F.when(F.coalesce(F.trim("session"), F.lit("")) == "", F.concat(F.lit("task "), F.col("id").cast("string"))).otherwise(F.col("session"))
    order = W.partitionBy("grp").orderBy(F.desc("active"), F.desc(F.when(F.col("active"), F.col("created")).otherwise(F.col("ended"))), "id")
    ended = F.count_if(~F.col("active")).over(order.rowsBetween(W.unboundedPreceding, 0))
    out = tasks.withColumn("grp", group).withColumn("place", F.row_number().over(order).cast("long")).withColumn("__ended", ended)
    return out.where(F.col("active") | (F.col("__ended") <= finished)).drop("__ended")


def widget(tasks: DataFrame, now: int, recent_for: int, most: int) -> DataFrame:
    """At most ``most`` tasks (id, active, started, ended): the active first, then those that ended within ``recent_for``, in the order they started."""
    shown = tasks.where(F.col("active") | (F.lit(now) - F.col("ended") < recent_for))
    return shown.orderBy(F.desc("active"), F.desc(F.coalesce("ended", "started")), "id").limit(most).orderBy("started", "id")


def visible(rows: DataFrame, keys: list[str], order: list[str], selected: str, most: int) -> DataFrame:
    """The rows of each list that a view of ``most`` rows shows: the selected one in the middle where there is room; adds place, from 0.

    selected: a boolean column, true for one row at most; without one the first rows
    are shown.
    """
    whole = W.partitionBy(*keys)
    placed = rows.withColumns({"__at": F.row_number().over(whole.orderBy(*order)) - 1, "__n": F.count("*").over(whole)})
    placed = placed.withColumn("__to", F.coalesce(F.max(F.when(F.col(selected), F.col("__at"))).over(whole), F.lit(0)))
    first = F.greatest(F.lit(0), F.least(F.col("__to") - most // 2, F.col("__n") - most))
    return placed.where((F.col("__at") >= first) & (F.col("__at") < first + most)).withColumn("place", F.col("__at").cast("long")).drop("__at", "__n", "__to")


def collated(rows: DataFrame, keys: list[str], names: list[str], then: list[str]) -> DataFrame:
    """``rows`` with place, from 1, in each group: by ``names`` as a reader sorts them - letters before accents before case - and ``then`` by value."""
    order = [F.collate(F.col(c), "UNICODE") for c in names] + [F.col(c) for c in then]
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def fitting(rows: DataFrame, keys: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Rows that fit a budget of each group in order: one that is too large is left out, and smaller ones after it may still fit.

    Rows are sorted by group and pass one after the other; what is carried along is
    the group's name and how much of its budget is used, so that a group of any length
    takes no memory.  A null size counts as 0.
    """
    amount = F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n")
    group = F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])).alias("__group")
    placed = rows.select(*[F.col(f"`{c}`") for c in rows.columns], amount, group).repartition("__group").sortWithinPartitions("__group", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, 0
        for batch in batches:
            kept = []
            for name, n in zip(batch.column("__group").to_pylist(), batch.column("__n").to_pylist(), strict=True):
                at, used = name, used if name == at else 0
                kept.append(used + n <= most)
                used += n if kept[-1] else 0
            yield batch.filter(pa.array(kept, pa.bool_())).select(columns)

    columns = rows.columns
    return placed.mapInArrow(run, rows.schema)


def unique_or_unknown(peers: DataFrame, headers: DataFrame, activations: DataFrame) -> DataFrame:
    """(peer, header, activation) of peers (peer): what is there exactly once, else "unknown"."""
    one = lambda df, value: df.groupBy("peer").agg(F.when(F.count("*") == 1, F.max(value)).alias(value))
    out = peers.select("peer").distinct().join(one(headers, "header"), "peer", "left").join(one(activations, "activation"), "peer", "left")
    whole = F.col("header").isNotNull() & F.col("activation").isNotNull()
    return out.select("peer", F.when(whole, F.col("header")).otherwise("unknown").alias("header"), F.when(whole, F.col("activation")).otherwise("unknown").alias("activation"))


def annotated(tasks: DataFrame, annotations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tasks (keys, id, ...) with their annotation, and per key the number of annotations without a task."""
    return tasks.join(annotations, [*keys, "id"], "left"), annotations.join(tasks.select(*keys, "id"), [*keys, "id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("unmatched"))


def match_work(nodes: DataFrame, area: str | None = None, topic: str | None = None, tag: str | None = None, text: str | None = None, root: str | None = None) -> DataFrame:
    """(node, reasons) of nodes (node, label, area, topic, tags, root) that meet every filter given; without any, all, as "classified"."""
    low = lambda c: fold(F.coalesce(F.col(c), F.lit("")))
    tags = fold_all(F.coalesce("tags", F.array().cast("array<string>")))
    tests = []
    for want, name, test in (
        (area, "area", lambda w: low("area") == w), (topic, "topic", lambda w: low("topic") == w), (tag, "tag", lambda w: F.array_contains(tags, w)),
        (text, "text", lambda w: F.exists(F.concat(F.array(low("label"), low("area"), low("topic")), tags), lambda x: F.contains(x, F.lit(w)))),
    ):
        if want is not None:
            nodes = nodes.where(test(unicodedata.normalize("NFC", want).strip(WHITE).lower()))
            tests.append(name)
    if root is not None:
        nodes, tests = nodes.where(F.col("root") == root), [*tests, "repository_root"]
    return nodes.select("node", F.lit(",".join(tests) or "classified").alias("reasons"))
