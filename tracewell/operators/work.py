"""Published work, symbols and prices: lookups, relatedness, pages and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fold, fold_all, half_up
from .snapshots import _cut
from .spread import dealt, lists


def _apart(nodes: DataFrame) -> DataFrame:
    """(node, area, topic, tags, refs): the traits of a node by their reasons, tags and refs distinct and in order.

    A topic is told with its area and null without one, blank areas are null, and refs
    are empty where there is no such column.
    """
    text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    ref = lambda r: F.when(r.isNotNull(), F.to_json(F.struct(r["kind"].alias("kind"), r["repository"].alias("repository"), r["id"].alias("id"))))
    refs = F.transform("refs", ref) if "refs" in nodes.columns else F.lit(None)
    some = lambda c: F.sort_array(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t != "")))
    folded = nodes.select("node", fold(F.col("area")).alias("area"), fold(F.col("topic")).alias("topic"), fold_all(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), refs.cast("array<string>").alias("refs"))
    return folded.select("node", text("area"), F.when((F.col("area") != "") & (F.col("topic") != ""), F.to_json(F.array("area", "topic"))).alias("topic"), some(F.col("tags")).alias("tags"), some(F.col("refs")).alias("refs"))


def related(nodes: DataFrame, source: str | int) -> DataFrame:
    """node, reasons: what shares a reference, an area, a topic within its area, or a tag with the source node, itself left out.

    Nodes are (node, area, topic, tags) and, if they declare any, refs (kind,
    repository, id).  Each gives one row per trait, and traits meet in an equi-join
    with those of the source, so no pairs of nodes are made.  Comparison ignores case,
    but for refs; a null or blank trait relates nothing.
    """
    traits = lambda reason, values: F.transform(values, lambda v: F.struct(F.lit(reason).alias("reason"), v.alias("value")))
    one = lambda reason: traits(reason, F.array_compact(F.array(reason)))
    rows = _apart(nodes).select("node", F.explode(F.concat(one("area"), one("topic"), traits("tag", F.col("tags")), traits("ref", F.col("refs")))).alias("t")).select("node", "t.reason", "t.value")
    own = rows.where(F.col("node") == source).select("reason", "value").distinct()
    return rows.where(F.col("node") != source).join(own, ["reason", "value"]).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def _grouped(tellings: DataFrame, name: str) -> DataFrame:
    """(reason, value, tags, refs, ``name``): tellings of equal tags and refs in arrays of (area, topic, node), with each of these, and those of equal area too, with their area."""
    member = F.struct("area", "topic", "node")
    trait = lambda reason, column: F.transform(column, lambda v: F.struct(F.lit(reason).alias("reason"), v.alias("value")))
    sets = lists(tellings.where(F.size("tags") + F.size("refs") > 0), ["tags", "refs"], member, name).select("tags", "refs", name, F.explode(F.concat(trait("ref", "refs"), trait("tag", "tags"))).alias("t")).select("t.reason", "t.value", "tags", "refs", name)
    return sets.unionByName(lists(tellings, ["area", "tags", "refs"], member, name).select(F.lit("area").alias("reason"), F.col("area").alias("value"), "tags", "refs", name))


def _told(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, node, reasons) of each pair of tellings that share a trait, told where they meet at their first: the area, else the least ref, else the least tag.

    What tags and refs have in common is found once for all tellings that have the same
    ones, so that a pair costs no more than to compare its areas and topics.
    """
    both = dealt(_grouped(sources, "sources").withColumnsRenamed({"tags": "s_tags", "refs": "s_refs"}), _grouped(nodes, "nodes").withColumnsRenamed({"tags": "n_tags", "refs": "n_refs"}), ["reason", "value"], "nodes")
    least = lambda of: F.array_min(F.array_intersect(f"s_{of}", f"n_{of}"))
    at, shares = (lambda reason: F.col("reason") == reason), (lambda of: F.arrays_overlap(f"s_{of}", f"n_{of}"))
    both = both.where(F.when(at("ref"), F.col("value") == least("refs")).when(at("tag"), ~shares("refs") & (F.col("value") == least("tags"))).otherwise(True))
    why = lambda *more: F.concat_ws(",", F.when(at("area"), "area"), F.when(shares("refs"), "ref"), F.when(shares("tags"), "tag"), *more)
    both = both.select("sources", "nodes", at("area").alias("here"), why().alias("why"), why(F.lit("topic")).alias("why_topic"))
    pairs = both.select(F.explode("sources").alias("s"), "nodes", "here", "why", "why_topic").select(F.col("s.node").alias("source"), F.col("s.area").alias("area"), F.col("s.topic").alias("topic"), F.explode("nodes").alias("n"), "here", "why", "why_topic")
    pairs = pairs.where((F.col("source") != F.col("n.node")) & (F.col("here") | F.coalesce(F.col("area") != F.col("n.area"), F.lit(True))))
    return pairs.select("source", F.col("n.node").alias("node"), F.when(F.col("topic") == F.col("n.topic"), F.col("why_topic")).otherwise(F.col("why")).alias("reasons"))


def related_all(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, reasons) as ``related`` of every node that ``sources`` (node) names.

    Nodes come last, from arrays, so that no result row is shuffled.  Only of nodes that
    are told several times, each telling apart, the rows are made distinct.
    """
    asked = sources.select("node").distinct()
    of = lambda tellings: tellings.join(asked, "node", "left_semi")
    # Traits take long, so they are made once, and by all tasks where a small file is read by one.
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = _cut(_apart(nodes.where("node is not null").repartition(n, "node")))
    repeated = told.groupBy("node").count().where("count > 1").select("node")
    if repeated.isEmpty():
        return _told(of(told), told)
    once, several = told.join(repeated, "node", "left_anti"), told.join(repeated, "node", "left_semi").distinct()
    return _told(of(once), once).unionByName(_told(of(several), once.unionByName(several)).unionByName(_told(of(once), several)).distinct())


def symbols(entries: DataFrame, name: str | None = None, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Entries (name, file, kind) whose name is equal but for case, whose file and kind are equal; None asks nothing."""
    for column, want in ((F.lower("name"), name and name.lower()), (F.col("file"), file), (F.col("kind"), kind)):
        entries = entries.where(column == want) if want is not None else entries
    return entries


def symbols_all(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """``symbols`` for a table of queries (query, name, file, kind): every entry with the query in front; null asks nothing.

    Distinct questions are joined by equality on the first of name, file and kind that
    they ask for, with distinct such entries; queries and entries come last, from arrays.
    """
    own = {"want_name": "__name", "want_file": "file", "want_kind": "kind"}
    q = queries.select("query", F.lower("name").alias("want_name"), F.col("file").alias("want_file"), F.col("kind").alias("want_kind")).withColumn("__asks", F.to_json(F.array(*own)))
    e = entries.withColumn("__name", F.lower("name")).withColumn("__class", F.to_json(F.array(*own.values())))
    asks, kinds = q.select("__asks", *own).distinct(), e.select("__class", *own.values()).distinct()
    found = asks.where(" and ".join(f"{w} is null" for w in own)).crossJoin(kinds)
    for i, want in enumerate(own):
        asked = asks.where(" and ".join([f"{want} is not null", *[f"{w} is null" for w in list(own)[:i]]]))
        found = found.unionByName(asked.join(kinds, F.col(want) == F.col(own[want])))
    for want, column in own.items():
        found = found.where(F.col(want).isNull() | (F.col(want) == F.col(column)))
    asking = found.select("__asks", "__class").join(lists(q, ["__asks"], F.col("query"), "__asking"), "__asks")
    both = dealt(asking, lists(e, ["__class"], F.struct(*[F.col(f"`{c}`") for c in entries.columns]), "__held"), ["__class"], "__held", 4)
    return both.select("__asking", F.explode("__held").alias("__e")).select(F.explode("__asking").alias("query"), "__e.*")


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of the ordered rows; the limit is held between 1 and 50."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(50, max(1, limit)))


def phases(timings: DataFrame, phase: str, value: str) -> DataFrame:
    """Per phase: count, total and largest value."""
    return timings.groupBy(phase).agg(F.count("*").alias("n"), half_up(F.sum(value), 4).alias("total"), F.max(value).alias("most"))


def price_ratio(prices: DataFrame) -> DataFrame:
    """Ratios of input and output prices to a base's, the larger as blended, and the reason where there are none.

    Prices are (id, input, output, base_input, base_output) and base_id, "base" without
    such a column.  A ratio needs
    all four prices, each a number above 0; reason names the first model, of the two,
    without a price or with one that is not.
    """
    bad = lambda i, o: F.when(F.col(i).isNull() & F.col(o).isNull(), "no catalog price for ").when(~F.coalesce((F.col(i) > 0) & (F.col(i) < float("inf")) & (F.col(o) > 0) & (F.col(o) < float("inf")), F.lit(False)), "zero or invalid price for ")
    named = lambda why, name: F.when(why.isNotNull(), F.concat(why, name.cast("string")))
    base = F.col("base_id") if "base_id" in prices.columns else F.lit("base")
    reason = F.coalesce(named(bad("input", "output"), F.col("id")), named(bad("base_input", "base_output"), base))
    ratio = lambda c: F.when(reason.isNull(), half_up(F.try_divide(F.col(c), F.col(f"base_{c}")), 6))
    return prices.select("id", ratio("input").alias("input"), ratio("output").alias("output"), F.greatest(ratio("input"), ratio("output")).alias("blended"), reason.alias("reason"))


def char_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """The leading rows of each group whose running size stays within ``most``; the first overflow ends the group."""
    running = F.sum(F.coalesce(size, F.lit(0))).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= most)
