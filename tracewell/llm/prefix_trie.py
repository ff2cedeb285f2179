"""Operator 11: the prefix trie of conversations, built level by level.

Down: at each depth the live conversations are grouped by their node and their next
turn; a group is a node of the next depth, named by its smallest conversation id.
A conversation that is alone at its node is live no longer: the rest of its nodes is
a chain, made in one step at the end, so that the number of rounds is the longest
prefix that two conversations share, not the longest conversation.  Up: the levels
are joined in reverse, so that each node sums leaves and savings of its children.

A first turn may be that of a third of all conversations.  Groups are therefore
counted by salt and then as a whole, and go back to their members by salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, ranked, read, settle, tidy

#: A conversation takes up to MOST_SHARED - 1 turns of the conversation at the next lower multiple of BLOCK.
BLOCK, MOST_SHARED = 100, 6
#: Members of a group that may share a salt, about.
GROUP_ROWS = 100_000
MIN_SALTS = 16
#: Ids joined to one string before it is digested; nodes of a chain made from one row.
IDS, CHAIN = 4096, 4096


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): (conv_id, depth from 1, key, size) and (conv_id, length) of the rebuilt conversations.

    key: digest of role and text, told apart by the role's length; size: code points of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), key.alias("key"), F.char_length(text).cast("long").alias("size"))
    own = settle(ranked(settle(rows, "trie-rows"), ["conv_id"], ["turn", "role", "key"], "trie-ranked").select("conv_id", "idx", "n", "key", "size"), "trie-turns")
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    convs = own.groupBy("conv_id").agg(F.first("n").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    bases = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = settle(convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-convs")
    first = own.where(f"idx < {MOST_SHARED - 1} and conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("base"), "idx", "key", "size")
    given = convs.where("given > 0").select("conv_id", "base", "given").join(first, "base").where("idx < given").select("conv_id", (F.col("idx") + 1).alias("depth"), "key", "size")
    # By blocks of turns, so that a conversation of very many turns does not meet in one task.
    block = F.floor(F.col("idx") / CHAIN).alias("block")
    blocks = convs.select("conv_id", "given", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHAIN})")).alias("block"))
    kept = own.where(F.col("idx") >= h).select("*", block).join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("given") + F.col("idx") - h + 1).alias("depth"), "key", "size")
    lengths = convs.select("conv_id", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    turns = given.unionByName(kept)
    return settle(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "trie-rebuilt"), settle(lengths, "trie-lengths")


def _grouped(live: DataFrame, salts: int) -> DataFrame:
    """Members (conv_id, length, node, parent, n_convs, size) of the next level from (conv_id, length, parent, key, size)."""
    step = settle(live.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts))), "trie-step")
    parts = step.groupBy("parent", "key", "salt").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"))
    whole = parts.groupBy("parent", "key").agg(F.min("node").alias("node"), F.sum("n_convs").alias("n_convs"))
    back = parts.select("parent", "key", "salt").join(whole, ["parent", "key"])
    return settle(step.join(back, ["parent", "key", "salt"]).select("conv_id", "length", "node", "parent", "n_convs", "size"), "trie-level")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of the ids in (depth, node, conv_id), in order and joined by commas.

    Ids of a node are joined to strings of IDS each, and the strings pass a digest
    one after the other, so that a node at which very many end takes little memory.
    """
    parts = ranked(ends, ["depth", "node"], ["conv_id"], "trie-ends").groupBy("depth", "node", F.floor(F.col("idx") / IDS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) != at:
                    if digest:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (depth, node), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "node", "ends_sha256"), x, strict=True)) for x in done], schema=out)
        if digest:
            yield pa.RecordBatch.from_pylist([{"depth": at[0], "node": at[1], "ends_sha256": digest.hexdigest()}], schema=out)

    out = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])
    return parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "block").mapInArrow(run, "depth long, node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; other columns are ignored.  Turns are
    ordered by turn, null first, where it is equal by role and then by digest; null
    role or text counts as empty, repeated turns are turns of their own, texts may
    have any length.  Rows without a conv_id belong to no conversation and are left out.  A
    conversation whose rebuilt turns are none ends at the root.  An empty table
    gives an empty result.
    """
    with tidy(conversations.sparkSession) as keep:
        turns, lengths = rebuilt(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))
        total, first = lengths.agg(F.count("*"), F.min("conv_id")).first()
        salts = max(MIN_SALTS, total // GROUP_ROWS)
        # Members of shared nodes by depth; all conversations share the root.
        at = lengths.select("conv_id", "length", F.lit(first).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("size"))
        levels = [at]
        while not (live := at.where(f"n_convs > 1 and length >= {len(levels)}").select("conv_id", "length", F.col("node").alias("parent"))).isEmpty():
            at = _grouped(live.join(turns.where(F.col("depth") == len(levels)).select("conv_id", "key", "size"), "conv_id"), salts)
            levels.append(at)

        shared = lambda d: levels[d].where("n_convs > 1")
        depth_of = lambda df, d: df.withColumn("depth", F.lit(d).cast("long"))
        ups, alones, below = [], [], None
        for d in range(len(levels) - 1, -1, -1):
            alone = levels[d].where("n_convs = 1")
            alones.append(depth_of(alone, d))
            up = shared(d).where("conv_id = node").select("node", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
            if below is None:
                up = up.select("*", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"))
            else:
                sums = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
                up = up.join(sums, "node", "left").select("node", "parent", "n_convs", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"))
            ups.append(up := settle(depth_of(up, d), "trie-up"))
            below = up.select("parent", "n_leaves", "saved").unionByName(alone.select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))

        nodes, chains = reduce(DataFrame.unionByName, ups), reduce(DataFrame.unionByName, alones)
        ends = reduce(DataFrame.unionByName, [depth_of(shared(d).where(F.col("length") == d).select("node", "conv_id"), d) for d in range(len(levels))])
        none = F.sha2(F.lit(""), 256)
        nodes = nodes.join(_digests(settle(ends, "trie-ends")), ["depth", "node"], "left").select(
            F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
        )
        blocks = chains.select("conv_id", "depth", "length", "parent", F.explode(F.expr(f"sequence(0L, (length - depth) div {CHAIN})")).alias("block")).repartition("conv_id", "block")
        steps = blocks.select("conv_id", F.col("depth").alias("start"), "length", "parent", F.explode(F.expr(f"sequence(depth + block * {CHAIN}, least(length, depth + block * {CHAIN} + {CHAIN - 1}))")).alias("depth"))
        last = F.col("depth") == F.col("length")
        one = lambda n: F.lit(n).cast("long")
        chain = steps.select(
            "conv_id", "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one(1).alias("n_convs"), F.when(last, one(0)).otherwise(one(1)).alias("n_children"),
            one(1).alias("n_leaves"), one(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
        )
        return keep(nodes.unionByName(chain), "trie-nodes")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """``prefix_trie`` of the whole table ``conversations``; odd rows as stated there."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


OP11_SQL = f"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS idx
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % {BLOCK} AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {MOST_SHARED} AS h FROM own
), turns AS (
    SELECT c.conv_id, o.idx, 0 AS part, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.idx < c.h
    UNION ALL
    SELECT c.conv_id, o.idx, 1, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.idx >= c.h
), whole AS (
    SELECT c.conv_id, coalesce(list({{'role': t.role, 'text': t.text}} ORDER BY t.part, t.idx) FILTER (t.role IS NOT NULL), []) AS turns
    FROM convs c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
    SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) AS length FROM whole, unnest(range(0, len(turns) + 1)) AS u(d)
), nodes AS (
    SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, coalesce(any_value(length(prefix[depth].text)), 0) AS size,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, prefix
), member AS (
    SELECT p.conv_id, p.depth, n.node, n.n_convs, n.size FROM prefixes p JOIN nodes n ON p.depth = n.depth AND p.prefix = n.prefix
), paths AS (
    SELECT n.depth AS own_depth, n.node AS own_node, n.n_convs, n.size, m.depth, m.node FROM nodes n JOIN member m ON m.conv_id = n.node AND m.depth <= n.depth
), child AS (
    SELECT depth, node, count(*) AS n FROM paths WHERE own_depth = depth + 1 GROUP BY ALL
), sums AS (
    SELECT p.depth, p.node, sum((p.n_convs - 1) * p.size) AS saved, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves
    FROM paths p LEFT JOIN child c ON c.depth = p.own_depth AND c.node = p.own_node GROUP BY ALL
)
SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.node AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.node = n.node LEFT JOIN child c ON c.depth = n.depth AND c.node = n.node
LEFT JOIN member p ON p.conv_id = n.node AND p.depth = n.depth - 1
"""
