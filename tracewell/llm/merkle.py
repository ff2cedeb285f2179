"""Operator 13: a Merkle manifest of a dataset, with a proof of every row.

Each language has a tree of its rows in runs of eight, and a tree over the
languages' roots gives the root.  All nodes are written as one table of
coordinates (tree, level, idx) with the tree's number of leaves.  A proof is found
by coordinates alone: from its index and the group size a node explodes the
coordinates of the siblings it needs, joins the node table, orders and concatenates
what it finds, and folds.

A node near the root is a sibling of a large part of all leaves.  Therefore a node
asks for the siblings of STRIDE levels only and takes the rest of its proof from
its ancestor STRIDE levels above, which asks for its own: no node is asked for by
more than 7 * 8**(STRIDE - 1) others, and none hands its proof to more than
8**STRIDE, however large a language is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, ranked, read, settle, tidy

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node has eight children: one level is a shift by three bits.
BITS = 3
RUN = 1 << BITS
#: Levels of siblings that a node asks for itself.
STRIDE = 2
#: Name of the tree over the languages' roots; those of languages are "-" (null) and "=" with the language, in the order asked for.
TOP = ""
STEPS = "array<struct<left: binary, right: binary>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """Digest of a row of the columns FIELDS, some of them replaced."""
    return F.unhex(F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def tampered_text() -> Column:
    """``text`` with A-Z in lower case where 3 divides the row's crc32, else as it is."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels (tree, level, idx, n, hash) of the trees of ``leaves`` (tree, idx, n, hash); n is the tree's number of leaves."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out = [leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "hash")]
    while (most - 1) >> BITS * (len(out) - 1) > 0:
        below = out[-1].where(F.expr(f"shiftright(n - 1, {BITS * (len(out) - 1)}) > 0"))
        runs = below.groupBy("tree", F.shiftright("idx", BITS).alias("idx"), "n").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("child"), "hash"))).alias("run"))
        joined = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["hash"]))), "")
        out.append(settle(runs.select("tree", F.lit(len(out)).alias("level"), "idx", "n", F.unhex(F.sha2(joined, 256)).alias("hash")), "merkle-level"))
    return out


def _roots(nodes: DataFrame) -> DataFrame:
    """(tree, n, hash) of each tree's root, the node of the first level that has one node."""
    alone = f"shiftright(n - 1, {BITS} * level) = 0 and (level = 0 or shiftright(n - 1, {BITS} * (level - 1)) > 0)"
    return nodes.where(alone).select("tree", "n", "hash")


def _segments(nodes: DataFrame) -> DataFrame:
    """(tree, level, idx, steps): for each node of a level that STRIDE divides, its siblings on STRIDE levels, to its left and right."""
    asked = nodes.where(f"level % {STRIDE} = 0 and shiftright(n - 1, {BITS} * level) > 0").select("tree", "level", "idx", "n", F.explode(F.sequence(F.lit(0), F.lit(STRIDE - 1))).alias("up"))
    asked = asked.where(f"shiftright(n - 1, {BITS} * (level + up)) > 0").select("*", F.expr(f"shiftright(idx, {BITS} * up)").alias("own"), F.expr(f"shiftright(n - 1, {BITS} * (level + up))").alias("last"))
    run = F.expr(f"filter(sequence(own - own % {RUN}, least(own - own % {RUN} + {RUN - 1}, last)), x -> x <> own)")
    asked = asked.select("tree", "level", "idx", "n", "up", F.explode_outer(run).alias("sibling"))
    there = nodes.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("idx").alias("sibling_"), "hash")
    found = asked.join(there, (asked.tree == there.t) & (asked.level + asked.up == there.l) & (asked.sibling == there.sibling_), "left")
    found = found.groupBy("tree", "level", "idx", "n").agg(F.array_sort(F.collect_list(F.struct("up", "sibling", "hash"))).alias("found"))
    side = lambda op: f"unhex(array_join(transform(filter(found, x -> x.up = k and x.sibling {op} shiftright(idx, {BITS} * k)), x -> hex(x.hash)), ''))"
    steps = f"transform(filter(sequence(0, {STRIDE - 1}), k -> shiftright(n - 1, {BITS} * (level + k)) > 0), k -> named_struct('left', {side('<')}, 'right', {side('>')}))"
    return found.select("tree", "level", "idx", F.expr(steps).alias("steps"))


def _upper_paths(segments: DataFrame, trees: DataFrame, height: int) -> DataFrame:
    """(tree, idx, path, subroot) of the nodes of level STRIDE, from there to the root of all.

    trees: (tree, n, path, subroot), the path from the tree's own root.  A tree that
    ends below a level stands there with one node.
    """
    ended = lambda level: trees.where(F.expr(f"shiftright(n - 1, {BITS * level}) = 0")).select("tree", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    level = -(-height // STRIDE) * STRIDE
    above = ended(max(level, STRIDE))
    for level in range(level - STRIDE, 0, -STRIDE):
        above = settle(_extended(segments.where(F.col("level") == level), above).select("tree", "idx", "path", "subroot").unionByName(ended(level)), "merkle-paths")
    return above


def _extended(steps: DataFrame, above: DataFrame) -> DataFrame:
    """``steps`` (tree, idx, steps, ...) with ``path``, their own steps and those of the ancestor STRIDE levels above, and its ``subroot``."""
    ancestor = above.select(F.col("tree").alias("a_tree"), F.col("idx").alias("a_idx"), F.col("path").alias("a_path"), "subroot")
    joined = steps.join(ancestor, (steps.tree == ancestor.a_tree) & (F.shiftright(steps.idx, BITS * STRIDE) == ancestor.a_idx))
    return joined.select(*steps.columns, F.concat(F.coalesce("steps", F.array().cast(STEPS)), "a_path").alias("path"), "subroot")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: the columns FIELDS; others are ignored.  Leaves, roots and proofs are of
    ``docs`` as they are; the root is folded again from a leaf whose text is
    ``tampered`` (an expression over the row; by default ``tampered_text``), so that
    ``verified`` is false where the text was changed.  Nulls are fields of their own
    ("-"), a null language is a tree of its own and comes first, null ids come first
    in their tree; rows that share an id are ordered by their leaf, and equal rows
    are leaves of their own.  Texts may be empty or of any length.  An empty table
    gives an empty result.
    """
    text = tampered_text() if tampered is None else tampered
    with tidy(docs.sparkSession) as keep:
        changed = ~text.eqNullSafe(F.col("text"))
        rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"), leaf_hash().alias("hash"), F.when(changed, leaf_hash(text=text)).alias("forged"))
        leaves = settle(ranked(settle(rows, "merkle-rows"), ["tree"], ["doc_id", "hash"], "merkle-ranked"), "merkle-leaves")
        levels = _levels(leaves)
        subroots = settle(_roots(reduce(DataFrame.unionByName, levels)), "merkle-subroots")
        top = settle(ranked(subroots.select(F.lit(TOP).alias("top"), F.col("tree").alias("of"), "hash"), ["top"], ["of"], "merkle-top").withColumnRenamed("top", "tree"), "merkle-top")
        top_levels = _levels(top)
        root = _roots(reduce(DataFrame.unionByName, top_levels)).first()
        root = F.lit(root["hash"].hex() if root else None).cast("string")
        segments = settle(_segments(reduce(DataFrame.unionByName, levels + top_levels)), "merkle-segments")

        ends = top.select("tree", "n", F.array().cast(STEPS).alias("path"), F.lit(None).cast("string").alias("subroot")).limit(1)
        of_top = _extended(top.join(segments.where(F.col("level") == 0), ["tree", "idx"], "left"), _upper_paths(segments.where(F.col("tree") == TOP), ends, len(top_levels)))
        trees = settle(subroots.join(of_top.select(F.col("of").alias("tree"), "path"), "tree").withColumn("subroot", F.lower(F.hex("hash"))), "merkle-trees")
        own = leaves.withColumn("level", F.lit(0)).join(segments, ["tree", "level", "idx"], "left")
        proofs = _extended(own, _upper_paths(segments.where(F.col("tree") != TOP), trees, len(levels)))
        text_of = lambda b: F.lower(F.hex(b))
        fold = F.aggregate("path", text_of(F.coalesce("forged", "hash")), lambda h, x: F.sha2(F.concat(text_of(x["left"]), h, text_of(x["right"])), 256))
        siblings = F.array_join(F.transform("path", lambda x: F.concat(text_of(x["left"]), text_of(x["right"]))), "")
        found = proofs.select("doc_id", text_of("hash").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root"))
        return keep(found.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """``manifest`` of the whole table ``documents``; odd rows as stated there."""
    return manifest(read(spark, sf_dir, "documents"))


def _sql_leaf(text: str) -> str:
    part = lambda c, v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    return "sha256(" + " || ".join(part(c, text if c == "text" else f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"


OP13_SQL = f"""
WITH RECURSIVE chosen AS (
    SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
    FROM documents
), leaves AS (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_sql_leaf("text")} AS leaf, {_sql_leaf("other")} AS forged FROM chosen
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
    SELECT tree, 0 AS level, idx, n, leaf AS hash FROM placed
    UNION ALL
    SELECT tree, any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, idx // 8
), tops AS (
    SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, idx, n, hash FROM tops
    UNION ALL
    SELECT any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY idx // 8
), every_node AS (
    SELECT tree, level, idx, n, hash FROM nodes UNION ALL SELECT '', level, idx, n, hash FROM upper
), sides AS (
    SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lo, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS hi
    FROM every_node a JOIN every_node b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL
), low AS (
    SELECT doc_id, leaf, tree, n, idx AS own, 0 AS level, idx, forged AS h, '' AS proof FROM placed
    UNION ALL
    SELECT l.doc_id, l.leaf, l.tree, (l.n + 7) // 8, l.own, l.level + 1, l.idx // 8, sha256(s.lo || l.h || s.hi), l.proof || s.lo || s.hi
    FROM low l JOIN sides s ON l.tree = s.tree AND l.level = s.level AND l.idx = s.idx WHERE l.n > 1
), high AS (
    SELECT l.doc_id, l.leaf, l.tree, l.own, t.hash AS subroot, t.n, 0 AS level, t.idx, l.h, l.proof FROM low l JOIN tops t ON l.tree = t.tree WHERE l.n = 1
    UNION ALL
    SELECT h.doc_id, h.leaf, h.tree, h.own, h.subroot, (h.n + 7) // 8, h.level + 1, h.idx // 8, sha256(s.lo || h.h || s.hi), h.proof || s.lo || s.hi
    FROM high h JOIN sides s ON s.tree = '' AND h.level = s.level AND h.idx = s.idx WHERE h.n > 1
)
SELECT doc_id, leaf, subroot, (SELECT hash FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT hash FROM upper WHERE n = 1) AS verified
FROM high WHERE n = 1
"""
