"""Operator 2: near duplicates by ProbMinHash, banding and verification.

Shingles of five words are weighted by their counts.  Each shingle is a Poisson
process whose rate is its weight; arrivals fall on registers at random, a
register keeps the shingle that reaches it first, and a shingle stops as soon as
its next arrival is later than every register of its document.  The share of
equal registers estimates the probability Jaccard similarity

    J_P(a, b) = sum over i in both of 1 / sum over j of max(a_j / a_i, b_j / b_i),

which is the Jaccard similarity where all counts are one.  Bands of registers
give candidates, and J_P of the whole texts decides.

Hot buckets: documents with the same weighted shingles are one node.  The leader
of a bucket is the node whose bands lie in the fullest buckets, which for copies
of one text is the text itself or what is closest to it.  Every node is verified
with the leader it shares most bands with, and what links is contracted.  Only
buckets that still hold several components go on: their nodes meet in tiles of
compact sketches, members of the largest component with the others alone, which
tells the nodes with a close partner of another component.  Those meet again, now
with their texts; a tile verifies its close pairs, the closest first, leaves out
pairs that its links have joined already, and gives the links of a forest.  A
pair that shares several buckets is taken in the first.  Pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_texts, read, settle, texts, tidy

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Documents whose registers are computed at once; nodes per side of a tile.
BLOCK_DOCS = 500
TILE = 512
#: Rows of small buckets that share a call, on average: a call of its own for each would cost more than its work.
BIN = 512
#: A text counts as one node more for each such number of characters, so that a tile's texts stay within some megabytes.
TILE_CHARS = 32_768
#: Sketches below this share of equal registers are not verified; it is 4.7 standard deviations below 0.8, a few pairs in a million.
SKETCH_FLOOR = 0.65
#: Bytes of a band in a sketch of 16 bits a register.
BAND_BYTES = 2 * ROWS

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of lower-case words, ascending, and their counts.

    Fewer words than a shingle has make one shingle; no word makes none.
    """
    w = np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split()), np.uint64)
    if not len(w):
        return w, np.zeros(0)
    n = max(1, len(w) - words + 1)
    h = np.full(n, len(w) if len(w) < words else words, np.uint64)
    for k in range(min(words, len(w))):
        h = _mix(h * U(0x9E3779B97F4A7C15) + w[k : k + n])
    h.sort()
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, n)).astype(float)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted shingle sets; 0 where either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][ia], b[1][ib]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    # sum_j max(a_j / a_i, b_j / b_i): over the shared j sorted by a_j / b_j, the first part takes b_j / b_i, the rest a_j / a_i.
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb = ratio[order], wa[order], wb[order]
    cum_b, cum_a = np.concatenate(([0.0], np.cumsum(wb))), np.concatenate(([0.0], np.cumsum(wa)))
    split = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(1.0 / ((cum_b[split] + only_b) / wb + (cum_a[-1] - cum_a[split] + only_a) / wa)))


def registers(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of weighted sets: one row of m element hashes each, 0 for empty sets."""
    doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    element = np.concatenate([s[0] for s in sets]) if sets else np.zeros(0, np.uint64)
    weight = np.concatenate([s[1] for s in sets]) if sets else np.zeros(0)
    at = np.full(len(sets) * m, np.inf)
    held = np.zeros(len(sets) * m, np.uint64)
    time, step = np.zeros(len(element)), 0
    while len(element):
        step += 1
        draw = _mix(element + U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> U(11)).astype(float) + 0.5) * 2.0**-53) / weight
        latest = at.reshape(-1, m).max(1)
        alive = time < latest[doc]
        doc, element, weight, time, draw = doc[alive], element[alive], weight[alive], time[alive], draw[alive]
        slot = doc * m + (_mix(draw ^ U(0xD6E8FEB86659FD93)) % U(m)).astype(np.int64)
        np.minimum.at(at, slot, time)
        won = at[slot] == time
        held[slot[won]] = element[won]
    return held.reshape(-1, m)


def features(rows: DataFrame) -> DataFrame:
    """``rows`` with text replaced by fingerprint (of the weighted shingles, null without words) and sketch (16 bits a register, band by band)."""

    def make():
        def run(block: list[str]) -> list:
            sets = [shingles(t) for t in block]
            prints = [xxhash.xxh128_digest(h.tobytes() + w.tobytes()) if len(h) else None for h, w in sets]
            return [pa.array(prints, pa.binary()), pa.array([row.tobytes() for row in _mix(registers(sets)).astype(np.uint16)], pa.binary())]

        return run

    return map_texts(rows, make, "fingerprint binary, sketch binary", BLOCK_DOCS)


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, node, leader: members of the buckets that hold several nodes; of ``nodes`` (node, sketch).

    The lowest bits of a key are the number of its band.
    """
    band = lambda k: F.xxhash64(F.substring("sketch", k * BAND_BYTES + 1, F.lit(BAND_BYTES)), k)
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: band(k) - F.pmod(band(k), F.lit(BANDS)) + k)
    banded = nodes.select("node", F.explode(keys).alias("key"))
    sizes = settle(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-bucket-sizes")
    members = settle(banded.join(sizes.hint("merge"), "key"), "near-members")
    popular = settle(members.groupBy("node").agg(F.sum("n").alias("popular")), "near-popular")
    ranked = members.join(popular.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("popular", F.negative("node").alias("minus"))).alias("lead"))
    lead = settle(ranked.select("key", F.negative("lead.minus").alias("leader")), "near-leaders")
    return settle(members.select("key", "node").join(lead.hint("merge"), "key"), "near-buckets")


def _open_members(buckets: DataFrame, linked: DataFrame) -> DataFrame:
    """key, node, component, main: members of the buckets that hold several components; main: of the bucket's largest component."""
    placed = settle(buckets.select("key", "node").join(linked.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "near-placed")
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    several = settle(several.select("key", F.col("top.component").alias("largest")), "near-several")
    return settle(placed.join(several.hint("merge"), "key").select("key", "node", "component", (F.col("component") == F.col("largest")).alias("main")), "near-open")


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` (key, node, component, main, size, ...) dealt over tiles: call, key, i, j and own besides.

    size is what a member counts as in a tile.  Members of the largest component
    meet the others only: a tile (i, j) holds others i with main members j >= 0,
    or others i with others -1 - j.
    """
    side = members.groupBy("key").agg(F.sum(F.when(F.col("main"), F.col("size")).otherwise(0)).alias("n_main"), F.sum(F.when(F.col("main"), 0).otherwise(F.col("size"))).alias("n_other"))
    tiles = {main: F.greatest(F.lit(1), F.ceil(F.col(n) / TILE)).cast("int") for main, n in ((True, "n_main"), (False, "n_other"))}
    own = F.pmod(F.xxhash64("node", "key"), F.when(F.col("main"), tiles[True]).otherwise(tiles[False])).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    spots = F.when(F.col("main"), F.transform(upto(tiles[False]), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))).otherwise(
        F.concat(
            F.transform(upto(tiles[True]), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
            F.transform(upto(tiles[False]), lambda j: F.struct(F.least("own", j).alias("i"), (-1 - F.greatest("own", j)).alias("j"))),
        )
    )
    bins = max(1, -(-members.count() // BIN))
    call = F.when(F.col("n_main") + F.col("n_other") <= TILE, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.xxhash64("key", "spot.i", "spot.j"))
    placed = members.join(settle(side, "near-sides").hint("merge"), "key").withColumn("own", own).withColumn("spot", F.explode(spots))
    return placed.select(call.alias("call"), "key", "spot.i", "spot.j", "own", *[c for c in members.columns if c not in ("key", "size")])


def _tiles(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Of each tile of one call: its rows, and its close pairs (two columns of places) with their shares of equal registers.

    Close: of different components, with SKETCH_FLOOR of equal registers, and with the tile's band as the first that they share.
    """
    rows = rows.sort_values(["key", "i", "j"], kind="stable", ignore_index=True)
    key, i, j = (rows[c].to_numpy() for c in ("key", "i", "j"))
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    for at, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        tile = rows.iloc[at:end]
        sketch = np.frombuffer(b"".join(tile["sketch"]), np.uint16).reshape(len(tile), BANDS, ROWS)
        own, part, main = (tile[c].to_numpy() for c in ("own", "component", "main"))
        left = np.flatnonzero(~main & (own == i[at]))
        right = np.flatnonzero(main if j[at] >= 0 else own == -1 - j[at])
        same, band = j[at] < 0 and i[at] == -1 - j[at], key[at] & (BANDS - 1)
        pairs, shares = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        for a in left:
            others = right[right > a] if same else right
            others = others[part[others] != part[a]]
            equal = sketch[others] == sketch[a]
            share = equal.mean((1, 2))
            near = np.flatnonzero(share >= SKETCH_FLOOR)
            bands = equal[near].all(2)
            near = near[bands[:, band] & (bands.argmax(1) == band)] if len(near) else near
            pairs.append(np.column_stack((np.full(len(near), a), others[near])))
            shares.append(share[near])
        yield tile, np.concatenate(pairs), np.concatenate(shares)


def _with_partner(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, component, main of the members that are in a close pair."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        found = [tile.iloc[np.unique(pairs)] for tile, pairs, _ in _tiles(rows)]
        return pd.concat(found)[["key", "node", "component", "main"]]

    sent = _dealt(members.join(nodes.select("node", "sketch").hint("merge"), "node").withColumn("size", F.lit(1)))
    return sent.groupBy("call").applyInPandas(find, "key long, node long, component long, main boolean").distinct()


def _tile_links(members: DataFrame, nodes: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) with J_P >= threshold over whole texts between close members: of each tile a spanning forest."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        links = []
        for tile, pairs, shares in _tiles(rows):
            node, text, root = tile["node"].to_numpy(), tile["text"].to_numpy(), {c: c for c in tile["component"].tolist()}
            part = tile["component"].tolist()
            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for a, b in pairs[np.argsort(-shares, kind="stable")].tolist():
                if top(part[a]) == top(part[b]):
                    continue
                for x in (a, b):
                    if x not in sets:
                        sets[x] = shingles(text[x])
                if probability_jaccard(sets[a], sets[b]) >= threshold:
                    root[top(part[a])] = top(part[b])
                    links.append((node[a], node[b]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    whole = members.join(nodes.select("node", "sketch").hint("merge"), "node").join(held.hint("merge"), "node")
    sent = _dealt(settle(whole.withColumn("size", 1 + F.floor(F.char_length("text") / TILE_CHARS)), "near-whole"))
    return sent.groupBy("call").applyInPandas(find, "a long, b long")


def _verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with J_P >= threshold over whole texts; held: node, text.

    The joins merge at every size: what is broadcast would grow with the corpus.
    """
    left = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").hint("merge").join(left, "a").join(right.hint("merge"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list = [(None, None), (None, None)]
        for batch in batches:
            keep = []
            for pair in zip(batch["text_a"], batch["text_b"], strict=True):
                last = [old if old[0] == t else (t, shingles(t)) for old, t in zip(last, pair, strict=True)]
                keep.append(probability_jaccard(last[0][1], last[1][1]) >= threshold)
            yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def _contracted(linked: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after more links (a, b): they are joined between components, not between nodes."""
    if links.isEmpty():
        return linked
    of = lambda end: linked.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")).hint("merge")
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = settle(components(ends).select(F.col("id").alias("component"), F.col("component").alias("lowest")), "near-joined")
    moved = linked.join(joined.hint("merge"), "component", "left").select("node", F.coalesce("lowest", "component").alias("component"))
    return settle(moved.unionByName(joined.select(F.col("component").alias("node"), F.col("lowest").alias("component"))).distinct(), "near-linked")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size (rows), kept.

    class_id is the smallest id of the rows linked directly or through others; one
    row with that id is kept.  Words are what white space separates, in lower case.
    Texts without words (null, empty, blank) link with nothing.  Rows with a null id
    are compared like any other; a class of such rows alone has a null class_id and
    keeps one of them.  Rows that repeat an id are rows of their own: each is compared
    by its own text.  Other columns are ignored; no row gives no row.
    """
    with tidy(docs.sparkSession) as keep:
        rows = texts(docs, id_col, text_col).withColumn("of_text", F.xxhash64("text"))
        found = settle(features(rows.withColumn("row", F.monotonically_increasing_id())), "near-features")
        # Equal weighted shingles: one node, and a row that has its text.
        nodes = found.where("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct("doc_id", "of_text")).alias("sample"), F.first("sketch").alias("sketch"))
        nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
        buckets = _buckets(nodes)
        wanted = nodes.join(buckets.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.col("sample.doc_id").alias("id"), F.col("sample.of_text").alias("hash"))
        same = rows["doc_id"].eqNullSafe(F.col("id")) & (rows["of_text"] == F.col("hash"))
        held = settle(rows.join(wanted.hint("merge"), same).select("node", "text").dropDuplicates(["node"]), "near-texts")
        # Every node with the leader it shares most bands with (b: the leader, which may be hot).
        first = buckets.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("hits"))
        first = first.groupBy("node").agg(F.max(F.struct("hits", "leader")).alias("x")).select(F.col("node").alias("a"), F.col("x.leader").alias("b"))
        linked = settle(components(_verified(settle(first, "near-first"), held, threshold)).withColumnRenamed("id", "node"), "near-linked")
        members = settle(_with_partner(_open_members(buckets, linked), nodes), "near-partners")
        linked = _contracted(linked, settle(_tile_links(members, nodes, held, threshold), "near-links"))
        named = found.select("row", "doc_id", "fingerprint").join(nodes.select("fingerprint", "node").hint("merge"), "fingerprint", "left")
        # Rows without words are classes of their own, below zero.
        classed = named.join(linked.hint("merge"), "node", "left").select("row", "doc_id", F.coalesce("component", "node", -1 - F.col("row")).alias("class"))
        classed = settle(classed, "near-classes")
        first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
        each = settle(classed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), first_row.alias("kept_row")), "near-each")
        done = classed.join(each.hint("merge"), "class").select("doc_id", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept"))
        return keep(done, "near-done")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
