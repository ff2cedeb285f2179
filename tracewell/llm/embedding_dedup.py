"""Operator 5: near-duplicate embeddings by int8 tile products with error bounds.

Within a label, unit vectors are quantised to int8 with one scale per vector.
With u = s q + e the product differs from the quantised one by at most
|s_u q_u| |e_v| + |e_u| |v|, so a tile of products tells which pairs may reach
the threshold; only those are computed again in double precision.

Equal vectors of a label are one node with a count.  Tiles of one label meet in
a task of their own; each task sends on one count per row and the links of a
spanning forest, never all its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, read, settle, tidy

THRESHOLD = 0.93
TILE = 2048
#: Rows of a tile multiplied at once.
STRIP = 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scales, norms of the quantised rows, norms of the residuals."""
    scale = np.abs(unit).max(1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool):
    """Yields (rows of left, rows of right) with cosine >= threshold in double precision; i < j where same."""
    norms = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (left, right)]
    (ql, sl, nl, el), (qr, sr, _, er) = (quantise(x / n[:, None]) for x, n in zip((left, right), norms, strict=True))
    qr32 = qr.astype(np.float32)  # products of int8 codes are whole numbers that float32 holds exactly up to 2**24
    exact = left.shape[1] * 127 * 127 < 1 << 24
    for at in range(0, len(left), STRIP):
        rows = slice(at, at + STRIP)
        product = ql[rows].astype(np.float32) @ qr32.T if exact else ql[rows].astype(np.float64) @ qr.T.astype(np.float64)
        most = product * sl[rows, None] * sr + nl[rows, None] * er + el[rows, None] * (1 + 1e-6)
        i, j = np.nonzero(most >= threshold - 1e-5)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 100_000):
            a, b = i[part : part + 100_000], j[part : part + 100_000]
            cosine = np.einsum("ij,ij->i", left[a], right[b]) / (norms[0][a] * norms[1][b])
            yield a[cosine >= threshold], b[cosine >= threshold]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of each place, the least place of its component) after the links between places a and b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        low = np.minimum(la[apart], lb[apart])
        np.minimum.at(label, np.maximum(la[apart], lb[apart]), low)
        while (label[label] != label).any():
            label = label[label]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows compare only where labels are equal and not null.  Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing, nor do
    vectors of different lengths.  A repeated id is a row of its own and links as such.
    A row with a null id links with nothing: n_links 0, no component, kept.
    """
    with tidy(vectors.sparkSession) as keep:
        return keep(_near_vectors(vectors, id_col, vector_col, label_col, threshold), "vector-result")


def _near_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    fit = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)) & F.col("vec_id").isNotNull())
    # -0.0 and 0.0 are one number, as grouping takes them.
    nodes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("vec"), F.count("*").alias("n"))
    # A number of its own for each, as one id may come with several vectors.
    nodes = settle(nodes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    tiles = settle(nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "vector-tiles")
    placed = nodes.join(tiles, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "v")

    def links_of(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        i, j = key[2], key[3]
        own, node, n = tile["own"].to_numpy(), tile["node"].to_numpy(), tile["n"].to_numpy()
        x = np.stack(tile["v"].to_numpy()).astype(float)
        # By powers of two, which changes no digit, so that no square over- or underflows.
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        count, label = np.zeros(len(tile), np.int64), np.arange(len(tile))
        if len(left) and len(right):
            for a, b in linked_pairs(x[left], x[right], threshold, i == j):
                a, b = left[a], right[b]
                np.add.at(count, a, n[b])
                np.add.at(count, b, n[a])
                label = joined(label, a, b)
        forest = [(node[p], node[label[p]]) for p in np.flatnonzero(label != np.arange(len(tile)))]
        some = np.flatnonzero(count)
        return pd.DataFrame(
            {
                "node": np.concatenate((node[some], [f[0] for f in forest])).astype(np.int64),
                "other": pd.array([None] * len(some) + [f[1] for f in forest], dtype="Int64"),
                "links": np.concatenate((count[some], np.zeros(len(forest)))).astype(np.int64),
            }
        )

    found = settle(pairs.groupBy("label", "dim", "i", "j").applyInPandas(links_of, "node long, other long, links long"), "vector-links")
    linked = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "vec", "n").join(counts, "node", "left").join(linked, "node", "left")
    placed = settle(placed.select("node", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vector-placed")
    least = placed.groupBy("component").agg(F.min("vec").alias("component_id"))
    told = placed.join(least, "component").select("node", "n_links", "component_id")
    done = settle(nodes.select("node", "label", "v").join(told, "node").select("label", "v", "n_links", "component_id"), "vector-done")
    back = rows.join(done, ["label", "v"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    return back.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), r AS (
  SELECT vec_id AS s, vec_id AS t FROM v
  UNION
  SELECT r.s, l.b FROM r JOIN l ON r.t = l.a
), c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id)
"""
