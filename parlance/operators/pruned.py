"""C9 with pruning: exact k nearest points that only compares a point with blocks which can hold one of them.

``pivots`` points of a group (the smallest hashes) cut it into cells, a cell of more than ``block_size`` points into sub-blocks.  A block
knows the least and largest distance of its points to every pivot; by the triangle inequality a point x is at least
max over pivots p of (least − d(x, p), d(x, p) − largest) away from all of them.  Two passes:

* within its own block a point finds k candidates, the k-th distance bounds its answer from above;
* it travels to the other blocks whose bound is not beyond that, in chunks, so that a sought-after block is not one task.

A group's blocks are one row (blocks × pivots numbers); a point is tested against them by an expression.  Rows equal ``neighbours.knn``,
ties included (by id).  Where distances hardly differ (many independent dimensions) little is skipped: ``report`` tells.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..clustering.kmeans import initial_centres
from ..functions.lexicon import RANDOM_SEED
from ..session import cut_lineage
from . import pairs as PK

PIVOTS = 16
SLACK = 1e-9                     # of a distance: rounding of the bounds


def blocks_of(points: DataFrame, group_cols: Sequence[str], pivots: int = PIVOTS, block_size: int = PK.DEFAULT_BLOCK_SIZE,
              seed: int = RANDOM_SEED) -> DataFrame:
    """(*group, id, features, to = distances to the pivots, block); ``points`` is a written table."""
    g = list(group_cols)
    chosen = (initial_centres(points, pivots, g, seed).groupBy(*g)
              .agg(F.sort_array(F.collect_list(F.struct("centre", "centroid"))).alias("_p")))       # at most ``pivots`` a group
    square = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    to = F.transform("_p", lambda p: F.sqrt(square(p["centroid"], F.col("features"))))
    placed = cut_lineage(points.join(chosen, g).select(*g, "id", "features", to.alias("to"))
                         .withColumn("_cell", F.array_position("to", F.array_min("to")) - 1))
    parts = placed.groupBy(*g, "_cell").agg(F.ceil(F.count(F.lit(1)) / block_size).alias("_n"))
    sub = F.pmod(F.xxhash64("id"), F.col("_n"))
    return cut_lineage(placed.join(parts, [*g, "_cell"]).select(*g, "id", "features", "to", (F.col("_cell") + pivots * sub).cast("long").alias("block")))


def _nearest(k: int, g: list):
    """The k nearest members of each query, by (distance, id); a point isn't its own neighbour."""
    def run(key_values: dict, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        ids = queries["id"].to_numpy()
        row, neighbour, dist = PK.nearest(PK.matrix(queries), PK.matrix(members), ids, members["id"].to_numpy(), k)
        res = pd.DataFrame({"id": ids[row], "neighbour": neighbour, "distance": dist})
        for c in reversed(g):
            res.insert(0, c, key_values[c])
        return res
    return run


def _schema(placed: DataFrame, g: list) -> str:
    kinds = dict(placed.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in g) + "id bigint, neighbour bigint, distance double"


def _inside(placed: DataFrame, k: int, g: list) -> DataFrame:
    """The k nearest points of each point's own block."""
    search = _nearest(k, g)

    def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return search(dict(zip(g, key)), pdf, pdf)
    return cut_lineage(placed.select(*g, "id", "features", "block").groupBy(*g, "block").applyInPandas(call, _schema(placed, g)))


def _travels(placed: DataFrame, own: DataFrame, k: int, g: list) -> DataFrame:
    """(*group, id, features, target): each point with the other blocks that can hold one of its k nearest."""
    rings = (placed.select(*g, "block", F.posexplode("to").alias("p", "d")).groupBy(*g, "block", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
             .groupBy(*g, "block").agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("rings"))
             .groupBy(*g).agg(F.collect_list(F.struct("block", "rings")).alias("_blocks")))
    reach = own.groupBy(*g, "id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_reach"))
    bound = lambda b: F.array_max(F.zip_with(b["rings"], "to", lambda r, d: F.greatest(r["lo"] - d, d - r["hi"])))     # noqa: E731
    within = lambda b: (b["block"] != F.col("block")) & (F.col("_reach").isNull()                                      # noqa: E731
                                                         | (bound(b) <= F.col("_reach") + SLACK * (1 + F.col("_reach"))))
    return (placed.join(reach, [*g, "id"], "left").join(rings, g)
            .select(*g, "id", "features", F.explode(F.filter("_blocks", within)["block"]).alias("target")))


def knn_pruned(points: DataFrame, k: int = 1, group_cols: Sequence[str] = (), pivots: int = PIVOTS,
               block_size: int = PK.DEFAULT_BLOCK_SIZE) -> DataFrame:
    """(*group, id, rank, neighbour, distance) as ``neighbours.knn``, euclidean."""
    pts, g = PK.ensure_group(points.select(*group_cols, "id", "features"), group_cols)
    placed = blocks_of(cut_lineage(pts), g, pivots, block_size)
    search, schema = _nearest(k, g), _schema(placed, g)
    own = _inside(placed, k, g)
    queries = cut_lineage(_travels(placed, own, k, g))
    chunks = queries.groupBy(*g, "target").agg(F.ceil(F.count(F.lit(1)) / (4 * block_size)).cast("int").alias("_n"))
    asked = queries.join(chunks, [*g, "target"]).select(*g, "target", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_n")).cast("int").alias("chunk"),
                                                        "id", "features", F.lit(True).alias("query"))
    members = (placed.withColumnRenamed("block", "target").join(chunks, [*g, "target"])
               .select(*g, "target", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk"), "id", "features", F.lit(False).alias("query")))

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["query"].to_numpy()
        if not asks.any():
            return pd.DataFrame(columns=[*g, "id", "neighbour", "distance"])
        return search(dict(zip(g, key)), pdf[asks], pdf[~asks])
    far = asked.unionByName(members).groupBy(*g, "target", "chunk").applyInPandas(across, schema)
    w = Window.partitionBy(*g, "id").orderBy("distance", "neighbour")
    out = (own.unionByName(far).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
           .select(*g, "id", "rank", "neighbour", "distance"))
    return out if group_cols else out.drop("_g")


def report(points: DataFrame, k: int = 1, group_cols: Sequence[str] = (), pivots: int = PIVOTS,
           block_size: int = PK.DEFAULT_BLOCK_SIZE) -> DataFrame:
    """(*group, blocks, visits, skipped): visits of points to other blocks that were made and that the bounds saved."""
    pts, g = PK.ensure_group(points.select(*group_cols, "id", "features"), group_cols)
    placed = blocks_of(cut_lineage(pts), g, pivots, block_size)
    sizes = (placed.groupBy(*g, "block").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(*g).agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("_n")))
    made = _travels(placed, _inside(placed, k, g), k, g).groupBy(*g).agg(F.count(F.lit(1)).alias("visits"))
    out = (sizes.join(made, g, "left").fillna(0, ["visits"])
           .select(*g, "blocks", "visits", (F.col("_n") * (F.col("blocks") - 1) - F.col("visits")).alias("skipped")))
    return out if group_cols else out.drop("_g")
