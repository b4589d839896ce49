"""Density clusters of vectors as joins: one level of the density hierarchy."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot
from ..scratch import materialize
from .dedup import components
from .rows import dense_id


def near_pairs(points: DataFrame, eps: float, block_rows: int = 1000) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: all points (id, v) not farther than ``eps`` from one another.

    By the triangle inequality two such points lie in the same or in neighbouring shells of width ``eps`` around any
    pivot; the pivots are two far points, found by two aggregations. Cells of equal shells are cut by hash into blocks of about
    ``block_rows`` points, and each pair of blocks of neighbouring cells is one matrix product, from which only near pairs leave.
    """
    far = lambda p: F.sqrt(F.greatest(dot(F.col("v"), F.col("v")) + F.lit(sum(x * x for x in p)) - 2 * dot(F.col("v"), F.array(*map(F.lit, p))), F.lit(0.0)))
    first = points.agg(F.min_by("v", "id").alias("v")).first().v
    if first is None:
        return points.select(F.col("id").alias("id_1"), F.col("id").alias("id_2")).limit(0)
    second = points.agg(F.max_by("v", F.struct(far(first), "id")).alias("v")).first().v
    shells = points.select("id", "v", F.floor(far(first) / eps).alias("s"), F.floor(far(second) / eps).alias("t"))
    cells = materialize(shells.groupBy("s", "t").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "cells")
    placed = shells.join(cells, ["s", "t"]).select("id", "v", F.struct("s", "t", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b")).alias("a"))
    block = cells.select("s", "t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    asked = block.select(F.struct("s", "t", "b").alias("a"), around("s"), "t").select("a", "s", around("t"))
    meet = asked.join(block, ["s", "t"]).select("a", F.struct("s", "t", "b").alias("c")).where("a <= c")
    left = placed.join(meet, "a").select("a", "c", "id", "v")
    right = placed.withColumnRenamed("a", "c").join(meet, "c").select("a", "c", "id", "v")

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(x) and len(y):
            v, w, p, q = np.stack(x["v"].to_numpy()), np.stack(y["w"].to_numpy()), x["id"].to_numpy(), y["id_2"].to_numpy()
            at, to = np.nonzero((v * v).sum(1)[:, None] + (w * w).sum(1)[None] - 2 * v @ w.T <= eps * eps)
            i, j = p[at], q[to]
            once = (i < j) | ((i > j) & (x["block"].iloc[0] != y["block_2"].iloc[0]))
            i, j = i[once], j[once]
        return pd.DataFrame({"id_1": np.minimum(i, j), "id_2": np.maximum(i, j)})

    key = lambda c: F.to_json(F.col(c))
    left = left.select(key("a").alias("k"), key("c").alias("l"), "id", "v", key("a").alias("block"))
    right = right.select(key("a"), key("c"), "id", "v", key("c")).toDF("k2", "l2", "id_2", "w", "block_2")
    return left.groupBy("k", "l").cogroup(right.groupBy("k2", "l2")).applyInPandas(near, "id_1 bigint, id_2 bigint")


def density_clusters(df: DataFrame, record: str, vector: str, eps: float, min_points: int = 3, min_size: int = 5) -> DataFrame:
    """(record, cluster): core points, with ``min_points`` points within ``eps`` (themselves included), linked over
    distances up to ``eps``; 0, 1, ... in the order of the clusters' smallest records, -1 for all other points.

    This is the level ``eps`` of the hierarchy that mutual reachability gives: two core points are linked where their
    mutual reachability is at most ``eps``. Points without a vector are -1; records are unique; no rows give no rows.
    """
    points = df.where(F.col(record).isNotNull()).select(F.col(record).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    pairs = materialize(near_pairs(points.where("v IS NOT NULL"), eps), "near")
    degree = pairs.select(F.explode(F.array("id_1", "id_2")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    core = degree.where(F.col("n") + 1 >= min_points).select("id")
    links = pairs.join(core.toDF("id_1"), "id_1", "left_semi").join(core.toDF("id_2"), "id_2", "left_semi")
    # a core point without a linked one stands alone
    groups = materialize(components(links.unionByName(core.select(F.col("id").alias("id_1"), F.col("id").alias("id_2")))), "groups")
    named = dense_id(groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("component"), "component", "cluster")
    inside = groups.join(named, "component").select("id", "cluster")
    return points.select("id").join(inside, "id", "left").select(F.col("id").alias(record), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
