"""Vectors: alignment, centroids, representatives, pooling, silhouette, projection."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, unit


def alignment(docs: DataFrame, vecs: DataFrame, record: str, mode: str = "strict") -> DataFrame:
    """Inner join by key; 'strict' asks for equal keys on both sides, 'truncate' allows vectors without a document."""
    lost, extra = docs.join(vecs, record, "left_anti").count(), vecs.join(docs, record, "left_anti").count()
    if lost or (extra and mode == "strict"):
        raise ValueError(f"{lost} documents without a vector, {extra} vectors without a document")
    return docs.join(vecs, record)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid, size): elementwise mean of unit vectors, of unit length."""
    parts = df.select(group, F.posexplode(unit(F.col(vector))).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    out = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"), F.max("n").alias("size"))
    return out.select(group, unit(F.col("mean")).alias("centroid"), "size")


def representatives(df: DataFrame, record: str, group: str, vector: str, k: int = 10) -> DataFrame:
    """(group, record, similarity, rank): the k members of highest cosine with their group's centroid."""
    near = df.join(centroids(df, group, vector), group).select(group, record, F.round(dot(unit(F.col(vector)), F.col("centroid")), 6).alias("similarity"))
    w = Window.partitionBy(group).orderBy(F.desc("similarity"), record)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def silhouette(df: DataFrame, record: str, group: str, vector: str, block_rows: int = 2000) -> DataFrame:
    """(silhouette, points, groups): mean Euclidean silhouette without outliers (-1) and singletons; null below 3 points or 2 groups.

    The measure needs every distance. Points are hashed to blocks, each pair of blocks is one task's matrix product, and
    only sums of distances for each point and group leave it.
    """
    good = df.where(F.col(group).isNotNull() & (F.col(group) != -1)).select(F.col(record).alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    sizes = good.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    good = good.join(sizes.select("g"), "g").select("g", "id", "v")
    blocks = max(1, -(-good.count() // block_rows))
    b = good.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = b.withColumn("o", other), b.toDF("h", "id2", "v", "o").select("h", "id2", "v", "o", other.alias("b"))

    def sums(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "g": [], "h": [], "d": []}
        if len(a) and len(c):
            x, y = np.stack(a["v"].to_numpy()), np.stack(c["v"].to_numpy())
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
            d[a["id"].to_numpy()[:, None] == c["id2"].to_numpy()[None]] = 0
            for h in np.unique(c["h"]):
                out["id"].append(a["id"].to_numpy())
                out["g"].append(a["g"].to_numpy())
                out["h"].append(np.full(len(a), h))
                out["d"].append(d[:, (c["h"] == h).to_numpy()].sum(1))
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})

    part = left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInPandas(sums, "id bigint, g bigint, h bigint, d double")
    total = part.groupBy("id", "g", "h").agg(F.sum("d").alias("d")).join(sizes.toDF("h", "n"), "h")
    own = F.col("g") == F.col("h")
    each = total.groupBy("id", "g").agg(F.max(F.when(own, F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    out = each.agg(F.avg(s).alias("s"), F.count("*").alias("points"), F.countDistinct("g").alias("groups"))
    return out.select(F.when((F.col("points") >= 3) & (F.col("groups") >= 2), F.round("s", 6)).alias("silhouette"), "points", "groups")


def hash_embed(df: DataFrame, record: str, tokens: str, dimensions: int = 64) -> DataFrame:
    """(record, vector): unit sum of the signed hash buckets of the tokens; a stand-in encoder that needs no model."""
    t = df.select(record, F.explode(tokens).alias("t")).select(record, F.pmod(F.xxhash64("t"), F.lit(dimensions)).cast("int").alias("pos"), F.when(F.xxhash64("t", F.lit(1)) < 0, -1.0).otherwise(1.0).alias("s"))
    cell = t.groupBy(record, "pos").agg(F.sum("s").alias("x"))
    zero = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return cell.groupBy(record).agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m")).select(record, unit(zero).alias("vector"))


def project(df: DataFrame, record: str, vector: str, k: int = 5) -> DataFrame:
    """(record, projection): principal components, the stand-in for a non-linear projection."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select(record, array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    return PCA(k=k, inputCol="x", outputCol="y").fit(x).transform(x).select(record, vector_to_array("y").alias("projection"))


def half(vector: Column) -> Column:
    """The elements rounded to what half precision holds: 11 significant bits, steps of 2^-24 near zero, ties to even, infinite beyond its range."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        exponent = F.greatest(F.floor(F.log2(F.when(x == 0, 1.0).otherwise(F.abs(x)))), F.lit(-14))
        step = F.pow(F.lit(2.0), exponent - 10)
        near = F.rint(x / step) * step
        return F.when(F.isnan(x) | F.isnull(x), x).when(F.abs(near) >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(near)

    return F.transform(vector, one)
