"""Dense row numbers and exact seeded samples without a global sort in one task."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def dense_id(df: DataFrame, key: str, name: str = "row_id", rows_per_range: int = 1_000_000) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of the number ``key``, which is unique and filled.

    The keys are cut into ranges of about ``rows_per_range`` rows at approximate quantiles; rows are numbered within
    their range, behind the counts of the ranges before. Only the cuts come to the driver: rows / ``rows_per_range``,
    10,000 at most, from where on ranges grow. Rows without a key have no number and are left out; no rows give no rows.
    """
    good = df.where(F.col(key).isNotNull())
    n = good.count()
    parts = min(10_000, n // rows_per_range + 1)
    cuts = sorted(set(good.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10 * parts).alias("c")).first().c or [])) if parts > 1 else []
    # the number of cuts below the key, by the built-in search of a sorted array
    span = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if len(cuts) < 64 else _bucket(F.col(key), cuts)
    placed = good.withColumn("_range", span if cuts else F.lit(0))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return numbered.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_range", "_before", "_row")


def _bucket(key: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are below ``key``: two levels, so that a row looks at about 2 * sqrt(cuts) of them."""
    step = int(len(cuts) ** 0.5)
    heads = F.array(*[F.lit(c) for c in cuts[::step]])
    groups = F.array(*[F.array(*map(F.lit, cuts[i : i + step])) for i in range(0, len(cuts), step)])
    head = F.size(F.filter(heads, lambda c: c < key))
    return F.when(head == 0, 0).otherwise((head - 1) * step + F.size(F.filter(F.element_at(groups, F.greatest(head, F.lit(1))), lambda c: c < key)))


def draw_key(record: Column, seed: int) -> Column:
    """A number of 60 bits from the MD5 of seed and record: the same in every engine and for any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), record.cast("string"))), 1, 15), 16, 10).cast("bigint")


def seeded_sample(df: DataFrame, record: str, n: int, seed: int = 42) -> DataFrame:
    """(record): ``n`` different records, or all if there are fewer, those of the least ``draw_key``.

    All rows are looked at. The least keys are found by ranges: only those of the range that holds the n-th key are
    numbered. Null records are never drawn; a repeated record counts once.
    """
    keys = df.where(F.col(record).isNotNull()).select(record).distinct().withColumn("_key", draw_key(F.col(record), seed))
    total = keys.count()
    if total <= n:
        return keys.select(record)
    # keys are even over 60 bits: all below the first bound are in, those between the bounds are few and are sorted
    slack = 6 * (n ** 0.5) + 64
    low, high = (int(max(0.0, min(1.0, (n + s) / total)) * (1 << 60)) for s in (-slack, slack))
    sure = keys.where(F.col("_key") < low)
    rest = n - sure.count()
    edge = keys.where((F.col("_key") >= low) & (F.col("_key") < high)) if 0 <= rest else keys
    if rest < 0 or edge.count() < rest:
        sure, edge, rest = keys.limit(0), keys, n  # not even keys: an ordinary sort
    return sure.select(record).unionByName(edge.orderBy("_key", record).limit(rest).select(record))


def cached_sample(spark: SparkSession, path: str, df: DataFrame, record: str, n: int, seed: int = 42) -> DataFrame:
    """The sample kept at ``path``, if its records all are records of ``df`` and as many as asked for; else a new one is drawn and kept."""
    try:
        kept = spark.read.parquet(path)
        if kept.columns == [record] and kept.count() == min(n, df.select(record).na.drop().distinct().count()) and kept.join(df, record, "left_anti").isEmpty():
            return kept
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    drawn = materialize(seeded_sample(df, record, n, seed), "sample")
    drawn.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
