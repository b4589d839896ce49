"""Problem 3: one group identifier for all records linked directly or indirectly."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

MAX_ROUNDS = 200


def linked_groups(pairs: DataFrame, left: str, right: str, record: str = "record_index", group: str = "group_index", seed: int = 7) -> DataFrame:
    """Group of every record named by ``pairs``, by randomised contraction of the link graph.

    Each round every vertex hooks to the member of its closed neighbourhood whose hash, drawn afresh for the
    round, is least; edges are relabelled by the hooks, loops and repeats dropped. An expected constant share of the
    vertices vanishes per round, so the work is a small multiple of the links whatever the shape of the graph: long
    chains need no more rounds than stars do. The hooks of all rounds are then composed backwards, from the smallest
    table to the largest, and each group is named by its smallest record.

    Every step is a map-side combined aggregation or an equi-join; a hub or a giant group is only many small rows of
    one join key, which adaptive execution splits. Tables between rounds are written to the shared folder.

    Defined cases: a line with a null on either side links nothing and names nobody; a line naming one record twice
    gives that record a group of its own; repeated and turned lines count once; no lines give no rows. Other columns
    of ``pairs`` are not looked at.
    """
    lines = pairs.select(F.col(left).cast("bigint").alias("a"), F.col(right).cast("bigint").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    lines = materialize(lines.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    edges, hooks = lines.where("a <> b"), []
    for r in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        rank = lambda c: F.xxhash64(F.col(c), F.lit(seed * 1_000_003 + r))  # noqa: B023, E731
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        best = ends.groupBy("v").agg(F.min(F.struct(rank("w").alias("h"), F.col("w").alias("w"))).alias("m"))
        hook = materialize(best.select("v", F.when(F.struct(rank("v").alias("h"), F.col("v").alias("w")) < F.col("m"), F.col("v")).otherwise(F.col("m.w")).alias("to")), "hooks")
        hooks.append(hook)
        moved = edges.join(hook.toDF("a", "ta"), "a").join(hook.toDF("b", "tb"), "b").where("ta <> tb")
        old, edges = edges, materialize(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(old)
    else:
        raise RuntimeError(f"links left after {MAX_ROUNDS} rounds")
    records = lines.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    if not hooks:
        return records.select(F.col("v").alias(record), F.col("v").alias(group))
    names = hooks[-1]
    for hook in reversed(hooks[:-1]):
        names = hook.join(names.toDF("to", "end"), "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    names = materialize(records.join(names, "v", "left").select("v", F.coalesce("to", "v").alias("to")), "names")
    least = names.groupBy("to").agg(F.min("v").alias("least"))
    return names.join(least, "to").select(F.col("v").alias(record), F.col("least").alias(group))
