"""Exact and TF-IDF deduplication, thresholds learnt from labelled pairs, groups and what they keep."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..scratch import discard, materialize
from .cosine import cosine_pairs


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least ``order``, which is unique, for each value of ``keys``; null keys are equal.

    Only digests of the keys and numbers are shuffled: one map-side combined aggregation, then a semi-join on ``order``.
    """
    least = df.groupBy(digest(*keys)).agg(F.min(order).alias(order))
    return df.join(least.select(order), order, "left_semi").select(df.columns)


def digest(*keys: str) -> Column:
    """SHA-256 of the keys; a null differs from an empty string."""
    return F.sha2(F.to_json(F.struct(*keys)), 256)


def term_counts(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, term, tf)."""
    return df.where(F.col(text).isNotNull()).select(record, F.explode(words(F.col(text))).alias("term")).groupBy(record, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, documents: int, max_df: float = 0.95, min_df: int = 1) -> DataFrame:
    """(term, df, idf) within the bounds; idf = ln((1 + N) / (1 + df)) + 1."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") <= max_df * documents) & (F.col("df") >= min_df))
    return df.withColumn("idf", F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0)


def tfidf(df: DataFrame, record: str, text: str, max_df: float = 0.95) -> DataFrame:
    """(record, term, df, weight): TF-IDF in long form, of unit length for each record."""
    counts = term_counts(df, record, text)
    weighted = counts.join(document_frequency(counts, df.count(), max_df), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy(record).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, record).select(record, "term", "df", (F.col("w") / F.col("norm")).alias("weight"))


def similar_pairs(df: DataFrame, record: str, text: str, threshold: float = 0.7, max_df: float = 0.95) -> DataFrame:
    """(id_1, id_2, similarity): all pairs of TF-IDF cosine ``threshold`` or more, by an exact prefix filter.

    Terms are put in order of rising document frequency. Two similar records have a length of ``threshold`` or more from
    the first term on that they share, so records meet at the terms of their prefixes alone, up to where that length is
    left. There the lengths of both behind the term, then the product of their outlines, bound the cosine; pairs that
    these cannot bring to the threshold are dropped, the others measured on all terms and kept at their first common term.
    """
    return cosine_pairs(df, record, text, threshold, max_df)


def similar_links(df: DataFrame, record: str, text: str, threshold: float = 0.7, max_df: float = 0.95) -> DataFrame:
    """(id_1, id_2): of the pairs of ``similar_pairs`` enough to connect all records that they connect."""
    return cosine_pairs(df, record, text, threshold, max_df, links=True).select("id_1", "id_2")


def similar_nearest(df: DataFrame, record: str, text: str, k: int = 10, threshold: float = 0.7, max_df: float = 0.95) -> DataFrame:
    """``nearest_pairs`` of ``similar_pairs``: where pairs are found, only the k - 1 nearest of each record are kept, so the pairs written grow with the records alone."""
    return _nearest(cosine_pairs(df, record, text, threshold, max_df, near=k - 1).select(F.col("id_1").alias("i"), F.col("id_2").alias("j"), "similarity"), k)


def similar_enriched(df: DataFrame, record: str, text: str, columns: list[str], threshold: float = 0.7, max_df: float = 0.95) -> DataFrame:
    """``enrich_pairs`` of ``similar_pairs``: the columns go along with the records, so no pair is written, shuffled or joined."""
    return cosine_pairs(df, record, text, threshold, max_df, columns=columns)


def nearest_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Pairs in which one is among the k - 1 nearest of the other; ties (similarity to 9 places) go to the smaller id."""
    ends = pairs.select(F.col("id_1").alias("i"), F.col("id_2").alias("j"), "similarity").unionByName(pairs.select(F.col("id_2").alias("i"), F.col("id_1").alias("j"), "similarity"))
    return _nearest(ends, k)


def _nearest(ends: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy(F.round("similarity", 9).desc(), "j")
    near = ends.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k - 1)
    return near.groupBy(F.least("i", "j").alias("id_1"), F.greatest("i", "j").alias("id_2")).agg(F.max("similarity").alias("similarity"))


def enrich_pairs(pairs: DataFrame, df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """``pairs`` with ``columns`` of both sides, suffixed _1 and _2."""
    side = lambda n: df.select(F.col(record).alias(f"id_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in columns])
    return pairs.join(side(1), "id_1").join(side(2), "id_2")


def components(pairs: DataFrame, a: str = "id_1", b: str = "id_2", max_rounds: int = 60) -> DataFrame:
    """(id, component): groups of records linked directly or indirectly, named by their smallest id.

    Alternating large and small stars: each round joins every vertex to the least of its neighbours, until nothing
    moves: until the number and the sums of two hashes of the links stay. Rounds are written tables.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), *[F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]).first())
    edges = materialize(pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    ids, old = pairs.select(F.explode(F.array(a, b)).alias("id")).distinct(), mark(edges)
    for _ in range(max_rounds):
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ends.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(down.select(F.col("x").alias("v"), F.col("m").alias("u")))
        new = materialize(small.select("u", "v").distinct(), "edges")
        discard(edges)
        edges, before, old = new, old, mark(new)
        if old == before:
            break
    else:
        raise RuntimeError(f"links still move after {max_rounds} rounds")
    low = edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return ids.join(low, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def drop_log(groups: DataFrame, df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """One row per dropped record: the kept (smallest) record of its group, with ``columns`` of both."""
    lost = groups.where("id <> component").select(F.col("component").alias("kept_index"), F.col("id").alias("dropped_index"))
    side = lambda s: df.select(F.col(record).alias(f"{s}_index"), *[F.col(c).alias(f"{s}_{c.lower()}") for c in columns])
    return lost.join(side("kept"), "kept_index").join(side("dropped"), "dropped_index")


def thresholds(low: float = 0.7, high: float = 0.995, step: float = 0.005) -> list[float]:
    """The grid from ``low`` by ``step`` up to ``high``, each as low + i * ((low + step) - low)."""
    n = round((high - low) / step) + 1
    return [low + i * ((low + step) - low) for i in range(n)]


def threshold_metrics(pairs: DataFrame, score: str, label: str, grid: list[float], beta: float = 0.5) -> DataFrame:
    """(threshold, tp, fp, fn, tn, predicted, precision, recall, f1, fbeta) of 'score >= threshold' on pairs labelled 0 or 1.

    Each pair is counted once, at the interval of thresholds that its score passes; the counts are then summed over
    the grid, not the pairs multiplied by it. A labelled pair whose score is null, NaN or no number is an error.
    """
    s = F.col(score).try_cast("double")
    readable = F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit("a labelled pair has no readable score"))).otherwise(s)
    good = pairs.select(F.col(score), F.col(label).try_cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0)).select(readable.alias("s"), "y")
    step = good.select(F.aggregate(F.array(*map(F.lit, grid)), F.lit(0), lambda n, t: n + (F.col("s") >= t).cast("int")).alias("k"), "y").groupBy("k").agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg"))
    t = step.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(grid)], "i int, threshold double")
    at = F.coalesce(F.col("k") >= F.col("i"), F.lit(False))
    n = lambda c, hit: F.coalesce(F.sum(F.when(at if hit else ~at, F.col(c))), F.lit(0)).cast("bigint")
    m = t.join(F.broadcast(step), how="left", on=F.lit(True)).groupBy("threshold").agg(n("pos", True).alias("tp"), n("neg", True).alias("fp"), n("pos", False).alias("fn"), n("neg", False).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = m.withColumn("predicted", F.col("tp") + F.col("fp")).withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f = lambda b: ratio((1 + b * b) * F.col("precision") * F.col("recall"), b * b * F.col("precision") + F.col("recall"))
    return m.withColumn("f1", f(1.0)).withColumn("fbeta", f(beta))


def select_threshold(metrics: DataFrame, target: float = 0.99) -> DataFrame:
    """One row: the least threshold that meets the target precision, else that of the best F-beta (first on ties)."""
    ok = (F.col("precision") >= target) & (F.col("predicted") > 0)
    best = lambda c: F.max_by("threshold", F.struct(F.col(c), -F.col("threshold")))
    return metrics.agg(F.min(F.when(ok, F.col("threshold"))).alias("eligible"), best("f1").alias("best_f1"), best("fbeta").alias("best_fbeta")).select(F.coalesce("eligible", "best_fbeta").alias("threshold"), F.col("eligible").isNotNull().alias("meets_target"), "best_f1", "best_fbeta")
