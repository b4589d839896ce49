"""Topic terms by class-based TF-IDF, and the quality of topics: diversity, coverage, coherence, ranks."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, ngrams, simple_words
from ..scratch import materialize


def term_table(docs: DataFrame, topic: str, text: str, n: int = 1) -> DataFrame:
    """(topic, term, tf) over the texts of each topic other than -1; stop words go before n-grams are formed."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    good = docs.where(F.col(topic).isNotNull() & (F.col(topic) != -1)).select(F.col(topic).alias("topic"), F.filter(simple_words(F.col(text)), lambda w: ~F.array_contains(stop, w)).alias("w"))
    grams = F.col("w") if n == 1 else F.flatten(F.array(F.col("w"), *[ngrams(F.col("w"), k) for k in range(2, n + 1)]))
    return good.select("topic", F.explode(grams).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("tf"))


def bounded(terms: DataFrame, min_df: float, max_df: float, most: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` and at most ``max_df`` of the topics; the ``most`` frequent of them, if given."""
    topics = terms.agg(F.countDistinct("topic").alias("topics"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("f"))
    ok = df.crossJoin(F.broadcast(topics)).where((F.col("df") >= min_df * F.col("topics")) & (F.col("df") <= max_df * F.col("topics")))
    if most:
        ok = ok.orderBy(F.desc("f"), "term").limit(most)
    return terms.join(ok.select("term"), "term", "left_semi")


def ctfidf(terms: DataFrame) -> DataFrame:
    """(topic, term, score): share of the term in its topic times ln(1 + mean terms of a topic / frequency of the term)."""
    size = terms.groupBy("topic").agg(F.sum("tf").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    freq = terms.groupBy("term").agg(F.sum("tf").alias("f"))
    x = terms.join(size, "topic").join(freq, "term").crossJoin(F.broadcast(mean))
    return x.select("topic", "term", (F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / F.col("f"))).alias("score"))


def top_words(scored: DataFrame, n: int = 10) -> DataFrame:
    """(topic, term, score, rank): ties (score to 9 places) go to the term first in the alphabet."""
    w = Window.partitionBy("topic").orderBy(F.round("score", 9).desc(), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def diversity(words: DataFrame) -> DataFrame:
    return words.agg(F.coalesce(F.round(F.try_divide(F.countDistinct("term"), F.count("*")), 6), F.lit(0.0)).alias("diversity"), F.count("*").alias("words"))


def coverage(docs: DataFrame, topic: str) -> DataFrame:
    out = F.coalesce(F.col(topic), F.lit(-1)) == -1
    n = F.sum(out.cast("bigint"))
    return docs.agg(F.count("*").alias("documents"), n.alias("outliers"), F.round(1 - F.try_divide(n, F.count("*")), 6).alias("coverage"), F.countDistinct(F.when(~out, F.col(topic))).alias("topics"))


def window_counts(tokens: DataFrame, wanted: list[str], window: int) -> DataFrame:
    """(x, y, c): in how many windows of each batch of token lists the terms x <= y of ``wanted`` stand together, a term with itself as well; the number of windows without terms.

    A text's windows by its wanted terms are one small matrix; only counts leave the task, one row for each pair and batch.
    """
    import numpy as np
    import pyarrow as pa

    place = {t: k for k, t in enumerate(wanted)}

    def run(batches):
        for b in batches:
            total, codes, n = 0, [], []
            for text in b.column(0).to_pylist():
                last = max(0, len(text) - window)
                total += last + 1
                hits = [(p, place[t]) for p, t in enumerate(text) if t in place]
                if not hits:
                    continue
                terms = sorted({k for _, k in hits})
                at = {k: j for j, k in enumerate(terms)}
                held = np.zeros((last + 1, len(terms)), np.float32)
                for p, k in hits:
                    held[min(last, max(0, p - window + 1)) : min(p, last) + 1, at[k]] = 1
                both = np.triu(held.T @ held)
                x, y = np.nonzero(both)
                ids = np.array(terms, np.int64)
                codes.append(ids[x] * len(wanted) + ids[y])
                n.append(both[x, y])
            code, k = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
            c = np.bincount(k, np.concatenate([np.zeros(0), *n]), len(code)).astype(np.int64)
            x, y = [[wanted[j] for j in part.tolist()] for part in np.divmod(code, max(1, len(wanted)))]
            yield pa.RecordBatch.from_arrays([pa.array([*x, None], pa.string()), pa.array([*y, None], pa.string()), pa.array([*c.tolist(), total], pa.int64())], ["x", "y", "c"])

    return tokens.mapInArrow(run, "x string, y string, c bigint")


def coherence(docs: DataFrame, record: str, text: str, words: DataFrame, window: int = 10, no_below: int | None = None, no_above: float = 0.9) -> DataFrame:
    """(coherence, topics, pairs): mean NPMI of the word pairs of each topic over sliding windows of ``window`` words.

    Only topic words in the vocabulary count, topics of two such words at least, and two such topics at least. Windows
    are made in the task that reads the text; only counts of words and pairs are shuffled. The topic words come to the driver.
    """
    tok = docs.select(F.col(record).alias("id"), simple_words(F.col(text)).alias("t"))
    n = tok.agg(F.count("*").alias("n"))
    df = tok.select("id", F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low = F.lit(no_below) if no_below else F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("n") * 0.001)))
    asked = materialize(words.select("topic", "term").distinct(), "asked")
    vocab = df.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(n)).where((F.col("df") >= low) & (F.col("df") <= no_above * F.col("n"))).select("term")
    asked = asked.join(vocab, "term", "left_semi")
    good = asked.groupBy("topic").agg(F.count("*").alias("k")).where("k >= 2").select("topic")
    asked = materialize(asked.join(good, "topic", "left_semi"), "wanted")
    counts = materialize(window_counts(tok.select("t"), [r.term for r in asked.select("term").distinct().orderBy("term").collect()], window), "windows")
    windows = counts.where("x IS NULL").agg(F.sum("c").alias("all"))
    summed = counts.where("x IS NOT NULL").groupBy("x", "y").agg(F.sum("c").alias("c"))
    one, pair = summed.where("x = y").select(F.col("x").alias("term"), "c"), summed.where("x < y")
    a, b = asked.toDF("topic", "x"), asked.toDF("topic", "y")
    q = a.join(b, "topic").where("x < y").join(one.toDF("x", "cx"), "x").join(one.toDF("y", "cy"), "y").join(pair, ["x", "y"], "left").crossJoin(F.broadcast(windows))
    p = F.coalesce("c", F.lit(0)) / F.col("all")
    npmi = F.log((p + 1e-12) / ((F.col("cx") / F.col("all")) * (F.col("cy") / F.col("all")))) / -F.log(p + 1e-12)
    each = q.groupBy("topic").agg(F.avg(npmi).alias("npmi"), F.count("*").alias("pairs"))
    return each.agg(F.when(F.count("*") >= 2, F.round(F.avg("npmi"), 6)).alias("coherence"), F.count("*").alias("topics"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def mmr(scored: DataFrame, docs: DataFrame, topic: str, text: str, n: int = 10, pool: int = 30, diversity: float = 0.7) -> DataFrame:
    """(topic, term, rank): words chosen one by one for their score against their likeness to those chosen before.

    Likeness of two words is the share of their topics' texts that hold both. A topic's pool has ``pool`` words, so each
    group handed to a task is bounded.
    """
    import pandas as pd

    best = top_words(scored, pool)
    held = docs.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.monotonically_increasing_id().alias("d"), F.explode(F.array_distinct(simple_words(F.col(text)))).alias("term")).join(best.select("topic", "term"), ["topic", "term"])
    bags = held.groupBy("topic", "d").agg(F.collect_list("term").alias("b"))
    pairs = bags.select("topic", F.explode("b").alias("x"), "b").select("topic", "x", F.explode("b").alias("y")).groupBy("topic", "x", "y").agg(F.count("*").alias("c"))
    like = pairs.join(held.groupBy("topic", F.col("term").alias("x")).agg(F.count("*").alias("cx")), ["topic", "x"]).join(held.groupBy("topic", F.col("term").alias("y")).agg(F.count("*").alias("cy")), ["topic", "y"])
    like = like.select("topic", "x", "y", (F.col("c") / F.sqrt(F.col("cx") * F.col("cy"))).alias("like")).join(best.select("topic", F.col("term").alias("x"), "score"), ["topic", "x"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        score = rows.groupby("x")["score"].first()
        score = (score / score.max()).sort_index()
        like = rows.pivot_table(index="x", columns="y", values="like", fill_value=0.0)
        done: list[str] = []
        while len(done) < min(n, len(score)):
            left = [w for w in score.index if w not in done]
            value = {w: (1 - diversity) * score[w] - diversity * (max(like.at[w, v] for v in done) if done else 0) for w in left}
            done.append(max(left, key=lambda w: (round(value[w], 9), [-ord(c) for c in w])))
        return pd.DataFrame({"topic": rows["topic"].iloc[0], "term": done, "rank": range(1, len(done) + 1)})

    return like.groupBy("topic").applyInPandas(choose, "topic int, term string, rank int")


#: The parameters of the grid over projection, density clusters and vocabulary, and what each may be.
GRID_POINTS = {"min_df": [0.003, 0.005], "max_df": [0.5, 0.8], "n_neighbors": [5, 10, 15], "n_components": [5, 10, 15], "min_cluster_size": [5, 10, 15], "min_samples": [1, 5, 10]}


def grid_points(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """A row for each point of the cross product of ``values``, with its tag 'name=value|...'; points without max_df > min_df are left out.

    The product is of parameters, not of data: its size is that of ``values`` alone.
    """
    out = spark.range(0, 1, 1, 1)
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    out = out.drop("id")
    if {"min_df", "max_df"} <= set(values):
        out = out.where("max_df > min_df")
    return out.withColumn("tag", F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in values]))


def admitted(terms: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with the number of terms that lie in their bounds and how often these occur.

    Terms are first counted by the number of topics that have them, which is a table of as many rows as topics at most.
    """
    topics = terms.agg(F.countDistinct("topic").alias("topics"))
    held = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("f")).groupBy("df").agg(F.count("*").alias("terms"), F.sum("f").alias("f")).crossJoin(F.broadcast(topics))
    bounds = points.select("min_df", "max_df").distinct()
    counts = bounds.join(held, (F.col("df") >= F.col("min_df") * F.col("topics")) & (F.col("df") <= F.col("max_df") * F.col("topics"))).groupBy("min_df", "max_df").agg(F.sum("terms").alias("terms"), F.sum("f").alias("occurrences"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return points.join(counts, ["min_df", "max_df"], "left").select(*points.columns, none("terms"), none("occurrences"))


METRICS = ["silhouette", "coherence", "diversity", "coverage"]


def rank_runs(runs: DataFrame, metrics: list[str], min_coverage: float = 0.6) -> DataFrame:
    """``runs`` with the competition rank of each metric (larger is better, null and NaN last) and their mean.

    Runs of a coverage below ``min_coverage`` are put behind all others.
    """
    clean = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
    for m in metrics:
        runs = runs.withColumn(f"{m}_rank", F.rank().over(Window.orderBy(clean(m).desc_nulls_last())).cast("double"))
    mean: Column = sum((F.col(f"{m}_rank") for m in metrics), F.lit(0.0)) / len(metrics)
    penalty = F.when(F.col("coverage") < min_coverage, 10000.0).otherwise(0.0)
    return runs.withColumn("penalty", penalty).withColumn("avg_rank", mean + F.col("penalty"))
