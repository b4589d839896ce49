import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.text import percent
from tessella.operators import density, labels, rows, tokens, topics, vectors
from tessella.sources.tables import read_topics, write_topics, write_vectors


@pytest.mark.parametrize("size", [3, 100, 1_000_000])
def test_dense_ids_follow_the_keys(spark, size):
    keys = random.Random(1).sample(range(-10_000, 10_000), 700)
    df = spark.createDataFrame([(k, "x") for k in keys] + [(None, "x")], "k bigint, row_id string").drop("row_id")
    got = {r.k: r.row_id for r in rows.dense_id(df, "k", rows_per_range=size).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert rows.dense_id(df.limit(0), "k").count() == 0


def test_samples_are_exact_and_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc")
    for n in (0, 1, 77, 4990, 5000, 6000):
        want = {r.doc for r in df.orderBy(rows.draw_key(F.col("doc"), 3), "doc").limit(n).collect()}
        got = [r.doc for r in rows.seeded_sample(df.repartition(7), "doc", n, 3).collect()]
        assert len(got) == min(n, 5000) and set(got) == want
    doubled = df.unionByName(df).unionByName(spark.createDataFrame([(None,)], "doc bigint"))
    assert rows.seeded_sample(doubled, "doc", 40).distinct().count() == 40


def test_a_kept_sample_is_used_again_only_if_it_is_valid(spark, tmp_path):
    path, df = f"file://{tmp_path}/sample", spark.range(100).withColumnRenamed("id", "doc")
    first = {r.doc for r in rows.cached_sample(spark, path, df, "doc", 10, 1).collect()}
    assert {r.doc for r in rows.cached_sample(spark, path, df, "doc", 10, 2).collect()} == first
    assert rows.cached_sample(spark, path, df, "doc", 12, 2).count() == 12
    lost = df.where("doc >= 50")
    assert min(r.doc for r in rows.cached_sample(spark, path, lost, "doc", 12, 2).collect()) >= 50


def _dbscan(v, eps, least, size):
    near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= eps
    core = np.flatnonzero(near.sum(1) >= least)
    name = {int(i): int(i) for i in core}
    for _ in core:
        for i in core:
            name[int(i)] = min(name[int(j)] for j in core if near[i, j])
    big = sorted(c for c in set(name.values()) if list(name.values()).count(c) >= size)
    return {i: big.index(name[i]) if name.get(i) in big else -1 for i in range(len(v))}


def test_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 0.3, (25, 3)) for c in (0, 3, 7)] + [rng.uniform(-4, 10, (15, 3))])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id bigint, v array<double>")
    for eps, least in ((0.4, 3), (0.7, 4), (2.0, 1)):
        got = {r.id: r.cluster for r in density.density_clusters(df, "id", "v", eps, least).collect()}
        assert got == {**_dbscan(v, eps, least, 5), 500: -1}
    assert density.density_clusters(df.limit(0), "id", "v", 1.0).count() == 0
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if np.sqrt(((v[i] - v[j]) ** 2).sum()) <= 0.7}
    got = [tuple(r) for r in density.near_pairs(df.where("id < 500"), 0.7, block_rows=4).collect()]
    assert len(got) == len(want) and set(got) == want


def test_half_precision_is_that_of_numpy(spark):
    x = [0.0, -0.0, 1.0, 0.1, -3.14159, 65504.0, 65519.0, 65520.0, -1e9, 1e-5, 6e-8, 2.9e-8, 2048.5, 2049.0, 2051.0, *np.random.default_rng(2).normal(0, 1, 300).tolist()]
    got = spark.createDataFrame([(x,)], "v array<double>").select(vectors.half(F.col("v"))).first()[0]
    with np.errstate(over="ignore"):
        assert got == np.array(x).astype(np.float16).astype(float).tolist()


def test_grid_has_valid_points_with_tags(spark):
    terms = spark.createDataFrame([(t, f"w{k}", k + 1) for t in range(10) for k in range(t + 1)], "topic int, term string, tf bigint")
    grid = topics.grid_points(spark, {"min_df": [0.1, 0.6], "max_df": [0.5, 1.0], "min_samples": [1, 5]})
    got = {r.tag: (r.terms, r.occurrences) for r in topics.admitted(terms, grid).collect()}
    assert len(got) == 6 and got["min_df=0.1|max_df=0.5|min_samples=5"] == (5, 5 * 6 + 4 * 7 + 3 * 8 + 2 * 9 + 10)
    assert got["min_df=0.6|max_df=1.0|min_samples=1"] == (5, 10 + 9 * 2 + 8 * 3 + 7 * 4 + 6 * 5)
    assert topics.grid_points(spark, topics.GRID_POINTS).count() == 324


def test_broken_answers_are_repaired(spark):
    cases = {
        '{"refined_title": "a b", "tags": ["X", "y",],}': ("a b", "x, y"),
        '{"refined_title": "a {b", "tags": ["X", "y': ("a {b", "x, y"),
        "{“refined_title”: “a”, “tags”: []}": ("a", ""),
        '{"refined_title": "fine, ]", "tags": ["q"]}': ("fine, ]", "q"),
        "no answer": ("unlabeled-topic", ""),
        None: ("unlabeled-topic", ""),
    }
    df = spark.createDataFrame([(k, a) for k, a in enumerate(cases)], "k int, answer string")
    got = {r.answer: (r.refined_title, r.tags) for r in labels.normalize(df, "answer").collect()}
    assert got == cases


def test_topics_and_vectors_are_kept_by_run(spark, tmp_path):
    path = f"file://{tmp_path}/topics"
    words = lambda t: spark.createDataFrame([(1, t, 0.5, 1)], "topic int, term string, score double, rank int")
    for run, term in (("007", "a"), ("b", "b"), ("007", "c")):
        write_topics(words(term), path, run)
    assert [r.term for r in read_topics(spark, path, "b").collect()] == ["b"]
    with pytest.raises(ValueError, match="no topics"):
        read_topics(spark, path, "d")
    write_vectors(spark.createDataFrame([(1, [0.5, 0.25])], "id bigint, v array<double>"), "id", "v", f"file://{tmp_path}/v")
    assert spark.read.parquet(f"file://{tmp_path}/v").first().v == [0.5, 0.25]


def test_percent_and_named_truncation(spark):
    df = spark.createDataFrame([("a b c d", 0.1234), (None, None)], "t string, x double")
    assert [r[0] for r in df.select(percent(F.col("x"))).collect()] == ["12.34%", None]
    assert [r.t_trunc4 for r in tokens.with_truncated(df, "t", 4).collect()] == ["a b", ""]
