import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.text import STOP_WORDS
from tessella.operators import cosine, dedup


def corpus(n, seed=5):
    rng, out = random.Random(seed), []
    names = [f"w{k}" for k in range(400)]
    for k in range(n):
        if k % 5 == 4:  # an edited or exact copy
            words = out[-1 - rng.randrange(4)][1].split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(names)
        else:
            words = [names[min(399, int(rng.paretovariate(0.5)) - 1)] for _ in range(60)] + [f"own{rng.randrange(3 * n)}" for _ in range(4)]
        out.append((k, " ".join(words)))
    return out


def brute(rows, t=0.7, max_df=0.95):
    texts = {}
    for k, text in rows:
        if text is not None:
            texts.setdefault(k, Counter()).update(w for w in text.split(" ") if len(w) > 1 and w not in STOP_WORDS)
    df = Counter(w for c in texts.values() for w in c)
    vec = {}
    for k, c in texts.items():
        v = {w: tf * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, tf in c.items() if df[w] <= max_df * len(rows)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vec[k] = {w: x / norm for w, x in v.items()}
    ids, out = sorted(vec), {}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s = sum(x * vec[b].get(w, 0.0) for w, x in vec[a].items())
            if s >= t:
                out[a, b] = s
    return out


@pytest.mark.parametrize("top,block", [(cosine.TOP, cosine.BLOCK_ROWS), (20, 5)])
def test_all_pairs_whatever_the_codes_and_blocks(spark, monkeypatch, top, block):
    monkeypatch.setattr(cosine, "TOP", top)
    monkeypatch.setattr(cosine, "BLOCK_ROWS", block)
    rows = corpus(300) + [(900, "many " * 400 + "words"), (901, "many " * 390 + "words"), (902, None), (903, ""), (7, "more words of one record")]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(5)
    got = dedup.similar_pairs(df, "k", "t").collect()
    want = brute(rows)
    assert len(got) == len(want) > 50 and {(r.id_1, r.id_2) for r in got} == set(want)
    assert all(abs(r.similarity - want[r.id_1, r.id_2]) < 1e-9 for r in got)
    assert dedup.similar_pairs(df.limit(0), "k", "t").count() == 0


def test_links_connect_what_the_pairs_connect(spark):
    df = spark.createDataFrame(corpus(200), "k bigint, t string")
    groups = lambda p: sorted(map(tuple, dedup.components(p).collect()))
    links = dedup.similar_links(df, "k", "t")
    assert groups(links) == groups(dedup.similar_pairs(df, "k", "t"))


def test_disk_of_similar_pairs_stays_within_the_texts(spark):
    root = Path(spark.conf.get("spark.local.dir"))
    used = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    rows = corpus(2000, 6)
    df = spark.createDataFrame(rows, "k bigint, t string")
    before = used()
    assert dedup.similar_pairs(df, "k", "t").count() > 300
    assert used() - before < 3 * sum(len(t) for _, t in rows)


def copies_on_disk(spark, n, copies, make):
    """Bytes that stay while ``make`` of a table of ``copies`` copies of each record is counted, and that count."""
    root = Path(spark.conf.get("spark.local.dir"))
    used = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    df = spark.createDataFrame(corpus(n), "k bigint, t string").crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).select((F.col("k") + 10_000 * F.col("copy")).alias("k"), "t", F.sha2("t", 512).alias("title"))
    before = used()
    return make(df).count(), used() - before


def test_nearest_pairs_are_those_of_all_pairs_and_written_with_the_records(spark, monkeypatch):
    monkeypatch.setattr(cosine, "HELD", 50)
    monkeypatch.setattr(cosine, "BLOCK_ROWS", 5)
    df = spark.createDataFrame([(k + 1000 * c, t) for k, t in corpus(120) for c in range(5)], "k bigint, t string").repartition(5)
    key = lambda p: sorted((r.id_1, r.id_2, round(r.similarity, 9)) for r in p.collect())
    for k in (2, 4, 10):
        assert key(dedup.similar_nearest(df, "k", "t", k)) == key(dedup.nearest_pairs(dedup.similar_pairs(df, "k", "t"), k))
    assert dedup.similar_nearest(df.limit(0), "k", "t").count() == 0
    (few, little), (many, much) = (copies_on_disk(spark, 100, c, lambda df: dedup.similar_nearest(df, "k", "t")) for c in (20, 80))
    assert many > few > 1000 and much < 8 * little


def test_rounding_to_nine_places_is_that_of_spark(spark):
    s = [0.7001953125, 0.8000000005, 0.8000000015, 0.99999999949999999, 1.0, 1.0000000000000002, 0.70710678118654752, 0.9583333333333334, 0.1234567895, 0.7500000004999999]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in s], "s double").select(F.round(F.round("s", 9) * 1e9, 0).cast("bigint")).collect()]
    assert cosine.nine_places(np.array(s)).tolist() == want


def test_enriched_pairs_are_those_of_the_join_and_none_is_written(spark, monkeypatch):
    monkeypatch.setattr(cosine, "SENT", 7)
    rows = [(k, t, None if k % 7 == 0 else f"title {k}", k % 3) for k, t in corpus(150)]
    for more in ([], [(3, None, "second row", None), (4, "own words of four", None, 5)]):
        df = spark.createDataFrame(rows + more, "k int, t string, title string, year int").repartition(3)
        got, want = dedup.similar_enriched(df, "k", "t", ["title", "year"]), dedup.enrich_pairs(dedup.similar_pairs(df, "k", "t").select("id_1", "id_2"), df, "k", ["title", "year"])
        names = ["id_1", "id_2", "title_1", "year_1", "title_2", "year_2"]
        assert got.columns == names and dict(got.dtypes) == dict(want.dtypes)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(names).collect())) and got.count() > 20
    assert dedup.similar_enriched(df.limit(0), "k", "t", ["title"]).count() == 0
    pairs, disk = copies_on_disk(spark, 100, 80, lambda df: dedup.similar_enriched(df, "k", "t", ["title"]))
    assert pairs > 400_000 and disk < pairs * 10
