import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import dedup, filters, labels, tokens, topics, vectors
from tessella.sources.tables import harmonize, read_config, read_csv, report, require_columns, write_csv


def test_components_and_log(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (7, 9), (9, 7), (5, 5), *[(k, k + 1) for k in range(20, 60)]], "id_1 bigint, id_2 bigint")
    got = dict(map(tuple, dedup.components(pairs).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7, 5: 5, **{k: 20 for k in range(20, 61)}}
    assert dedup.components(pairs.limit(0)).count() == 0


def test_exact_dedup_groups_nulls(spark):
    df = spark.createDataFrame([(3, None, "a"), (1, None, "a"), (2, "t", None), (4, "t", "a")], "row_index bigint, Title string, Abstract string")
    assert sorted(r.row_index for r in dedup.first_of_each(df, ["Title", "Abstract"], "row_index").collect()) == [1, 2, 4]


def test_similar_pairs_against_brute_force(spark):
    texts = ["mastitis in dairy cows of the north", "mastitis in dairy cows of the south", "lameness of heifers on pasture", "lameness of heifers on pasture", "", None, "unrelated words here only"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    vec = {}
    for r in dedup.tfidf(df, "id", "t").collect():
        vec.setdefault(r.id, {})[r.term] = r.weight
    want = {(a, b) for a in vec for b in vec if a < b and sum(w * vec[b].get(k, 0) for k, w in vec[a].items()) >= 0.5}
    got = {(r.id_1, r.id_2) for r in dedup.similar_pairs(df, "id", "t", 0.5).collect()}
    assert got == want and (2, 3) in got


def test_threshold_grid_and_selection(spark):
    grid = dedup.thresholds()
    assert len(grid) == 60 and grid[23] == 0.7 + 23 * (0.705 - 0.7)
    df = spark.createDataFrame([(0.9, "1"), (0.8, "1"), (0.75, "0"), (0.99, ""), (0.71, None)], "s double, y string")
    m = dedup.threshold_metrics(df, "s", "y", [0.7, 0.78, 0.95])
    rows = {r.threshold: r for r in m.collect()}
    assert (rows[0.7].tp, rows[0.7].fp, rows[0.78].fp, rows[0.95].predicted, rows[0.95].precision) == (2, 1, 0, 0, 0.0)
    best = dedup.select_threshold(m).first()
    assert best.threshold == 0.78 and best.meets_target
    assert not dedup.select_threshold(m.where("threshold < 0.75")).first().meets_target


def test_a_labelled_pair_without_a_readable_score_is_an_error(spark):
    for bad in (None, "nan", "x"):
        df = spark.createDataFrame([("0.9", "1"), (bad, "0"), ("0.8", "")], "s string, y string")
        with pytest.raises(Exception, match="no readable score"):
            dedup.threshold_metrics(df, "s", "y", [0.7]).collect()
    df = spark.createDataFrame([("0.9", "1"), (None, "")], "s string, y string")
    assert dedup.threshold_metrics(df, "s", "y", [0.7]).first().tp == 1


def test_chunks(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")).alias("t"))
    assert [c[0] for c in df.select(tokens.chunks(F.col("t"), 4, 3)).first()[0]] == ["0", "3", "6"]
    assert df.select(F.size(tokens.chunks(F.slice("t", 1, 4), 4, 3))).first()[0] == 1
    assert df.select(tokens.chunks(F.slice("t", 1, 0), 4, 3)).first()[0] == [[]]


def test_ranks_put_null_and_nan_last(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (math.nan, 1.0), (None, 0.5)], "a double, coverage double")
    got = {(r.a if r.a is None or not math.isnan(r.a) else "nan"): (r.a_rank, r.penalty) for r in topics.rank_runs(df, ["a", "coverage"]).collect()}
    assert got == {2.0: (1.0, 0.0), 1.0: (2.0, 0.0), "nan": (3.0, 0.0), None: (3.0, 10000.0)}


def test_curation_keeps_unknown_topics_and_shared_texts(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "b ", 1), (4, None, 1), (5, "c", 9), (6, "d", 2)], "doc_id bigint, Document string, Topic int")
    cur = spark.createDataFrame([(1, "Keep"), (2, " remove")], "topic int, status string")
    assert sorted(r.doc_id for r in filters.curate(docs, docs, cur, "Document").collect()) == [1, 2, 3, 5]


def test_alignment(spark):
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(4).withColumnRenamed("id", "k").withColumn("v", F.array(F.lit(1.0)))
    assert vectors.alignment(a, b, "k", "truncate").count() == 3
    with pytest.raises(ValueError):
        vectors.alignment(a, b, "k")
    with pytest.raises(ValueError):
        vectors.alignment(b.drop("v"), a, "k", "truncate")


def test_silhouette_over_blocks(spark):
    rows = [(k, k % 3, [float(k % 3) * 5 + k * 0.01, float(k)]) for k in range(40)] + [(99, 7, [0.0, 0.0]), (100, -1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, g int, v array<double>")
    one, many = vectors.silhouette(df, "id", "g", "v").first(), vectors.silhouette(df, "id", "g", "v", block_rows=7).first()
    assert one == many and one.points == 40 and one.groups == 3
    assert vectors.silhouette(df.where("g = 0"), "id", "g", "v").first().silhouette is None


def test_label_normal_form(spark):
    answers = ['x <JSON>{"refined_title": " T ", "confidence": 4.7, "specificity_score": 9, "tags": ["A", ""], "factor_associations": [{"factor": "f", "direction": "UP"}]}</json>', "no json", '{"confidence": "4"} bye', "", None]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    v1 = {r.i: r for r in labels.normalize(df, "answer", 1).collect()}
    v2 = {r.i: r for r in labels.normalize(df, "answer", 2).collect()}
    assert (v1[0].refined_title, v1[0].confidence, v1[0].specificity_score, v1[0].tags, v1[0].associations) == ("T", 4, 5, "a", 1)
    assert '"direction":"unclear"' in v1[0].associations_json and v2[0].confidence == 3 and v2[2].confidence == 4
    assert {v1[k].refined_title for k in (1, 3, 4)} == {"unlabeled-topic"} and v1[1].confidence == 3


def test_first_balanced_object_and_lists_of_tags(spark):
    answers = ['so: {"refined_title": "T", "tags": "A, b ,", "confidence": "4.0"} and {"x": 1}', '{"a": {"b": 1}} {', 'open { only', '{"confidence": 4.9, "specificity_score": "4.0"}']
    df = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    got = [r[0] for r in df.orderBy("i").select(labels.extract_json(F.col("answer"))).collect()]
    assert got == ['{"refined_title": "T", "tags": "A, b ,", "confidence": "4.0"}', '{"a": {"b": 1}}', "open { only", answers[3]]
    v1 = {r.i: r for r in labels.normalize(df, "answer", 1).collect()}
    assert (v1[0].refined_title, v1[0].tags, v1[0].confidence) == ("T", "a, b", 3) and (v1[3].confidence, v1[3].specificity_score) == (4, 3)


def test_coherence_against_its_definition(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{chr(97 + k)}x" for k in range(12)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([3, 9, 14, 30]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    words = [(t, w) for t in range(3) for w in rnd.sample(vocabulary, 4)]
    got = topics.coherence(docs, "id", "t", spark.createDataFrame(words, "topic int, term string"), no_above=1.0).first()
    windows = [set(t[k : k + 10]) for t in map(str.split, texts) for k in range(max(1, len(t) - 9))]
    p = lambda *ws: sum(set(ws) <= w for w in windows) / len(windows)
    npmi = lambda a, b: math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12)
    per = [[npmi(a, b) for a, b in itertools.combinations([w for t, w in words if t == k], 2)] for k in range(3)]
    assert got.coherence == pytest.approx(sum(sum(x) / len(x) for x in per) / 3, abs=1e-5) and got.pairs == 18


def test_match_rate(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "b ", 1), (4, None, 1)], "doc_id bigint, Document string, Topic int")
    cur = spark.createDataFrame([(2, "remove")], "topic int, status string")
    assert tuple(filters.match_rate(docs, docs, cur, "Document").first()) == (3, 2, 3, 100.0)


def test_sources(spark, tmp_path):
    a = spark.createDataFrame([("d", "t", "a", "x", "j", "2001")], "DOI string, Title string, Abstract string, Authors string, Journal string, Year string")
    b = a.withColumnsRenamed({"DOI": "doi", "Title": "title", "Abstract": "abstract", "Authors": "creator", "Journal": "publicationName", "Year": "coverDate"})
    u = harmonize({"one": a, "two": b})
    assert [r.source for r in u.orderBy("source").collect()] == ["one", "two"] and u.columns[-1] == "source"
    with pytest.raises(ValueError):
        require_columns(a, ["nope"])
    quoted = a.withColumn("Title", F.lit('two\n"lines"'))
    write_csv(quoted, str(tmp_path / "c"))
    assert read_csv(spark, str(tmp_path / "c")).first().Title == 'two\n"lines"'
    (tmp_path / "p.json").write_text('{"min_df": 1}')
    assert read_config(str(tmp_path / "p.json"), ["min_df"])["min_df"] == 1
    with pytest.raises(ValueError):
        read_config(str(tmp_path / "p.json"), ["max_df"])
    assert "rows" in report({"rows": 3}, "T")


def test_stream_filter(spark, tmp_path):
    from tessella.streaming.filters import run_available, stream_kept

    df = spark.createDataFrame([(1, "odds ratio 2"), (2, "odds ratio 2 in women"), (3, None)], "id bigint, text string")
    df.write.parquet(str(tmp_path / "in"))
    run_available(stream_kept(spark, str(tmp_path / "in"), df.schema, "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    run_available(stream_kept(spark, str(tmp_path / "in"), df.schema, "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_diversity_and_coverage(spark):
    w = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], "topic int, term string")
    assert topics.diversity(w).first().diversity == 0.75 and topics.diversity(w.limit(0)).first().diversity == 0.0
    d = spark.createDataFrame([(0,), (-1,), (None,), (1,)], "Topic int")
    assert topics.coverage(d, "Topic").first() == (4, 2, 0.5, 2)
