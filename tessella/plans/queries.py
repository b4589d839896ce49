"""Queries of the operators over the given tables, and the SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import exclude_pattern
from ..operators import dedup, density, filters, labels, rows, tokens, topics, vectors
from ..scratch import materialize
from ..sources.tables import harmonize, table


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "merged_exact_dedup")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_info_full")


# filters and sources
def filter_include_exclude(s, d):
    return filters.lexicon_flags(table(s, d, "documents"), "text").select("doc_id", "included", "excluded", "kept")


def filter_stats(s, d):
    return filters.filter_stats(filters.lexicon_flags(table(s, d, "documents"), "text"))


def _sources(s, d):
    c = _corpus(s, d)
    first, second = c.where("row_index % 2 = 0"), c.where("row_index % 2 = 1")
    back = {"DOI": "doi", "Title": "title", "Abstract": "abstract", "Authors": "creator", "Journal": "publicationName", "Year": "coverDate"}
    return harmonize({"first": first, "second": second.withColumnsRenamed(back)}, ["row_index"])


def harmonize_union(s, d):
    return _sources(s, d)


def exact_dedup(s, d):
    return dedup.first_of_each(_corpus(s, d).select("row_index", "Title", "Abstract", "source"), ["Title", "Abstract"], "row_index")


def exact_dedup_stats(s, d):
    one = _corpus(s, d).groupBy(dedup.digest("Title", "Abstract")).agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("total"), F.count("*").alias("kept")).withColumn("removed", F.col("total") - F.col("kept"))


def extract_year(s, d):
    return _corpus(s, d).select("row_index", X.year_of(F.col("Year")).alias("year"))


def year_filter(s, d):
    return filters.in_years(_corpus(s, d), "Year").select("row_index", "year")


def year_profile(s, d):
    return filters.year_profile(_corpus(s, d), "Year")


def clean_text(s, d):
    return _corpus(s, d).select("row_index", X.clean_for_match(F.col("Title")).alias("title"), X.clean_for_match(F.col("Abstract")).alias("abstract"))


def abstract_cut(s, d):
    return _corpus(s, d).select("row_index", X.cut(F.col("Abstract"), 900).alias("abstract"))


def dense_rows(s, d):
    """The rows left by exact deduplication, numbered 0, 1, ... in loading order."""
    return rows.dense_id(exact_dedup(s, d).select("row_index"), "row_index", "position")


def document_sample(s, d):
    return rows.seeded_sample(table(s, d, "documents"), "doc_id", 300)


# similarity and groups
def tfidf_df(s, d):
    c = _corpus(s, d)
    return dedup.document_frequency(dedup.term_counts(c, "row_index", "Abstract"), c.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_terms(s, d):
    return dedup.tfidf(_corpus(s, d), "row_index", "Abstract").select("row_index", "term", F.round("weight", 6).alias("weight"))


def _pairs(s, d):
    return dedup.similar_pairs(_corpus(s, d), "row_index", "Abstract")


def similar_pairs(s, d):
    return _pairs(s, d).select("id_1", "id_2", F.round("similarity", 6).alias("similarity"))


def similar_pairs_topk(s, d):
    return dedup.similar_nearest(_corpus(s, d), "row_index", "Abstract").select("id_1", "id_2", F.round("similarity", 6).alias("similarity"))


def pair_enrich(s, d):
    return dedup.similar_enriched(_corpus(s, d), "row_index", "Abstract", ["Title", "Authors", "source"])


def dedup_components(s, d):
    return dedup.components(dedup.similar_links(_corpus(s, d), "row_index", "Abstract"))


def dedup_kept(s, d):
    g = dedup_components(s, d).where("id <> component").select(F.col("id").alias("row_index"))
    return _corpus(s, d).select("row_index").join(g, "row_index", "left_anti")


def dedup_drop_log(s, d):
    return dedup.drop_log(dedup_components(s, d), _corpus(s, d), "row_index", ["Title", "source", "DOI"])


def log_components(s, d):
    return dedup.components(table(s, d, "auto_drop_log").where("kept_index IS NOT NULL AND dropped_index IS NOT NULL"), "kept_index", "dropped_index")


def dedup_stats(s, d):
    g = log_components(s, d)
    return g.agg(F.count("*").alias("records"), F.countDistinct("component").alias("groups"), F.count(F.when(F.col("id") != F.col("component"), 1)).alias("dropped"))


def threshold_metrics(s, d):
    m = dedup.threshold_metrics(table(s, d, "candidate_pairs"), "Similarity", "is_duplicate", dedup.thresholds())
    return m.select("threshold", "tp", "fp", "fn", "tn", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fbeta")])


def threshold_selected(s, d):
    return dedup.select_threshold(threshold_metrics(s, d))


# tokens
def _lengths(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", tokens.tokenize(F.col("text")).alias("tokens")).withColumn("n", F.size("tokens") + tokens.SPECIALS)


def token_stats(s, d):
    return tokens.length_stats(_lengths(s, d), "n")


def token_exceeding(s, d):
    return _lengths(s, d).agg(F.count_if(F.col("n") > 512).alias("exceeding"), F.round(F.avg((F.col("n") > 512).cast("double")) * 100, 6).alias("percent"))


def token_truncate(s, d):
    return _lengths(s, d).select("doc_id", tokens.truncate(F.col("tokens"), 512).alias("text_trunc512"))


def token_chunks(s, d):
    c = _lengths(s, d).select("doc_id", F.posexplode(tokens.chunks(F.col("tokens"))).alias("chunk", "c"))
    return c.select("doc_id", "chunk", F.size("c").alias("n"), F.array_join("c", " ").alias("text"))


def chunk_embeddings(s, d):
    """Long texts: the mean of the unit vectors of their chunks, not made unit again."""
    c = _lengths(s, d).select("doc_id", F.posexplode(tokens.chunks(F.col("tokens"))).alias("chunk", "c"))
    v = vectors.hash_embed(c.select(F.struct("doc_id", "chunk").alias("k"), "c"), "k", "c").select("k.doc_id", F.posexplode("vector").alias("pos", "x"))
    m = v.groupBy("doc_id", "pos").agg(F.avg("x").alias("x"))
    return m.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


# vectors
def _vecs(s, d):
    return table(s, d, "embeddings")


def l2_normalize(s, d):
    return _vecs(s, d).select("vec_id", F.posexplode(X.unit(F.col("embedding"))).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


def topic_centroids(s, d):
    c = vectors.centroids(_vecs(s, d), "label", "embedding")
    return c.select("label", "size", F.posexplode("centroid").alias("pos", "x")).select("label", "size", "pos", F.round("x", 6).alias("x"))


def representative_docs(s, d):
    return vectors.representatives(_vecs(s, d), "vec_id", "label", "embedding")


def alignment_counts(s, d):
    a, b = table(s, d, "documents").select("doc_id"), _vecs(s, d).select(F.col("vec_id").alias("doc_id"))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "doc_id", "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("aligned"), F.count_if(F.col("r").isNull()).alias("without_vector"), F.count_if(F.col("l").isNull()).alias("without_document"))


def silhouette_euclid(s, d):
    return vectors.silhouette(_vecs(s, d), "vec_id", "label", "embedding")


def pca_project(s, d):
    return vectors.project(_vecs(s, d), "vec_id", "embedding")


def half_vectors(s, d):
    return _vecs(s, d).select("vec_id", F.posexplode(vectors.half(F.col("embedding"))).alias("pos", "x"))


DENSITY = {"eps": 1.12, "min_points": 3, "min_size": 5}


def density_clusters(s, d):
    return density.density_clusters(_vecs(s, d), "vec_id", "embedding", **DENSITY)


# topics
def _terms(s, d, n=1):
    return topics.term_table(_docs(s, d), "Topic", "Document", n)


def ctfidf_terms(s, d):
    return topics.ctfidf(_terms(s, d)).select("topic", "term", F.round("score", 6).alias("score"))


def _top(s, d, n=10):
    return topics.top_words(topics.ctfidf(topics.bounded(_terms(s, d), 0.0, 0.5)), n)


def topic_top_words(s, d):
    return _top(s, d).select("topic", "rank", "term", F.round("score", 6).alias("score"))


def topic_ngrams(s, d):
    return topics.top_words(topics.ctfidf(topics.bounded(_terms(s, d, 3), 0.0, 0.5, 30_000)), 10).select("topic", "rank", "term", F.round("score", 6).alias("score"))


def topic_diversity(s, d):
    return topics.diversity(_top(s, d))


def topic_coverage(s, d):
    return topics.coverage(_docs(s, d), "Topic")


def topic_mmr(s, d):
    return topics.mmr(topics.ctfidf(topics.bounded(_terms(s, d), 0.0, 0.5)), _docs(s, d), "Topic", "Document")


def coherence_npmi(s, d):
    return topics.coherence(_docs(s, d), "doc_id", "Document", _top(s, d))


def topic_keywords(s, d):
    t = table(s, d, "topic_info_full")
    return t.select(F.col("Topic").alias("topic"), F.posexplode(labels.keywords(F.col("Representation"), None, F.col("Name"))).alias("pos", "word"))


def grid_points(s, d):
    """The points of the whole grid, each with the terms of the topics that its vocabulary bounds admit."""
    return topics.admitted(_terms(s, d), topics.grid_points(s, topics.GRID_POINTS))


GRID, GRID_WORDS = [(low, high) for low in (0.0, 0.05, 0.5) for high in (0.3, 0.6, 1.0)], (5, 10)


def grid_ranked(s, d):
    """Vocabulary bounds and word numbers tried on the topics, ranked by diversity and mean score; terms are counted once. Points whose bounds exclude everything are left out."""
    terms = materialize(_terms(s, d), "terms")
    cov = topics.coverage(_docs(s, d), "Topic").select("coverage")
    runs = None
    for low, high in GRID:
        if low < high:
            scored = topics.top_words(topics.ctfidf(topics.bounded(terms, low, high)), 10)
            for n in GRID_WORDS:
                w = scored.where(F.col("rank") <= n)
                one = w.agg(F.round(F.countDistinct("term") / F.count("*"), 6).alias("diversity"), F.round(F.avg("score"), 6).alias("mean_score"), F.countDistinct("topic").alias("topics"))
                one = one.select(F.lit(f"min_df={low}|max_df={high}|words={n}").alias("tag"), F.lit(low).alias("min_df"), F.lit(high).alias("max_df"), F.lit(n).alias("words"), "*").crossJoin(cov)
                runs = one if runs is None else runs.unionByName(one)
    return topics.rank_runs(runs, ["diversity", "mean_score", "coverage"])


def grid_best(s, d):
    return grid_ranked(s, d).orderBy("avg_rank", "coverage_rank", "diversity_rank", "mean_score_rank", "min_df", "max_df", "words").limit(1)


# curation and labels
def curate_semi_join(s, d):
    docs = _docs(s, d)
    return filters.curate(docs, docs, table(s, d, "curation_map"), "Document").select("doc_id", "Topic")


def curate_stats(s, d):
    docs, kept = _docs(s, d), curate_semi_join(s, d)
    a = docs.agg(F.count("*").alias("total"), F.round(F.avg(F.length("Document")), 6).alias("mean_length"))
    return a.crossJoin(kept.agg(F.count("*").alias("kept"))).withColumn("retention", F.round(F.try_divide("kept", "total"), 4))


def match_rate(s, d):
    return filters.match_rate(_docs(s, d), _docs(s, d), table(s, d, "curation_map"), "Document")


def run_comparison(s, d):
    docs = _docs(s, d)
    kept = filters.curate(docs, docs, table(s, d, "curation_map"), "Document")
    out = None
    for name, x in (("all", docs), ("curated", kept)):
        w = topics.top_words(topics.ctfidf(topics.bounded(topics.term_table(x, "Topic", "Document"), 0.0, 0.5)), 10)
        one = topics.coverage(x, "Topic").crossJoin(topics.diversity(w)).crossJoin(topics.coherence(x, "doc_id", "Document", w).select("coherence")).select(F.lit(name).alias("run"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _answers(s, d):
    t = table(s, d, "topic_info_full").where("Topic <> -1").select(F.col("Topic").alias("topic"), labels.keywords(F.col("Representation"), None, F.col("Name")).alias("words"))
    n = _docs(s, d).groupBy(F.col("Topic").alias("topic")).agg(F.count("*").alias("n"))
    return labels.extractive_answers(t, n)


def label_normalize_v1(s, d):
    return labels.normalize(_answers(s, d), "answer", 1).drop("answer")


def label_normalize_v2(s, d):
    return labels.normalize(_answers(s, d), "answer", 2).drop("answer")


def label_merge(s, d):
    v = label_normalize_v1(s, d).select(F.col("topic").alias("Topic"), "refined_title", "confidence")
    return table(s, d, "topic_info_full").select("Topic", "Name").join(v, "Topic", "left")


def score_histogram(s, d):
    return labels.score_histogram(label_normalize_v1(s, d), "specificity_score")


def label_confidence_report(s, d):
    return labels.confidence_report(label_normalize_v1(s, d))


def label_prompts(s, d):
    """The prompt of each topic: its keywords and the texts of highest probability."""
    from pyspark.sql import Window

    w = Window.partitionBy("Topic").orderBy(F.desc_nulls_last("Probability"), "doc_id")
    best = _docs(s, d).where("Topic <> -1 AND Document IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 10")
    t = best.groupBy("Topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "Document"))), lambda x: x["Document"]).alias("texts"))
    k = table(s, d, "topic_info_full").select("Topic", labels.keywords(F.col("Representation"), None, F.col("Name")).alias("words"))
    return k.join(t, "Topic").select("Topic", labels.prompt(F.col("words"), F.col("texts")).alias("prompt"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_include_exclude, filter_stats, harmonize_union, exact_dedup, exact_dedup_stats, extract_year, year_filter, year_profile, clean_text, abstract_cut, dense_rows, document_sample,
        tfidf_df, tfidf_terms, similar_pairs, similar_pairs_topk, pair_enrich, dedup_components, dedup_kept, dedup_drop_log, log_components, dedup_stats, threshold_metrics, threshold_selected,
        token_stats, token_exceeding, token_truncate, token_chunks, chunk_embeddings, l2_normalize, topic_centroids, representative_docs, alignment_counts, silhouette_euclid, pca_project, half_vectors, density_clusters,
        ctfidf_terms, topic_top_words, topic_ngrams, topic_diversity, topic_coverage, topic_mmr, coherence_npmi, topic_keywords, grid_points, grid_ranked, grid_best,
        curate_semi_join, curate_stats, match_rate, run_comparison, label_normalize_v1, label_normalize_v2, label_merge, score_histogram, label_confidence_report, label_prompts,
    )
}

_q = lambda t: "'" + t.replace("'", "''") + "'"
_SQUEEZE = lambda c: rf"regexp_replace(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"
_STOP = ", ".join(map(_q, X.STOP_WORDS))
_YEAR = "CASE WHEN regexp_extract(Year, '((?:19|20)[0-9]{2})', 1) <> '' THEN CAST(regexp_extract(Year, '((?:19|20)[0-9]{2})', 1) AS INTEGER) WHEN TRY_CAST(Year AS DOUBLE) BETWEEN 1900 AND 2100 THEN CAST(floor(TRY_CAST(Year AS DOUBLE)) AS INTEGER) END"
_RISK = r"(?i)risk factor|relative risk|risk ratio|rate ratio|odds ratio|prevalence ratio|associat|confidence interval|cohort study|p[-\s\p{Z}]?value|95%?[\s\p{Z}]*ci|ci[\s\p{Z}]*95|case[-\s\p{Z}]?control|cross[-\s\p{Z}]?sectional|(?:^|[^\p{L}\p{N}_])(?:rr|or|pr)(?:[\s\p{Z}]*=[\s\p{Z}]*|[\s\p{Z}]+)[0-9]"
_FLAGS = f"""WITH f AS (SELECT doc_id, coalesce(regexp_matches(text, {_q(_RISK)}), false) AS included, coalesce(regexp_matches(text, {_q(exclude_pattern())}), false) AS excluded FROM documents)"""
_TFIDF = rf"""
tok AS (SELECT row_index, unnest(regexp_extract_all(lower(Abstract), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM merged_exact_dedup WHERE Abstract IS NOT NULL),
cnt AS (SELECT row_index, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY ALL),
nn AS (SELECT count(*)::DOUBLE AS n FROM merged_exact_dedup),
df AS (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM cnt, nn GROUP BY term HAVING count(*) <= 0.95::DOUBLE * any_value(n)),
w AS (SELECT row_index, term, tf * idf AS w FROM cnt JOIN df USING (term)),
vec AS (SELECT row_index, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_index)) AS weight FROM w)"""
_PAIRS = _TFIDF + """,
pairs AS (SELECT a.row_index AS id_1, b.row_index AS id_2, sum(a.weight * b.weight) AS similarity FROM vec a JOIN vec b ON a.term = b.term AND a.row_index < b.row_index GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.7::DOUBLE - 1e-12)"""
_GROUPS = """,
e AS (SELECT id_1 AS v, id_2 AS w FROM pairs UNION SELECT id_2, id_1 FROM pairs),
r AS (SELECT DISTINCT v, v AS seen FROM e UNION SELECT r.v, e.w FROM r JOIN e ON r.seen = e.v),
comp AS (SELECT v AS id, min(seen) AS component FROM r GROUP BY v)"""
_LOG = """WITH RECURSIVE pairs AS (SELECT DISTINCT kept_index AS id_1, dropped_index AS id_2 FROM auto_drop_log WHERE kept_index IS NOT NULL AND dropped_index IS NOT NULL)""" + _GROUPS
_GRID = "WITH g AS (SELECT 0.7::DOUBLE + i * ((0.7::DOUBLE + 0.005::DOUBLE) - 0.7::DOUBLE) AS threshold FROM range(60) t(i)), p AS (SELECT Similarity AS s, TRY_CAST(is_duplicate AS DOUBLE) AS y FROM candidate_pairs WHERE TRY_CAST(is_duplicate AS DOUBLE) IN (0, 1)), c AS (SELECT threshold, count(*) FILTER (WHERE s >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE s >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE s < threshold AND y = 1) AS fn, count(*) FILTER (WHERE s < threshold AND y = 0) AS tn FROM g LEFT JOIN p ON true GROUP BY threshold), m AS (SELECT *, tp + fp AS predicted, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS recall FROM c), k AS (SELECT threshold, tp, fp, fn, tn, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round(CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END, 6) AS fbeta FROM m) "
_TOKENS = rf"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{tokens.TOKEN}') AS toks FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, toks, CAST(len(toks) + 2 AS INTEGER) AS n FROM t) "
_UNIT = "WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), u AS (SELECT vec_id, label, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x FROM x)"
_CENTRE = _UNIT + ", m AS (SELECT label, pos, avg(x) AS x, count(*) AS size FROM u GROUP BY ALL), c AS (SELECT label, size, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12) AS x FROM m)"


_SIMPLE = rf"regexp_extract_all(translate(lower(coalesce(Document, '')), '{X.ACCENTED}', '{X.BARE}'), '[a-z][a-z\-]{{2,}}')"


def _terms_sql(source: str = "document_info_full") -> str:
    return rf"""
tk AS (SELECT Topic AS topic, unnest({_SIMPLE}) AS term FROM {source} WHERE Topic IS NOT NULL AND Topic <> -1),
terms AS (SELECT topic, term, count(*) AS tf FROM tk WHERE term NOT IN ({_STOP}) GROUP BY ALL)"""


def _top_sql(source: str = "document_info_full", n: int = 10, low: float = 0.0, high: float = 0.5, tag: str = "") -> str:
    """Common table expressions after terms: bounds, scores and the first n words."""
    return f"""
ok{tag} AS (SELECT term FROM terms{{src}} GROUP BY term HAVING count(*) >= {low}::DOUBLE * (SELECT count(DISTINCT topic) FROM terms{{src}}) AND count(*) <= {high}::DOUBLE * (SELECT count(DISTINCT topic) FROM terms{{src}})),
bt{tag} AS (SELECT * FROM terms{{src}} WHERE term IN (SELECT term FROM ok{tag})),
sz{tag} AS (SELECT topic, sum(tf) AS size FROM bt{tag} GROUP BY topic),
fq{tag} AS (SELECT term, sum(tf) AS f FROM bt{tag} GROUP BY term),
sc{tag} AS (SELECT topic, term, tf / size * ln(1 + (SELECT avg(size) FROM sz{tag}) / f) AS score FROM bt{tag} JOIN sz{tag} USING (topic) JOIN fq{tag} USING (term)),
top{tag} AS (SELECT * FROM (SELECT topic, term, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS INTEGER) AS rank FROM sc{tag}) WHERE rank <= {n})""".replace("{src}", "")


def _coherence_sql(source: str = "document_info_full", top: str = "top", tag: str = "") -> str:
    """Common table expressions after the top words; the last one, coh, has the one row."""
    text = rf"""
d@ AS (SELECT doc_id AS id, {_SIMPLE} AS t FROM {source}),
vf@ AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(t) AS term FROM d@) GROUP BY term),
nd@ AS (SELECT count(*) AS n FROM d@),
vo@ AS (SELECT term FROM vf@, nd@ WHERE df >= least(5, greatest(2, floor(n * 0.001::DOUBLE))) AND df <= 0.9::DOUBLE * n AND term IN (SELECT term FROM {top})),
ask@ AS (SELECT DISTINCT topic, term FROM {top} WHERE term IN (SELECT term FROM vo@)),
good@ AS (SELECT * FROM ask@ WHERE topic IN (SELECT topic FROM ask@ GROUP BY topic HAVING count(*) >= 2)),
win@ AS (SELECT id, unnest(range(0, greatest(1, len(t) - 9))) AS w, t FROM d@),
seen@ AS (SELECT DISTINCT id, w, unnest(t[w + 1 : w + 10]) AS term FROM win@),
hit@ AS (SELECT * FROM seen@ WHERE term IN (SELECT term FROM good@)),
tot@ AS (SELECT count(*) AS n FROM win@),
one@ AS (SELECT term, count(*) AS c FROM hit@ GROUP BY term),
pr@ AS (SELECT a.term AS x, b.term AS y, count(*) AS c FROM hit@ a JOIN hit@ b ON a.id = b.id AND a.w = b.w AND a.term < b.term GROUP BY ALL),
q@ AS (SELECT a.topic, coalesce(pr@.c, 0) / tot@.n AS p, ox.c / tot@.n AS px, oy.c / tot@.n AS py FROM good@ a JOIN good@ b ON a.topic = b.topic AND a.term < b.term JOIN one@ ox ON ox.term = a.term JOIN one@ oy ON oy.term = b.term LEFT JOIN pr@ ON pr@.x = a.term AND pr@.y = b.term, tot@),
each@ AS (SELECT topic, avg(ln((p + 1e-12::DOUBLE) / (px * py)) / -ln(p + 1e-12::DOUBLE)) AS npmi, count(*) AS pairs FROM q@ GROUP BY topic),
coh@ AS (SELECT CASE WHEN count(*) >= 2 THEN round(avg(npmi), 6) END AS coherence, count(*) AS topics, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs FROM each@)"""
    return text.replace("@", tag)


def _grid_sql() -> str:
    """The points of the grid, one chain of bounds, scores and words for each pair of bounds."""
    chains, runs = [], []
    for k, (low, high) in enumerate((a, b) for a, b in GRID if a < b):
        chains.append(_top_sql(low=low, high=high, tag=f"_g{k}"))
        for n in GRID_WORDS:
            runs.append(f"SELECT 'min_df={low}|max_df={high}|words={n}' AS tag, {low}::DOUBLE AS min_df, {high}::DOUBLE AS max_df, {n}::INTEGER AS words, round(count(DISTINCT term) / count(*), 6) AS diversity, round(avg(score), 6) AS mean_score, count(DISTINCT topic) AS topics, (SELECT coverage FROM cov) AS coverage FROM top_g{k} WHERE rank <= {n}")
    ranks = ", ".join(f"CAST(rank() OVER (ORDER BY {m} DESC NULLS LAST) AS DOUBLE) AS {m}_rank" for m in ("diversity", "mean_score", "coverage"))
    return f"WITH {_terms_sql()}, {', '.join(chains)}, cov AS ({_COVER('document_info_full')}), runs AS ({' UNION ALL '.join(runs)}), rk AS (SELECT *, {ranks}, CASE WHEN coverage < 0.6 THEN 10000.0 ELSE 0.0 END::DOUBLE AS penalty FROM runs), ranked AS (SELECT *, (diversity_rank + mean_score_rank + coverage_rank) / 3.0::DOUBLE + penalty AS avg_rank FROM rk) "


_KEPT = rf"kept AS (SELECT doc_id, Topic, Document FROM document_info_full WHERE {_SQUEEZE('Document')} IN (SELECT {_SQUEEZE('Document')} FROM document_info_full d WHERE Document IS NOT NULL AND (Topic IS NULL OR Topic NOT IN (SELECT topic FROM curation_map WHERE topic IS NOT NULL AND lower({_SQUEEZE('status')}) = 'remove'))))"
_COVER = lambda src: f"SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(Topic, -1) = -1) AS outliers, round(1 - count(*) FILTER (WHERE coalesce(Topic, -1) = -1) / count(*), 6) AS coverage, count(DISTINCT Topic) FILTER (WHERE coalesce(Topic, -1) <> -1) AS topics FROM {src}"
_WORDS = "WITH k AS (SELECT Topic AS topic, list_filter(list_transform(Representation, lambda x: trim(x)), lambda x: x <> '')[1:15] AS words FROM topic_info_full)"



def _label_sql(version: int) -> str:
    """The stand-in's answers in their normal form, written out from the keywords and the number of texts."""
    side, proof, link = (1_000_000, 160, 500) if version == 1 else (200, 300, 400)
    summary = "'About ' || array_to_string(words, ', ') || '.'"
    summary = f"substr({summary}, 1, 2000)" if version == 1 else f"array_to_string(string_split({summary}, ' ')[1:250], ' ')"
    factor, outcome = f"substr(coalesce(words[2], ''), 1, {side})", f"substr(words[1], 1, {side})"
    links = f"""'[{{"factor":"' || {factor} || '","outcome_or_result":"' || {outcome} || '","direction":"positive","brief_evidence":"' || substr(n || ' texts', 1, {proof}) || '"}}]'"""
    score = "CAST(greatest(1, least(5, length(n::VARCHAR))) AS INTEGER)"
    more = f", {score} AS specificity_score" if version == 1 else ""
    return _WORDS + f", n AS (SELECT k.topic, k.words, (SELECT count(*) FROM document_info_full d WHERE d.Topic = k.topic) AS n FROM k WHERE k.topic <> -1) SELECT topic, substr(array_to_string(words[1:3], ' '), 1, 100) AS refined_title, substr(words[1], 1, 250) AS search_topic, {summary} AS summary, {links} AS associations_json, 1::INTEGER AS associations, substr(array_to_string(words, ' '), 1, {link}) AS link_text, array_to_string(list_transform(words, lambda w: lower(w))[1:10], ', ') AS tags, {score} AS confidence{more} FROM n"


def _points_sql() -> str:
    g = topics.GRID_POINTS
    kind = lambda v: "DOUBLE" if isinstance(v[0], float) else "INTEGER"
    lists = ", ".join(f"(SELECT unnest([{', '.join(map(str, v))}]::{kind(v)}[]) AS {k})" for k, v in g.items())
    tag = " || '|' || ".join(f"'{k}=' || {k}" for k in g)
    return f"WITH {_terms_sql()}, tn AS (SELECT count(DISTINCT topic) AS n FROM terms), td AS (SELECT term, count(*) AS df, sum(tf) AS f FROM terms GROUP BY term), pt AS (SELECT * FROM {lists} WHERE max_df > min_df), bo AS (SELECT min_df, max_df, count(*) AS terms, sum(f) AS f FROM (SELECT DISTINCT min_df, max_df FROM pt), td, tn WHERE df >= min_df * n AND df <= max_df * n GROUP BY ALL) SELECT pt.*, {tag.replace('min_df', 'pt.min_df').replace("'pt.min", "'min").replace('max_df', 'pt.max_df').replace("'pt.max", "'max")} AS tag, CAST(coalesce(terms, 0) AS BIGINT) AS terms, CAST(coalesce(f, 0) AS BIGINT) AS occurrences FROM pt LEFT JOIN bo ON bo.min_df = pt.min_df AND bo.max_df = pt.max_df"


SQL = {
    "dense_rows": "SELECT row_index, row_number() OVER (ORDER BY row_index) - 1 AS position FROM (SELECT min(row_index) AS row_index FROM merged_exact_dedup GROUP BY Title, Abstract)",
    "document_sample": "SELECT doc_id FROM documents ORDER BY substr(md5('42:' || doc_id), 1, 15), doc_id LIMIT 300",
    "half_vectors": "WITH x AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), s AS (SELECT *, pow(2.0::DOUBLE, greatest(floor(log2(CASE WHEN x = 0 THEN 1.0 ELSE abs(x) END)), -14) - 10) AS step FROM x) SELECT vec_id, pos, round_even(x / step, 0) * step AS x FROM s",
    "density_clusters": f"WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), near AS (SELECT a.id AS x, b.id AS y FROM v a, v b WHERE list_distance(a.v, b.v) <= {DENSITY['eps']}::DOUBLE), core AS (SELECT x AS id FROM near GROUP BY x HAVING count(*) >= {DENSITY['min_points']}), e AS (SELECT x, y FROM near WHERE x IN (SELECT id FROM core) AND y IN (SELECT id FROM core)), r AS (SELECT id, id AS seen FROM core UNION SELECT r.id, e.y FROM r JOIN e ON r.seen = e.x), g AS (SELECT id, min(seen) AS c FROM r GROUP BY id), big AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM g GROUP BY c HAVING count(*) >= {DENSITY['min_size']}) SELECT v.id AS vec_id, CAST(coalesce(k, -1) AS INTEGER) AS cluster FROM v LEFT JOIN g ON g.id = v.id LEFT JOIN big ON big.c = g.c",
    "grid_points": _points_sql(),
    "filter_include_exclude": _FLAGS + " SELECT doc_id, included, excluded, included AND NOT excluded AS kept FROM f",
    "filter_stats": _FLAGS + " SELECT count(*) AS total_input, count(*) FILTER (WHERE included) AS with_included, count(*) FILTER (WHERE excluded) AS with_excluded, count(*) FILTER (WHERE included AND NOT excluded) AS final_kept, count(*) - count(*) FILTER (WHERE included AND NOT excluded) AS final_removed, round(count(*) FILTER (WHERE included AND NOT excluded) / count(*), 6) AS retention_rate FROM f",
    "harmonize_union": "SELECT DOI, Title, Abstract, Authors, Journal, Year, CASE WHEN row_index % 2 = 0 THEN 'first' ELSE 'second' END AS source, row_index FROM merged_exact_dedup",
    "exact_dedup": "SELECT row_index, Title, Abstract, source FROM merged_exact_dedup QUALIFY row_number() OVER (PARTITION BY Title, Abstract ORDER BY row_index) = 1",
    "exact_dedup_stats": "SELECT count(*) AS total, count(DISTINCT (coalesce(Title, chr(1)), coalesce(Abstract, chr(1)))) AS kept, count(*) - count(DISTINCT (coalesce(Title, chr(1)), coalesce(Abstract, chr(1)))) AS removed FROM merged_exact_dedup",
    "extract_year": f"SELECT row_index, {_YEAR} AS year FROM merged_exact_dedup",
    "year_filter": f"SELECT * FROM (SELECT row_index, {_YEAR} AS year FROM merged_exact_dedup) WHERE year BETWEEN 2000 AND 2025",
    "year_profile": f"WITH y AS (SELECT {_YEAR} AS y FROM merged_exact_dedup) SELECT count(*) AS total, min(y) AS year_min, max(y) AS year_max, count(*) FILTER (WHERE y BETWEEN 2000 AND 2025) AS kept, count(*) FILTER (WHERE y < 2000) AS before, count(*) FILTER (WHERE y > 2025) AS after, count(*) FILTER (WHERE y IS NULL) AS missing FROM y",
    "abstract_cut": f"WITH a AS (SELECT row_index, {_SQUEEZE("coalesce(Abstract, '')")} AS t FROM merged_exact_dedup) SELECT row_index, CASE WHEN length(t) > 900 THEN substr(t, 1, 900) || '...' ELSE t END AS abstract FROM a",
    "tfidf_df": f"WITH {_TFIDF} SELECT term, df, round(idf, 6) AS idf FROM df",
    "tfidf_terms": f"WITH {_TFIDF} SELECT row_index, term, round(weight, 6) AS weight FROM vec",
    "similar_pairs": f"WITH {_PAIRS} SELECT id_1, id_2, round(similarity, 6) AS similarity FROM pairs",
    "similar_pairs_topk": f"WITH {_PAIRS}, e AS (SELECT id_1 i, id_2 j, similarity FROM pairs UNION ALL SELECT id_2, id_1, similarity FROM pairs), n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(similarity, 9) DESC, j) <= 9) SELECT least(i, j) AS id_1, greatest(i, j) AS id_2, round(max(similarity), 6) AS similarity FROM n GROUP BY 1, 2",
    "pair_enrich": f"WITH {_PAIRS} SELECT id_1, id_2, a.Title AS Title_1, a.Authors AS Authors_1, a.source AS source_1, b.Title AS Title_2, b.Authors AS Authors_2, b.source AS source_2 FROM pairs JOIN merged_exact_dedup a ON a.row_index = id_1 JOIN merged_exact_dedup b ON b.row_index = id_2",
    "dedup_components": f"WITH RECURSIVE {_PAIRS}{_GROUPS} SELECT id, component FROM comp",
    "dedup_kept": f"WITH RECURSIVE {_PAIRS}{_GROUPS} SELECT row_index FROM merged_exact_dedup WHERE row_index NOT IN (SELECT id FROM comp WHERE id <> component)",
    "dedup_drop_log": f"WITH RECURSIVE {_PAIRS}{_GROUPS} SELECT component AS kept_index, id AS dropped_index, k.Title AS kept_title, k.source AS kept_source, k.DOI AS kept_doi, x.Title AS dropped_title, x.source AS dropped_source, x.DOI AS dropped_doi FROM comp JOIN merged_exact_dedup k ON k.row_index = component JOIN merged_exact_dedup x ON x.row_index = id WHERE id <> component",
    "log_components": _LOG + " SELECT id, component FROM comp",
    "dedup_stats": _LOG + " SELECT count(*) AS records, count(DISTINCT component) AS groups, count(*) FILTER (WHERE id <> component) AS dropped FROM comp",
    "threshold_metrics": _GRID + "SELECT * FROM k",
    "threshold_selected": _GRID + "SELECT coalesce(min(threshold) FILTER (WHERE precision >= 0.99 AND predicted > 0), (SELECT threshold FROM k ORDER BY fbeta DESC, threshold LIMIT 1)) AS threshold, count(*) FILTER (WHERE precision >= 0.99 AND predicted > 0) > 0 AS meets_target, (SELECT threshold FROM k ORDER BY f1 DESC, threshold LIMIT 1) AS best_f1, (SELECT threshold FROM k ORDER BY fbeta DESC, threshold LIMIT 1) AS best_fbeta FROM k",
    "token_stats": _TOKENS + "SELECT count(n) AS n_documents, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, round(stddev_samp(n), 6) AS std, " + ", ".join(f"round(quantile_cont(n::DOUBLE, {q / 100}), 6) AS p{q}" for q in (25, 50, 75, 90, 95, 99)) + " FROM l",
    "token_exceeding": _TOKENS + "SELECT count(*) FILTER (WHERE n > 512) AS exceeding, round(avg(CASE WHEN n > 512 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS percent FROM l",
    "token_truncate": _TOKENS + "SELECT doc_id, array_to_string(toks[1:510], ' ') AS text_trunc512 FROM l",
    "token_chunks": _TOKENS + ", c AS (SELECT doc_id, toks, unnest(range(0, 1 + CASE WHEN len(toks) > 512 THEN CAST(ceil((len(toks) - 512) / 409) AS BIGINT) ELSE 0 END)) AS i FROM l) SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(len(toks[i * 409 + 1 : i * 409 + 512]) AS INTEGER) AS n, array_to_string(toks[i * 409 + 1 : i * 409 + 512], ' ') AS text FROM c",
    "l2_normalize": _UNIT + " SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM u",
    "topic_centroids": _CENTRE + " SELECT label, size, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM c",
    "representative_docs": _CENTRE + ", s AS (SELECT u.label, vec_id, round(sum(u.x * c.x), 6) AS similarity FROM u JOIN c ON u.label = c.label AND u.pos = c.pos GROUP BY ALL) SELECT * FROM (SELECT label, vec_id, similarity, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10",
    "alignment_counts": "SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS aligned, count(*) FILTER (WHERE e.vec_id IS NULL) AS without_vector, count(*) FILTER (WHERE d.doc_id IS NULL) AS without_document FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id",
    "silhouette_euclid": "WITH g AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> -1 AND label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 1)), n AS (SELECT label, count(*) AS n FROM g GROUP BY label), p AS (SELECT a.vec_id, a.label, b.label AS h, sum(list_distance(a.v, b.v)) AS d FROM g a, g b GROUP BY ALL), e AS (SELECT vec_id, p.label, max(CASE WHEN p.label = h THEN d / (n - 1) END) AS a, min(CASE WHEN p.label <> h THEN d / n END) AS b FROM p JOIN n ON n.label = h GROUP BY ALL) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS points, count(DISTINCT label) AS groups FROM e",
    "ctfidf_terms": f"WITH {_terms_sql()}, {_top_sql(high=1e9, n=1)} SELECT topic, term, round(score, 6) AS score FROM sc",
    "topic_top_words": f"WITH {_terms_sql()}, {_top_sql()} SELECT topic, rank, term, round(score, 6) AS score FROM top",
    "topic_diversity": f"WITH {_terms_sql()}, {_top_sql()} SELECT round(count(DISTINCT term) / count(*), 6) AS diversity, count(*) AS words FROM top",
    "coherence_npmi": f"WITH {_terms_sql()}, {_top_sql()}, {_coherence_sql()} SELECT * FROM coh",
    "topic_coverage": _COVER("document_info_full"),
    "topic_keywords": _WORDS + " SELECT topic, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, unnest(words) AS word FROM k",
    "curate_semi_join": f"WITH {_KEPT} SELECT doc_id, Topic FROM kept",
    "curate_stats": f"WITH {_KEPT} SELECT count(*) AS total, round(avg(length(Document)), 6) AS mean_length, (SELECT count(*) FROM kept) AS kept, round((SELECT count(*) FROM kept) / count(*), 4) AS retention FROM document_info_full",
    "run_comparison": f"WITH {_KEPT}, {_terms_sql()}, {_top_sql()}, {_terms_sql('kept').replace('tk AS', 'tk2 AS').replace('terms AS', 'terms2 AS').replace('FROM tk', 'FROM tk2')}, {_top_sql(tag='2').replace('FROM terms', 'FROM terms2')}, {_coherence_sql()}, {_coherence_sql('kept', 'top2', '2')} SELECT 'all' AS run, * FROM ({_COVER('document_info_full')}), (SELECT round(count(DISTINCT term) / count(*), 6) AS diversity, count(*) AS words FROM top), (SELECT coherence FROM coh) UNION ALL SELECT 'curated', * FROM ({_COVER('kept')}), (SELECT round(count(DISTINCT term) / count(*), 6), count(*) FROM top2), (SELECT coherence FROM coh2)",
    "match_rate": f"WITH {_KEPT}, stay AS (SELECT Document FROM document_info_full WHERE Topic IS NULL OR Topic NOT IN (SELECT topic FROM curation_map WHERE topic IS NOT NULL AND lower({_SQUEEZE('status')}) = 'remove')), k AS (SELECT count(*) AS kept_documents, count(DISTINCT {_SQUEEZE('Document')}) AS distinct_texts FROM stay) SELECT kept_documents, distinct_texts, (SELECT count(*) FROM kept) AS matched, round(100.0::DOUBLE * (SELECT count(*) FROM kept) / kept_documents, 6) AS match_rate FROM k",
    "grid_ranked": _grid_sql() + "SELECT * FROM ranked",
    "grid_best": _grid_sql() + "SELECT * FROM ranked ORDER BY avg_rank, coverage_rank, diversity_rank, mean_score_rank, min_df, max_df, words LIMIT 1",
    "topic_ngrams": rf"""WITH dw AS (SELECT Topic AS topic, list_filter({_SIMPLE}, lambda x: x NOT IN ({_STOP})) AS w FROM document_info_full WHERE Topic IS NOT NULL AND Topic <> -1),
g AS (SELECT topic, unnest(w) AS term FROM dw UNION ALL SELECT topic, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM dw UNION ALL SELECT topic, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM dw),
terms AS (SELECT topic, term, count(*) AS tf FROM g GROUP BY ALL),
vocab AS (SELECT term FROM terms GROUP BY term HAVING count(*) <= 0.5::DOUBLE * (SELECT count(DISTINCT topic) FROM terms) ORDER BY sum(tf) DESC, term LIMIT 30000),
bt AS (SELECT * FROM terms WHERE term IN (SELECT term FROM vocab)), sz AS (SELECT topic, sum(tf) AS size FROM bt GROUP BY topic), fq AS (SELECT term, sum(tf) AS f FROM bt GROUP BY term),
sc AS (SELECT topic, term, tf / size * ln(1 + (SELECT avg(size) FROM sz) / f) AS score FROM bt JOIN sz USING (topic) JOIN fq USING (term))
SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM sc) WHERE rank <= 10""",
    "label_prompts": _WORDS + f", b AS (SELECT Topic, {_SQUEEZE('Document')} AS t, row_number() OVER (PARTITION BY Topic ORDER BY Probability DESC NULLS LAST, doc_id) AS r FROM document_info_full WHERE Topic <> -1 AND Document IS NOT NULL), p AS (SELECT Topic, string_agg('- ' || CASE WHEN length(t) > 900 THEN substr(t, 1, 900) || '...' ELSE t END, chr(10) ORDER BY r) AS lines FROM b WHERE r <= 10 GROUP BY Topic) SELECT p.Topic, 'Keywords: ' || array_to_string(k.words, ', ') || chr(10) || 'Documents:' || chr(10) || lines AS prompt FROM p JOIN k ON k.topic = p.Topic",
    "label_normalize_v1": _label_sql(1),
    "label_normalize_v2": _label_sql(2),
    "label_merge": _WORDS + ", n AS (SELECT Topic AS topic, length(CAST(count(*) AS VARCHAR)) AS d FROM document_info_full GROUP BY Topic) SELECT t.Topic, t.Name, CASE WHEN t.Topic <> -1 THEN substr(array_to_string(k.words[1:3], ' '), 1, 100) END AS refined_title, CASE WHEN t.Topic <> -1 THEN CAST(greatest(1, least(5, coalesce(n.d, 1))) AS INTEGER) END AS confidence FROM topic_info_full t LEFT JOIN k ON k.topic = t.Topic LEFT JOIN n ON n.topic = t.Topic",
    "score_histogram": "WITH n AS (SELECT t.Topic, greatest(1, least(5, length(CAST(count(d.Topic) AS VARCHAR)))) AS s FROM topic_info_full t LEFT JOIN document_info_full d ON d.Topic = t.Topic WHERE t.Topic <> -1 GROUP BY t.Topic) SELECT CAST(i AS INTEGER) AS specificity_score, count(s) AS labels FROM range(1, 6) r(i) LEFT JOIN n ON s = i GROUP BY i",
    "label_confidence_report": "WITH n AS (SELECT t.Topic, greatest(1, least(5, length(CAST(count(d.Topic) AS VARCHAR)))) AS s FROM topic_info_full t LEFT JOIN document_info_full d ON d.Topic = t.Topic WHERE t.Topic <> -1 GROUP BY t.Topic) SELECT count(*) AS labels, round(avg(s), 6) AS mean_confidence, count(*) FILTER (WHERE s >= 4) AS confident FROM n",
}
