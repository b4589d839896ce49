"""Queries of the numbered problems and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, copies, encode, groups, packing, residue, similar, survivors


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.linked_groups(table(spark, d, "auto_drop_log"), "kept_index", "dropped_index")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.group_survivors(table(spark, d, "auto_drop_log"), table(spark, d, "merged_exact_dedup"), table(spark, d, "source_trust"), p3_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.near_duplicates(table(spark, d, "merged_exact_dedup"), "row_index", ["Title", "Abstract"])


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.subject_clusters(table(spark, d, "document_info_full"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_members(spark, d).select("doc_id", "topic")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical documents of each cluster."""
    return clusters.typical(p4_members(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_groups(table(spark, d, "merged_exact_dedup"), "row_index", ["Title", "Abstract"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_groups(spark, d).where("row_index <> first_index").select("first_index", F.col("row_index").alias("copy_index"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The collapsed records with their number of copies, as the tries counted them."""
    return p5_groups(spark, d).where("copies IS NOT NULL").select("first_index", "copies")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return encode.round_trip(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(encode.token_counts(table(spark, d, "documents")), table(spark, d, "container_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used for each capacity, against the least that the tokens would need."""
    return (
        p7_containers(spark, d).groupBy("spec_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("pieces"))
        .groupBy("spec_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("fullest"))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validation(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p4_clusters, p5_found, p5_records, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_validation)}

P3_SQL = """
WITH RECURSIVE l AS (
  SELECT DISTINCT least(kept_index, dropped_index) a, greatest(kept_index, dropped_index) b
  FROM auto_drop_log WHERE kept_index IS NOT NULL AND dropped_index IS NOT NULL),
e AS (SELECT a v, b w FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT v, v AS seen FROM e UNION SELECT r.v, e.w FROM r JOIN e ON r.seen = e.v),
p3 AS (SELECT v AS record_index, min(seen) AS group_index FROM r GROUP BY v)
"""

SQL = {
    "p3_found": P3_SQL + "SELECT record_index, group_index FROM p3",
    "p1_found": P3_SQL
    + r""", said AS (
  SELECT kept_index AS record_index, kept_doi AS doi, kept_source AS source FROM auto_drop_log WHERE kept_index IS NOT NULL AND dropped_index IS NOT NULL
  UNION SELECT dropped_index, dropped_doi, dropped_source FROM auto_drop_log WHERE kept_index IS NOT NULL AND dropped_index IS NOT NULL),
m AS (
  SELECT p3.group_index, p3.record_index, t.trust_rank, c.retrieved_at,
    coalesce(regexp_matches(regexp_replace(said.doi, '[\p{Z}\s]+', '', 'g'), '(?i)(^|[^0-9])10\.[0-9]{4,9}(/|%2F)[^\p{Z}\s<>"]*[0-9]'), false) AS ok
  FROM p3 JOIN said USING (record_index)
  LEFT JOIN source_trust t ON lower(regexp_replace(said.source, '[^\p{L}]+', '', 'g')) = t.source
  LEFT JOIN merged_exact_dedup c ON c.row_index = p3.record_index),
o AS (
  SELECT group_index, record_index, ok, trust_rank,
    row_number() OVER (PARTITION BY group_index ORDER BY ok DESC, trust_rank NULLS LAST, retrieved_at DESC NULLS LAST, record_index) AS d,
    row_number() OVER (PARTITION BY group_index ORDER BY trust_rank NULLS LAST, retrieved_at DESC NULLS LAST, record_index) AS s
  FROM m)
SELECT group_index, max(CASE WHEN d = 1 THEN CASE WHEN ok THEN record_index ELSE -1 END END) AS doi_index,
  max(CASE WHEN s = 1 THEN CASE WHEN trust_rank IS NOT NULL THEN record_index ELSE -1 END END) AS source_index
FROM o GROUP BY group_index HAVING count(DISTINCT record_index) > 1
""",
}
