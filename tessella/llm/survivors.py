"""Problem 1: the best representative of each group of duplicates, field by field."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: "10.", four to nine digits, a slash (also as %2F), a suffix with a digit; looked for in the text without white space.
DOI = r"(?i)(?<![0-9])10\.[0-9]{4,9}(?:/|%2F)[^\p{Z}\s<>\"]*[0-9]"


def usable_doi(doi: Column) -> Column:
    return F.coalesce(F.regexp_replace(doi, r"[\p{Z}\s]+", "").rlike(DOI), F.lit(False))


def source_key(source: Column) -> Column:
    """The letters of a source's name in lower case: 'Pub-Med_2020' and 'pubmed' are one source."""
    return F.lower(F.regexp_replace(source, r"[^\p{L}]+", ""))


def survive(members: DataFrame, group: str, record: str, usable: dict[str, Column], priority: Column, recency: Column) -> DataFrame:
    """One row per group of two or more records: for each field the record whose value survives, -1 if none is usable.

    A single aggregation takes, per field, the maximum of (usable, -priority, recency, -record): the smallest
    priority wins (null last), then the latest ``recency`` (null last), then the smallest record. The maxima combine
    map-side, so a group of a third of all rows sends one row per task. Repeated rows of a record change nothing;
    groups of a single record and rows whose group or record is null give none; no rows give no rows.
    """
    worst = F.lit(2**31 - 1)
    order = lambda ok: F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), (-F.coalesce(priority.cast("int"), worst)).alias("p"), recency.alias("t"), (-F.col(record)).alias("r"))
    best = members.where(F.col(group).isNotNull() & F.col(record).isNotNull()).groupBy(group).agg(*[F.max(order(ok)).alias(f"best_{k}") for k, ok in usable.items()], F.min(record).alias("low"), F.max(record).alias("high"))
    pick = [F.when(F.col(f"best_{k}.ok"), -F.col(f"best_{k}.r")).otherwise(F.lit(-1)).cast("bigint").alias(k) for k in usable]
    return best.where("low < high").select(group, *pick)


def group_survivors(log: DataFrame, corpus: DataFrame, trust: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_index, doi_index, source_index) of every group of ``groups`` with at least two records.

    DOI and source of a record are those the log gives it, retrieved_at is that of its row in ``corpus`` (null if it
    has none); trust_rank is that of the record's source, worst where the source is unusable.
    """
    full = log.where(F.col("kept_index").isNotNull() & F.col("dropped_index").isNotNull())
    side = lambda s: full.select(F.col(f"{s}_index").alias("record_index"), F.col(f"{s}_doi").alias("doi"), source_key(F.col(f"{s}_source")).alias("key"))
    said = side("kept").unionByName(side("dropped")).distinct()
    ranks = trust.groupBy(source_key(F.col("source")).alias("key")).agg(F.min("trust_rank").alias("trust_rank"))
    seen = corpus.groupBy(F.col("row_index").alias("record_index")).agg(F.max("retrieved_at").alias("retrieved_at"))
    members = groups.join(said, "record_index").join(ranks, "key", "left").join(seen, "record_index", "left")
    usable = {"doi_index": usable_doi(F.col("doi")), "source_index": F.col("trust_rank").isNotNull()}
    return survive(members, "group_index", "record_index", usable, F.col("trust_rank"), F.col("retrieved_at"))
