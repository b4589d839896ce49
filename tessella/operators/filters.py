"""Include and exclude filters, year ranges and curation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import flags
from ..functions.text import squeeze, year_of


def lexicon_flags(df: DataFrame, text: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    inc, exc = flags(F.col(text), include, exclude)
    return df.withColumn("included", inc).withColumn("excluded", exc).withColumn("kept", F.col("included") & ~F.col("excluded"))


def filter_stats(flagged: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(f"with_{c}" if c != "kept" else "final_kept")
    return flagged.agg(F.count("*").alias("total_input"), n("included"), n("excluded"), n("kept")).withColumn("final_removed", F.col("total_input") - F.col("final_kept")).withColumn("retention_rate", F.round(F.try_divide(F.col("final_kept"), F.col("total_input")), 6))


def in_years(df: DataFrame, column: str, low: int = 2000, high: int = 2025) -> DataFrame:
    return df.withColumn("year", year_of(F.col(column))).where(F.col("year").between(low, high))


def year_profile(df: DataFrame, column: str, low: int = 2000, high: int = 2025) -> DataFrame:
    y = year_of(F.col(column))
    n = lambda c: F.count(F.when(c, 1))
    return df.agg(F.count("*").alias("total"), F.min(y).alias("year_min"), F.max(y).alias("year_max"), n(y.between(low, high)).alias("kept"), n(y < low).alias("before"), n(y > high).alias("after"), n(y.isNull()).alias("missing"))


def curate(docs: DataFrame, corpus: DataFrame, curation: DataFrame, text: str, doc_text: str = "Document", topic: str = "Topic") -> DataFrame:
    """Rows of ``corpus`` whose text is that of a document of a topic not marked for removal; unknown topics are kept.

    A text in a kept and in a removed topic is kept for all its rows; null texts never match.
    """
    key = lambda c: F.sha2(squeeze(F.col(c)), 256)
    kept = kept_documents(docs, curation, topic).select(key(doc_text).alias("__text")).where("__text IS NOT NULL").distinct()
    return corpus.withColumn("__text", key(text)).join(kept, "__text", "left_semi").drop("__text")


def kept_documents(docs: DataFrame, curation: DataFrame, topic: str = "Topic") -> DataFrame:
    """The documents of topics that are not marked for removal."""
    gone = curation.where(F.lower(squeeze(F.col("status"))) == "remove").select(F.col("topic").alias("__t")).distinct()
    return docs.join(gone, F.col(topic) == F.col("__t"), "left_anti")


def match_rate(docs: DataFrame, corpus: DataFrame, curation: DataFrame, text: str, doc_text: str = "Document", topic: str = "Topic") -> DataFrame:
    """(kept_documents, distinct_texts, matched, match_rate): how many rows of ``corpus`` the kept documents account for, in per cent of these documents."""
    kept = kept_documents(docs, curation, topic).agg(F.count("*").alias("kept_documents"), F.countDistinct(F.sha2(squeeze(F.col(doc_text)), 256)).alias("distinct_texts"))
    found = curate(docs, corpus, curation, text, doc_text, topic).agg(F.count("*").alias("matched"))
    return kept.crossJoin(found).withColumn("match_rate", F.round(F.try_divide(100.0 * F.col("matched"), F.col("kept_documents")), 6))
