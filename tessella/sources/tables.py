"""Scans, harmonised unions and sinks of record tables."""

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of the second source and what they are called in the merged corpus.
RENAMES = {"doi": "DOI", "title": "Title", "abstract": "Abstract", "creator": "Authors", "publicationName": "Journal", "coverDate": "Year"}
RECORD = ["DOI", "Title", "Abstract", "Authors", "Journal", "Year", "source"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, if it has all ``columns``; else an error before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Headered CSV with quoted line breaks; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Append result rows under their run, so that runs can be told apart and repeated runs replaced."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_stats(row: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def read_config(path: str, keys: list[str]) -> dict:
    config = json.loads(Path(path).read_text())
    missing = [k for k in keys if k not in config]
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return config


def report(row: dict, title: str) -> str:
    """A text report of a one-row result."""
    width = max((len(k) for k in row), default=0)
    return "\n".join([title, "=" * len(title), *(f"{k:<{width}}  {v:,}" if isinstance(v, int) else f"{k:<{width}}  {v}" for k, v in row.items())])


def harmonize(sources: dict[str, DataFrame], keep: list[str] | None = None) -> DataFrame:
    """Union by name of sources with the names of either kind, each row with its source's name."""
    keep = [*RECORD, *(keep or [])]
    parts = [require_columns(df.withColumnsRenamed(RENAMES).withColumn("source", F.lit(name)), keep).select(keep) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_topics(words: DataFrame, path: str, run_id: str) -> None:
    """The words of the topics of a run (topic, term, score, rank) beside those of other runs; a repeated run replaces its own."""
    out = words.select("topic", "term", "score", "rank").withColumn("run_id", F.lit(run_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_topics(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """(topic, term, score, rank) of a run; the topic as int. A run that was never written is an error."""
    got = spark.read.option("recursiveFileLookup", False).parquet(path).where(F.col("run_id").cast("string") == run_id)
    if got.isEmpty():
        raise ValueError(f"no topics of run {run_id}")
    return got.select(F.col("topic").cast("int").alias("topic"), "term", "score", "rank")


def write_vectors(df: DataFrame, record: str, vector: str, path: str) -> None:
    """(record, vector) as Parquet, the elements as 32-bit floats."""
    df.select(record, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)
