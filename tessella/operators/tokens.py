"""Token lengths, truncation and overlapping chunks. The default tokenizer takes words and single signs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
SPECIALS = 2


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def length_stats(df: DataFrame, length: str) -> DataFrame:
    """Count, extremes, mean, median, sample deviation and linearly interpolated percentiles of a length."""
    c = F.col(length)
    p = lambda q: F.round(F.percentile(c, F.lit(q)), 6)
    return df.agg(F.count(c).alias("n_documents"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 6).alias("mean"), p(0.5).alias("median"), F.round(F.stddev_samp(c), 6).alias("std"), *[p(q / 100).alias(f"p{q}") for q in (25, 50, 75, 90, 95, 99)])


def truncate(tokens: Column, limit: int) -> Column:
    return F.array_join(F.slice(tokens, 1, limit - SPECIALS), " ")


def chunks(tokens: Column, length: int = 512, stride: int = 409) -> Column:
    """The whole list if it fits, else lists of ``length`` from 0, stride, 2 * stride ... until one reaches the end."""
    n = F.size(tokens)
    more = F.when(n > length, F.ceil((n - length) / stride)).otherwise(0).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda i: F.slice(tokens, i * stride + 1, length))


def with_truncated(df: DataFrame, text: str, n: int = 512) -> DataFrame:
    """``df`` with the column '<text>_trunc<n>': the text cut to ``n`` tokens; null is ''."""
    return df.withColumn(f"{text}_trunc{n}", truncate(tokenize(F.coalesce(F.col(text), F.lit(""))), n))
