"""The lexicon filter on a stream of record files; it keeps no state, so late and repeated rows need no care."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import lexicon_flags


def stream_kept(spark: SparkSession, folder: str, schema, text: str, include: list[str] | None = None, exclude: list[str] | None = None, files: int = 8) -> DataFrame:
    """The rows of new Parquet files in ``folder`` that pass the filter."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return lexicon_flags(rows, text, include, exclude).where("kept").drop("included", "excluded", "kept")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write what is there now as Parquet, each file once over all runs."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
