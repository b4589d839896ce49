"""Written intermediate tables in the shared folder that the cluster names.

``spark.checkpoint.dir`` is read from the session; only where it is unset (tests, local runs)
is a folder of this machine taken. Every table is a Parquet folder of its own, so a lost executor costs the
reading task a retry, never the lineage behind the table. Tables that a result still reads stay until ``clear``.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and is computed a single time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def materialize_alone(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, and the shuffles behind the table are deleted at once, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later result reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
        left = _written.get(df.sparkSession.sparkContext.applicationId, [])
        if path in left:
            left.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables left by this application: when the results read from them have been written or collected."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
