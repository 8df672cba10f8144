"""Tables in the folder that all executors share: they cut lineages and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows, written as JSON, that are broadcast at most.
MOST_BROADCAST = 64_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where it is unset (local runs and tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomspark-"))
    return spark.sparkContext.getCheckpointDir()


#: Tables that store() made for this driver and nobody has deleted yet.
_MADE: dict[str, None] = {}


def store(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE[path] = None
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by store() that no later step reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(f).getParent().toString())


def sweep_stored(spark: SparkSession) -> int:
    """Delete all tables that store() has made for this driver; their number.  For the end of a job, when its results are written."""
    n = 0
    while _MADE:
        _delete(spark, _MADE.popitem()[0])
        n += 1
    return n


def fits_broadcast(df: DataFrame, most_bytes: int = MOST_BROADCAST) -> bool:
    size = F.octet_length(F.to_json(F.struct("*"))) + 16
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most_bytes


def checked_broadcast(df: DataFrame, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if its rows have at most so many bytes; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if fits_broadcast(df, most_bytes) else df
