"""Tables in the folder that all executors share, for plans that read one narrow table several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or where it is unset one of our own (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/hustings"
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="hustings-tables-")
    return _own[app]


def path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    at = path(df.sparkSession, tag)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def delete(spark: SparkSession, at: str) -> None:
    """Deletes a file or folder wherever it lies."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def finished(result: DataFrame, tag: str, *inputs: DataFrame) -> DataFrame:
    """The stored result; the stored tables that it was made from are deleted."""
    out = stored(result, tag)
    for df in inputs:
        delete(df.sparkSession, df._stored_at)
    return out
