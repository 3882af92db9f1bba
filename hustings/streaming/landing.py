"""A landing folder as a stream of files: each is read once, as a checkpoint remembers, and restarts repeat nothing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hustings.sources import documents

#: What Spark's reader of binary files returns.
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, pattern: str = "*.hwp", per_batch: int = 32) -> DataFrame:
    """New files, so many a batch. Files must arrive whole: written elsewhere and moved here."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def settled(spark: SparkSession, folder: str, pattern: str = "*", seconds: float = 4.0, most_files: int = 1_000_000) -> DataFrame:
    """(path, modificationTime, length) of files whose size and time stayed the same for so long. A file that is still
    written, or goes meanwhile, isn't listed; ValueError beyond most_files. Contents aren't read."""

    def listing() -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")

    before = listing().limit(most_files + 1).collect()
    if len(before) > most_files:
        raise ValueError(f"more than {most_files} files")
    time.sleep(seconds)
    return listing().join(spark.createDataFrame(before, "path string, modificationTime timestamp, length long"), ["path", "modificationTime", "length"], "left_semi")


def ingest(spark: SparkSession, folder: str, out: str, failed: str, checkpoint: str, pattern: str = "*.hwp", per_batch: int = 32, extractor: Callable = documents.hwp) -> StreamingQuery:
    """Extracts what has arrived and stops: whole documents go to `out`, the others with their errors to `failed`. A batch
    that is run again overwrites its own folder, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        whole = batch.Status == documents.OK
        batch.filter(whole).select("FileName", "Title", "Date", "Content").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.filter(~whole).select("FileName", "Title", "Date", "Status", "Error").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        batch.unpersist()

    rows = documents.extract(files(spark, folder, pattern, per_batch), extractor)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
