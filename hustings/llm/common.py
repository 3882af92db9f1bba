"""Shared helpers: the cluster's shared folder, lineage cuts, Arrow batch bounds, connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.plans import storage
from hustings.plans.session import ship

#: Rows per Arrow batch: bounds a worker's memory when texts are long.
ARROW_ROWS = 512

#: The same for rows of a few numbers.
NARROW_ROWS = 65_536

#: Stored tables end the lineage: a lost executor costs no recomputation.
shared_dir, fresh_path, stored = storage.folder, storage.path, storage.stored


def session(spark: SparkSession, arrow_rows: int = ARROW_ROWS) -> SparkSession:
    """The session, with this package on its executors and Arrow batches bounded: few rows for wide texts, more for narrow
    ones. Operators that take more store what they make of them and leave the bound at ARROW_ROWS, so a frame that is
    still to run finds no other."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow_rows))
    return spark


def release(*tables: DataFrame) -> None:
    """Deletes tables of stored() that no later plan reads."""
    for df in tables:
        storage.delete(df.sparkSession, df._stored_at)


class Shelf:
    """Stored tables of one operator: put() stores one, drop() deletes some, close() all that are left."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        self.held.append(stored(df, tag))
        return self.held[-1]

    def take(self, df: DataFrame) -> DataFrame:
        """Holds a table that another operator stored."""
        self.held.append(df)
        return df

    def drop(self, *tables: DataFrame) -> None:
        release(*tables)
        self.held = [t for t in self.held if not any(t is x for x in tables)]

    def close(self) -> None:
        release(*self.held)
        self.held = []


def collect_garbage(spark: SparkSession) -> None:
    """Collects the garbage of every executor: a task for each core, which asks its JVM to. A collector gives memory back to
    the machine only then, so what one step left counts until it is told."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, as it does when the driver's
    garbage is collected. Then the executors' is, where they aren't the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if spark.sparkContext.master.split("[")[0] != "local":
        collect_garbage(spark)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def pieces(batch: pa.RecordBatch, column: str | int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold most_bytes at most, or one row."""
    _, offs = text_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + most_bytes, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def forest(edges: DataFrame, most_edges: int = 500_000) -> DataFrame:
    """Edges (a, b) with the same components: each task joins up to most_edges of them and passes on one edge a vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def flush() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        n = 0
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
            if (n := n + batch.num_rows) >= most_edges:
                yield flush()
                n = 0
        yield flush()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, tag: str, most_rounds: int = 40) -> DataFrame:
    """A stored table (id, root): for every vertex of edges (a, b), the smallest id that links reach.

    Tasks first join the edges they hold. What is left alternates large-star and small-star steps, each a min per vertex
    with map-side combining. Each round is written to the shared folder and deleted after the next. A vertex's
    neighbours are never gathered in one place.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        sides = both(e)
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return sides.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        return (
            down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    given = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), tag)
    now = stored(forest(given.coalesce(given.count() // 500_000 + 1)).distinct(), tag)
    release(given)
    before = state(now)
    for _ in range(most_rounds if before[0] else 0):
        old, now = now, stored(small(large(now)), tag)
        release(old)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = stored(roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()), tag)
    release(now)
    return out
