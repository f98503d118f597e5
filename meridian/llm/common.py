"""Helpers shared by the corpus operators: column picking, shared tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_CHARS = 2_000_000
#: Tables are broadcast up to this size; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64_000_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name and position, so extra columns whose names clash do no harm."""
    columns = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return flat.select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def plain(df: DataFrame, *names: str) -> DataFrame:
    """All columns in their order, the named ones by their names and the others by place, so no two clash."""
    columns = df.columns
    at = {columns.index(n): n for n in names}
    return df.toDF(*[at.get(i, f"c{i}") for i in range(len(columns))])


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of df whose doc_id isn't among those of gone (doc_id)."""
    gone = gone.select(F.col("doc_id").alias("__gone"))
    return plain(df, "doc_id").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local session may do without and gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    What forget() hasn't deleted goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meridian-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, marked for broadcast if its rows, of row_bytes each at most, stay within BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a bounded number of text bytes, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = total = 0
        for i, n in enumerate(x or 0 for x in sizes):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay as they are. Every step writes
    the minima before joining them, so the join reads two plain exchanges and hubs can be split.
    """
    # A pair is kept with its larger node first.
    held = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        forget(low)
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")))
        moved = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = stored(moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        for x in (low, large, held):
            forget(x)
        held = after
        now = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = held.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
