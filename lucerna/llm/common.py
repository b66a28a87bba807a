"""Shared helpers: shared-folder spools, bounded Arrow slices, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts may be long, so batches are kept short.
ARROW_ROWS = 1000
#: Bytes of text that a Python worker holds in pieces at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short unless the session already asks for shorter ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until the frame has no column like it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, run: Callable) -> DataFrame:
    """mapInArrow over all columns, giving the same ones, whatever their names; `run` finds them by place."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The frame's columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in but]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one serves a session that is one
    process (local master); on a cluster that raises ValueError, since executors wouldn't see each other's files."""
    sc = spark.sparkContext
    if not (folder := sc.getCheckpointDir()):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lucerna-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    The files go by `drop`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back._spooled = path
    return back


def drop(*frames: DataFrame | None) -> None:
    """Deletes the files of spooled frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_spooled", None):
            files, target = _file_system(df.sparkSession, path)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)


#: Rows of a frame that is broadcast, at most.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it is counted to have at most `limit` rows; else as it is, for a shuffled join. For frames
    of a few short columns that were written before."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sliced(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes in the given string column (a longer value comes alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at, base = 0, 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def list_column(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values laid end to end."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def connected_components(edges: DataFrame) -> DataFrame:
    """Stars (node, root) from edges (a, b) of longs; root is the smallest node that `node` reaches.

    Alternating large-star and small-star rounds: each round every node hands its neighbours the smallest
    node it knows. Hub minima are written before they are joined, so that both sides of the join have an
    exchange of their own and Spark can split a hub. Nodes without an edge to another node don't appear.
    """
    now = spool(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while not now.isEmpty():
        was = now
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = spool(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(hub, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = spool(large.where("a <> b").distinct(), "large")
        least = spool(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = spool(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        drop(was, hub, large, least)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (seen := tuple(seen)) == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
