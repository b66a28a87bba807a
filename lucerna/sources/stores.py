"""Files in any store that Spark reads and writes, by Hadoop's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = place(spark, path)
    return files.exists(target)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names, which executors share; it goes when the driver's JVM ends.
    A folder of this machine serves only where the session names none and runs in one process; else ValueError."""
    import tempfile

    sc = spark.sparkContext
    top = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="lucerna-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, target = place(spark, path)
    files.deleteOnExit(target)
    return path


def listed(spark: SparkSession, folder: str, below: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder (with `below` of those under it too) by path, without hidden ones; none where it isn't there."""
    files, top = place(spark, folder)
    if not files.exists(top):
        return []
    found, it = [], files.listFiles(top, below)
    while it.hasNext():
        at = it.next()
        if not at.getPath().getName().startswith(("_", ".")):
            found.append((at.getPath().toString(), at.getLen()))
    return sorted(found)


def put(spark: SparkSession, path: str, text: str) -> None:
    files, target = place(spark, path)
    out = files.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file; False if there is one of that name already."""
    files, to = place(spark, target)
    files.mkdirs(to.getParent())
    return not files.exists(to) and files.rename(place(spark, source)[1], to)


def remove(spark: SparkSession, path: str) -> None:
    files, target = place(spark, path)
    files.delete(target, True)
    files.cancelDeleteOnExit(target)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside go when the write ends, not when the driver's JVM happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def joined(spark: SparkSession, parts: list[tuple[str, int]], path: str, head: str, tail: str, cut: int) -> None:
    """One file of a head, the parts without the last `cut` bytes of the last one, and a tail. It is made beside the parts and takes
    its name when it is whole. Stores that join files do it themselves; elsewhere bytes are copied from file to file, none in Python."""
    jvm = spark.sparkContext._jvm
    folder = parts[0][0].rsplit("/", 1)[0] if parts else f"{path}-{uuid.uuid4().hex}"
    whole, last = f"{folder}/_whole", f"{folder}/_last"
    put(spark, whole, head if parts else head + tail)
    if parts:
        files, target = place(spark, whole)
        source = files.open(place(spark, parts[-1][0])[1])
        out = files.create(place(spark, last)[1], True)
        jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, parts[-1][1] - cut)
        out.write(bytearray(tail.encode()))
        out.close()
        source.close()
        rest = [place(spark, p)[1] for p, _ in parts[:-1]] + [place(spark, last)[1]]
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(rest))
        for k, p in enumerate(rest):
            array[k] = p
        try:
            files.concat(target, array)
        except UnsupportedOperationException:
            out = files.create(target, True)
            out.write(bytearray(head.encode()))
            for p in rest:
                source = files.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
            out.close()
    remove(spark, path)
    move(spark, whole, path)
    remove(spark, folder)


def plain(path: str) -> str:
    """A path without its scheme's empty authority, as stores and readers write it differently."""
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon and (rest.startswith("///") or not rest.startswith("//")) else path
