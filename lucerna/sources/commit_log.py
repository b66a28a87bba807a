"""Appends in chunks with a log of what is committed.

A run's records are written chunk by chunk: Spark stages a chunk's files (each of `every` records at most) in a hidden folder, where no
reader looks; then they take their place in the cell's folder, and last a manifest that lists them gets the next number of the log, by
a rename that fails if another writer has taken it. Readers follow the manifests, so a chunk is there as a whole or not at all,
whatever was killed: a task (Spark commits one attempt of each), the job, or the driver between any two steps. A chunk has a name, and
one whose name the log has already isn't written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stores

LOG, STAGED = "_log", "_staged"
#: Chunks of a run at most; each has a cost of its own (plans, jobs, the log), so their number must not grow with the run.
CHUNKS = 16


def manifests(spark: SparkSession, out: str) -> list[dict]:
    """The log, oldest first: version, chunk, files (below the folder) and records."""
    found = [p for p, _ in stores.listed(spark, f"{out}/{LOG}") if p.endswith(".json")]
    if not found:
        return []
    rows = spark.read.text(found, wholetext=True).collect()  # a row for each chunk
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])


def append(df: DataFrame, out: str, chunk: str, every: int, by: tuple[str, ...] = ("model", "strategy"), compression: str = "none") -> bool:
    """Commits a chunk of JSON lines under its name; False if the log has it already. Nulls are kept. compression: a codec of Spark's text
    files; readers know it by the files' names."""
    spark = df.sparkSession
    log = manifests(spark, out)
    if any(m["chunk"] == chunk for m in log):
        return False
    staged = f"{out}/{STAGED}/{uuid.uuid4().hex}"
    with stores.brief_shuffles(spark):
        df.write.option("ignoreNullFields", "false").option("maxRecordsPerFile", every).option("compression", compression).partitionBy(*by).json(staged)
    top = str(stores.place(spark, staged)[0].makeQualified(stores.place(spark, staged)[1]).toString())
    names = [p[len(top) + 1 :] for p, n in stores.listed(spark, staged, below=True) if n]
    for name in names:
        stores.move(spark, f"{staged}/{name}", f"{out}/{name}")
    records = spark.read.text([f"{out}/{n}" for n in names]).count() if names else 0
    version = log[-1]["version"] + 1 if log else 0
    while True:
        stores.put(spark, f"{staged}/_manifest", json.dumps({"version": version, "chunk": chunk, "files": names, "records": records}))
        if stores.move(spark, f"{staged}/_manifest", f"{out}/{LOG}/{version:020d}.json"):
            break
        # another writer was first: its chunk may be this one
        if any(m["chunk"] == chunk for m in manifests(spark, out)):
            return False
        version += 1
    stores.remove(spark, staged)
    return True


def read(spark: SparkSession, out: str) -> DataFrame | None:
    """The committed lines with the folders' columns; None where nothing is committed."""
    files = [f"{out}/{n}" for m in manifests(spark, out) for n in m["files"]]
    return spark.read.option("basePath", out).text(files) if files else None


def chunks(df: DataFrame, keys: list[str], every: int, most: int = CHUNKS) -> tuple[DataFrame, int]:
    """Adds _chunk, from 0, by the keys' hash: about `every` rows for each core in a chunk, more where there would be over `most` chunks. The
    frame should be written or cheap."""
    n = df.count()
    count = min(most, -(-n // (every * df.sparkSession.sparkContext.defaultParallelism))) if n else 0
    return df.withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.lit(max(1, count))).cast("int")), count
