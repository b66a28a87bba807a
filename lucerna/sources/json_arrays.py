"""JSON arrays of objects: read by byte ranges, written in parts.

Spark cuts the file behind every closing brace, so a range of bytes is read by a task of its own, wherever it begins. Whether it begins
inside a string, and how deep, follows from the ranges before it: a first pass gives each range's quotes and its change of depth for
either case, and the driver carries the state on, a row for each range. In the second pass each range knows its start; it gives its
whole objects and, at its ends, pieces of those that other ranges have the rest of. An object's place is its place in its range and the
count of those that begin in earlier ranges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import stores

#: Any escaped sign: escapes stand in strings alone, and none begins with a closing brace.
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int64)
_STEP[[ord(c) for c in "[{"]], _STEP[[ord(c) for c in "]}"]] = 1, -1
#: Bytes that a worker looks at at once (a longer value comes whole), and objects that it shows at once.
PIECE, SHOWN = 1 << 20, 256
#: What may stand before an object of an array.
_BETWEEN = b" \t\r\n,["


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the bytes before each closing brace, with the byte range that they are read in."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _by_range(batches) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(range, its next bytes, about `PIECE` at most), in order; what the file lacks behind its last brace gets one too."""
    for b in sliced(batches):
        files, starts, values = (c.to_pylist() for c in b.columns)
        at = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or (files[k], starts[k]) != (files[at], starts[at]):
                yield (files[at], starts[at]), b"}".join(values[at:k]) + b"}"
                at = k


def sliced(batches) -> Iterator[pa.RecordBatch]:
    """Slices whose last column holds `PIECE` bytes at most; a longer value comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield b.slice(at, to - at)
            at = to


def _steps(data: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each byte whether it is outside of strings and its change of depth there, and whether the data ends inside a string."""
    signs = np.frombuffer(_ESCAPE.sub(b"__", data), np.uint8)
    inside = (np.cumsum(signs == ord('"')) + quoted) % 2 == 1
    return ~inside, np.where(inside, 0, _STEP[signs]), bool(inside[-1])


def _summaries(batches):
    """Of each range: whether its quotes are odd, and its change of depth if it begins outside of a string, and inside."""
    held: dict[tuple[str, int], list] = {}
    for at, data in _by_range(batches):
        x = held.setdefault(at, [False, 0, 0])
        odd = x[0]
        for k in range(2):
            _, step, end = _steps(data, bool(k) ^ odd)
            x[1 + k] += int(step.sum())
        x[0] = end ^ True  # as the last pass began inside
    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.string()), pa.array([s for _, s in held], pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*held.values()) if held else ([], [], []), (pa.bool_(), pa.int64(), pa.int64())))], ["file", "start", "odd", "outside", "inside"])


def _objects(batches, begins: dict):
    """(file, start, at, kind, text): objects and the pieces of those that go over a range's ends, in order."""
    names = ["file", "start", "at", "kind", "text"]
    now, rest, depth, quoted, count, open_ = None, b"", 0, False, 0, False
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else ([],) * 5, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names)
        out.clear()
        return done

    def close():
        if now is not None and (depth > 1 or quoted):
            out.append((*now, count, "on" if open_ else "begin", rest if open_ else rest.lstrip(_BETWEEN)))

    for at, data in _by_range(batches):
        if at != now:
            close()
            now, rest, count = at, b"", 0
            quoted, depth = begins[at]
            open_ = depth > 1 or quoted  # begins within an object
        outside, step, ends_quoted = _steps(data, quoted)
        depths = depth + np.cumsum(step)
        ends = np.flatnonzero((step == -1) & (depths == 1) & (np.frombuffer(data, np.uint8) == ord("}"))) + 1
        last = 0
        for end in ends.tolist():
            text, last = rest + data[last:end], end
            rest = b""
            if open_:
                out.append((*now, count, "end", text))
                open_ = False
            else:
                out.append((*now, count, "whole", text.lstrip(_BETWEEN)))
                count += 1
        rest += data[last:]
        depth, quoted = int(depths[-1]), ends_quoted
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, text): the objects of JSON arrays as text, with their places from 0 in their file. A file that isn't one whole array, or
    holds anything but objects, raises ValueError. Objects are written once to the shared folder."""
    ranges = _ranges(spark, path)
    seen = ranges.mapInArrow(_summaries, "file string, start bigint, odd boolean, outside bigint, inside bigint").collect()  # a row for each range
    begins, state, last = {}, (False, 0), None
    for r in [*sorted(seen, key=lambda r: (r.file, r.start)), None]:
        if last is not None and (r is None or r.file != last) and state != (False, -1):
            raise ValueError(f"{last} isn't one JSON array")
        if r is None:
            break
        state = (False, 0) if r.file != last else state
        begins[r.file, r.start], last = state, r.file
        state = (state[0] ^ r.odd, state[1] + (r.inside if state[0] else r.outside))
    shared = spark.sparkContext.broadcast(begins)
    folder = stores.work_folder(spark, "objects")
    ranges.mapInArrow(lambda batches: _objects(batches, shared.value), "file string, start bigint, at bigint, kind string, text binary").write.parquet(folder)
    parts = spark.read.parquet(folder)
    wholes = parts.where("kind = 'whole'").select("file", "start", "at", "text")
    # at most two pieces for each range: from one that begins an object to the one that ends it
    order = Window.partitionBy("file").orderBy("start", F.col("kind") != "end")
    pieces = parts.where("kind <> 'whole'").withColumn("k", F.count_if(F.col("kind") == "begin").over(order)).groupBy("file", "k")
    pieces = pieces.agg(F.min_by(F.struct("start", "at"), F.struct(F.col("kind") != "begin", "start")).alias("x"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("t"))
    joined = pieces.select("file", "x.start", "x.at", F.expr("aggregate(t, x'', (a, b) -> a || b.text)").alias("text"))
    every = wholes.unionByName(joined)
    begun = parts.where("kind in ('whole', 'begin')").groupBy("file", "start").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = begun.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # a row for each range
    placed = every.join(F.broadcast(offsets), ["file", "start"]).select("file", (F.col("before") + F.col("at")).alias("at"), F.col("text").cast("string").alias("text"))
    odd = placed.where(~F.startswith("text", F.lit("{"))).first()
    if odd:
        raise ValueError(f"{odd.file} holds something else than objects before place {odd['at'] + 1}")
    return placed


def read_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """(_file, _at, the schema's fields) of arrays of objects; an object that the schema can't read raises."""
    found = read_objects(spark, path)
    return found.select(F.col("file").alias("_file"), F.col("at").alias("_at"), F.from_json("text", schema, {"mode": "FAILFAST"}).alias("_row")).select("_file", "_at", "_row.*")


def write_array(df: DataFrame, path: str) -> None:
    """One JSON array, indented by two, in the order of the frame's partitions, in any store that Spark writes to. Tasks write its parts; a
    last step joins them by the store's means, and the file takes its name when it is whole."""
    spark = df.sparkSession
    folder = f"{path}-parts-{stores.uuid.uuid4().hex}"

    def shown(batches):
        for whole in batches:
            for b in (whole.slice(k, SHOWN) for k in range(0, whole.num_rows, SHOWN)):
                rows = ["  " + json.dumps(json.loads(j), ensure_ascii=False, indent=2).replace("\n", "\n  ") + "," for j in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).mapInArrow(shown, "value string").write.text(folder)
    parts = [(p, n) for p, n in stores.listed(spark, folder) if n]
    if not parts:
        stores.remove(spark, folder)
    stores.joined(spark, parts, path, "[\n", "\n]\n", len(",\n"))
