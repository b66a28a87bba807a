"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `window` words (an item of fewer words is one window). A window is a set of
five-word shingles; a document holds the window only if it holds all of them, so one shingle, its necessary
prefix for containment 1, finds every occurrence. The rarest one, by document frequency over the whole corpus, is
taken. A hit of the prefix must leave room for the rest of the window (length and position bounds), and then all
the window's shingles are compared in place, which is exact: shingles are numbered by their words, not hashed.

The scan keeps, per document, only positions of benchmark shingles. The benchmark is looked up in blocks of at
most `BLOCK_WORDS` words, each broadcast in turn. Where it has more than one block, a first scan keeps the texts that hold a window, by the
64-bit hashes of all windows (`HASHES` of them broadcast at a time), and the blocks are looked up in those texts alone; so the corpus is
read once for every `HASHES` windows, not for every block.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no windows;
repeated document rows each get a row; an item without an id goes by the name None; repeated windows, and items repeated under other ids, all count; an
empty benchmark leaves all documents clean; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_column, raw, short_batches, sliced, spool, unused

WINDOW, SHINGLE = 13, 5
#: Words of benchmark text in one broadcast block.
BLOCK_WORDS = 250_000
#: Hashes of windows in one broadcast.
HASHES = 8_000_000
#: Bytes that are not digits, a-z or part of a non-ASCII character separate words.
SEPARATE = bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in range(256))
EDGE = b"\xff"  # never part of UTF-8


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(SEPARATE).split()


class Shingles:
    """Numbers for shingles by a trie over word numbers; look-ups are exact and run over whole arrays."""

    def __init__(self, runs: list[list[bytes]], size: int):
        self.size = size
        self.words: dict[bytes, int] = {}
        for run in runs:
            for w in run:
                self.words.setdefault(w, len(self.words) + 1)
        self.base = len(self.words) + 1
        numbers = [np.array([self.words[w] for w in run], np.int64) for run in runs]
        node = [np.zeros(len(x), np.int64) for x in numbers]
        self.levels = []
        for d in range(size):  # a run shorter than `size` ends in an inner node of its own length
            keys = np.unique(np.concatenate([n[: max(0, len(x) - d)] * self.base + x[d:] for n, x in zip(node, numbers)] or [np.zeros(0, np.int64)]))
            self.levels.append(keys)
            node = [np.searchsorted(keys, n[: max(0, len(x) - d)] * self.base + x[d:]) for n, x in zip(node, numbers)]
        sizes = np.cumsum([0, *map(len, self.levels)])
        self.start = sizes[:-1]
        self.count = int(sizes[-1])

    def find(self, numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a run of `depth` words is known, and its shingle number."""
        at = np.flatnonzero(numbers > 0)
        at = at[at + depth <= len(numbers)]
        node = np.zeros(len(at), np.int64)
        for d in range(depth):
            keys, want = self.levels[d], node * self.base + numbers[at + d]
            if not len(keys):
                return at[:0], at[:0]
            k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            good = (keys[k] == want) & (numbers[at + d] > 0)
            at, node = at[good], k[good]
        return at, node + self.start[depth - 1]


def benchmark_windows(items: list[tuple[object, bytes]], window: int, size: int):
    """The windows of a block of items: their shingle tables, distinct windows and the items of each.

    Windows: per distinct window (words, shingle numbers by place); a window of fewer than `size` words is
    one shingle of its own length.
    """
    runs = [(i, w) for i, text in items if (w := words(text))]
    table = Shingles([w for _, w in runs], size)
    found: dict[tuple[int, ...], tuple[int, set]] = {}
    for i, w in runs:
        numbers = np.array([table.words[x] for x in w], np.int64)
        n = min(window, len(w))
        depth = min(size, n)
        at, node = table.find(numbers, depth)
        node = node[np.argsort(at)]
        for s in range(len(w) - n + 1):
            found.setdefault(tuple(node[s : s + n - depth + 1].tolist()), (n, set()))[1].add(i)
    depths = sorted({min(size, n) for n, _ in found.values()}, reverse=True)
    return table, found, depths


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """Blocks of items with at most about `limit` words each, fetched by partition."""
    block, held = [], 0
    for i, text in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        text = (text or "").encode()
        block.append((i, text))
        held += len(words(text))
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def window_hashes(texts: list[bytes], lengths: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """The words of each text, hashes by length of the runs of words that begin at each place, each place's text and its words left."""
    known: dict[bytes, int] = {}
    flat, sizes = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        w = words(t)
        sizes[k] = len(w)
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh64_intdigest(x)
        flat += [known[x] for x in w]
    h = np.array(flat, np.uint64)
    of = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))
    out, run = {}, np.zeros(len(h), np.uint64)
    for d in range(max(lengths, default=0)):
        run = run * np.uint64(0x9E3779B97F4A7C15)
        run[: len(h) - d] += h[d:]
        if d + 1 in lengths:
            out[d + 1] = run.copy()
    return sizes, out, of, left


def holding(source: DataFrame, benchmark: DataFrame, item_col: str, window: int, kind: str, hashes: int) -> DataFrame:
    """(doc_id, text, row, n_words) of every document; text only where a window occurs (or, by chance, one's hash)."""
    spark = source.sparkSession

    def cut(batches):
        for b in sliced(batches, 0):
            texts = raw(b.column(0))
            sizes, found, of, left = window_hashes(texts, list(range(1, window + 1)))
            n, h = [], []
            for d, values in found.items():
                at = (left >= d) & (np.minimum(sizes[of], window) == d)
                n.append(np.full(int(at.sum()), d))
                h.append(values[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(n), pa.int32()), pa.array(np.concatenate(h), pa.int64())], ["n", "h"])

    every = spool(benchmark.select(F.col(item_col)).mapInArrow(cut, "n int, h bigint").distinct(), "windows")
    slices = max(1, -(-every.count() // hashes))
    marked = None
    for k in range(slices):
        part = every.where(F.pmod(F.xxhash64("h"), F.lit(slices)) == k).toArrow()  # at most about `hashes` rows
        n, h = part.column("n").to_numpy(), part.column("h").to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast({int(d): np.sort(h[n == d]) for d in np.unique(n)})

        def look(batches, shared=shared):
            for b in sliced(batches, 1):
                texts = raw(b.column(1))
                sizes, found, of, left = window_hashes(texts, list(shared.value))
                hit = np.zeros(len(texts), bool)
                for d, values in found.items():
                    held = shared.value[d]
                    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
                    hit[of[(held[at] == values) & (left >= d)]] = True
                text = pc.if_else(pa.array(hit), b.column(1), pa.scalar(None, b.column(1).type))
                yield pa.RecordBatch.from_arrays([b.column(0), text, b.column(2), pa.array(sizes, pa.int64())], ["doc_id", "text", "row", "n_words"])

        found = source.mapInArrow(look, f"doc_id {kind}, text string, row bigint, n_words bigint")
        marked = found if marked is None else marked.union(found)
    if slices > 1:  # a document's scans meet; repeated rows stay as many
        marked = marked.groupBy("doc_id", "row", "n_words").agg(F.max("text").alias("text"), F.count("*").alias("n"))
        marked = marked.withColumn("copy", F.explode(F.array_repeat(F.lit(0), (F.col("n") / slices).cast("int"))))
    return spool(marked.select("doc_id", "text", "row", "n_words"), "holding")


def text_key(text: Column) -> Column:
    """With the id, what tells rows of one id apart: rows with the same key have the same text and so the same result."""
    return F.xxhash64(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, size: int = SHINGLE, block_words: int = BLOCK_WORDS, hashes: int = HASHES) -> DataFrame:
    """Per document row: doc_id, row (`text_key` of its text), n_words, spans (word ranges inside an occurring window, merged, as
    array<struct<start,end>>), n_hit and items (ids of items with occurring windows, as sorted strings)."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, n_words bigint, starts array<int>, ends array<int>, items array<string>"
    out = f"doc_id {kind}, row bigint, n_words bigint, spans array<struct<start:int,end:int>>, n_hit bigint, items array<string>"
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("row"))
    blocks = blocks_of(benchmark, item_col, item_text_col, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:  # merged where it is verified: of two steps in a row each task would hold two Python workers
        return _block(source, first, window, size, out, kind, _merge)
    marked = holding(source, benchmark, item_text_col, window, kind, hashes)
    none = [F.array().cast(t).alias(c) for c, t in (("starts", "array<int>"), ("ends", "array<int>"), ("items", "array<string>"))]
    clean = marked.where("text is null").select("doc_id", "row", "n_words", *none)
    source = marked.where("text is not null").select("doc_id", "text", "row")
    parts = [_block(source, block, window, size, schema, kind) for block in (first, second, *blocks)]
    merged = parts[0]  # a document's hits meet by its id and its text's hash; repeated rows stay as many
    for p in parts[1:]:
        merged = merged.union(p)
    lists = [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("spans_", "items")]
    merged = merged.withColumn("spans_", F.arrays_zip("starts", "ends")).groupBy("doc_id", "row", "n_words").agg(*lists, F.count("*").alias("n"))
    merged = merged.withColumn("copy", F.explode(F.array_repeat(F.lit(0), (F.col("n") / len(parts)).cast("int"))))
    merged = merged.select("doc_id", "row", "n_words", F.col("spans_.starts").alias("starts"), F.col("spans_.ends").alias("ends"), "items")
    return merged.unionByName(clean).mapInArrow(_merge, out)


def _block(source: DataFrame, items: list, window: int, size: int, schema: str, kind: str, then: Callable = iter) -> DataFrame:
    """The hits of a block's windows, one row for each of the source's; `then` goes over the batches in the same task."""
    spark = source.sparkSession
    table, windows, depths = benchmark_windows(items, window, size)
    used = np.zeros(table.count + 1, bool)
    used[[x for nodes in windows for x in nodes]] = True
    shared = spark.sparkContext.broadcast((table, depths, used))

    def scan(batches):
        table, depths, used = shared.value
        number = table.words.get
        for b in sliced(batches, 1):
            texts = raw(b.column(1))
            flat = (b" \xff ".join(t.lower() for t in texts) + b" \xff").translate(SEPARATE).split()
            numbers = np.fromiter(map(number, flat, repeat(0)), np.int64, len(flat))
            edges = np.flatnonzero(np.fromiter(map(EDGE.__eq__, flat), bool, len(flat)))
            starts = np.concatenate([[0], edges[:-1] + 1])
            found = [table.find(numbers, d) for d in depths]
            at = np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)])
            node = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
            order = np.argsort(at, kind="stable")
            at, node = at[order[used[node[order]]]], node[order[used[node[order]]]]
            doc = np.searchsorted(edges, at)
            sizes = np.bincount(doc, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(edges - starts, pa.int64()), list_column(at - starts[doc] if len(at) else at, sizes, pa.int32()), list_column(node, sizes, pa.int32())], ["doc_id", "row", "n_words", "at", "node"])

    matches = spool(source.mapInArrow(scan, f"doc_id {kind}, row bigint, n_words bigint, at array<int>, node array<int>"), "matches")
    seen = matches.select(F.explode(F.array_distinct("node")).alias("node")).groupBy("node").count()
    rarity = np.zeros(max(1, table.count), np.int64)
    for node, n in seen.collect():  # at most one row for each shingle of the block
        rarity[node] = n
    prefix: dict[int, list[tuple[int, int]]] = {}
    listed = [(np.array(nodes, np.int64), n, sorted(map(str, ids))) for nodes, (n, ids) in windows.items()]
    for k, (nodes, n, _) in enumerate(listed):
        p = int(np.argmin(rarity[nodes]))
        prefix.setdefault(int(nodes[p]), []).append((p, k))
    leads = np.zeros(table.count + 1, bool)
    leads[[*prefix]] = True
    index = spark.sparkContext.broadcast((prefix, listed, leads))

    def verify(batches):
        prefix, listed, leads = index.value
        for b in batches:
            starts, ends, names = [], [], []
            for n_words, at, node in zip(b.column(2).to_pylist(), b.column(3), b.column(4)):
                s, e, got = [], [], set()
                if len(at):
                    at, node = at.values.to_numpy(), node.values.to_numpy()
                    for j in np.flatnonzero(leads[node]):
                        for p, k in prefix[int(node[j])]:
                            nodes, n, ids = listed[k]
                            first = int(at[j]) - p
                            if first < 0 or first + n > n_words:
                                continue
                            if len(nodes) > 1:  # one shingle of full depth stands at a position; all must follow on
                                full = j - p
                                if full < 0 or full + len(nodes) > len(node) or not (np.array_equal(node[full : full + len(nodes)], nodes) and at[full] == first and at[full + len(nodes) - 1] == first + len(nodes) - 1):
                                    # shorter items' shingles may stand between: compare by position
                                    near = (at >= first) & (at < first + len(nodes)) & (node >= nodes.min()) & (node <= nodes.max())
                                    pairs = set(zip(at[near].tolist(), node[near].tolist()))
                                    if not all((first + i, int(x)) in pairs for i, x in enumerate(nodes)):
                                        continue
                            s.append(first)
                            e.append(first + n)
                            got.update(ids)
                starts.append(s)
                ends.append(e)
                names.append(sorted(got))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "starts", "ends", "items"])

    return matches.mapInArrow(lambda batches: then(verify(batches)), schema)


def _merge(batches):
    """Hit ranges of each row merged, and the items' ids sorted."""
    for b in batches:
        spans, hits, items = [], [], []
        for s, e, names in zip(b.column(b.schema.get_field_index("starts")).to_pylist(), b.column(b.schema.get_field_index("ends")).to_pylist(), b.column(b.schema.get_field_index("items")).to_pylist()):
            out: list[list[int]] = []
            for x, y in sorted(zip(s, e)):
                if out and x <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], y)
                else:
                    out.append([x, y])
            spans.append([{"start": x, "end": y} for x, y in out])
            hits.append(sum(y - x for x, y in out))
            items.append(sorted(set(names)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("row")), b.column(b.schema.get_field_index("n_words")), pa.array(spans, kind), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "spans", "n_hit", "items"])


def contaminated() -> Column:
    """The verdict on a row of `decontaminate`: a twentieth of its words, and at least one, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that aren't contaminated; rows that share an id, or have none, are judged each by its own text."""
    found = decontaminate(docs, benchmark, id_col, text_col)
    key, row = unused(docs, "bad"), unused(docs, "bad_row")
    bad = spool(found.where(contaminated()).select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct(), "bad")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(key)) & (text_key(F.col(text_col)) == F.col(row)), "left_anti")


def report(found: DataFrame) -> DataFrame:
    """The digest of `decontaminate`: counts, a checksum of the items and the verdict."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
