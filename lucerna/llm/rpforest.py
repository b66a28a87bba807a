"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only where labels (and lengths) are equal. Copies are one class from then on. A label of at most `LEAF`
classes is one cell, so all its pairs are compared. In a larger one trees split at random directions again and again: a node's threshold
is the median of its sampled vectors' projections, and vectors within a margin of it go to both sides (spill). The margin is
`DEVIATIONS` standard deviations of how far a pair that just links lies apart along a random direction, so a split parts such a pair
once in some twenty times, and a label gets as many trees as its depth needs to miss one pair in `MISSED` by that reckoning.
Thresholds are fitted on at most about `SAMPLE` classes a round; leaves that stay larger than `LEAF` are split again in up to
`ROUNDS` rounds, each with a sample of its own, and every class is placed. A node whose margin would hold half of it (a tight group, which no
direction cuts) stays whole. Leaves that are too large after all that are dealt out as pairs of chunks, so all their pairs are
compared and no task holds more than two chunks.

Inside a leaf all pairs are verified by cosine in double precision. A pair that meets in several leaves counts in the first of them
(each class carries the list of its leaves), so links are counted without writing a pair; what is written is a count for each class
and a spanning forest of each leaf's links, whose union gives the components.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and one without a label, links with
nothing. Vectors without an id take part, and a component is named by its smallest id that is not null; repeated rows each get a
row and count as others; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil, erfc, exp, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop, few, list_column, short_batches, spool
from .simhash import nearest_forest

COSINE = 0.93
#: Classes of a cell that isn't split; classes that a round fits on; rounds; sampled classes that a split takes at least.
LEAF, SAMPLE, ROUNDS, FEWEST = 1024, 30_000, 4, 16
#: The margin in standard deviations of a just linked pair's difference along a direction; the share of a node in it at most.
DEVIATIONS, MOST = 0.8, 0.5
#: Of so many just linked pairs all trees may miss one; trees at least and at most.
MISSED, TREES = 500, (3, 16)
SEED = 13
#: Pairs whose lists of leaves are compared at once.
PAIRS_AT_ONCE = 1 << 15
#: The leaf of a label without trees.
WHOLE = -1


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of length one, in double precision; large and small components neither overflow nor vanish."""
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(tree: int, depth: int, dim: int) -> np.ndarray:
    """A unit vector for each level down to `depth`, as columns; a level's is the same whatever the depth."""
    rows = [np.random.default_rng([SEED, tree, k, dim]).standard_normal(dim) for k in range(depth)]
    return np.array([r / np.sqrt(r @ r) for r in rows]).reshape(depth, dim).T


def trees_for(count: int, leaf: int = LEAF) -> int:
    """How many trees a label of `count` classes gets. Along a direction a pair lies apart as a normal variable, and vectors have a
    density of at most 0.4 a standard deviation of theirs, which is about that of a pair at right angles (sqrt 2 from each other)."""
    spread = sqrt((2 - 2 * COSINE) / 2) * sqrt(2)  # of a pair, in standard deviations of the vectors
    beyond = exp(-(DEVIATIONS**2) / 2) / sqrt(2 * pi) - DEVIATIONS * erfc(DEVIATIONS / sqrt(2)) / 2
    kept = (1 - min(0.5, 0.4 * spread * 2 * beyond)) ** max(1, ceil(log2(max(2, 1.2 * count / leaf))))
    return min(TREES[1], max(TREES[0], ceil(log(MISSED) / -log(1 - kept)))) if kept < 1 else TREES[0]


class Forest:
    """Nodes as arrays: a split has its children at `left` and `left` + 1 and takes projections to `high` to the left and from
    `low` on to the right; a leaf has no children. roots: a node for each tree of a label and length."""

    def __init__(self, cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF):
        self.roots: dict[tuple[str, int], list[int]] = {}
        self.low, self.high, self.left, self.tree, self.level = [], [], [], [], []
        self.cosine, self.trees, self.leaf = cosine, trees, leaf

    def node(self, tree: int, level: int) -> int:
        for column, value in ((self.low, 0.0), (self.high, 0.0), (self.left, -1), (self.tree, tree), (self.level, level)):
            column.append(value)
        return len(self.left) - 1

    def plant(self, label: str, dim: int, x: np.ndarray, count: int) -> None:
        """Trees for a cell that has none, from sampled rows of it."""
        self.roots[label, dim] = [self.node(t, 0) for t in range(self.trees or trees_for(count, self.leaf))]
        for node in self.roots[label, dim]:
            self.grow(node, x, count)

    def grow(self, leaf: int, x: np.ndarray, count: int) -> None:
        """Splits a leaf of `count` rows, by sampled rows of it, until what is left should hold `self.leaf` rows at most."""
        dim = x.shape[1]
        margin = DEVIATIONS * sqrt(2 - 2 * self.cosine) / sqrt(dim) / 2
        todo = [(leaf, np.arange(len(x)), float(count))]
        while todo:
            node, rows, n = todo.pop()
            if n <= self.leaf or len(rows) < FEWEST:
                continue
            along = x[rows] @ directions(self.tree[node], self.level[node] + 1, dim)[:, -1]
            middle = float(np.median(along))
            if (np.abs(along - middle) <= margin).mean() > MOST:
                continue
            self.low[node], self.high[node] = middle - margin, middle + margin
            self.left[node] = self.node(self.tree[node], self.level[node] + 1)
            self.node(self.tree[node], self.level[node] + 1)
            sides = [rows[along <= self.high[node]], rows[along >= self.low[node]]]
            todo += [(self.left[node] + k, side, n * len(side) / len(rows)) for k, side in enumerate(sides)]

    def frozen(self) -> dict:
        return {"roots": self.roots, "low": np.array(self.low), "high": np.array(self.high), "left": np.array(self.left, np.int64), "depth": max(self.level, default=-1) + 1}


def leaves(forest: dict, label: str, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a row is in, by row."""
    if (label, dim) not in forest["roots"]:
        return np.arange(len(x)), np.full(len(x), WHOLE)
    found = []
    for tree, root in enumerate(forest["roots"][label, dim]):
        along = x @ directions(tree, forest["depth"], dim)
        row, node = np.arange(len(x)), np.full(len(x), root)
        level = 0
        while len(row):
            child = forest["left"][node]
            done = child < 0
            found.append((row[done], node[done]))
            row, node, child = row[~done], node[~done], child[~done]
            if len(row):
                p = along[row, level]
                both = [p <= forest["high"][node], p >= forest["low"][node]]
                row, node = np.concatenate([row[s] for s in both]), np.concatenate([child[s] + k for k, s in enumerate(both)])
                level += 1
    row, node = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort([node, row])
    return row[order], node[order]


def cells(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """(label, length, places) of a batch's rows, by its first two columns."""
    names: dict[tuple[str, int], list[int]] = {}
    for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        names.setdefault(key, []).append(k)
    for (label, dim), places in names.items():
        yield label, dim, np.array(places)


def vectors_at(column: pa.Array, places: np.ndarray, dim: int, kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.take(pa.array(places)).to_pylist()), kind), dim)


def placed(classes: DataFrame, forest: dict, kind: str) -> DataFrame:
    """A row for each class and leaf: label, dim, leaf, node, size, vec and, in order, all leaves of the class."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            for label, dim, places in cells(b):
                row, leaf = leaves(shared.value, label, dim, vectors_at(b.column(4), places, dim, kind))
                starts = np.searchsorted(row, np.arange(len(places)))
                sizes = np.bincount(row, minlength=len(places))[row]  # a class with k leaves has k rows, each with all k
                inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                whole = b.take(pa.array(places[row]))
                lists = list_column(leaf[np.repeat(starts[row], sizes) + inside].astype(np.int32), sizes, pa.int32())
                yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), pa.array(leaf.astype(np.int32)), whole.column(2), whole.column(3), whole.column(4), lists], ["label", "dim", "leaf", "node", "size", "vec", "leaves"])

    return classes.select("label", "dim", "node", "size", "vec").mapInArrow(run, "label string, dim int, leaf int, node bigint, size bigint, vec binary, leaves array<int>")


def leaf_sizes(classes: DataFrame, forest: dict, kind: str) -> DataFrame:
    """(label, dim, leaf, n): how many classes each leaf has, summed inside tasks first."""
    if not forest["roots"]:
        return classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.lit(WHOLE).alias("leaf"), "n")
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            for label, dim, places in cells(b):
                leaf, n = np.unique(leaves(shared.value, label, dim, vectors_at(b.column(4), places, dim, kind))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(n)), pa.array([dim] * len(n), pa.int32()), pa.array(leaf.astype(np.int32)), pa.array(n)], ["label", "dim", "leaf", "n"])

    counted = classes.select("label", "dim", "node", "size", "vec").mapInArrow(run, "label string, dim int, leaf int, n bigint")
    return counted.groupBy("label", "dim", "leaf").agg(F.sum("n").alias("n"))


def fit(classes: DataFrame, kind: str, cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[dict, DataFrame]:
    """The forest for classes (label, dim, node, size, vec), and the leaves (label, dim, leaf, n) that are still too large."""
    forest = Forest(cosine, trees, leaf)
    held = -1
    for k in range(rounds + 1):
        large = spool(leaf_sizes(classes, forest.frozen(), kind).where(F.col("n") > leaf), "large")
        total = large.agg(F.sum("n")).first()[0]
        if not total or total == held or k == rounds:  # nothing is too large, or the last round split nothing
            break
        held = total
        share = min(1.0, sample / total)
        at = placed(classes, forest.frozen(), kind) if k else classes.withColumn("leaf", F.lit(WHOLE))
        chosen = F.pmod(F.xxhash64("node", "leaf", F.lit(k)), F.lit(1 << 20)) < F.lit(ceil(share * (1 << 20)))
        rows = at.where(chosen).join(few(large), ["label", "dim", "leaf"]).select("label", "dim", "leaf", "n", "node", "vec").toPandas()
        drop(large)
        for (label, dim, node), part in sorted(rows.groupby(["label", "dim", "leaf"])):
            part = part.sort_values("node")
            x = unit(np.frombuffer(b"".join(map(bytes, part.vec)), kind), dim)
            if node == WHOLE:
                forest.plant(label, dim, x, int(part.n.iloc[0]))
            else:
                forest.grow(int(node), x, int(part.n.iloc[0]))
    return forest.frozen(), large


def first_met(mine: np.ndarray, theirs: np.ndarray, leaf: int) -> np.ndarray:
    """Whether `leaf` is the first leaf that two classes share, for each pair of rows of padded lists of leaves."""
    earlier = (mine[:, :, None] == theirs[:, None, :]) & (mine[:, :, None] < leaf) & (mine[:, :, None] > WHOLE)
    return ~earlier.any(axis=(1, 2))


def leaf_links(x: np.ndarray, size: np.ndarray, side: np.ndarray, two: bool, lists: np.ndarray, leaf: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one leaf, or two chunks of it: how many vectors each row links with that are met here first, and a forest (a, b) of its
    links. side: the chunk of each row; where two chunks meet, only pairs across them count."""
    left = np.flatnonzero(side == 0) if two else np.arange(len(x))
    right = np.flatnonzero(side == 1) if two else left
    counts = np.zeros(len(x), np.int64)
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(left), 256):
        near = x[left[at : at + 256]] @ x[right].T
        a, b = np.nonzero(near >= cosine)
        if not two:
            a, b = a[a + at < b], b[a + at < b]
        weight = 1 - near[a, b]
        a, b = left[a + at], right[b]
        links.append((a, b, weight))
        for k in range(0, len(a), PAIRS_AT_ONCE):
            i, j = a[k : k + PAIRS_AT_ONCE], b[k : k + PAIRS_AT_ONCE]
            new = first_met(lists[i], lists[j], leaf)
            np.add.at(counts, i[new], size[j[new]])
            np.add.at(counts, j[new], size[i[new]])
    a, b, weight = (np.concatenate(c) for c in zip(*links))
    chosen = nearest_forest(len(x), a, b, weight)
    return counts, a[chosen], b[chosen]


def links(at: DataFrame, large: DataFrame, kind: str, cosine: float = COSINE, chunk: int = LEAF) -> DataFrame:
    """(a, b, n) from placed classes: forest edges a - b, and with null b the vectors n that a links with. large: the sizes n of the
    leaves of more than `chunk` classes."""
    cell = ["label", "dim", "leaf"]
    m = F.coalesce(F.ceil(F.col("n") / (chunk // 2)), F.lit(1)).cast("int")
    dealt = at.join(few(large), cell, "left").withColumn("m", m).withColumn("s", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    ways = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least("s", j).alias("i"), F.greatest("s", j).alias("j"), (F.col("s") > j).cast("int").alias("side")))
    key = [*cell, "i", "j"]
    rows = dealt.withColumn("way", F.explode(ways)).select(*cell, "way.i", "way.j", "way.side", "node", "size", "vec", "leaves")
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def group(table: pa.Table) -> pa.RecordBatch:
        dim, leaf = table["dim"][0].as_py(), table["leaf"][0].as_py()
        x = unit(np.frombuffer(b"".join(table["vec"].to_pylist()), kind), dim)
        node, size, side = (table[c].to_numpy() for c in ("node", "size", "side"))
        every = table["leaves"].combine_chunks()
        sizes = every.value_lengths().to_numpy()
        lists = np.full((len(x), int(sizes.max())), WHOLE, np.int32)
        lists[np.arange(lists.shape[1]) < sizes[:, None]] = every.flatten().to_numpy()
        counts, a, b = leaf_links(x, size, side, table["i"][0].as_py() != table["j"][0].as_py(), lists, leaf, cosine)
        some = np.flatnonzero(counts)
        out = [pa.array(np.concatenate([node[a], node[some]])), pa.concat_arrays([pa.array(node[b]), pa.nulls(len(some), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(counts[some])])]
        return pa.RecordBatch.from_arrays(out, ["a", "b", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in range(5)]))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in pairwise(edges if keys else []):
                if held and keys[lo] != last:
                    yield group(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = keys[lo]
        if held:
            yield group(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, trees: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    short_batches(df.sparkSession)
    vector = F.col(vector_col)
    single = df.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    good = F.col(label_col).isNotNull() & vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(vector, lambda x: x != 0)
    takes = F.coalesce(good, F.lit(False))
    # two hashes tell classes apart; rows that take no part have a null one
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"), takes.alias("takes"))
    keyed = rows.withColumn("k1", F.when(F.col("takes"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("takes"), F.xxhash64(F.lit(SEED), "v", "label")))

    def packed(batches):
        for b in batches:
            v = b.column(3)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
            raw = pa.array([flat[lo:hi].tobytes() for lo, hi in pairwise(ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int32)), raw], ["k1", "k2", "label", "dim", "vec"])

    ids = spool(keyed.select("id", "k1", "k2"), "ids")
    vectors = keyed.where("takes").select("k1", "k2", "label", "v").mapInArrow(packed, "k1 bigint, k2 bigint, label string, dim int, vec binary")
    classes = vectors.groupBy("k1", "k2").agg(F.count("*").alias("size"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"))
    classes = spool(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    forest, large = fit(classes, kind, cosine, trees, leaf, sample, rounds)
    found = spool(links(placed(classes, forest, kind), large, kind, cosine, leaf), "links")
    stars = spool(connected_components(found.where("b is not null").select("a", "b")), "stars")
    counted = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    names = classes.select("k1", "k2", "node", "size").join(stars, "node", "left").join(counted, "node", "left")
    names = spool(names.select("k1", "k2", F.coalesce("root", "node").alias("root"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "names")
    least = ids.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"))
    roots = names.join(least, ["k1", "k2"]).groupBy("root").agg(F.min("least").alias("component_id"))
    named = spool(names.join(roots, "root").select("k1", "k2", "n_links", "component_id"), "named")
    drop(classes, large, found, stars, names)
    out = ids.join(named, ["k1", "k2"], "left")
    alone = F.col("k1").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
