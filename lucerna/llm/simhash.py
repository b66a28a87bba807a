"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints come from XXH64 of word shingles. Equal fingerprints are one from then on. With the bits cut into
`blocks` blocks, two fingerprints within `distance` bits agree on all but `distance` of the blocks, so each distinct
fingerprint goes to one group for every choice of blocks - distance of them. More blocks give longer keys and
more groups; their number follows the count of fingerprints, so that groups stay near a chunk in size at any count
(5 blocks, 13 bits and 5 groups each up to a million or so; 6 blocks, 21 bits and 15 groups each up to some hundred
millions; and so on). Every such number finds every link. Inside a group an index finds the links: fingerprints in order of Gray rank are cut into leaves, a node
keeps the mask and the values of the bits that all its fingerprints share, and a query adds up differences
from node to node (only bits that the parent didn't cover yet), dropping a whole node once they exceed the
distance. A group of more than `CHUNK` is cut again by longer keys: the bits outside its key are cut into distance + 1 parts, and
two fingerprints within the distance agree on one of them, so a member goes to that many smaller groups, up to `LEVELS` times.
Only what is still too large then is dealt out as pairs of chunks, so no task holds more than two
chunks, and a group gives a forest of its links, the nearest ones, not all its pairs. Components then join the forests.

`distinct_texts` is the filter on texts: one of each group whose sets of five-word shingles are linked by a Jaccard similarity of 0.8 or
more. Fingerprints of the sets within `distance` bits are candidates from the index. The links beyond come from a prefix-filtered join,
which loses none: with all shingles in one order, two sets that similar share one of the first n - ceil(0.8 n) + 1 of each. The order
puts the shingles that are frequent last. Candidates are judged by the length of their sets and by a bound on how many shingles only
one of them has, taken from parities of hashed shingles, and then by their texts.

Defined results: a null, empty or wordless text has fingerprint zero and links like any other; null ids
take part, and a component is named by its smallest id that is not null (null if it has none); repeated rows each
get a row; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, connected_components, drop, few, list_column, raw, short_batches, sliced, spool, unused

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: Fingerprints in a chunk of a group, in a leaf, and children of a node; and how often a large group is cut by longer keys.
CHUNK, LEAF, LEVELS = 512, 8, 3
#: The filter on texts: words of a shingle, least similarity.
SIMILAR_WORDS, SIMILAR = 5, 0.8
#: Shingles with a hash below `COUNTED` come first in the order and are counted; those in `FREQUENT` rows or more, up to the `LISTED` most
#: frequent, go behind them. Bits of the parities.
COUNTED, FREQUENT, LISTED, PARITIES = 1 << 62, 64, 500_000, 512
#: Pairs that a task remembers.
SEEN = 500_000
#: Shingles hashed before their bits are counted.
COUNT_AT_ONCE = 1 << 15


def shingle_hashes(text: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle in order, repeats included, in bounded arrays; none for a wordless text."""
    parts = text.lower().split()
    if not parts:
        return
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(size, len(parts)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, COUNT_AT_ONCE):
        yield np.array([hashed(flat[a:b], seed) for a, b in zip(starts[at : at + COUNT_AT_ONCE], stops[at : at + COUNT_AT_ONCE])], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits set in over half of all hashes."""
    total, n = np.zeros(BITS, np.int64), 0
    for h in parts:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, size, seed))


def shingle_set(text: bytes, size: int = SIMILAR_WORDS, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending: a line repeated through a text counts once."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, shingle_hashes(text, size, seed))]))


def set_fingerprint(found: np.ndarray) -> int:
    return majority(found[k : k + COUNT_AT_ONCE] for k in range(0, len(found), COUNT_AT_ONCE))


def parities(found: np.ndarray, places: int = PARITIES) -> np.ndarray:
    """Whether an odd number of hashes falls on each place, as longs. Two sets differ in at least as many hashes as parities."""
    odd = np.bincount((found % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_parities(found: np.ndarray) -> np.ndarray:
    """Parities on a place for each hash at least (a power of two), so that they tell long sets apart too; folding both halves into one gives
    those of half the places."""
    return parities(found, max(PARITIES, 1 << (len(found) - 1).bit_length()) if len(found) else PARITIES)


def prefix(found: np.ndarray, frequent: np.ndarray, level: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(least n) + 1 hashes of a set in the order: those below `COUNTED` that aren't frequent, and then frequent ones by
    level and all others. frequent: ascending."""
    n = len(found)
    if not n:
        return found, found
    counted = found[: np.searchsorted(found, np.uint64(COUNTED))]
    place = np.searchsorted(frequent, counted)
    place[place == len(frequent)] = 0
    often = frequent[place] == counted if len(frequent) else np.zeros(len(counted), bool)
    late = counted[often]
    late = late[np.lexsort([late, level[place[often]]])] if len(late) else late
    most = n - ceil(least * n - 1e-9) + 1
    rare = counted[~often][:most]
    return rare, np.concatenate([late, found[len(counted) :]])[: most - len(rare)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    short_batches(df.sparkSession)

    def run(batches):
        for b in sliced(batches, 1):
            fp = np.array([fingerprint(t, size, seed) for t in raw(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, fp bigint")


# ---- the index of a group ----


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order, leaves first; each node with the bits that its
    fingerprints share (mask) and their values, less what its parent has."""

    def __init__(self, values: np.ndarray, leaf: int = LEAF):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = v = values[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        ones, zeros = v, ~v
        cuts = np.arange(0, len(v), leaf)
        while len(v):
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones | zeros, ones, cuts))
            if len(cuts) == 1:
                break
            cuts = np.arange(0, len(cuts), leaf)
        covered = [m for m, _, _ in self.levels]
        self.own = []
        for k, (mask, _, _) in enumerate(self.levels):  # bits a node has beyond its parent
            above = covered[k + 1][np.arange(len(mask)) // leaf] if k + 1 < len(self.levels) else np.zeros(len(mask), np.uint64)
            self.own.append(mask & ~above)
        self.last = every & ~covered[0][np.arange(len(values)) // leaf] if len(values) else covered
        self.leaf = leaf

    def within(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in `values` as given) at most `distance` bits apart."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        spent = np.zeros(len(queries), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            _, pattern, _ = self.levels[k]
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & self.own[k][node])
            keep = spent <= distance
            q, node, spent = q[keep], node[keep], spent[keep]
            below = len(self.levels[k - 1][0]) if k else len(self.values)
            child = node[:, None] * self.leaf + np.arange(self.leaf)
            real = child < below
            q, spent, node = np.repeat(q, self.leaf)[real.ravel()], np.repeat(spent, self.leaf)[real.ravel()], child[real]
        near = spent + np.bitwise_count((queries[q] ^ self.values[node]) & self.last[node]) <= distance
        return q[near], self.order[node[near]]


def forest(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The root of each of `values` (a place in it) under links left[i] - right[i]."""
    root = np.arange(len(values))
    while True:
        was = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(was, root):
            return root


def nearest_forest(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest of least weight over n values: in each round every tree takes its nearest link."""
    order = np.argsort(weight, kind="stable")
    a, b = left[order], right[order]
    root, taken, m = np.arange(n), [], len(order)
    while True:
        live = np.flatnonzero(root[a] != root[b])
        if not len(live):
            return order[np.concatenate(taken)] if taken else order[:0]
        first = np.full(n, m)
        np.minimum.at(first, root[a[live]], live)
        np.minimum.at(first, root[b[live]], live)
        chosen = np.unique(first[first < m])
        taken.append(chosen)
        root = root[forest(root, root[a[chosen]], root[b[chosen]])[root]]


def group_links(values: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) of the links of one group, nearest ones first. side: of which chunk each is, where two chunks meet."""
    two = side.any() and not side.all()
    asked = np.flatnonzero(side == 0) if two else np.arange(len(values))
    held = np.flatnonzero(side == 1) if two else asked
    q, at = GrayIndex(values[held]).within(values[asked], distance)
    a, b = asked[q], held[at]
    keep = a < b if not two else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    apart = np.bitwise_count(values[a] ^ values[b]).astype(np.int64)
    chosen = nearest_forest(len(values), a, b, apart)
    return values[a[chosen]], values[b[chosen]]


def signed(mask: int) -> int:
    return mask - (1 << BITS) * (mask >> BITS - 1)


def parted(bits: list[int], parts: int) -> list[int]:
    """Masks of the bits cut into parts."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << x for x in bits[edges[k] : edges[k + 1]]) for k in range(parts)]


def masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of every choice of blocks - distance of the blocks."""
    return [sum(x) for x in combinations(parted(list(range(BITS)), blocks), blocks - distance)]


def longer(mask: int, distance: int) -> list[int]:
    """Masks beyond `mask` of which two fingerprints that agree on it and are within the distance agree on one at least."""
    rest = [k for k in range(BITS) if not mask >> k & 1]
    return [mask | x for x in parted(rest, distance + 1)] if len(rest) > distance else []


def blocks_for(count: int, distance: int, chunk: int) -> int:
    """The least number of blocks whose keys are long enough to spread `count` fingerprints into groups below `chunk`."""
    blocks = distance + 1
    while blocks < 2 * distance and count >> BITS * (blocks - distance) // blocks >= chunk // 2:
        blocks += 1
    return blocks


def grouped(rows: DataFrame, first: list[int], further, chunk: int, levels: int) -> DataFrame:
    """rows (fp, ...) in their groups: block, key, i, j and side beside the rows' columns.

    first: the masks of the first keys; further(mask): longer masks for a group that is too large. Groups that are too large after
    `levels` cuts are dealt out as pairs of chunks.
    """
    names, done, top = rows.columns, None, 0
    keyed = lambda df, options: df.select(*names, F.explode(options).alias("k")).select(*names, "k.block", "k.key")
    keys = lambda ids, values: F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in zip(ids, values)])
    now, known = keyed(rows, keys(range(len(first)), first)), dict(enumerate(first))
    for level in range(levels + 1):
        large = spool(now.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "groups")
        dealt = now.join(large, ["block", "key"], "left")
        hot = [r.block for r in large.select("block").distinct().collect()]  # at most a row for each mask
        options = {b: further(known[b]) for b in hot}
        if not hot or level == levels or not all(options.values()):
            m = F.coalesce(F.ceil(F.col("n") / (chunk // 2)), F.lit(1)).cast("int")
            dealt = dealt.withColumn("m", m).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
            pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least(F.col("s"), j).alias("i"), F.greatest(F.col("s"), j).alias("j"), (F.col("s") > j).cast("int").alias("side")))
            part = dealt.select("block", "key", *names, F.explode(pairs).alias("p")).select("block", "key", "p.i", "p.j", "p.side", *names)
            return done.unionByName(part) if done is not None else part
        small = dealt.where("n is null").select("block", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *names)
        done = small if done is None else done.unionByName(small)
        top, choice, known = max(known) + 1, None, {}
        for b in hot:
            ids = range(top, top := top + len(options[b]))
            known |= zip(ids, options[b])
            choice = F.when(F.col("block") == b, keys(ids, options[b])) if choice is None else choice.when(F.col("block") == b, keys(ids, options[b]))
        now = keyed(dealt.where("n is not null"), choice)


def links(distinct: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK, blocks: int | None = None, levels: int = LEVELS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose closure has every link within `distance`."""
    blocks = blocks or blocks_for(distinct.count(), distance, chunk)
    return _linked(grouped(distinct.select("fp"), masks(distance, blocks), lambda m: longer(m, distance), chunk, levels), distance)


def _linked(dealt: DataFrame, distance: int) -> DataFrame:
    dealt = dealt.repartition("block", "key", "i", "j").sortWithinPartitions("block", "key", "i", "j")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            cols = [c.to_numpy() for c in table.columns]
            if not len(cols[0]):
                return None
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            a, b = [], []
            values, side = cols[5].view(np.uint64), cols[4]
            for lo, hi in zip([0, *new], [*new, len(values)]):
                if hi - lo > 1:
                    x, y = group_links(values[lo:hi], side[lo:hi], distance)
                    a.append(x)
                    b.append(y)
            flat = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["a", "b"])

        for batch in batches:  # the rows of one group may go on in the next batch
            if not batch.num_rows:
                continue
            held.append(batch)
            cols = [batch.column(c).to_numpy() for c in range(4)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
            if len(new):
                last = int(new[-1]) + 1
                yield done(pa.Table.from_batches([*held[:-1], batch.slice(0, last)]))
                held = [batch.slice(last)]
            # a group has at most two chunks, so what is held stays small
        if held:
            yield done(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for rows of (doc_id, fp): component_id is the smallest id reachable by links."""
    prints = spool(prints, "prints")
    distinct = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = spool(connected_components(links(distinct, distance)), "stars")
    named = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = spool(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    names = spool(named.select("fp", "root").join(roots, "root").select("fp", "component_id"), "names")
    drop(distinct, stars, roots)
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


# ---- texts ----


def shingles(text: bytes, size: int = SIMILAR_WORDS) -> set[tuple[bytes, ...]]:
    parts = text.lower().split()
    return set(zip(*(parts[k:] for k in range(min(size, len(parts))))))


def similar(left: bytes, right: bytes) -> float:
    """Jaccard similarity of the sets of five-word shingles (fewer words: of the whole sequence); of wordless texts 1."""
    a, b = shingles(left), shingles(right)
    return len(a & b) / len(a | b) if a or b else 1.0


def text_key(text: Column) -> Column:
    """With the id, what tells rows apart; texts that differ have different keys, but for chance of one in 2^64 a pair."""
    return F.xxhash64(text)


def frequent_shingles(texts: DataFrame, least: int = FREQUENT, most: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """The shingles below `COUNTED` that are in `least` rows or more, at most the `most` frequent of them, ascending, and the binary
    logarithm of their rows. All rows are counted; the list bears on the order alone, never on the result."""

    def run(batches):
        for b in sliced(batches, 0):
            found = [shingle_set(t) for t in raw(b.column(0))]
            token, n = np.unique(np.concatenate([f[: np.searchsorted(f, np.uint64(COUNTED))] for f in found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    counted = texts.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counted.orderBy(F.col("n").desc(), "token").limit(most).toPandas()
    token = found.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(found.n.to_numpy(np.int64)[order]).astype(np.int64)


def _judged(pairs: DataFrame, classes: DataFrame, source: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose texts have the similarity: first by bounds from sizes and parities, then by the texts."""

    def judge(batches):
        for b in sliced(batches, 2):
            same = [similar(x, y) >= least for x, y in zip(raw(b.column(2)), raw(b.column(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}"))
    size = F.least(F.size("wide_a"), F.size("wide_b"))  # sets of like size have as many places, or twice as many
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.when(F.size(x) == size, F.col(x)).otherwise(F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), xor))
    differ = F.aggregate(F.zip_with(fold("wide_a"), fold("wide_b"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda x, y: x + y)
    both = F.col("n_a") + F.col("n_b")
    near = (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-6) & (differ <= both * ((1 - least) / (1 + least)) + 1e-6)
    close = spool(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"), "close")
    asked = spool(close.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes, "c").select("c", F.col("of.id").alias("of_id"), F.col("of.key").alias("of_key")), "asked")
    found = source.join(few(asked), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))).select("c", "text")
    texts = spool(found.groupBy("c").agg(F.min("text").alias("text")), "texts")
    left, right = texts.select(F.col("c").alias("a"), F.col("text").alias("x")), texts.select(F.col("c").alias("b"), F.col("text").alias("y"))
    linked = spool(close.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint"), "links")
    drop(close, asked, texts)
    return linked


def _telling(roots: DataFrame) -> DataFrame:
    """(token, least): of the tokens with classes of several roots one for each set of classes, as tokens of one set give the same pairs. Sets are told
    apart by their size and 128 bits of hashes. least: the smallest class. roots: (token, c, root), each once."""
    mixed = [F.bit_xor(F.xxhash64("c", F.lit(k))).alias(f"x{k}") for k in range(2)]
    sets = roots.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), F.min("c").alias("least"), *mixed).where("lo < hi")
    return sets.groupBy("k", "x0", "x1").agg(F.min("token").alias("token"), F.min("least").alias("least")).select("token", "least")


def _across(rows: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of classes of different roots that share a token and pass the bounds. rows: (least, token, c, root, n, bits).

    In each token's group the classes outside of its most frequent root meet all others, both dealt out in chunks. Tokens
    with one smallest class meet in one task, which gives a pair once for them.
    """
    sizes = rows.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token")
    sizes = sizes.agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("k"), F.max("k").alias("k_main"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda k: F.ceil(k / (chunk // 2)).cast("int")
    dealt = rows.join(spool(sizes, "sizes"), "token").withColumn("mi", parts(F.col("k") - F.col("k_main"))).withColumn("mj", parts(F.col("k")))
    upto = lambda m: F.sequence(F.lit(0), m - 1)
    place = lambda m: F.pmod(F.xxhash64("c"), m).cast("int")
    names = ["least", "token", "i", "j", "side", "c", "root", "n", "bits"]
    held = dealt.withColumn("i", F.explode(upto(F.col("mi")))).withColumn("j", place(F.col("mj"))).withColumn("side", F.lit(1)).select(*names)
    asking = dealt.where("root <> main").withColumn("j", F.explode(upto(F.col("mj")))).withColumn("i", place(F.col("mi"))).withColumn("side", F.lit(0)).select(*names)
    key = ["least", "i", "j", "token"]

    def group(cols: list, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        side, c, root, n, bits = (x[lo:hi] for x in cols)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        for at in range(0, len(a), 64):
            x = a[at : at + 64]
            total = n[x][:, None] + n[b][None, :]
            differ = np.bitwise_count(bits[x][:, None, :] ^ bits[b][None, :, :]).sum(axis=2, dtype=np.int64)
            near = (root[x][:, None] != root[b][None, :]) & (differ <= total * ((1 - least) / (1 + least)) + 1e-6)
            near &= np.minimum(n[x][:, None], n[b][None, :]) >= least * np.maximum(n[x][:, None], n[b][None, :]) - 1e-6
            i, j = np.nonzero(near)
            out.append((c[x[i]], c[b[j]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (c[:0], c[:0])

    def run(batches):
        held: list[pa.RecordBatch] = []
        seen: dict[tuple, set] = {}

        def done(table: pa.Table):
            keys = [table[x].to_numpy() for x in key]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cols = [*(table[x].to_numpy() for x in ("side", "c", "root", "n")), table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)]
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *new], [*new, table.num_rows]):
                at = tuple(int(k[lo]) for k in keys[:3])
                if at not in seen or len(seen[at]) > SEEN:
                    seen.clear()
                known = seen.setdefault(at, set())
                a, b = group(cols, lo, hi)
                pairs = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) - known
                known |= pairs
                out += pairs
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:  # the rows of one group may go on in the next batch
            if not batch.num_rows:
                continue
            held.append(batch)
            new = np.flatnonzero(np.any([(k := batch.column(x).to_numpy())[1:] != k[:-1] for x in key], axis=0))
            if len(new):
                last = int(new[-1]) + 1
                yield done(pa.Table.from_batches([*held[:-1], batch.slice(0, last)]))
                held = [batch.slice(last)]
        if held:
            yield done(pa.Table.from_batches(held))

    together = held.unionByName(asking).repartition(*key[:3]).sortWithinPartitions(*key)
    return together.mapInArrow(run, "a bigint, b bigint").distinct()


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row, all its columns, of each group of near copies: the one with the smallest id (a row without an id only where there
    is no other), of rows with one id the one with the smallest `text_key`, of wholly equal ids and texts any one.

    Texts with one set of shingles are a class; classes link if their similarity is `least` or more, and no link is lost. First each
    class is held against those near by fingerprint and, for each token of its prefix, against the token's smallest class; then, where
    a token's classes aren't all connected yet, against those of other components. Every row is judged by its own
    text, so rows that share an id and differ in their texts both stay. Null, empty and wordless texts are one group.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(source.select("text")))

    def scan(batches):
        for b in sliced(batches, 1):
            found = [shingle_set(t) for t in raw(b.column(1))]
            mixed = [int((f ^ (f >> np.uint64(31))).sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 + len(f) for f in found]
            c = np.array([x % (1 << BITS) for x in mixed], np.uint64).view(np.int64)
            fp = np.array([set_fingerprint(f) for f in found], np.uint64).view(np.int64)
            first = [[x.view(np.int64) for x in prefix(f, *often.value, least)] for f in found]
            sizes = np.array([len(f) for f in found])
            odd = [[p(f) for f in found] for p in (parities, wide_parities)]
            listed = [list_column(np.concatenate(x), np.array([len(y) for y in x]), pa.int64()) for x in (*odd, *zip(*first))]
            columns = [b.column(0), b.column(2), pa.array(c), pa.array(sizes), pa.array(fp), *listed]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "c", "n", "fp", "bits", "wide", "rare", "late"])

    prints = spool(source.select("id", "text", "key").mapInArrow(scan, f"id {kind}, key bigint, c bigint, n bigint, fp bigint, bits array<bigint>, wide array<bigint>, rare array<bigint>, late array<bigint>"), "prints")
    place = F.struct(F.col("id").isNull().alias("no"), "id", "key")
    classes = spool(prints.groupBy("c").agg(F.min(place).alias("of"), *[F.any_value(x).alias(x) for x in ("n", "fp", "bits", "wide")]), "classes")

    # candidates: near fingerprints, and of each token's classes the smallest
    prints_of = spool(classes.groupBy("fp").agg(F.min("c").alias("lead")), "fps")
    lead = lambda x: prints_of.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}"))
    by_bits = links(prints_of.select("fp")).join(lead("a"), "a").join(lead("b"), "b").select(F.col("lead_a").alias("x"), F.col("lead_b").alias("y"))
    equal = classes.join(prints_of, "fp").select(F.col("c").alias("x"), F.col("lead").alias("y"))
    # a rare token's classes are few and meet in one task; the others' least and largest are found by parts first
    of_token = Window.partitionBy("token")
    rare = prints.select(F.explode("rare").alias("token"), "c").withColumns({"lo": F.min("c").over(of_token), "hi": F.max("c").over(of_token)})
    late = prints.select(F.explode("late").alias("token"), "c").distinct()
    late = late.join(late.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "token")
    tokens = spool(rare.unionByName(late).where("lo < hi").distinct(), "tokens")
    leads = tokens.select(F.col("c").alias("x"), F.col("lo").alias("y"))
    pairs = by_bits.unionByName(equal).unionByName(leads).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = spool(pairs, "pairs")
    linked = _judged(pairs, classes, source, least)
    stars = spool(connected_components(linked), "stars")

    # what is left: classes of one token in different components
    roots = tokens.select("token", "c").join(stars.withColumnRenamed("node", "c"), "c", "left").select("token", "c", F.coalesce("root", "c").alias("root"))
    open_ = _telling(roots)
    rows = spool(roots.join(open_, "token").join(classes.select("c", "n", "bits"), "c").select("least", "token", "c", "root", "n", "bits"), "open")
    more = _judged(_across(rows, least).join(pairs, ["a", "b"], "left_anti"), classes, source, least)
    of = stars.withColumnRenamed("node", "c")
    root_of = lambda x: of.select(F.col("c").alias(x), F.col("root").alias(f"root_{x}"))
    across = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    over = spool(connected_components(across), "over")
    named = classes.select("c", "of").join(of, "c", "left").withColumn("node", F.coalesce("root", "c")).drop("root").join(over, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("of").alias("best"))
    judged = prints.groupBy("id", "key", "c").agg(F.count("*").alias("n")).join(named.join(best, "root").select("c", "best"), "c")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    judged = spool(judged.select("id", "key", "n", stays.alias("stays")), "judged")
    drop(prints, classes, prints_of, tokens, pairs, linked, stars, rows, more, over)
    one, key = unused(docs, "of_id"), unused(docs, "of_key")
    mine = F.col(id_col).eqNullSafe(F.col(one)) & (text_key(F.col(text_col)) == F.col(key))
    kept = docs.join(few(judged.where("not stays").select("id", "key").toDF(one, key)), mine, "left_anti")
    again = spool(judged.where("stays and n > 1").select("id", "key").toDF(one, key), "again")
    if again.isEmpty():
        return kept
    several = kept.join(again, mine, "left_semi").groupBy(F.col(id_col).alias(one), text_key(F.col(text_col)).alias(key)).agg(F.any_value(F.struct(*columns(docs))).alias("row")).select("row.*")
    return kept.join(again, mine, "left_anti").unionByName(several.toDF(*docs.columns))
