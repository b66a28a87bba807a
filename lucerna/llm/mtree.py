"""Exact top-k search by inner product with M-trees.

Inner products become distances: with M the largest norm of the indexed vectors, x is extended by
sqrt(M^2 - |x|^2) and a query by 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the k highest scores are the k
nearest vectors in a Euclidean, hence metric, space.

Index: routing vectors, the `CELLS` rows with the smallest hashes at most, cut the space into cells; a cell's vectors become trees of
at most `TREE_ROWS` vectors, each a row of a table, so no task holds more than a tree while it builds one, and a hot cell is
several trees. A tree has pages: every node keeps a routing vector, a covering radius, its distance to its parent's
routing vector and its smallest vec_id. Search: best first by lower bound. A node is skipped without computing
its distance if |d(q, parent) - d(parent, node)| - radius already exceeds the k-th best; a leaf's vectors are
skipped alike by their stored distances. Scores are integer products, so pruning only ever needs a safe
margin for rounding of the bounds. Equal scores go to the smaller vec_id, so a page whose bound equals the k-th
score is still opened unless all its ids are larger.

Queries are a stated set. Only the trees' roots (a routing vector, a radius and an id for each tree) are broadcast. Each query goes to the tree
with the best bound first, which gives it a k-th score; then only to groups that hold another tree whose bound
beats that score. Trees and the queries sent to them meet by a shuffle, in at most `GROUPS` groups of trees.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; components so large that a score would not
fit into 64 bits raise ValueError; a
query's candidates are the vectors of its length, and a tree holds vectors of one length; a query's own id is no
candidate, also where rows repeat it; of several query rows with one id the smallest of the longest vectors asks; repeated candidate rows each count; fewer than k
candidates give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, spool

K, SCALE = 10, 1024
#: Vectors in a tree, entries in a page; routing vectors and groups of trees, at most.
TREE_ROWS, PAGE, CELLS, GROUPS = 16_384, 256, 1024, 4096


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as longs; only whole, finite vectors with an id and a component at least."""
    x = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def build(ids: np.ndarray, vectors: np.ndarray, top: float, page: int = PAGE) -> dict:
    """A tree as arrays: rows in leaf order and, per level from the leaves up, pages with their routing vector,
    radius, span of children, distance to the parent's routing vector and smallest id."""
    points = vectors.astype(np.float64)
    extra = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", points, points)))
    points = np.column_stack([points, extra])
    order: list[np.ndarray] = []

    def split(rows: np.ndarray) -> None:
        """Halves by distance to two far routing vectors until a page holds them; equal distances split by rank."""
        while len(rows) > page:
            p = points[rows]
            a = p[int(np.argmax(((p - p[0]) ** 2).sum(1)))]
            b = p[int(np.argmax(((p - a) ** 2).sum(1)))]
            side = np.argsort(((p - a) ** 2).sum(1) - ((p - b) ** 2).sum(1), kind="stable")
            half = max(page, (len(rows) // 2 + page - 1) // page * page)
            split(rows[side[:half]])
            rows = rows[side[half:]]
        order.append(rows)

    split(np.argsort(ids, kind="stable"))
    rows = np.concatenate(order)
    small = np.int32 if not vectors.size or np.abs(vectors).max() < 2**31 else np.int64
    tree = {"ids": ids[rows], "vectors": vectors[rows].astype(small), "levels": []}
    below, radius, least = points[rows], np.zeros(len(rows)), ids[rows]
    spans = np.cumsum([0, *map(len, order)])
    while True:
        lo, hi = spans[:-1], spans[1:]
        centre = np.array([below[a:b].mean(0) for a, b in zip(lo, hi)])
        up = np.concatenate([np.sqrt(((below[a:b] - c) ** 2).sum(1)) for a, b, c in zip(lo, hi, centre)])
        reach = np.array([(up[a:b] + radius[a:b]).max() for a, b in zip(lo, hi)])
        least = np.array([least[a:b].min() for a, b in zip(lo, hi)])
        tree["levels"].append({"lo": lo, "hi": hi, "centre": centre, "radius": reach, "least": least, "up": up})
        if len(lo) == 1:
            return tree
        below, radius = centre, reach
        spans = np.unique([*range(0, len(lo), page // 4), len(lo)])


def bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray, top: float) -> np.ndarray:
    """The highest score, rounding allowed for, that each tree (a root's routing vector and radius) can hold for each query."""
    q = queries.astype(np.float64)
    norm = (q * q).sum(1)[:, None]
    apart = np.sqrt(np.maximum(0.0, norm + (centre * centre).sum(1) - 2 * q @ centre[:, :-1].T))
    slack = 1e-7 * (norm + top) + 1e-6
    return (norm + top - np.maximum(0.0, apart - radius - 1e-6 * np.sqrt(norm + top)) ** 2) / 2 + slack


def search(tree: dict, query: np.ndarray, own: int, top: float, best: list, k: int, count: list | None = None) -> None:
    """Adds the tree's best to `best`, a heap of (score, -vec_id) of at most k with the worst first.

    count: gets the number of distances computed, for tests of the pruning.
    """
    q = np.append(query.astype(np.float64), 0.0)
    norm = float(q @ q)
    exact = np.sqrt(norm * top) < 2**52
    slack = 1e-9 * (norm + top) + 1e-6

    def may(low: float, least: int) -> bool:
        """Whether a page at distance `low` at least, with ids from `least`, can hold one of the k best."""
        if len(best) < k:
            return True
        most = (norm + top - max(0.0, low) ** 2) / 2 + slack
        return most >= best[0][0] + 1 or (most >= best[0][0] and least < -best[0][1])

    levels = tree["levels"]
    root = levels[-1]
    d = float(np.sqrt(((root["centre"][0] - q) ** 2).sum()))
    queue = [(d - root["radius"][0], len(levels) - 1, 0, d)]
    computed = 1
    while queue:
        low, level, at, d = heapq.heappop(queue)
        node = levels[level]
        if not may(low, int(node["least"][at])):
            continue
        lo, hi = int(node["lo"][at]), int(node["hi"][at])
        up = node["up"][lo:hi]
        if level:  # children are pages
            child = levels[level - 1]
            near = np.abs(d - up) - child["radius"][lo:hi]  # from stored distances alone
            keep = [i for i in range(hi - lo) if may(float(near[i]), int(child["least"][lo + i]))]
            if keep:
                part = np.array(keep) + lo
                dist = np.sqrt(((child["centre"][part] - q) ** 2).sum(1))
                computed += len(part)
                for i, x in zip(part.tolist(), dist.tolist()):
                    if may(x - child["radius"][i], int(child["least"][i])):
                        heapq.heappush(queue, (x - float(child["radius"][i]), level - 1, i, x))
            continue
        ids = tree["ids"][lo:hi]
        rows = np.arange(lo, hi)
        if len(best) == k:
            low_each = np.abs(d - up)
            most = (norm + top - low_each**2) / 2 + slack
            rows = rows[(most >= best[0][0]) & (ids != own)]
        else:
            rows = rows[ids != own]
        if not len(rows):
            continue
        computed += len(rows)
        some = tree["vectors"][rows]
        score = np.rint(some.astype(np.float64) @ q[:-1]).astype(np.int64) if exact else some.astype(np.int64) @ query
        if len(best) == k:
            worst, mark = best[0][0], -best[0][1]
            good = (score > worst) | ((score == worst) & (tree["ids"][rows] < mark))
            rows, score = rows[good], score[good]
        if len(rows) > k:
            first = np.lexsort((tree["ids"][rows], -score))[:k]
            rows, score = rows[first], score[first]
        for s, i in zip(score.tolist(), tree["ids"][rows].tolist()):
            if len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))
    if count is not None:
        count.append(computed)


def index(vectors: DataFrame, tree_rows: int = TREE_ROWS, cells: int = CELLS) -> tuple[DataFrame, dict[int, float], dict[int, dict]]:
    """The table of trees (tree_id, group, pickled tree) over rows of `quantised`, the squared largest norm of each length, and by
    length the roots: tree ids, groups, routing vectors, radii and smallest ids. Written to the shared folder."""
    import pickle

    spark = vectors.sparkSession
    vectors = spool(vectors, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    lengths = vectors.groupBy(F.size("v")).agg(F.max(norm), F.count("*")).collect()
    tops = {dim: top * (1 + 1e-12) for dim, top, _ in lengths}
    if any(not top < 2.0**62 for top in tops.values()):
        raise ValueError("components are too large: a score would not fit into 64 bits")
    routers: dict[int, np.ndarray] = {}
    for dim, _, n in lengths:
        few = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(max(1, min(cells, n // (tree_rows // 4))))
        routers[dim] = np.unique(np.array([r.v for r in few.select("v").collect()], np.float64), axis=0)
    shared = spark.sparkContext.broadcast(routers)

    def route(batches):
        for b in batches:
            dims = pc.list_value_length(b.column(1)).to_numpy()
            cell = np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                r = shared.value[int(dim)]
                x = matrix(b.column(1).take(pa.array(at))).astype(np.float64)
                cell[at] = np.argmin((r * r).sum(1) - 2 * x @ r.T, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    routed = spool(vectors.mapInArrow(route, "vec_id bigint, v array<bigint>, dim int, cell int"), "routed")
    sizes = sorted((r.dim, r.cell, r["count"]) for r in routed.groupBy("dim", "cell").count().collect())  # at most `cells` rows for each length
    # cells smaller than a tree share one with their neighbours in order; larger ones are dealt to several by a hash
    plan, at, held, now = [], 0, 0, None
    for dim, cell, n in sizes:
        parts = -(-n // (tree_rows * 3 // 4))
        if parts > 1 or dim != now or held + n > tree_rows * 3 // 4:
            at, held = (at + 1 if now is not None else 0), 0
        plan.append((dim, cell, at, parts))
        at, held, now = at + parts - 1, (held + n if parts == 1 else tree_rows), dim
    total = at + 1
    where = spark.createDataFrame(plan, "dim int, cell int, first int, parts int")  # at most `cells` rows for each length
    dealt = routed.join(F.broadcast(where), ["dim", "cell"]).withColumn("tree_id", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    dealt = dealt.select("tree_id", "vec_id", "v").repartition(min(max(1, total), GROUPS), "tree_id").sortWithinPartitions("tree_id", "vec_id", "v")

    def run(batches):
        ids, parts, held, part_no, now = [], [], 0, 0, None

        def tree():
            whole = build(np.concatenate(ids), np.concatenate(parts), tops[parts[0].shape[1]])
            root = whole["levels"][-1]
            values = [now, part_no, whole["vectors"].shape[1], root["centre"][0].tolist(), float(root["radius"][0]), int(root["least"][0]), pickle.dumps(whole, 5)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["tree_id", "part", "dim", "centre", "radius", "least", "tree"])

        for b in batches:
            at, trees = 0, b.column(0).to_numpy()
            while at < b.num_rows:
                if held and (trees[at] != now or held == tree_rows):
                    yield tree()
                    part_no = part_no + 1 if trees[at] == now else 0
                    ids, parts, held = [], [], 0
                now = int(trees[at])
                alike = int(np.searchsorted(trees, now, "right")) - at
                part = b.slice(at, min(alike, tree_rows - held))
                ids.append(part.column(1).to_numpy())
                parts.append(matrix(part.column(2)))
                held, at = held + part.num_rows, at + part.num_rows
        if held:
            yield tree()

    trees = spool(dealt.mapInArrow(run, "tree_id int, part int, dim int, centre array<double>, radius double, least bigint, tree binary"), "trees")
    drop(vectors, routed)
    roots: dict[int, dict] = {}
    rows = sorted(trees.select("dim", "tree_id", "part", "centre", "radius", "least").collect())  # one for each tree
    for dim in tops:
        of = [r for r in rows if r.dim == dim]
        roots[dim] = {"id": np.array([(r.tree_id, r.part) for r in of]), "group": np.array([r.tree_id * min(total, GROUPS) // total for r in of]), "centre": np.array([r.centre for r in of]), "radius": np.array([r.radius for r in of]), "least": np.array([r.least for r in of])}
    group = F.floor(F.col("tree_id") * min(total, GROUPS) / total).cast("int")
    return trees.select("tree_id", "part", group.alias("group"), "tree"), tops, roots


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, tree_rows: int = TREE_ROWS, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products. Both frames from `quantised`."""
    import pickle

    spark = vectors.sparkSession
    trees, tops, roots = index(vectors, tree_rows, cells)
    shared = spark.sparkContext.broadcast((tops, roots))
    asked = queries.groupBy("vec_id").agg(F.min(F.struct(-F.size("v"), "v")).getField("v").alias("v")).withColumn("floor", F.lit(None).cast("bigint")).withColumn("done", F.lit(-1))
    asked = spool(asked, "queries")
    groups = max(1, min(GROUPS, sum(len(r["id"]) for r in roots.values())))

    def send(first: bool):
        def run(batches):
            tops, roots = shared.value
            for b in batches:
                out: list[tuple[int, int, int]] = []  # row, group, tree's place among the roots or -1 for all
                dims = pc.list_value_length(b.column(1)).to_numpy()
                for dim in np.unique(dims):
                    if (root := roots.get(int(dim))) is None or not len(root["id"]):
                        continue
                    at = np.flatnonzero(dims == dim)
                    most = bounds(matrix(b.column(1).take(pa.array(at))), root["centre"], root["radius"], tops[int(dim)])
                    if first:
                        best = np.argmax(most, axis=1)
                        out += zip(at.tolist(), root["group"][best].tolist(), best.tolist())
                        continue
                    floor = np.array([-np.inf if x is None else x for x in b.column(2).take(pa.array(at)).to_pylist()])
                    open_ = most >= floor[:, None]
                    place = b.column(3).take(pa.array(at)).to_numpy()
                    open_[np.flatnonzero(place >= 0), place[place >= 0]] = False
                    for i, row in zip(at.tolist(), open_):
                        out += [(i, g, -1) for g in np.unique(root["group"][row]).tolist()]
                rows = pa.array([x for x, *_ in out], pa.int64())
                done = pa.array([p for *_, p in out], pa.int32()) if first else b.column(3).take(rows)
                yield pa.RecordBatch.from_arrays([pa.array([g for _, g, _ in out], pa.int32()), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), done], ["group", "vec_id", "v", "floor", "done"])

        return run

    def probe(first: bool):
        def run(batches):
            tops, roots = shared.value
            places = {dim: {tuple(x): i for i, x in enumerate(r["id"].tolist())} for dim, r in roots.items()}
            held: list[tuple[int, int, dict]] = []  # of the group at hand: length, place among the roots, tree
            now = None
            for b in batches:
                rows = []
                for group, tree_id, part, tree, own, v, floor, done in zip(*(b.column(c).to_pylist() if c != 5 else b.column(5) for c in range(8))):
                    if group != now:
                        held, now = [], group
                    if tree is not None:
                        tree = pickle.loads(tree)
                        dim = tree["vectors"].shape[1]
                        held.append((dim, places[dim][(tree_id, part)], tree))
                        continue
                    query = v.values.to_numpy()
                    heap = [] if floor is None else [(floor, -(2**63) - 1)] * k  # what a tree must beat; of equal scores any id does
                    mine = [(p, t) for dim, p, t in held if dim == len(query) and (p == done) == first]
                    if mine and not first:
                        root = roots[len(query)]
                        most = bounds(query[None], root["centre"][[p for p, _ in mine]], root["radius"][[p for p, _ in mine]], tops[len(query)])[0]
                        mine = [mine[i] for i in np.argsort(-most, kind="stable").tolist() if floor is None or most[i] >= floor]
                    for _, tree in mine:
                        search(tree, query, own, tops[len(query)], heap, k)
                    rows += [(own, -i, s, done) for s, i in heap if i >= -(2**63)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["query_id", "vec_id", "score", "done"])

        return run

    stored = trees.select("group", "tree_id", "part", "tree", F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("array<bigint>").alias("v"), F.lit(None).cast("bigint").alias("floor"), F.lit(None).cast("int").alias("done"))

    def met(frame: DataFrame, first: bool) -> DataFrame:
        sent = frame.mapInArrow(send(first), "group int, vec_id bigint, v array<bigint>, floor bigint, done int")
        both = stored.unionByName(sent, allowMissingColumns=True).repartitionById(groups, F.col("group")).sortWithinPartitions("group", F.col("tree").isNull(), "tree_id", "part", "vec_id")
        return both.mapInArrow(probe(first), "query_id bigint, vec_id bigint, score bigint, done int")

    near = spool(met(asked.select("vec_id", "v", "floor", "done"), True), "near")
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"), F.max("done").alias("place")).withColumnRenamed("query_id", "vec_id")
    # a query whose first tree held nothing but itself looks everywhere again
    again = spool(asked.select("vec_id", "v").join(kth, "vec_id", "left").select("vec_id", "v", F.when(F.col("n") >= k, F.col("worst")).alias("floor"), F.coalesce("place", F.lit(-1)).alias("done")), "again")
    found = near.select("query_id", "vec_id", "score").union(met(again, False).select("query_id", "vec_id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
