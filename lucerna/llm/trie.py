"""The prefix trie of conversations, from a Cartesian tree over their sorted order.

Equal conversations are one class. Classes are sorted by their turns' digests (any fixed order of turns serves), cut into blocks by
range, and `low[j]` is the number of first turns that class j shares with the one before it. A node of the trie at which classes part
is an interval of that array: for a value v at j it reaches from the nearest smaller value on the left to the one on the right. Each
block finds its nearest smaller values with a stack, merges equal values of one interval into one node, and leaves open what reaches
out of it; an open end lies in the nearest block whose minimum is smaller, at the first of that block's running minima below v. Only a
row for each block (its minimum and its sums) reaches the driver. Depths between an interval and the one around it have the same
members; they are written by the rows of the interval's first class. Members, leaves and tokens of an interval are differences of
running sums, its smallest conversation a minimum over block ends and whole blocks.

Conversations of any length stay spread: turns are numbered, and their prefixes' hashes and bytes summed, by a sort over ranges whose
partitions hand on a row each. A class's key holds as many turns as it shares with any other class, and one more. The digest of a
node's conversations is taken over pieces of joined ids that tasks have made, as a stream.

Defined results: turns of one number are in order of role and MD5 of the text, equal ones in any; a null role or text is an empty one;
rows without a conversation go; a table without conversations gives no node; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, spool

#: A conversation's turns come from the first one of its run of `RUN` ids up to a number below `HEADS`.
RUN, HEADS = 5, 9
#: Classes of a block, about; bytes of joined ids in a piece.
BLOCK, PIECE = 50_000, 1 << 16
#: The value around all others, and one above all.
OUTSIDE, ABOVE = -1, 1 << 62


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, key: str, order: list[str], names: list[str]) -> DataFrame:
    """The frame written in order, each named column of longs replaced by its running sum (modulo 2^64) within its key, which is a long.

    Rows are sorted over ranges of key and order, so a key's rows may lie in several partitions. Sums start anew in each; for the key
    that a partition starts with, the driver adds up what earlier ones end with, from two rows of each partition at most.
    """
    plain = df.select(key, *order, *names, *[c for c in df.columns if c not in (key, *order, *names)])
    columns, at = plain.columns, [plain.columns.index(c) for c in names]

    def sums(batches):
        last, carry = None, np.zeros(len(at), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            new = np.append(keys[0] != last, keys[1:] != keys[:-1])
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1  # -1: goes on from the batch before
            back = np.zeros(len(at), np.uint64) - carry
            out = list(b.columns)
            for i, c in enumerate(at):
                total = np.cumsum(b.column(c).to_numpy().view(np.uint64))
                before = np.append(np.append(np.uint64(0), total)[starts], back[i])  # the last one for group -1
                value = total - before[group]
                carry[i] = value[-1]
                out[c] = pa.array(value.view(np.int64))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(out, b.schema.names)

    dealt = plain.repartitionByRange(partitions(df), key, *order).sortWithinPartitions(key, *order)
    done = spool(dealt.mapInArrow(sums, plain.schema).withColumn("_part", F.spark_partition_id()), "running")
    ends = done.groupBy("_part").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    edge = done.join(F.broadcast(ends), "_part").where((F.col(key) == F.col("_lo")) | (F.col(key) == F.col("_hi")))
    latest = F.max_by(F.struct(*names), F.struct(*order)).alias("sums")
    found = edge.groupBy("_part", "_lo", key).agg(latest).orderBy("_part", key).collect()
    known, offsets = {}, []
    for r in found:
        if r[key] == r["_lo"] and r[key] in known:
            offsets.append((r["_part"], r[key], *[(x + 2**63) % 2**64 - 2**63 for x in known[r[key]]]))
        known[r[key]] = [a + b for a, b in zip(known.get(r[key], [0] * len(names)), r["sums"])]
    if not offsets:
        return done.drop("_part").select(*df.columns)
    schema = f"_part int, {key} long, " + ", ".join(f"_add{k} long" for k in range(len(names)))
    added = done.join(F.broadcast(df.sparkSession.createDataFrame(offsets, schema)), ["_part", key], "left")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    turn = F.expr("18446744073709551616BD")
    signed = lambda x: F.when(x * 2 >= turn, x - turn).when(x * 2 < -turn, x + turn).otherwise(x).cast("long")
    return added.select(*[signed(wide(c) + F.coalesce(wide(f"_add{names.index(c)}"), F.lit(0))).alias(c) if c in names else F.col(c) for c in df.columns])


def rebuilt(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, pos, id, size): their turns, the first h of them (or all there are) taken from the
    conversation that starts their run of ids. id: MD5 of a turn; size: its text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.concat_ws(":", F.octet_length(role), role, text)
    rows = chat.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("digest"), F.md5(turn).alias("id"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).withColumn("pos", F.lit(1).cast("long"))
    turns = spool(running(rows, "conv_id", ["turn", "role", "digest", "tie"], ["pos"]).select("conv_id", "pos", "id", "size"), "turns")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % RUN
    convs = sizes.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")), "base", "left")
    convs = spool(convs.withColumn("of_base", F.coalesce("of_base", F.lit(0))), "convs")
    heads = turns.where((F.col("conv_id") % RUN == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    borrowed = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "id", "size")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.least("h", "of_base")).alias("pos"), "id", "size")
    return convs.select("conv_id"), borrowed.unionByName(own)


def shared(a: str, b: str) -> int:
    """How many first turns two keys share; a turn has 32 signs."""
    if a == b:
        return len(a) // 32
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) // 32


def minima(values: np.ndarray) -> np.ndarray:
    """Places of the running minima, each smaller than all before."""
    least = np.minimum.accumulate(values)
    return np.flatnonzero(np.append(True, least[1:] < least[:-1])) if len(values) else np.zeros(0, np.int64)


def intervals(low: list[int], first: int) -> tuple[list[int | None], list[tuple[int | None, int | None, int, int]]]:
    """For each place of a block that starts at `first` the place of the nearest smaller value on its left (None: outside of the block), and the
    nodes (left, right, value, how many places hold the value) with the nearest smaller places on both sides."""
    stack: list[list] = []  # value, left, places, last place
    lefts, nodes = [], []
    for j, v in enumerate(low, first):
        while stack and stack[-1][0] > v:
            value, left, m, _ = stack.pop()
            nodes.append((left, j, value, m))
        if stack and stack[-1][0] == v:
            stack[-1][2] += 1
            stack[-1][3] = j
        else:
            stack.append([v, stack[-1][3] if stack else None, 1, j])
        lefts.append(stack[-1][1])
    nodes += [(left, None, value, m) for value, left, m, _ in stack]
    return lefts, [x for x in nodes if x[2] > OUTSIDE]


def least_within(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The minimum of values[start:stop] for each pair, from minima over runs of powers of two."""
    out, power, run = np.zeros(len(start), values.dtype), 0, values
    level = np.floor(np.log2(np.maximum(1, stop - start))).astype(int)
    while power <= level.max(initial=0):
        here = level == power
        out[here] = np.minimum(run[start[here]], run[stop[here] - (1 << power)])
        run = np.minimum(run[: len(run) - (1 << power)], run[1 << power :]) if len(run) > 1 << power else run
        power += 1
    return out


#: What a block gives, by kind: `class` (place, its interval's left end and values), `node` (left, right, value, places),
#: `right` and `left` (a running minimum from that side: place, value, the one before) and `block` (its sums).
BLOCK_ROWS = "kind string, block int, at bigint, value bigint, after bigint, `left` bigint, `right` bigint, places bigint, conv_id bigint, len bigint, n bigint, total bigint, joint bigint, leaf bigint, sum_n bigint, sum_all bigint, sum_total bigint, sum_joint bigint, sum_leaf bigint, least bigint, upto bigint"


def block_rows(table: pa.Table, block: int, first: int, low_first: int, low_next: int) -> pa.Table:
    table = table.sort_by("at")
    keys, ends = table["key"].to_pylist(), table["upto"].to_pylist()
    low = [low_first, *(shared(a, b) for a, b in zip(keys, keys[1:]))]
    after = [*low[1:], low_next]
    length, n, total, conv = (table[c].to_numpy() for c in ("len", "n", "total", "conv_id"))
    joint = np.array([e[v - 1] if v > 0 else 0 for e, v in zip(ends, low)], np.int64)
    leaf = (length > np.array(after)).astype(np.int64)
    lefts, nodes = intervals(low, first)
    size = len(keys)
    values = np.array(low)
    place = np.arange(size) + first
    inner = [x for x in nodes if x[0] is not None and x[1] is not None]
    inner_least = least_within(conv, np.array([x[0] - first for x in inner], int), np.array([x[1] - first for x in inner], int)).tolist() if inner else []
    known = {x[:3]: v for x, v in zip(inner, inner_least)}
    rows: dict[str, list] = {f.split()[0].strip("`"): [] for f in BLOCK_ROWS.split(", ")}

    def add(count: int, **columns):
        for name, column in rows.items():
            column.append(columns.get(name, [None] * count))

    same = lambda x, k=size: [x] * k
    sums = {"sum_n": n, "sum_all": n * total, "sum_total": total, "sum_joint": joint, "sum_leaf": leaf}
    upto, back = np.minimum.accumulate(conv), np.minimum.accumulate(conv[::-1])[::-1]
    add(size, kind=same("class"), block=same(block), at=place, value=values, after=after, left=lefts, conv_id=conv, len=length, n=n, total=total, joint=joint, leaf=leaf, least=back, upto=upto, **{k: np.cumsum(v) for k, v in sums.items()})
    if nodes:
        left, right, value, m = zip(*nodes)
        add(len(nodes), kind=same("node", len(nodes)), block=same(block, len(nodes)), left=left, right=right, value=value, places=m, least=[known.get(x[:3]) for x in nodes])
    for kind, order in (("right", np.arange(size)), ("left", np.arange(size)[::-1])):
        found = minima(values[order])
        lows = values[order][found]
        add(len(found), kind=same(kind, len(found)), block=same(block, len(found)), at=place[order][found], value=lows, after=np.append(ABOVE, lows[:-1]))
    add(1, kind=["block"], block=[block], value=[int(values.min())], least=[int(conv.min())], **{k: [int(v.sum())] for k, v in sums.items()})
    kinds = [pa.string(), pa.int32()] + [pa.int64()] * (len(rows) - 2)
    return pa.table([pa.concat_arrays([pa.array(list(x), kind) for x in column]) for column, kind in zip(rows.values(), kinds)], names=list(rows))


def cartesian(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, nodes) of the Cartesian tree over classes (conv_id, len, n, total, key, upto): classes with place, shared turns before (value) and after,
    and the smallest conversation of the node around their first own turn; nodes by their first class with their sums."""
    count = classes.count()
    blocks = max(partitions(classes), ceil(count / BLOCK))
    ranged = classes.repartitionByRange(blocks, "key").sortWithinPartitions("key").withColumn("block", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = spool(ranged, "sorted")
    ends = ranged.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).orderBy("block").collect()
    where, at = {}, 0  # a row for each block
    for k, r in enumerate(ends):
        before = shared(ends[k - 1].last, r.first) if k else OUTSIDE
        where[r.block] = (k, at, before, shared(r.last, ends[k + 1].first) if k + 1 < len(ends) else OUTSIDE)
        at += r.n
    shown = classes.sparkSession.sparkContext.broadcast(where)

    def tree(table: pa.Table) -> pa.Table:
        return block_rows(table, *shown.value[table["block"][0].as_py()])

    found = spool(ranged.groupBy("block").applyInArrow(tree, BLOCK_ROWS), "blocks")
    drop(ranged)
    totals = found.where("kind = 'block'").orderBy("block").collect()
    lows, leasts = np.array([r.value for r in totals], np.int64), np.array([r.least for r in totals], np.int64)
    names = ["sum_n", "sum_all", "sum_total", "sum_joint", "sum_leaf"]
    offsets, sums = [], [0] * len(names)
    for r in totals:
        offsets.append((r.block, *sums))
        sums = [a + r[c] for a, c in zip(sums, names)]
    spark = classes.sparkSession
    if not offsets:
        return tuple(spark.createDataFrame([], ", ".join(f"`{c}` long" for c in columns.split())) for columns in ("conv_id at value after len n total around", "left value conv_id len above low places least n leaves saved"))
    offset = spark.createDataFrame(offsets, "block int, " + ", ".join(f"off_{c} long" for c in names))
    own = found.where("kind = 'class'").join(F.broadcast(offset), "block").withColumns({c: F.col(c) + F.col(f"off_{c}") for c in names}).drop(*offset.columns[1:])

    # open ends: the block that has them, then that block's running minimum
    @F.pandas_udf("int")
    def nearest(block, value, side):
        out = []
        for b, v, s in zip(block, value, side):
            hit = np.flatnonzero(lows[b + 1 :] < v) + b + 1 if s == "right" else np.flatnonzero(lows[:b] < v)
            out.append((int(hit[0]) if s == "right" else int(hit[-1])) if len(hit) else -1)
        return pd.Series(out, dtype="int32")

    nodes = found.where("kind = 'node'").select("block", "left", "right", "value", "places", "least")
    sides = {}
    for side in ("left", "right"):
        asked = nodes.where(F.col(side).isNull()).select("block", "value").distinct()
        asked = asked.withColumn("of", nearest("block", "value", F.lit(side)))
        edge = found.where(F.col("kind") == side).select(F.col("block").alias("of"), F.col("at").alias(f"{side}_at"), F.col("value").alias("low"), "after")
        met = asked.join(edge, "of", "left").where("of < 0 or (low < value and value <= after)")
        sides[side] = spool(met.select("block", "value", F.coalesce(f"{side}_at", F.lit(count)).alias(f"{side}_at")), side)
    for side, known in sides.items():
        nodes = nodes.join(known, ["block", "value"], "left").withColumn(side, F.coalesce(side, f"{side}_at")).drop(f"{side}_at")
    nodes = nodes.groupBy("left", "value").agg(F.sum("places").alias("places"), F.max("right").alias("right"), F.min("least").alias("inner"))

    @F.pandas_udf("long")
    def between(first, last):
        return pd.Series([int(leasts[a + 1 : b].min()) if b - a > 1 else None for a, b in zip(first, last)], dtype="Int64")

    lo = own.select(F.col("at").alias("left"), F.col("block").alias("lo"), "conv_id", "len", F.col("value").alias("low"), F.col("least").alias("back"), *[(F.col(c) - F.col(x)).alias(f"lo_{c}") for c, x in zip(names[:1] + names[2:3] + names[4:], ["n", "total", "leaf"])], (F.col("sum_all") - F.col("n") * F.col("total")).alias("lo_sum_all"), F.col("sum_joint").alias("lo_sum_joint"))
    hi = own.select((F.col("at") + 1).alias("right"), F.col("block").alias("hi"), F.col("after").alias("high"), F.col("upto").alias("ahead"), *[F.col(c).alias(f"hi_{c}") for c in names])
    whole = nodes.join(lo, "left").join(hi, "right")
    least = F.when(F.col("lo") == F.col("hi"), F.coalesce("inner", "back")).otherwise(F.least("back", "ahead", between("lo", "hi")))
    diff = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    saved = diff("sum_all") - diff("sum_total") + diff("sum_joint")
    whole = whole.select("left", "value", "conv_id", "len", F.greatest("low", "high").alias("above"), F.col("low"), "places", least.alias("least"), diff("sum_n").alias("n"), diff("sum_leaf").alias("leaves"), saved.alias("saved"))
    whole = spool(whole, "nodes")
    own = own.join(sides["left"].withColumnRenamed("left_at", "open"), ["block", "value"], "left").withColumn("left", F.coalesce("left", "open"))
    around = whole.select("left", "value", F.col("least").alias("around"))
    own = spool(own.join(around, ["left", "value"], "left").select("conv_id", "at", "value", "after", "len", "n", "total", "around"), "own")
    drop(found, *sides.values())
    return own, whole


def digests(members: DataFrame) -> DataFrame:
    """(conv_id, ends): SHA-256 of the comma-joined ids of each class (conv_id, member), ascending. Tasks join ids to pieces; one then takes
    a class's pieces as a stream."""

    def pieces(batches):
        own, first, held, size = None, None, [], 0
        out: list[tuple[int, int, str]] = []
        for b in batches:
            for c, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (c != own or size > PIECE):
                    out.append((own, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    own, first = c, m
                held.append(str(m))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv_id", "first", "text"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([first]), pa.array([",".join(held)])], ["conv_id", "first", "text"])

    def hashed(batches):
        own, state, done = None, None, []
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if c != own:
                    if state:
                        done.append((own, state.hexdigest()))
                    own, state = c, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["conv_id", "ends"])
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([state.hexdigest()])], ["conv_id", "ends"])

    ranged = members.select("conv_id", "member").repartitionByRange(partitions(members), "conv_id", "member").sortWithinPartitions("conv_id", "member")
    texts = ranged.mapInArrow(pieces, "conv_id bigint, first bigint, text string")
    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(hashed, "conv_id bigint, ends string")


def prefix_trie(chat: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(chat)
    marked = turns.withColumn("a", F.xxhash64("id", "pos")).withColumn("b", F.xxhash64("pos", "id", F.lit(1))).withColumn("upto", F.col("size"))
    turns = spool(running(marked, "conv_id", ["pos"], ["a", "b", "upto"]), "rebuilt")

    # equal conversations are one class, named by its smallest
    last = turns.groupBy("conv_id").agg(F.max("pos").alias("len"), F.max_by(F.struct("a", "b", "upto"), "pos").alias("x")).select("conv_id", "len", "x.*")
    every = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("len", "a", "b", "upto")])
    every = spool(every, "every")
    classes = spool(every.groupBy("len", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("upto").alias("total")), "classes")
    several = every.join(classes.where("n > 1").select("len", "a", "b", F.col("conv_id").alias("of")), ["len", "a", "b"]).select(F.col("of").alias("conv_id"), F.col("conv_id").alias("member"))
    ends = spool(digests(several), "ends")

    # keys: the turns that a class shares with another, and one more
    firsts = spool(turns.join(classes.select("conv_id"), "conv_id"), "firsts")
    common = firsts.groupBy("pos", "a", "b").agg(F.count("*").alias("k")).where("k > 1").select("pos", "a", "b")
    depth = firsts.join(common, ["pos", "a", "b"]).groupBy("conv_id").agg(F.max("pos").alias("depth"))
    cut = firsts.join(depth, "conv_id", "left").where(F.col("pos") <= F.coalesce("depth", F.lit(0)) + 1)
    listed = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "upto"))).alias("x"))
    keyed = listed.select("conv_id", F.array_join("x.id", "").alias("key"), F.col("x.upto").alias("upto"))
    keyed = classes.select("conv_id", "len", "n", "total").join(keyed, "conv_id", "left")
    own, nodes = cartesian(keyed.withColumn("key", F.coalesce("key", F.lit(""))).withColumn("upto", F.coalesce("upto", F.array().cast("array<bigint>"))))

    drop(turns, classes, every)

    # depths: every node is the row of its first class at its depth
    root = own.where("at = 0").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("before"))
    rows = firsts.select("conv_id", "pos", (F.col("upto") - F.col("size")).alias("before")).unionByName(root)
    rows = rows.join(own, "conv_id").where(F.col("pos") > F.col("value"))
    outer = F.lag("least").over(Window.partitionBy("left").orderBy("value"))
    nodes = nodes.withColumn("outer", outer)
    inner = nodes.select(F.col("conv_id"), F.explode(F.sequence(F.col("above") + 1, F.col("value"))).alias("pos"), F.col("value").alias("v"), "above", "low", "places", "least", F.col("n").alias("members"), "leaves", "saved", "outer")
    tops = nodes.groupBy(F.col("conv_id")).agg(F.max_by("least", "value").alias("top"))  # around a class's own last turns
    rows = rows.join(inner, ["conv_id", "pos"], "left").join(tops, "conv_id", "left").join(ends, "conv_id", "left")
    branch = F.col("v").isNotNull()
    first_own = F.col("pos") == F.col("value") + 1
    parent = F.when(F.col("pos") == 0, F.lit(None)).when(first_own, F.col("around")).when(branch, F.when(F.col("pos") == F.col("above") + 1, F.col("outer")).otherwise(F.col("least")))
    parent = parent.otherwise(F.when(F.col("pos") == F.greatest("value", "after") + 1, F.col("top")).otherwise(F.col("conv_id")))
    children = F.when(branch, F.when(F.col("pos") < F.col("v"), F.lit(1)).otherwise(F.col("places") + 1 - (F.col("len") == F.col("v")).cast("long"))).otherwise((F.col("pos") < F.col("len")).cast("long"))
    many = F.when(branch, F.col("members")).otherwise(F.col("n"))
    saved = F.when(branch, F.col("saved")).otherwise((F.col("n") - 1) * F.col("total")) - (many - 1) * F.col("before")
    sha: Column = F.when(F.col("pos") < F.col("len"), F.sha2(F.lit(""), 256)).when(F.col("n") > 1, F.col("ends")).otherwise(F.sha2(F.col("conv_id").cast("string"), 256))
    return rows.select(
        F.when(branch, F.col("least")).otherwise(F.col("conv_id")).alias("conv_id"), F.col("pos").alias("depth"), parent.cast("long").alias("parent_conv_id"), many.alias("n_convs"), children.cast("long").alias("n_children"),
        F.when(branch, F.col("leaves")).otherwise(F.lit(1).cast("long")).alias("n_leaves"), saved.alias("saved_tokens"), sha.alias("ends_sha256"),
    )
