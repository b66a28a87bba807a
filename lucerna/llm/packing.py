"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity`
numbers) reaches the driver, which packs lengths, not rows: branch and bound over fillings around the longest
remaining piece, with best-fit solutions as incumbents. Each filling is used many times, so the plan has at most
a few times `capacity` entries however many rows there are; rows find their place by their rank among the pieces
of their length.

Defined results: a null text is empty (one piece, the end token alone); repeated rows are packed each on its own;
pieces of one length are placed in any order; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_column, short_batches, sliced, spool

CAPACITY, END = 1024, 2
#: Search nodes of the packer; each also tries a best-fit completion.
NODES = 160
#: Rows of one length are ranked in so many groups at least, and in groups of about so many rows.
BUCKETS, BUCKET_ROWS = 256, 50_000


def byte_signs() -> dict[str, int]:
    """The byte for which each sign of a byte-level vocabulary stands: printable Latin-1 for itself, the rest from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids that `tokenizers` gives for the vocabulary file (byte-level BPE, JSON), no special tokens added. tiktoken finds them
    with the file's ranks; where its pattern runs out of stack (white space of some hundred thousand signs), `tokenizers` itself does."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}  # one token wherever a text holds them
    signs = byte_signs()
    ranks = {bytes(map(signs.__getitem__, word)): k for word, k in file["model"]["vocab"].items() if word not in special}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    whole = cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> list[int]:
        try:
            return quick.encode(text, allowed_special="all")
        except ValueError:
            return whole().encode(text, add_special_tokens=False).ids

    return encode


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut from the back
    so that only the first piece is shorter than `capacity`."""
    short_batches(df.sparkSession)

    def run(batches):
        encode = encoder(vocabulary)
        for b in sliced(batches, 1):
            docs, number, start, length, crc, flat = [], [], [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k in range(len(edges) - 1):
                    part = ids[edges[k] : edges[k + 1]]
                    docs.append(row)
                    number.append(k)
                    start.append(edges[k])
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        flat.append(part)
            columns = [b.column(0).take(pa.array(docs, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(list_column(np.concatenate(flat), np.array(length), pa.int32()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


# ---- the packer, over a histogram ----


def bound(hist: np.ndarray) -> int:
    """Lower bound on bins: hist[w] pieces of length w. The largest over thresholds a of: pieces over C - a
    have a bin each, pieces over C / 2 too, and the rest of at least a fill what those leave."""
    c = len(hist) - 1
    w = np.arange(c + 1)
    n, s = np.append(np.cumsum(hist[::-1])[::-1], 0), np.append(np.cumsum((hist * w)[::-1])[::-1], 0)
    half = c // 2
    a = np.arange(0, half + 1)
    over, wide = n[c - a + 1], n[half + 1] - n[c - a + 1]
    room = wide * c - (s[half + 1] - s[c - a + 1])
    rest = np.maximum(0, s[a] - s[half + 1] - room)
    return int(np.max(over + wide + -(-rest // c), initial=0))


def best_fit(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: [(lengths in a bin, how many such bins)]."""
    c = len(hist) - 1
    open_: dict[int, list[list]] = {}
    for w in range(c, 0, -1):
        left = int(hist[w])
        if not left:
            continue
        # a bin with room r takes r // w pieces of this length before a roomier one is touched
        for room in sorted(r for r in open_ if r >= w):
            for group in open_.pop(room):
                content, count = group
                each = room // w
                full = min(count, left // each)
                if full:
                    open_.setdefault(room - each * w, []).append([content + (w,) * each, full])
                    left -= full * each
                    count -= full
                if count and left:  # fewer than a bin's worth remain
                    open_.setdefault(room - left * w, []).append([content + (w,) * left, 1])
                    left, count = 0, count - 1
                if count:
                    open_.setdefault(room, []).append([content, count])
            if not left:
                break
        each = c // w
        if left >= each:
            open_.setdefault(c - each * w, []).append([(w,) * each, left // each])
            left %= each
        if left:
            open_.setdefault(c - left * w, []).append([(w,) * left, 1])
    return [(content, count) for groups in open_.values() for content, count in groups]


def fillings(hist: np.ndarray, first: int, width: int) -> list[tuple[int, ...]]:
    """Undominated completions of a bin that holds `first`, least waste first, `width` at most.

    A completion is dominated where one piece can be exchanged for a longer one that still fits, or where one
    more piece fits: only those of one, two or three pieces that leave no such exchange are kept, and longer
    ones made by filling up with the longest that fit.
    """
    room = len(hist) - 1 - first
    left = hist.copy()
    left[first] -= 1
    have = np.flatnonzero(left[: room + 1])
    have = have[have > 0][::-1]
    if not len(have):
        return [(first,)]
    fit = np.full(room + 1, 0)  # the longest length that fits into each room
    fit[have] = have
    fit = np.maximum.accumulate(fit)
    found: dict[tuple[int, ...], int] = {}
    for top in have[: 4 * width]:
        top = int(top)
        for second in (None, *(int(x) for x in have[np.searchsorted(-have, -(room - top)) :][: 2 * width])):
            content, used = [top], {top: 1}
            space = room - top
            while space > 0:
                w = second if second is not None and len(content) == 1 and second <= space else int(fit[space])
                while w > 0 and used.get(w, 0) >= left[w]:
                    w = int(fit[w - 1]) if w > 1 else 0
                if not w:
                    break
                content.append(w)
                used[w] = used.get(w, 0) + 1
                space -= w
            longer = any((y := int(fit[min(x + space, room)])) > x and used.get(y, 0) < left[y] for x in content)
            if not longer or space == 0:
                found.setdefault((first, *sorted(content, reverse=True)), space)
            if second is None and not space:
                break
    if not found:
        found[(first, int(have[0]))] = 0
    return sorted(found, key=lambda x: (found[x], len(x), tuple(-w for w in x)))[:width]


def completions(hist: np.ndarray, first: int) -> Iterator[tuple[int, ...]]:
    """All completions of a bin that holds `first` to which no piece can be added, longest pieces first."""
    left = hist.copy()
    left[first] -= 1
    space = w = len(hist) - 1 - first
    content: list[int] = []
    sizes = np.arange(len(hist))
    while True:
        while w > 0 and (w > space or not left[w]):
            w -= 1
        if w > 0:
            content.append(w)
            left[w] -= 1
            space -= w
            continue
        if not left[1 : space + 1].any():
            yield (first, *content)
        if not content:
            return
        w = content.pop()
        left[w] += 1
        space += w
        # without it, all shorter pieces together must leave too little room for it
        w = w - 1 if space - left[:w] @ sizes[:w] < w else 0


def solve(hist: np.ndarray, nodes: int = NODES, width: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Bins for a histogram of lengths, as few as `nodes` search nodes find: [(lengths, how many such bins)].

    The search completes the bin of the longest remaining piece, as often as the histogram allows, trying
    undominated fillings in order of their waste; a branch ends where its bins and the lower bound of what
    remains don't beat the incumbent. Every node's remainder packed by best fit is a candidate incumbent.
    The dives take `width` fillings at their top and one below, each as often as it fits. If they end before the nodes do,
    a second search goes through all completions, each any number of times, with the nodes that are left.
    """
    hist = hist.astype(np.int64).copy()
    hist[0] = 0
    best = best_fit(hist)
    least, goal, spent = sum(n for _, n in best), bound(hist), 0
    # two kinds of dives: from the full histogram, completing only what best fit leaves loose is cheaper
    stack: list[tuple[np.ndarray, int, tuple]] = [(hist, 0, ())]
    while stack and spent < nodes and least > goal:
        rest, used, done = stack.pop()
        if used + bound(rest) >= least:
            continue
        spent += 1
        tail = best_fit(rest)
        if (total := used + sum(n for _, n in tail)) < least:
            chain, bins = done, []
            while chain:
                bins.append(chain[0])
                chain = chain[1]
            best, least = bins + tail, total
        # descend through several fillings at once; the alternatives to the first of them are kept
        others = []
        for depth in range(16):
            if not rest.any():
                break
            first = int(np.flatnonzero(rest)[-1])
            options = fillings(rest, first, width if not depth else 1)
            after = []
            for filling in options:
                need = np.bincount(filling, minlength=len(rest))
                times = int(np.min(rest[need > 0] // need[need > 0]))
                after.append((rest - need * times, used + times, ((filling, times), done)))
            others += after[:0:-1]
            rest, used, done = after[0]
        stack += others
        stack.append((rest, used, done))

    def options(rest: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray, int]]:
        for filling in completions(rest, int(np.flatnonzero(rest)[-1])) if rest.any() else ():
            need = np.bincount(filling, minlength=len(rest))
            for times in range(int(np.min(rest[need > 0] // need[need > 0])), 0, -1):
                yield filling, need, times

    seen = {hist.tobytes(): 0}
    path = [(hist, 0, (), options(hist), goal)]
    while path and spent < nodes and least > goal:
        rest, used, done, more, low = path[-1]
        if low >= least or (option := next(more, None)) is None:
            path.pop()
            continue
        spent += 1
        filling, need, times = option
        rest, used, done = rest - need * times, used + times, ((filling, times), done)
        if (low := used + bound(rest)) >= least or seen.get(key := rest.tobytes(), used + 1) <= used:
            continue
        seen[key] = used
        tail = best_fit(rest)
        if (total := used + sum(n for _, n in tail)) < least:
            bins, chain = [], done
            while chain:
                bins.append(chain[0])
                chain = chain[1]
            best, least = bins + tail, total
        path.append((rest, used, done, options(rest), low))
    return best


def pack(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32, ...) from `pieces`.

    Rows get a number that is written with them. Ranks within a length are taken in groups by a hash of it, and the groups'
    starts by a running sum over group counts, so that neither a length that most rows share nor rows that are all alike are one
    task's work.
    """
    columns = parts.columns
    parts = spool(parts.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    groups = max(BUCKETS, -(-parts.count() // BUCKET_ROWS))
    keyed = parts.withColumn("_g", F.pmod(F.xxhash64("_n"), F.lit(groups)).cast("int"))
    counts = spool(keyed.groupBy("length", "_g").agg(F.count("*").alias("_k")), "counts")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("_k")).collect():  # at most `capacity` rows
        hist[length] = n
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_g", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy("length", "_g").orderBy("_n")
    ranked = keyed.withColumn("_r", F.row_number().over(own)).join(starts, ["length", "_g"])
    ranked = ranked.select(*columns, (F.col("_from") + F.col("_r") - 1).alias("_rank"))

    # by length: first rank, first sequence, pieces of that length in a sequence, offset of the first of them
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = dict.fromkeys(range(capacity + 1), 0), 0
    for content, times in solve(hist, nodes):
        offset = 0
        for w in dict.fromkeys(content):
            each = content.count(w)
            plan.setdefault(w, []).append((taken[w], sequence, each, offset))
            taken[w] += each * times
            offset += each * w
        sequence += times
    arrays = {w: np.array(x, dtype=np.int64).T for w, x in plan.items()}
    place = parts.sparkSession.sparkContext.broadcast(arrays)
    names = columns
    length_at, rank_at = names.index("length"), len(names)

    def run(batches):
        for b in batches:
            length, rank = b.column(length_at).to_numpy(), b.column(rank_at).to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for w in np.unique(length):
                at = length == w
                first, start, each, base = place.value[int(w)]
                k = np.searchsorted(first, rank[at], "right") - 1
                j = rank[at] - first[k]
                seq[at], offset[at] = start[k] + j // each[k], base[k] + j % each[k] * w
            yield pa.RecordBatch.from_arrays([*b.columns[:rank_at], pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != "_n")
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids; needs pieces made with `with_ids`. A sequence holds at most
    `capacity` tokens, so no group grows."""
    inner = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inner, lambda x: x["ids"])).alias("ids"))

