"""Divergence of sources by joint count histograms.

Each language keeps the terms that occur in at least `DOCUMENTS` of its documents. A group (language and source) gives a kept term
the share p = 1 + floor(1e9 (count + 2) / (N + 2 V)), and two shares differ by f = floor((p - q)^2 / (p + q)). For two groups only the
pair of a term's counts matters, so terms are tallied into a joint histogram of (count, count) for each pair of sources, and f is
evaluated once for each combination and multiplied. Terms that lack in a source are never written: what a combination with a zero has
follows from the source's own histogram less its row in the joint one, and (0, 0) has the rest of the V terms.

Texts are counted inside tasks and partly summed there, so a hot source or language shuffles a row for each of its terms and task. A
term's counts (one for each source that has it) meet in one task, which tallies pairs of sources in slices of `PAIRS_AT_ONCE` and gives
a row for each combination that it saw; these are summed again. Pairs of sources are the result's own rows.

Arithmetic is exact: in longs, and in decimals of 38 digits where a count is multiplied by 1e9.

Defined results: a null text, language or source counts as an empty one; a group without kept terms has no counts, and where its
language keeps no term its divergences are 0; equal values rank by the item's UTF-8; repeated rows count each, as documents of their
own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import raw, short_batches, sliced, spool

DOCUMENTS, RANKS = 10, 10
#: Bytes of text that are counted together; of a longer text, read at once.
HELD, TEXT_BYTES = 1 << 24, 1 << 20
#: Rows of terms' counts tallied together, pairs of sources at once, combinations held before they are passed on.
ROWS_AT_ONCE, PAIRS_AT_ONCE, COMBINATIONS = 1 << 17, 1 << 21, 400_000
#: A source's kept terms are ranked in so many parts first.
SALT = 16
#: Capitals become small, all else in ASCII but letters a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes, limit: int = TEXT_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in order, lower-cased, in lists from pieces of `limit` bytes or as far as the next term's end."""
    at = 0
    while at < len(text):
        to = at + limit
        while to < len(text) and FOLD[text[to]] != 32:
            to += 1
        yield text[at:to].translate(FOLD).split()
        at = to


def group_of(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"))]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents."""
    short_batches(docs.sparkSession)

    names = ["lang", "source", "term", "n", "docs"]

    def counted(groups: list[tuple[str, str]], texts: list[bytes]) -> pa.RecordBatch:
        """The counts of several texts, each of a group."""
        of_group: dict[tuple[str, str], int] = {}
        group = np.array([of_group.setdefault(g, len(of_group)) for g in groups], np.int64)
        words = pc.ascii_split_whitespace(pa.array([t.translate(FOLD) for t in texts], pa.binary()).cast(pa.string()))
        flat, text = words.flatten(), pc.list_parent_indices(words)
        real = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(real).dictionary_encode()
        term, text, width = coded.indices.to_numpy().astype(np.int64), text.filter(real).to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        pairs, n = np.unique(text * width + term, return_counts=True)
        key = group[pairs // width] * width + pairs % width
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        docs = np.diff(starts, append=len(key))
        langs, sources = (pa.array([g[k] for g in of_group], pa.string()) for k in range(2))
        key = key[starts]
        of, term = pa.array(key // width), pa.array(key % width)
        return pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), coded.dictionary.take(term), pa.array(np.add.reduceat(n, starts) if len(starts) else n), pa.array(docs)], names)

    def run(batches):
        groups, texts, size = [], [], 0
        for b in sliced(batches, 2):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2))):
                if len(text) > HELD:  # by itself, in pieces
                    n: Counter = Counter()
                    for part in terms(text):
                        n.update(part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(n, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([1] * len(n), pa.int64())], names)
                    continue
                groups.append((lang, source))
                texts.append(text)
                size += len(text) + 1
            if size > HELD:
                yield counted(groups, texts)
                groups, texts, size = [], [], 0
        if texts:
            yield counted(groups, texts)

    texts = docs.select(*group_of(lang_col, source_col), F.col(text_col).alias("text"))
    found = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(1e9 (n + 2) / (total + 2 kept)), exact."""
    return F.call_function("div", (n.cast("decimal(20,0)") + F.lit(2)) * F.lit(10**9).cast("decimal(10,0)"), F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)")) + F.lit(1)


def apart(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / (p + q)); shares are at most 1e9 + 1, so squares are longs."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def slices(sizes: np.ndarray, limit: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs a < b within runs of the given sizes that lie end to end, at most about `limit` at once."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(after)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right")))
        here = after[at:to]
        a = np.repeat(np.arange(at, to), here)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(here) - here, here)
        at = to


def tallies(cells: DataFrame) -> DataFrame:
    """(lang, s, t, c, d, m): for m terms source s has the count c > 0 and t, which comes after s, d > 0. cells: (lang, term, source, n)."""
    dealt = cells.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")

    def run(batches):
        names: dict[tuple[str, str], int] = {}
        sums: Counter = Counter()

        def out():
            if sums:
                listed = list(names)
                s, t, c, d = zip(*sums)
                columns = [[listed[x][0] for x in s], [listed[x][1] for x in s], [listed[x][1] for x in t], c, d, list(sums.values())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 3)], ["lang", "s", "t", "c", "d", "m"])
                sums.clear()

        def tally(rows: pa.Table, starts: np.ndarray):
            group = np.array([names.setdefault(k, len(names)) for k in zip(rows["lang"].to_pylist(), rows["source"].to_pylist())])
            counts, n = np.unique(rows["n"].to_numpy(), return_inverse=True)
            for x, y in slices(np.diff(np.append(starts, rows.num_rows))):
                who, what = group[x] * len(names) + group[y], n[x] * len(counts) + n[y]
                if len(names) * len(counts) >= 1 << 31:  # a code for both would pass 64 bits
                    who, what = pd.factorize(who)[0], pd.factorize(what)[0]
                _, first, m = np.unique(who * (int(what.max(initial=0)) + 1) + what, return_index=True, return_counts=True)
                x, y = x[first], y[first]
                for key, k in zip(zip(group[x].tolist(), group[y].tolist(), counts[n[x]].tolist(), counts[n[y]].tolist()), m.tolist()):
                    sums[key] += k
                if len(sums) > COMBINATIONS:
                    yield from out()

        held, count = [], 0

        def whole(last: bool):
            """Tallies what is held but for the last term, whose rows may go on; with `last` all of it."""
            rows = pa.Table.from_batches(held).combine_chunks()
            changed = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (rows["lang"].combine_chunks(), rows["term"].combine_chunks())]
            starts = np.append(0, np.flatnonzero(changed[0] | changed[1]) + 1)
            if last:
                yield from tally(rows, starts)
            elif len(starts) > 1:
                yield from tally(rows.slice(0, int(starts[-1])), starts[:-1])
                held[:] = rows.slice(int(starts[-1])).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= ROWS_AT_ONCE:
                yield from whole(False)
                count = 0
        if held:
            yield from whole(True)
        yield from out()

    return dealt.mapInArrow(run, "lang string, s string, t string, c bigint, d bigint, m bigint").groupBy("lang", "s", "t", "c", "d").agg(F.sum("m").alias("m"))


def _combination(c: Column, d: Column, m: Column) -> Column:
    return F.struct(c.cast("long").alias("c"), d.cast("long").alias("d"), m.cast("long").alias("m"))


def histograms(cells: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, s, t, c, d, m) for every pair of a language's sources with s before t: for m of the V terms s has the count c and t d.

    Combinations with a zero follow from what is known: a source's own histogram less what the pair has together, and for (0, 0)
    V less the terms of both, plus the common ones.
    """
    own = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    left, right = groups.select("lang", F.col("source").alias("s")), groups.select("lang", F.col("source").alias("t"))
    zero, c, d, n, m = F.lit(0), F.col("c"), F.col("d"), F.col("n"), F.col("m")
    both = spool(tallies(cells), "tallies")
    parts = (
        (both, [(c, zero, -m), (zero, d, -m), (zero, zero, m)]),
        (own.withColumnRenamed("source", "s").join(right, "lang").where("s < t"), [(n, zero, m), (zero, zero, -m)]),
        (own.withColumnRenamed("source", "t").join(left, "lang").where("s < t"), [(zero, n, m), (zero, zero, -m)]),
        (left.join(right, "lang").where("s < t").join(langs, "lang"), [(zero, zero, F.col("v"))]),
    )
    every = None
    for rows, found in parts:
        part = rows.select("lang", "s", "t", F.explode(F.array(*[_combination(*x) for x in found])).alias("x")).select("lang", "s", "t", "x.*")
        every = part if every is None else every.unionByName(part)
    rest = every.groupBy("lang", "s", "t", "c", "d").agg(F.sum("m").alias("m")).where("m <> 0 or (c = 0 and d = 0)")
    return both.unionByName(rest)


def audit(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of every group from each other source of its language (part `pair`),
    and the terms that it uses more than its language does (part `term`, up to `ranks`)."""
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumn("all", F.sum("n").over(of_term)).withColumn("docs", F.sum("docs").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    cells = spool(counted.where(F.col("docs") >= documents).drop("docs"), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("v"))
    groups = docs.select(*group_of("lang", "source")).distinct().join(totals, ["lang", "source"], "left")
    groups = spool(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    langs = spool(groups.groupBy("lang").agg(F.sum("total").alias("of_lang"), F.sum("v").alias("v")), "langs")
    groups = groups.drop("v")

    cells_of = histograms(cells, groups, langs.select("lang", "v"))
    of = lambda x: groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"))
    known = cells_of.join(of("s"), ["lang", "s"]).join(of("t"), ["lang", "t"]).join(langs, "lang")
    value = F.when(F.col("v") > 0, F.col("m") * apart(share(F.col("c"), F.col("total_s"), F.col("v")), share(F.col("d"), F.col("total_t"), F.col("v")))).otherwise(F.lit(0))
    sums = known.groupBy("lang", "s", "t").agg(F.sum(value).alias("value"))
    sides = F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))
    pairs = sums.select("lang", F.explode(sides).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    p = share(F.col("n"), F.col("total"), F.col("v"))
    q = share(F.col("all"), F.col("of_lang"), F.col("v"))
    used = cells.join(groups, ["lang", "source"]).join(langs, "lang").select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    order = [F.col("value").desc(), F.col("item")]
    used = used.select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("p"), F.col("q")).alias("value"))
    part = F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))
    best = used.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALT))).withColumn("k", part).where(F.col("k") <= ranks).drop("salt", "k")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    return pairs.unionByName(best).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
