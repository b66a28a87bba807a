import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lucerna.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip(spark, hard):
    """Pieces are the tokenizer's ids in place; sequences are full from 0 without gaps and hold every token once."""
    rows = packing.pack(packing.pieces(hard, "doc_id", "text", RANKS, with_ids=True)).collect()
    want = {}
    encode = tokenizer()
    for r in hard.collect():
        want.setdefault(r.doc_id, []).append([*encode.encode(r.text or "", add_special_tokens=False).ids, 2])
    by_doc, by_seq = {}, {}
    for r in rows:
        assert 1 <= r.length <= 1024 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for doc, texts in want.items():
        parts = sorted(by_doc[doc], key=lambda r: (r.piece, r.start))
        if len(texts) == 1:
            assert [x for r in parts for x in r.ids] == texts[0]
            assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
            assert all(r.length == 1024 for r in parts[1:])
        else:
            assert sorted(tuple(r.ids) for r in parts) == sorted(map(tuple, texts))
    for parts in by_seq.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    flat = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(packing.pieces(hard, "doc_id", "text", RANKS, with_ids=True))).collect()}
    assert sum(map(len, flat.values())) == sum(r.length for r in rows)


def test_same_ids_as_tokenizers():
    encode, mine = tokenizer(), packing.encoder(RANKS)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["the", " ", "\n", "é", "漢", "😀", "don't", "123", "  ", "<|endoftext|>", "\t", "ing", "$", "ß"]) for _ in range(rng.randint(0, 80)))
        assert mine(text) == encode.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 1_000_000, "\t" * 1_000_000 + "x", "x" * 1_000_000, " \n" * 500_000 + "<|endoftext|>"], ids=["spaces", "lines", "tabs", "letters", "both"])
def test_long_runs(spark, text):
    """A million signs of a kind end neither the query nor differ from the tokenizer's ids."""
    ids = [*tokenizer().encode(text, add_special_tokens=False).ids, 2]
    rows = packing.pieces(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string"), "doc_id", "text", RANKS, with_ids=True).collect()
    assert [x for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == 1 for x in r.ids] == ids


def optimum(lengths, capacity):
    """Fewest bins, by trying every place."""
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + lengths[k] <= capacity:
                bins[i] += lengths[k]
                go(k + 1, bins)
                bins[i] -= lengths[k]
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_few_bins(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(5, 60) for _ in range(10)), reverse=True)
    hist = np.bincount(lengths, minlength=101)
    bins = packing.solve(hist)
    used = np.zeros(101, int)
    for content, times in bins:
        assert sum(content) <= 100
        for w in content:
            used[w] += times
    assert (used == hist).all()
    least = optimum(lengths, 100)
    assert packing.bound(hist) <= least <= sum(n for _, n in bins) <= sum(n for _, n in packing.best_fit(hist))
    assert sum(n for _, n in bins) == least


def test_branching_beats_best_fit():
    """Pieces on which best fit alone takes a sequence more than needed."""
    rng, better = random.Random(5), 0
    for _ in range(200):
        hist = np.bincount([rng.randint(15, 60) for _ in range(12)], minlength=101)
        fit, found = sum(n for _, n in packing.best_fit(hist)), sum(n for _, n in packing.solve(hist))
        assert packing.bound(hist) <= found <= fit
        better += found < fit
    assert better


@pytest.mark.parametrize("capacity, lengths", [(39, [7, 11, 13, 13, 14, 15, 17, 19, 21, 22]), (41, [9, 11, 11, 13, 16, 19, 19, 19, 20, 23]), (44, [11, 11, 14, 14, 17, 17, 18, 21, 22, 23]), (55, [11, 14, 16, 20, 22, 23, 23, 23, 28, 31])])
def test_all_completions(capacity, lengths):
    """Pieces that need a filling beyond those of the dives; the completions of a bin are those to which nothing can be added."""
    hist = np.bincount(lengths, minlength=capacity + 1)
    bins = packing.solve(hist)
    assert sum(n for _, n in bins) == 4 and sorted(w for content, n in bins for w in content * n) == lengths
    first, others = lengths[-1], lengths[:-1]
    want = set()
    for mask in range(1 << len(others)):
        part = [w for k, w in enumerate(others) if mask >> k & 1]
        room = capacity - first - sum(part)
        if room >= 0 and all(w > room for k, w in enumerate(others) if not mask >> k & 1):
            want.add((first, *sorted(part, reverse=True)))
    got = list(packing.completions(hist, first))
    assert len(got) == len(set(got)) and set(got) == want


def test_many_short_pieces_end():
    hist = np.bincount([*range(1, 40), 1024, 700, 400], minlength=1025)
    assert len(list(packing.completions(np.bincount([*range(1, 40), 200], minlength=1025), 200))) == 1
    assert sum(n for _, n in packing.solve(hist)) == packing.bound(hist)


def test_hot_length(spark):
    """A length that nearly all rows share still gets distinct places."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 10 = 0, 700L, 300L) AS length", "id AS ids_crc32")
    got = packing.pack(rows.selectExpr("doc_id", "piece", "start", "length", "ids_crc32"))
    assert got.select("sequence_id", "offset").distinct().count() == 20_000
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_equal_rows(spark):
    """Rows that are all alike are spread over the groups, and each gets its own place."""
    rows = spark.range(30_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "7L AS ids_crc32")
    got = packing.pack(rows)
    assert got.select("sequence_id", "offset").distinct().count() == 30_000 and got.agg({"sequence_id": "max"}).first()[0] == 29


def test_empty(spark, empty):
    assert packing.pack(packing.pieces(empty, "doc_id", "text", RANKS)).count() == 0
