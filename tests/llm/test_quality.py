import random
import zlib

import numpy as np
import pytest

from lucerna.llm import quality


def corpus(n=1200, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["tion", "the", "of", "an", "er", "in"]) + rng.choice(["ly", "ed", "ing", ""]) for _ in range(rng.randint(20, 120))]
        good = rng.random() < 0.75
        kind = rng.randrange(3)
        text = " ".join(words) + "." if good else [" ".join(w.upper() + "!!" for w in words), " ".join(w + rng.choice(["***", "$$$"]) for w in words), " ".join([words[0]] * 60)][kind]
        docs.append((i, text))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(d, quality.train(d, l)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97


def test_what_labels_are_learned(spark):
    """Turning the held-out labels round changes no score; nor does leaving out, doubling or keeping negative ones."""
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    turned = [(i, 1 - q if held(i) else q) for i, q in labels]
    none = [(i, q) for i, q in labels if q == 1]
    more = labels + [(i, 0) for i, q in labels if q == 0] + [(10_000 + k, 0) for k in range(300)]
    a, *others = (quality.score(d, quality.train(d, spark.createDataFrame(x, "doc_id long, quality int"))).orderBy("doc_id").collect() for x in (labels, turned, none, more))
    assert all(a == b for b in others)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.87])
def test_class_prior(share):
    """The prior comes from positives and unlabelled rows alone."""
    rng = np.random.default_rng(int(100 * share))
    good, bad = lambda n: rng.normal(1, 1, (n, 6)), lambda n: rng.normal(-1.2, 1, (n, 6))
    n = int(4000 * share)
    assert abs(quality.class_prior(good(3000), np.concatenate([good(n), bad(4000 - n)])) - share) < 0.04


def test_risk_is_not_negative():
    """The model fits the classes without driving the negatives' estimated risk below zero by much."""
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 1, (2000, 5)), rng.normal(-1, 1, (1000, 5))
    u = np.concatenate([rng.normal(1, 1, (1400, 5)), rng.normal(-1, 1, (600, 5))])
    model = quality.fit(p, u, 0.7)
    assert (quality.probability(model, p) > 0.5).mean() > 0.95 and (quality.probability(model, n) < 0.5).mean() > 0.9
    risk = np.logaddexp(0, quality.logits(model, u)).mean() - 0.7 * np.logaddexp(0, quality.logits(model, p)).mean()
    assert risk > -0.05


def test_odd_tables(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (None, 1), (9, None), (777, 1)], "doc_id long, quality int")
    got = quality.score(hard, quality.train(hard, labels)).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in quality.score(hard, quality.train(hard, none)).collect()} == {0.5}
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    kept = quality.accepted(hard, quality.train(hard, labels))
    assert kept.columns == hard.columns
