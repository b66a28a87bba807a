from pyspark.sql import functions as F

import corpus_pipeline as cp
from lucerna.llm import packing, quality, simhash
from lucerna.llm.common import spool, table
from .test_decontaminate import brute as contaminated
from .test_secrets import brute as secret_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against brute force on its own input, over whole tables."""
    docs = table(spark, SF, "documents")
    names = docs.columns
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    (q, d, b, s, p) = [f for _, f in cp.STAGES]

    kept = spool(q(spark, docs, SF), "t")
    scores = quality.score(docs, quality.train(docs, table(spark, SF, "labels")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.where("predicted = 1").collect())

    rows = kept.collect()
    sets = [simhash.shingles((r.text or "").encode()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(r.doc_id, least.get(find(k), r.doc_id))
    distinct = spool(d(spark, kept, SF), "t")
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(least.values()) and len(least) < len(rows)

    clean = spool(b(spark, distinct, SF), "t")
    want = [r.doc_id for r in distinct.collect() if not contaminated(r.text, items)[-1]]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want) and len(want) < distinct.count()

    masked = spool(s(spark, clean, SF), "t")
    assert masked.count() == clean.count() and not any(secret_spans(r.text) for r in masked.collect())
    before = {r.doc_id: r.text for r in clean.collect()}
    assert all((r.text == before[r.doc_id]) == (not secret_spans(before[r.doc_id])) for r in masked.collect())
    assert all(x.columns == names for x in (kept, distinct, clean, masked))

    packed = p(spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked.collect()}
    assert {(r.sequence_id, r.offset) for r in packed}.__len__() == len(packed)
    assert cp.run(spark, SF).count() == len(packed)
    assert packing.CAPACITY == 1024


def test_odd_documents(spark):
    """Null ids and texts, repeated ids with other texts, an empty table."""
    rows = [(1, "some words here and there", "en", "s", 25), (1, "quite different words are in this row", "en", "s", 37), (2, "some words here and there", "en", "s", 25), (None, None, None, None, None), (None, "x", None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_dedup_stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "3", "None"]
    assert cp.quality_stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    item = table(spark, SF, "benchmark").first().text
    several = spark.createDataFrame([(7, item, "en", "s", 1), (7, "clean words", "en", "s", 1), (None, item, None, None, None), (None, "clean words", None, None, None), (None, None, None, None, None)], docs.schema)
    assert sorted(str(r.text) for r in cp.decontamination_stage(spark, several, SF).collect()) == ["None", "clean words", "clean words"]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).count()


def test_clashing_columns(spark):
    """Extra columns, also with the names that stages use or with a dot, stay as they are."""
    docs = table(spark, SF, "documents").limit(40)
    docs = docs.unionByName(docs.limit(3))
    names = ["gone", "Again", "bad", "bad_row", "row", "fp", "component_id", "n", "c0", "a.b", "quality", "score"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for _, stage in cp.STAGES[:-1]:
        kept = spool(stage(spark, docs, SF), "t")
        assert kept.columns == docs.columns
        assert {r[-len(names) :] for r in kept.collect()} <= {tuple(range(len(names)))}
    assert cp.packing_stage(spark, docs, SF).count() >= 43
