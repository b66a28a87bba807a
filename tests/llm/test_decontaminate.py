import hashlib
import random
import re

from lucerna.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for i, item in items:
        x = words(item)
        n = min(window, len(x))
        if not n:
            continue
        for s in range(len(x) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def corpus(seed, n_docs=120):
    rng = random.Random(seed)
    say = lambda n: [rng.choice("The of cat É漢 x1 dog's run AND sun".split()) if rng.random() < 0.6 else f"w{rng.randint(0, 40)}" for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 2, 4, 5, 6, 12, 13, 14, 30])))) for i in range(20)]
    items += [(20, None), (21, "--- !!"), (22, items[3][1]), (3, items[5][1]), (None, items[6][1])]
    docs = []
    for k in range(n_docs):
        text = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items)[1] or "").split()
            cut = item[rng.randint(0, 3) :] if rng.random() < 0.5 else item
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() if rng.random() < 0.5 and x.isascii() else x for x in cut]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs + [(None, items[0][1]), (0, docs[0][1]), (500, None), (501, "")], items


def rows(df):
    return sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def check(spark, docs, items, **options):
    left = spark.createDataFrame([(*x, "b") for x in docs], "doc_id long, text string, items string")
    right = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    want = sorted((i is None, i, *brute(t, [(x, y) for x, y in items])) for i, t in docs)
    assert rows(d.report(d.decontaminate(left, right, **options))) == want
    return want


def test_brute_force(spark):
    want = check(spark, *corpus(1))
    assert sum(x[-1] for x in want) > 20 and sum(not x[-1] for x in want) > 10


def test_blocks_of_benchmark(spark):
    """A benchmark in many broadcast blocks gives the same rows."""
    docs, items = corpus(2, 40)
    check(spark, docs, items, block_words=40)
    check(spark, docs, items, block_words=150, hashes=60)


def test_hard_texts(spark, hard, empty):
    bench = spark.createDataFrame([(1, "a"), (2, "word word word word word word")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit) for r in d.report(d.decontaminate(hard, bench)).collect()}
    assert (5, 30_000) in got and (3, 1) in got and (0, 0) in got
    assert d.report(d.decontaminate(empty, bench)).count() == 0
    none = bench.limit(0)
    assert d.report(d.decontaminate(hard, none)).where("n_hit > 0").count() == 0


def test_one_worker_a_task(spark):
    """Steps in a row each hold a Python worker of their own for every task."""
    docs, items = corpus(3)
    found = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
