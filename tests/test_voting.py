import random
from collections import Counter

from lucerna.operators import voting

KIND = "k long, sample_ix int, type string, choices struct<text:array<string>,label:array<string>>, answer string, answer_normalized string, parse_success boolean, refusal boolean"


def run(spark, questions, kind="open-ended-qa", min_valid=3):
    rows = [(k, i, kind, None, a, n, ok, no) for k, q in enumerate(questions) for i, (a, n, ok, no) in enumerate(q)]
    got = voting.majority(voting.votes(spark.createDataFrame(rows, KIND)), ["k"], min_valid).orderBy("k").collect()
    return [r.asDict(recursive=True) for r in got]


def ok(*answers):
    return [(a, None, True, False) for a in answers]


def test_known_votes(spark):
    got = run(spark, [ok("A", "a.", "B", "A ", "b!"), ok("x", "y", "y", "x"), ok("x", "y"), [("x", None, False, False), ("y", None, True, True)], ok("?!", "..", ""), [("raw", "Norm", True, False)] * 3])
    assert (got[0]["final_answer"], got[0]["agreement_ratio"], got[0]["tie_broken"], got[0]["sc_success"]) == ("a", 0.6, False, True)
    assert (got[1]["final_answer"], got[1]["tie_broken"]) == ("x", True)
    assert (got[2]["final_answer"], got[2]["sc_success"], got[2]["tie_broken"], got[2]["agreement_ratio"]) == ("x", False, False, 0.5)
    assert (got[3]["final_answer"], got[3]["valid_samples"], got[3]["total_samples"], got[3]["agreement_ratio"]) == ("", 0, 2, 0.0)
    assert (got[4]["final_answer"], got[4]["votes"], got[4]["valid_samples"]) == ("", 0, 3)
    assert got[5]["final_answer"] == "norm" and got[5]["vote_counts"] == [{"answer": "norm", "n": 3}]


def test_random_votes(spark):
    rng = random.Random(0)
    questions = [[(rng.choice(["one", "Two", "two.", "three", ""]), None, rng.random() < 0.9, rng.random() < 0.1) for _ in range(rng.randint(1, 9))] for _ in range(200)]
    for got, samples in zip(run(spark, questions), questions):
        valid = [a for a, _, good, no in samples if good and not no]
        votes = [v for a in valid if (v := a.strip().lower().rstrip(".!?,;:"))]
        order = Counter(votes).most_common()
        assert got["vote_counts"] == [{"answer": a, "n": n} for a, n in order]
        assert got["final_answer"] == (order[0][0] if order else "")
        assert got["sc_success"] == (len(votes) >= 3) and got["valid_samples"] == len(valid) and got["total_samples"] == len(samples)
        assert got["tie_broken"] == (len(votes) >= 3 and len(order) > 1 and order[0][1] == order[1][1])
