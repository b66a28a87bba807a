"""Native parsing against cases with known results and against a plain Python reading of the same rules."""

import difflib
import random
import re

import pytest

from lucerna.functions import normalise, parsing
from lucerna.functions import vocabulary as V

CH4 = {"text": ["Water boils at 100 C", "Water freezes at 100 C", "Ice is a gas", "None of these"], "label": ["A", "B", "C", "D"]}
CH2 = {"text": ["Yes it does", "No it does not"], "label": []}
MC, TF, OPEN = "mcq-4-choices", "true_or_false", "open-ended-qa"
SCHEMA = "raw_response string, strategy string, type string, choices struct<text:array<string>,label:array<string>>"

CASES = [
    ("ANSWER: B\nJUSTIFICATION: because", "da", MC, CH4, {"answer": "B", "answer_normalized": "B", "justification": "because", "parse_success": True, "parse_errors": []}),
    ("ANSWER: some words\nJUSTIFICATION: x", "da", OPEN, None, {"answer_normalized": "some words", "parse_success": True}),
    ("ANSWER: A\nKEY REASONING: k\nUNCERTAINTY: u\nCONFIDENCE:  HIGH ", "ras", MC, CH4, {"key_reasoning": "k", "uncertainty": "u", "confidence": "high", "answer_normalized": "A"}),
    ("ANSWER: True\nRATIONALE: r", "ctl", TF, None, {"answer": "True", "answer_normalized": "Yes", "rationale": "r"}),
    ("Well, let me see.\nanswer: c\njustification: y", "da", MC, CH4, {"answer_normalized": "C", "justification": "y"}),
    ("**ANSWER**: D\n**JUSTIFICATION**: z", "da", MC, CH4, {"answer": "D", "answer_normalized": "D", "justification": "z"}),
    ("**ANSWER:** D\n**JUSTIFICATION:** z", "da", MC, CH4, {"answer_normalized": "D", "parse_success": True}),
    ("<think>ANSWER: A</think>ANSWER: B", "da", MC, CH4, {"answer_normalized": "B", "think_block_removed": True}),
    ("<think>never closed ANSWER: B", "da", MC, CH4, {"think_block_removed": False, "answer_normalized": "B"}),
    ("```\nANSWER: B\n```", "da", MC, CH4, {"answer_normalized": "B"}),
    ("ANSWER: B) Water freezes", "da", MC, CH4, {"answer_normalized": "B"}),
    ("ANSWER: water boils at 100", "da", MC, CH4, {"answer_normalized": "A"}),
    ("ANSWER: water boils at 100 c", "da", MC, CH4, {"answer_normalized": "C"}),  # a letter at the end comes before likeness
    ("ANSWER: The correct option is (C)", "da", MC, CH4, {"answer_normalized": "C"}),
    ("ANSWER: xyz", "da", MC, CH4, {"answer_normalized": None, "parse_success": False, "parse_errors": ["mc_normalization_failed"]}),
    ("ANSWER: it does not", "da", "mcq-2-choices", CH2, {"answer_normalized": "B"}),
    ("ANSWER: one\nANSWER: two", "da", OPEN, None, {"answer": "two"}),
    ("no label here\nsecond", "da", OPEN, None, {"answer": "no label here", "parse_success": True, "parse_errors": ["answer_field_missing_used_fallback"]}),
    ("", "da", MC, CH4, {"parse_success": False, "parse_errors": ["empty_response"], "answer": None}),
    ("  \n ", "ctl", OPEN, None, {"parse_success": False, "parse_errors": ["empty_response"]}),
    (None, "ctl", OPEN, None, {"parse_success": False, "parse_errors": ["empty_response"], "raw_response": ""}),
    ("I cannot answer that.", "da", MC, CH4, {"refusal": True, "parse_success": True, "answer": "REFUSED", "answer_normalized": "REFUSED", "parse_errors": []}),
    ("ANSWER: A\nKEY REASONING: only", "ras", MC, CH4, {"answer_normalized": "A", "uncertainty": None, "confidence": None}),
    ("答案：正确\n理由：这是因为证据充分", "da", OPEN, None, {"answer": "正确", "justification": "这是因为证据充分"}),
    ("ANSWER: protein binds END", "da", "relation_extraction", None, {"answer_normalized": "protein binds"}),
]


def parsed(spark, rows, **options):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + SCHEMA)
    return [r.parsed.asDict() for r in parsing.parse(df, **options).orderBy("k").collect()]


def test_known_cases(spark):
    for got, (raw, *_, want) in zip(parsed(spark, [c[:4] for c in CASES]), CASES):
        assert {k: got[k] for k in want} == want, raw


@pytest.mark.parametrize("text,want", [("[1] and [3]", [1, 3]), ("[1, 2][2]", [1, 2]), ("(4) passage 1 and Passage 3", [1, 3, 4]), ("source 11, Source 10 [0]", [10]), ("none", []), ("[99999999999999999999]", []), ("", [])])
def test_citations(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalise.citations(df.t)).first()[0] == want


def test_citations_only_from_fields_with_passages(spark):
    rows = [("see [5]\nANSWER: x [1]\nJUSTIFICATION: by passage 2 and [12]", "da", OPEN, None)]
    assert parsed(spark, rows, mode="rag")[0]["citations"] == [1, 2]
    assert parsed(spark, rows)[0]["citations"] == []


# ---- a plain reading of the rules ----

NAMES = "|".join(V.LABELS)


def plain_choice(raw, choices):
    a = raw.strip()
    labels = choices["label"] if len(choices["label"]) >= len(choices["text"]) else [chr(65 + k) for k in range(len(choices["text"]))]
    valid = {x.upper() for x in labels}
    for rx, flags, how in ((r"\s*\(?([A-Fa-f])\)?\s*$", 0, re.match), (r"\s*\(?([A-F])\)?[).:\s]+\S", re.I, re.match), (r"(?:answer|option|choice)\s+(?:is\s+)?[(\[]?([A-F])[)\]]?\b", re.I, re.search), (r"\b([A-Fa-f])\s*\.?\s*$", 0, re.search)):
        if (m := how(rx, a, flags)) and m[1].upper() in valid:
            return m[1].upper()
    near = [difflib.SequenceMatcher(None, a.lower(), t.lower()).ratio() for t in choices["text"]]
    if near and max(near) >= 0.8:
        return labels[near.index(max(near))].upper()
    sole = {c.upper() for c in a} & valid
    return sole.pop() if len(sole) == 1 else None


def plain_normal(raw, kind, choices):
    if not raw or not raw.strip():
        return None
    if kind in V.CHOICE_TYPES and choices:
        return plain_choice(raw, choices)
    a = raw.strip()
    if kind == TF:
        a = a.lower()
        if a in V.TRUTH_WORDS:
            return V.TRUTH_WORDS[a]
        for w in ("yes", "no"):
            if a.startswith(w):
                return V.TRUTH_WORDS[w]
        m = re.search(rf"\b({'|'.join(V.TRUTH_WORDS)})\b", a)
        return m and V.TRUTH_WORDS[m[1]]
    return a[:-3].strip() if a.endswith("END") else a


def plain(raw, strategy, kind, choices):
    out = dict.fromkeys(("answer", "answer_normalized", "justification", "rationale", "key_reasoning", "uncertainty", "confidence")) | {"parse_success": False, "parse_errors": [], "refusal": False, "think_block_removed": False}
    if not raw or not raw.strip():
        return out | {"parse_errors": ["empty_response"]}
    text = re.sub(r"<\|?think\|?>.*?<\|?/?think\|?>", "", raw, flags=re.S)
    out["think_block_removed"] = text != raw
    text = text.strip()
    out["refusal"] = bool(re.search("|".join(V.REFUSALS), text, re.I))
    if m := re.search(rf"(?:^|\n)\s*\**?(?:\*{{1,3}})?(?:{NAMES})(?:\*{{1,3}})?\s*:", text, re.I):
        if re.match(rf"(?:^|\n)\s*(?:\*{{1,3}})?(?:{NAMES})", m[0], re.I):
            text = text[m.start() :].lstrip("\n")
    for rx, by, flags in ((r"```\w*\n?|```", "", 0), (rf"\*{{1,3}}({NAMES})\*{{1,3}}", r"\1", re.I), (rf"`({NAMES})`", r"\1", re.I), (r"^#{1,4}\s*", "", re.M)):
        text = re.sub(rx, by, text, flags=flags)
    own = "|".join(V.STRATEGY_LABELS[strategy])
    fields = {m[1].strip().upper(): m[2].strip() for m in re.finditer(rf"({own})\s*:\s*(.*?)(?=(?:{own})\s*:|$)", text, re.S | re.I)}
    answer = fields.get("ANSWER")
    if answer:
        out["answer"], out["answer_normalized"] = answer, plain_normal(answer, kind, choices)
        if out["answer_normalized"] is None and kind in V.CHOICE_TYPES:
            out["parse_errors"] = ["mc_normalization_failed"]
    elif not out["refusal"]:
        line = next((x.strip() for x in text.strip().split("\n") if x.strip()), None)
        out["parse_errors"] = ["answer_field_missing_used_fallback" if line else "answer_field_missing"]
        if line:
            out["answer"], out["answer_normalized"] = line, plain_normal(line, kind, choices)
    for k, label in (("justification", "JUSTIFICATION"), ("rationale", "RATIONALE"), ("key_reasoning", "KEY REASONING"), ("uncertainty", "UNCERTAINTY")):
        out[k] = fields.get(label)
    out["confidence"] = fields.get("CONFIDENCE", "").strip().lower() or None
    if out["refusal"]:
        out |= {"parse_success": True, "answer": out["answer"] or "REFUSED", "answer_normalized": out["answer_normalized"] or "REFUSED"}
    elif out["answer_normalized"] is not None:
        out["parse_success"] = True
    elif out["answer"] is not None and kind in V.OPEN_TYPES:
        out |= {"answer_normalized": out["answer"], "parse_success": True}
    return out


PARTS = ["ANSWER", "answer", "JUSTIFICATION", "Key Reasoning", "CONFIDENCE", "RATIONALE", "UNCERTAINTY", ":", ": ", "\n", "\n\n", "**", "***", "`", "```", "```text\n", "# ", "<think>", "</think>", "<|think|>", " ", "A", "b", "(C)", "D.", "the answer is B", "Water boils at 100 C", "yes", "No", "nothing", "incorrect", "END", "I cannot", "as an AI", "\t", "é", " ", "\r\n", "text of the thing", "high"]


@pytest.mark.parametrize("seed", range(4))
def test_random_noise(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        kind = rng.choice([MC, "mcq-2-choices", TF, OPEN, "filling"])
        rows.append(("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))), rng.choice(V.STRATEGIES), kind, {MC: CH4, "mcq-2-choices": CH2}.get(kind) if rng.random() < 0.9 else None))
    for got, row in zip(parsed(spark, rows), rows):
        want = plain(*row)
        assert {k: got[k] for k in want} == want, row


# ---- hostile texts ----

N = 1_000_000
HOSTILE = {
    "list": "[" + "1," * (N // 2) + "1]", "lists": "[1]" * (N // 3), "open list": "[" + "1, " * (N // 3), "brackets": "[" * N, "parens": "(1" * (N // 2), "digits": "(" + "1" * N, "passages": "passage " * (N // 8),
    "lines": "x" + "\n" * N + "x", "spaces": "x" + " " * N + "x", "both": " \n" * (N // 2) + "x", "stars": "x" + "*" * N + "x", "ticks": "`" * N, "hashes": "\n#" * (N // 2), "ends": "x" + "!" * N + "x",
    "labels": "ANSWER" * (N // 6), "fields": "\nANSWER:" * (N // 8), "label run": "ANSWER" + " " * N, "letters": "a " * (N // 2) + "x", "letter run": "a" + " " * N + "x", "answers": "answer " * (N // 7), "thoughts": "<think>" * (N // 7),
    "chinese": "答案" * (N // 2), "reasons": "理由:" * (N // 3), "chinese run": "答案:" + "\n" * N, "refusal run": "I" + " " * N + "x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_linear_time(spark, name):
    """All text functions together on a megabyte; quadratic ones would take hours, repeated groups end the JVM."""
    import time

    from pyspark.sql import functions as F

    from lucerna.functions import text

    df, t = spark.createDataFrame([(HOSTILE[name],)], "t string"), F.col("t")
    every = [
        text.strip(t), parsing.without_thinking(t), parsing.without_preamble(t), parsing.without_markup(t), parsing.labelled(t, V.LABELS), parsing.refuses(t), parsing.chinese(t), parsing.chinese_value(t, "ANSWER"),
        parsing.chinese_value(t, "JUSTIFICATION"), parsing.first_line(t), normalise.citations(t), normalise.truth(t), normalise.open_answer(t), normalise.vote_text(t), normalise.stated_letter(t, F.lit(["A", "B"])), normalise.sole_letter(t, F.lit(["A", "B"])),
    ]
    began = time.time()
    df.select(*[F.xxhash64(c) for c in every]).collect()
    assert time.time() - began < 20


def test_citations_by_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["[", "]", "(", ")", ",", " ", "1", "2", "10", "11", "\n", "\x1c", "passage ", "Passage", "source  ", "SOURCE 3", "x", "\t7", "[3, 4]", "(5)", "[6 ]", "[ 8]", "[9,]"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.c for r in df.select("k", normalise.citations(df.t).alias("c")).collect()}
    for k, t in enumerate(texts):
        numbers = [y.strip() for x in re.findall(r"\[(\d+(?:\s*,\s*\d+)*)\]", t) for y in x.split(",")] + re.findall(r"\((\d+)\)", t) + re.findall(r"(?:[Pp]assage|[Ss]ource)\s+(\d+)", t)
        assert got[k] == sorted({int(n) for n in numbers if 1 <= int(n) <= 10}), t
