import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from lucerna.llm import secrets

BASE = [
    ("assign", re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def brute(text):
    out = []
    for k, (_, rx, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


PARTS = ["password", "PassWD", "SECRET", "token", "api_key", "apikey", ":", "= ", '"', "'", "AKIA", "ABCDEFGHIJ0123", "abcdef0123", "0123456789ab", " ", "é", "😀", ".", "eyJabcdefgh", ".eyJabcdefgh.x", "ſecret", "K", "ghp_", "-----BEGIN RSA PRIVATE KEY-----"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_base_spans(spark, hard):
    rows = [(k, t) for k, t in enumerate(texts(1, 400))] + [(r.doc_id, r.text) for r in hard.collect()]
    got = secrets.report(secrets.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int"))).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    want = []
    for i, t in rows:
        found = brute(t)
        want.append((i, *(sum(x.startswith(k) for x in found) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(found).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    for r in got:  # base spans stay among all spans, in order
        spans = r.spans.split(",") if r.spans else []
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


MORE = {
    "pem": (re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,. \t\r\n\\]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----)?"), 0, 1),
    "github": (re.compile(rb"gh[pousr]_([A-Za-z0-9]+)"), 1, 36), "slack": (re.compile(rb"xox[abprs]-[0-9]{6,}-([A-Za-z0-9-]+)"), 1, 10),
    "jwt": (re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 1),
}
BITS = ["-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-----END ", "\n", "\\n", "Proc-Type: 4,ENCRYPTED", "ab+/=", "--", "ghp_", "gho_", "a1B2c3D4" * 4, "xoxb-", "123456", "-", "eyJ", ".", "abcdefgh", "é", " ", "token", "=", ": ", "secret", "AKIA", "0123456789abcdef"]


@pytest.mark.parametrize("seed", range(3))
def test_all_kinds_lose_no_span(seed):
    """Random texts against each rule's own regex."""
    rng = random.Random(seed)
    scanner = secrets.compiled(secrets.RULES)
    every = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    every += ["x -----BEGIN EC PRIVATE KEY----- AB12 -----END EC PRIVATE KEY----- ghp_" + "a1B2" * 9 + " xoxb-123456789-abcdefghijkl eyJabcdefghi.eyJabcdefghi.sig-1", "token=secret: xtoken=abcdefghijkl", "-----BEGIN  PRIVATE KEY-----"]
    every.append("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0AF1\n\nabc+/=\n-----END RSA PRIVATE KEY-----")
    every.append('"-----BEGIN PRIVATE KEY-----\\nMIIab\\n-----END PRIVATE KEY-----\\n"')
    found, seen = secrets.found_in(scanner, [t.encode() for t in every]), set()
    for k, text in enumerate(every):
        data = text.encode()
        want = {tuple(x.split(":")) for x in brute(text)}
        for kind, (rx, group, least) in MORE.items():
            want |= {(kind, str(len(data[: m.start()].decode())), str(len(data[: m.end()].decode()))) for m in rx.finditer(data) if len(m[group]) >= least}
        assert {(secrets.RULES[r].kind, str(a), str(z)) for a, r, z in found.get(k, [])} == want, text
        seen |= {x[0] for x in want}
    assert seen == {r.kind for r in secrets.RULES}
    for text in every[-2:]:
        assert any(secrets.RULES[r].kind == "pem" and z - a > 50 for a, r, z in found[every.index(text)])


def test_hostile_texts_take_linear_time():
    import time

    scanner = secrets.compiled(secrets.RULES)
    for text in ("token=" * 150_000, "token" + " " * 1_000_000, "a" * 1_000_000 + "token=x", "-----BEGIN PRIVATE KEY-----a" * 30_000, "AKIA" * 250_000, "eyJabcdefgh." * 80_000, "0" * 1_000_000, "token: " * 140_000, "ghp_" * 250_000):
        began = time.time()
        secrets.found_in(scanner, [text.encode()])
        assert time.time() - began < 5, text[:30]


def test_states_that_carry_far_take_a_second_a_megabyte():
    import time

    scanner = secrets.compiled(secrets.RULES)
    for text in ("token" + " " * 1_000_000, "xoxa-" + "1" * 1_000_000, "-----BEGIN " + "A" * 1_000_000, "eyJ" + "a" * 1_000_000, ("x" * 1020 + "token" + " " * 3000) * 250):
        began = time.thread_time()
        secrets.found_in(scanner, [text.encode()])
        assert time.thread_time() - began < 1.5, text[:30]


@pytest.mark.parametrize("size", [7, 100, 1000])
def test_passes_join(monkeypatch, size):
    """Spans don't depend on where a pass ends."""
    scanner, every = secrets.compiled(secrets.RULES), [t.encode() for t in texts(5, 12)]
    want = secrets.found_in(scanner, every)
    monkeypatch.setattr(secrets, "PASS", size)
    assert secrets.found_in(scanner, every) == want and want


@pytest.mark.parametrize("few", [0, 10**9])
def test_lanes_that_stay_wrong(monkeypatch, few):
    """Lanes corrected together only, and byte by byte only."""
    monkeypatch.setattr(secrets, "FEW_LANES", few)
    dfa = secrets.compiled(secrets.RULES).marks
    for text in (b"token" + b" " * 5000 + b"=abc", b"ab" * 300 + b"xoxb-" + b"1" * 3000, b"-----BEGIN " + b"A" * 700 + b"x" * 900):
        data = np.frombuffer(text, np.uint8)
        now, want = 0, []
        for b in data:
            now = dfa.step[now + b]
            want.append(now)
        assert (secrets.states(dfa, data, 64) == np.array(want)).all()


@pytest.mark.parametrize("lane", [1, 3, 64, 5000])
def test_lanes_are_one_pass(lane):
    dfa = secrets.compiled(secrets.RULES).marks
    data = np.frombuffer(bytes([secrets.EDGE]).join(t.encode() for t in texts(2, 60)), np.uint8)
    now, want = 0, []
    for b in data:
        now = dfa.step[now + b]
        want.append(now)
    assert (secrets.states(dfa, data, lane) == np.array(want)).all()


def test_automaton_is_minimal():
    """No two states agree on everything they can still accept."""
    dfa = secrets.automaton([secrets.Nfa().read(p) for p in ("ab{2}c", "(?i:x|y)z?")])
    step = dfa.step.reshape(-1, 256) // 256
    part = np.unique(dfa.accept, return_inverse=True)[1]
    for _ in range(dfa.states):
        part = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
    assert len(set(part.tolist())) == dfa.states


def test_redaction(spark, hard, empty):
    df = spark.createDataFrame([(1, "my password: abcdefabcdef0123456789 end", "en", 39), (2, "clean é", "en", 7), (3, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(df).collect()}
    assert got == {1: ("my [secret] end", 15), 2: ("clean é", 7), 3: (None, None)}
    assert secrets.redacted(hard).columns == hard.columns and secrets.redacted(hard).count() == hard.count()
    assert secrets.report(secrets.scan(empty)).count() == 0


def test_memory_of_a_slice():
    """A slice of texts is scanned in short passes: with 2 MB at once it takes 36 MB."""
    scanner, every = secrets.compiled(secrets.RULES), [b"some words and no more " * 90 + b"token = abcdefghijklmnop"] * 1000
    tracemalloc.start()
    try:
        assert len(secrets.found_in(scanner, every)) == 1000
        assert tracemalloc.get_traced_memory()[1] < 25e6
    finally:
        tracemalloc.stop()
