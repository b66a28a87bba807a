"""Secret scans with one deterministic automaton for all rules.

Rules are byte regexes. A small compiler turns each into a nondeterministic automaton, joins the shortest forms of all rules (the
run that a rule ends with cut to its least, an optional end left out) behind one unanchored start, makes that deterministic
by subset construction over byte classes, and minimises it by partition refinement into one transition array. A text is scanned
once, byte by byte, for all rules together: the scan runs in lanes side by side, each lane guessing that it begins in the start
state, and lanes that guessed wrong are run again from the true state until both agree, so the states are those of one pass.

An accepting state is a mark: a match of those rules exists whose shortest end is here. From a mark, the rule's reversed automaton
goes back to where the match starts, the first such place after the rule's last match, and the rule's own automaton from there
on to its longest end; both stop as soon as they are dead. So matches are leftmost, longest and non-overlapping per kind, and
one whose last run is too short is dropped but still uses up its place. A rule's match that starts earlier must have its shortest end no later,
and rules must be free of choices in which the longest match isn't the first one tried; the rules here are.

Defined results: null and empty texts have no spans; repeated rows each get a row; spans are in code points,
end exclusive, ordered by start and then as kinds are listed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, raw, short_batches, sliced

LANE = 256
#: How often wrong lanes are corrected together, and below how many they aren't; bytes of a pass, whose last state the next one takes over.
TOGETHER, FEW_LANES, PASS = 4, 32, 1 << 19
EDGE = 0xFF  # between texts; never part of UTF-8, and in no rule


class Rule(NamedTuple):
    """kind; the regex; the least length of the run that the regex ends with (from the end of its shortest form, the byte there
    included), shorter matches being dropped."""

    kind: str
    pattern: str
    least: int = 1


#: The base kinds, in order.
BASE = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "AKIA[A-Z0-9]+", 14),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Kinds beyond the base: well-known token forms with little room for chance, and private keys, with headers and line ends written
#: out in their bodies. A key that doesn't end is its first line.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(([A-Za-z0-9+/=:,. \t\r\n\\]|-[A-Za-z0-9])*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]+", 10),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


# ---- regex to automaton ----


class Nfa:
    """States with byte-set edges and empty edges, grown by a recursive-descent parser of a regex subset:
    literals, escapes, classes, groups, (?i:...), |, ?, *, +, {m}, {m,n}."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def read(self, pattern: str) -> tuple:
        self.p, self.i, self.fold = pattern, 0, False
        tree = self._either()
        if self.i != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.i}")
        return tree

    def add(self, tree: tuple, rule: int) -> int:
        start, end = self._build(tree)
        self.accept[end] = rule
        return start

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _next(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def _either(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self._next()
            options.append(self._sequence())
        return ("or", options)

    def _sequence(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            item = self._atom()
            while self._peek() and self._peek() in "?*+{":
                c = self._next()
                if c == "{":
                    end = self.p.index("}", self.i)
                    low, comma, high = self.p[self.i : end].partition(",")
                    self.i = end + 1
                    item = ("times", item, int(low), int(high) if high else None if comma else int(low))
                else:
                    item = ("times", item, {"?": 0, "*": 0, "+": 1}[c], 1 if c == "?" else None)
            items.append(item)
        return ("seq", items)

    def _atom(self):
        c = self._next()
        if c == "(":
            was = self.fold
            if self.p.startswith("?i:", self.i):
                self.i += 3
                self.fold = True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            tree = self._either()
            self.fold = was
            if self._next() != ")":
                raise ValueError("unclosed group")
            return tree
        if c == "[":
            found, body = set(), []
            while self._peek() != "]":
                body.append(self._escape() if self._peek() == "\\" else ord(self._next()))
                if self._peek() == "-" and self.p[self.i + 1] != "]":
                    self._next()
                    found.update(range(body.pop(), ord(self._next()) + 1))
            self._next()
            return ("bytes", self._cased(found | set(body)))
        if c == "\\":
            self.i -= 1
            return ("bytes", self._cased({self._escape()}))
        return ("bytes", self._cased({ord(c)}))

    def _escape(self) -> int:
        self._next()
        c = self._next()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _cased(self, found: set) -> frozenset:
        return frozenset(found | {ord(chr(x).swapcase()) for x in found if chr(x).isascii() and chr(x).isalpha()} if self.fold else found)

    def _build(self, tree) -> tuple[int, int]:
        kind, first, last = tree[0], self.state(), self.state()
        if kind == "bytes":
            self.edges[first].append((tree[1], last))
        elif kind == "or":
            for x in tree[1]:
                a, b = self._build(x)
                self.empty[first].append(a)
                self.empty[b].append(last)
        elif kind == "seq":
            at = first
            for x in tree[1]:
                a, b = self._build(x)
                self.empty[at].append(a)
                at = b
            self.empty[at].append(last)
        else:
            _, item, low, high = tree
            at = first
            for _ in range(low):
                a, b = self._build(item)
                self.empty[at].append(a)
                at = b
            if high is None:
                a, b = self._build(item)
                self.empty[at] += [a, last]
                self.empty[b] += [a, last]
            else:
                for _ in range(high - low):
                    a, b = self._build(item)
                    self.empty[at] += [a, last]
                    at = b
                self.empty[at].append(last)
        return first, last


def shortest(tree: tuple) -> tuple:
    """The expression of a tree's shortest matches: the run or option that it ends with cut to its least."""
    kind = tree[0]
    if kind == "seq" and tree[1]:
        last = shortest(tree[1][-1])
        return ("seq", [*tree[1][:-1], last])
    if kind == "or":
        return ("or", [shortest(x) for x in tree[1]])
    if kind == "times":
        return ("times", tree[1], tree[2], tree[2])
    return tree


def reverse(tree: tuple) -> tuple:
    kind = tree[0]
    if kind in ("seq", "or"):
        parts = [reverse(x) for x in tree[1]]
        return (kind, parts[::-1] if kind == "seq" else parts)
    return ("times", reverse(tree[1]), *tree[2:]) if kind == "times" else tree


class Dfa(NamedTuple):
    step: np.ndarray  # [state * 256 + byte] -> state * 256
    accept: np.ndarray  # [state] -> bits of rules
    states: int


def automaton(trees: list[tuple], anchored: bool = False) -> Dfa:
    """The minimal automaton that, at every byte, knows which trees have a match ending there: one from the start if anchored,
    else one from anywhere. An anchored automaton that can't accept any more is in a state that no byte leaves."""
    nfa = Nfa()
    starts = [nfa.add(t, k) for k, t in enumerate(trees)]
    # bytes that no edge tells apart are one class
    sets = {s for out in nfa.edges for s, _ in out}
    classes: dict[tuple, list[int]] = {}
    for byte in range(256):
        classes.setdefault(tuple(byte in s for s in sets), []).append(byte)
    groups = list(classes.values())

    @cache
    def closure(state: int) -> frozenset:
        seen, todo = {state}, [state]
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.edges[x] or x in nfa.accept)

    start = frozenset().union(*(closure(s) for s in starts))
    again = frozenset() if anchored else start
    after = [[frozenset().union(*(closure(to) for s, to in out if g[0] in s)) for g in groups] for out in nfa.edges]
    number, order, table = {start: 0}, [start], []
    for now in order:  # grows as sets are found
        row = []
        for k in range(len(groups)):
            to = again.union(*(after[x][k] for x in now))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    step = np.array(table)
    accept = np.array([sum(1 << r for r in {nfa.accept[x] for x in now if x in nfa.accept}) for now in order])
    # partition refinement until no class of bytes tells two states of a part apart
    part = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # the part of the start state becomes state 0
    names = np.full(part.max() + 1, -1)
    first = []
    for k, p in enumerate(part.tolist()):
        if names[p] < 0:
            names[p] = len(first)
            first.append(k)
    small = names[part[step[first]]]
    full = np.zeros((len(first), 256), np.int32)
    for k, g in enumerate(groups):
        full[:, g] = small[:, [k]] * 256
    return Dfa(full.ravel(), accept[first], len(first))


class Walk(NamedTuple):
    """An anchored automaton of one rule, as lists."""

    step: list[int]
    accept: list[bool]
    dead: int

    @staticmethod
    def of(tree: tuple) -> Walk:
        dfa = automaton([tree], anchored=True)
        still = [k for k in range(dfa.states) if not dfa.accept[k] and (dfa.step[k * 256 : k * 256 + 256] == k * 256).all()]
        return Walk(dfa.step.tolist(), (dfa.accept > 0).tolist(), still[0] * 256 if still else -1)


class Scanner(NamedTuple):
    """All rules compiled: the automaton of all shortest forms, and each rule's ways back and ahead."""

    rules: tuple[Rule, ...]
    marks: Dfa
    back: list[Walk]
    ahead: list[Walk]


@cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    trees = [Nfa().read(r.pattern) for r in rules]
    return Scanner(rules, automaton([shortest(t) for t in trees]), [Walk.of(reverse(shortest(t))) for t in trees], [Walk.of(t) for t in trees])


def states(dfa: Dfa, data: np.ndarray, lane: int = LANE, begin: int = 0) -> np.ndarray:
    """The state after each byte, as one pass from the state `begin` would have it.

    Lanes are corrected together for as long as many are wrong, `TOGETHER` times at most; what is wrong then is walked byte by byte,
    from each lane's true state until it agrees, so that no byte is walked twice, however far a state carries.
    """
    n = -(-len(data) // lane)
    rows = np.full(n * lane, EDGE, np.uint8)
    rows[: len(data)] = data
    rows = np.ascontiguousarray(rows.reshape(n, lane).T).astype(np.int32)
    seen = np.empty((lane, n), np.int32)
    now = np.zeros(n, np.int32)
    now[:1] = begin
    start = now.copy()
    for i in range(lane):
        now = dfa.step[now + rows[i]]
        seen[i] = now
    for _ in range(TOGETHER):
        todo = np.flatnonzero(seen[-1, :-1] != start[1:]) + 1
        if len(todo) < FEW_LANES:
            break
        now = start[todo] = seen[-1, todo - 1]
        for i in range(lane):
            if not len(todo):
                break
            now = dfa.step[now + rows[i, todo]]
            off = now != seen[i, todo]
            todo, now = todo[off], now[off]
            seen[i, todo] = now
    wrong = np.flatnonzero(seen[-1, :-1] != start[1:]) + 1
    step = dfa.step.tolist() if len(wrong) else []
    k = int(wrong[0]) if len(wrong) else n
    while k < n:
        state = int(seen[-1, k - 1])
        if state == start[k]:
            later = np.flatnonzero(seen[-1, k:-1] != start[k + 1 :])  # the next lane that begins in another state than the one before ends in
            k = k + 1 + int(later[0]) if len(later) else n
            continue
        start[k] = state
        walked = []
        for byte, known in zip(rows[:, k].tolist(), seen[:, k].tolist()):
            state = step[state + byte]
            if state == known:
                break
            walked.append(state)
        seen[: len(walked), k] = walked
        k += 1
    return seen.T.ravel()[: len(data)]


def starts_at(walk: Walk, text: bytes, mark: int, low: int) -> int:
    """The first place from `low` on where a shortest match that ends with the byte at `mark` starts, or -1."""
    state, found = 0, -1
    for i in range(mark, low - 1, -1):
        state = walk.step[state + text[i]]
        if state == walk.dead:
            break
        if walk.accept[state >> 8]:
            found = i
    return found


def ends_at(walk: Walk, text: bytes, start: int) -> int:
    """The end of the longest match from `start`."""
    state, end, step, accept, dead = 0, start, walk.step, walk.accept, walk.dead
    for i in range(start, len(text)):
        state = step[state + text[i]]
        if state == dead:
            break
        if accept[state >> 8]:
            end = i + 1
    return end


def spans(scanner: Scanner, text: bytes, marks: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points, from a text's marks: places and the rules that accept there."""
    out = []
    for k in range(len(scanner.rules)):
        mine = marks[bits >> k & 1 > 0]
        at, low = 0, 0
        while at < len(mine):
            mark = int(mine[at])
            start = starts_at(scanner.back[k], text, mark, low)
            if start < 0:
                at += 1
                continue
            end = low = ends_at(scanner.ahead[k], text, start)
            if end - mark >= scanner.rules[k].least:
                out.append((start, k, end))
            at = int(np.searchsorted(mine, low))
    if out and not text.isascii():
        lead = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
        out = [(int(lead[a]), k, int(lead[b])) for a, k, b in out]
    return sorted(out)


def found_in(scanner: Scanner, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
    """The spans of the texts that have any, in one pass over all of them."""
    data = np.frombuffer(bytes([EDGE]).join(texts) + bytes([EDGE]), np.uint8)
    places, rules, state = [], [], 0
    for first in range(0, len(data), PASS):
        now = states(scanner.marks, data[first : first + PASS], begin=state)
        state = int(now[-1])
        accepted = scanner.marks.accept[now >> 8]
        here = np.flatnonzero(accepted)
        places.append(here + first)
        rules.append(accepted[here])
    at, bits = np.concatenate(places), np.concatenate(rules)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    which = np.searchsorted(ends, at, "right")
    edges = np.flatnonzero(np.diff(which, prepend=-1, append=len(texts)))
    out = {}
    for lo, hi in zip(edges[:-1], edges[1:]):
        k = int(which[lo])
        if found := spans(scanner, texts[k], at[lo:hi] - (ends[k] - sizes[k]), bits[lo:hi]):
            out[k] = found
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): spans as array<struct<kind, start, end>>."""
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(compiled(tuple(rules)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in sliced(batches, 1):
            found = found_in(shared.value, raw(b.column(1)))
            out = [[{"kind": rules[k].kind, "start": a, "end": z} for a, k, z in found.get(i, ())] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, every secret's span in the text replaced by `mask` (overlapping spans by
    one) and the length column, where there is one, counted anew for changed texts. Null texts stay null."""
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(compiled(tuple(rules)))
    names = df.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches):
        for b in sliced(batches, at):
            texts = raw(b.column(at))
            changed = {}
            for i, found in found_in(shared.value, texts).items():
                text, out, done = texts[i].decode(), [], 0
                for a, _, z in found:
                    if a >= done:
                        out += [text[done:a], mask]
                    done = max(done, z)
                changed[i] = "".join([*out, text[done:]])
            columns = list(b.columns)
            if changed:
                new = columns[at].to_pylist()
                for i, t in changed.items():
                    new[i] = t
                columns[at] = pa.array(new, columns[at].type)
                if length_at is not None:
                    n = columns[length_at].to_pylist()
                    for i, t in changed.items():
                        n[i] = len(t)
                    columns[length_at] = pa.array(n, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_rows(df, run)


def report(found: DataFrame) -> DataFrame:
    """The digest of `scan`: counts of the base kinds, a checksum of the base spans and all spans."""
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
