"""Main-text extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive where they look like an article's, tags negative, and one
linear scan finds the contiguous stretch with the highest sum: the content region, whose edges the scan sets (to whole blocks).
All weights come from labelled pages: a word's score is the log odds, squashed to -1 to 1, that its block is the article's, by a
logistic model of the block's element, length, end, links, of the elements around it and of the words of their classes, ids and
roles; a tag's score is the log odds of standing inside the region, below zero always. Words against the article count a
quarter, so that an advert within an article doesn't part it.

Within the region a block stays unless its words score negative and the elements around it alone speak against it. Where no
element but the page holds the region, menus, headers and footers of the page are left to the scan. Blocks come in page
order, one a line. If no block scores positive, all that nothing speaks against and that aren't links alone do.

Defined results: a null or empty page, and one without words, has the empty text; markup that doesn't end, isn't
closed or isn't opened is read as browsers roughly do; repeated rows each get a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import cache, lru_cache
from itertools import takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, sliced

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select option annotation annotation-xml button".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
#: Elements that a block's score heeds wherever they stand around it.
AROUND = frozenset("article main nav aside header footer form dialog menu section table ul ol dl blockquote figure pre".split())
NEVER_PLAIN = frozenset("in:nav in:aside in:header in:footer in:form in:dialog in:menu".split())
PAGE_PARTS = ("in:nav", "in:header", "in:footer")
#: Elements of formulas, whose tags tell nothing about the region.
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mmultiscripts mtable mtr mtd mstyle mfenced mpadded mphantom menclose merror".split())
#: Blocks that an article's own ids name, as the elements within a line do: no roles there.
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote dt dd tr td th caption figcaption summary section li".split())
#: Elements that the start of another one ends.
ENDS = {"p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements that such an end doesn't reach beyond.
HOLDS = frozenset("table ul ol dl article main section div body html blockquote aside nav header footer form figure".split())
#: Words of class names after which they tell what an element has around or in it, not what it is.
HAVING = frozenset("has have with without no".split())
SIDE_BY_SIDE = re.compile(r"side[\W_]*by[\W_]*side")
#: Ids of sections and list items in an article that hold comments, whatever else ids name.
COMMENTS = re.compile(r"(?:comments?|respond|disqus)(?:[\W_]*(?:list|area|section|form|thread|\d+))*", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>", re.S)
CUT_OFF = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SENTENCE = tuple(".!?:;\u2026\u3002\uff01\uff1f\"')\u201d\u00bb")


class Token(NamedTuple):
    kind: str  # "word", "open" or "close"
    text: str  # the words of a run of text, or the tag's name
    element: int  # the innermost element around a text or made by a tag; 0 is the page


class Page(NamedTuple):
    """Tokens in page order, and by element: its name, its parent and what its tag tells (names of features and values)."""

    tokens: list[Token]
    names: list[str]
    parents: list[int]
    tells: list[tuple[tuple[str, float], ...]]


#: Words of class names in the labelled pages: of what is outside an article, of what is as often part of one, and of its own.
OUTSIDE = {
    "nav": "nav navbar navigation menu breadcrumb topbar masthead pagination pager skip", "side": "sidebar widget complementary rail", "ad": "ad ads advert advertisement advertising adsense sponsor sponsored promo promoted",
    "note": "cookie consent gdpr popup modal overlay alert", "foot": "footer foot copyright contentinfo colophon disclaimer", "comment": "comment comments commentlist disqus respond replies", "form": "newsletter subscribe signup login",
    "more": "related recommended recommendations sharing",
}
EITHER = "notice banner share social follow reply search toolbar discussion side header head effect history box area top list section bar".split()
OWN = "article post entry content story body text title section chapter abstract intro conclusion".split()


#: Words that only say where or what kind of box something is, and OWN ones that stand beside OUTSIDE ones in names of what is outside.
LAYOUT = frozenset("area banner bar block bottom box container first head header inner item last left link list main outer page primary right secondary section site slot top unit wrap wrapper article content entry post story".split())
KNOWN = LAYOUT | frozenset(EITHER) - {"history", "effect"} | frozenset(w[:-1] if len(w) > 3 and w.endswith("s") else w for x in OUTSIDE.values() for w in x.split())


@lru_cache(4096)
def told(element: str, attributes: str, in_content: bool) -> tuple[tuple[str, float], ...] | None:
    """What a tag tells of the words in it: its name if it is in AROUND, and each word of its class, id and role, by the share
    that the word has of its class name; a name of several words tells nothing if one of them is unknown. None if the element is never seen.
    in_content: inside an article or main, where ids of headings, paragraphs, sections and elements within a line are anchors."""
    anchor = in_content and (element in ANCHORS or element not in BLOCK)
    found: dict[str, float] = {f"in:{'own-' * (element == 'header' and in_content)}{element}": 1.0} if element in AROUND else {}
    for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
            return None
        if name == "id" and anchor:
            if element not in ("section", "li") or not COMMENTS.fullmatch(value.strip()):
                continue
            value = "comments"
        if name in ("class", "id", "role") and element not in ("html", "body"):
            for one in value.split():
                one = SIDE_BY_SIDE.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())
                words = list(takewhile(lambda w: w not in HAVING, re.findall(r"[a-z]+", one)))
                words = [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in words]
                if len(words) > 1 and not KNOWN.issuperset(words):  # of which only a part is known
                    continue
                for w in words:
                    found[f"c:{w}"] = max(found.get(f"c:{w}", 0.0), 1 / len(words))
    return tuple(found.items())


def read(page: str) -> Page:
    """A page's tags and runs of text that can be seen; in time linear in its length, however deep its markup."""
    out = Page([], ["page"], [0], [()])
    stack: list[tuple[int, bool]] = []  # element, whether it can't be seen
    opened: Counter = Counter()
    names = out.names
    if cut := CUT_OFF.search(page, page.rfind(">") + 1):  # a last tag that never ends is none
        page = page[: cut.start()]
    at, n = 0, len(page)

    def text(piece: str) -> None:
        if piece and not (stack and stack[-1][1]):
            out.tokens.append(Token("word", entities.unescape(piece), stack[-1][0] if stack else 0))

    def pop(to: int) -> None:
        while len(stack) > to:
            element, _ = stack.pop()
            opened[names[element]] -= 1
            out.tokens.append(Token("close", names[element], element))

    def close(which: frozenset, hold: frozenset) -> None:
        """Closes the innermost element of `which`, if none of `hold` stands before it."""
        if not any(opened[x] > 0 for x in which):
            return
        for k in range(len(stack) - 1, -1, -1):
            name = names[stack[k][0]]
            if name in which:
                pop(k)
                return
            if name in hold:
                return

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            close(frozenset([name]), frozenset())
            continue
        if name in ENDS:
            close(ENDS[name], HOLDS)
        if name in BLOCK and name != "p":
            close(ENDS["p"], HOLDS)
        tells = told(name, m[3], opened["article"] + opened["main"] > 0)
        names.append(name)
        element = len(names) - 1
        out.parents.append(stack[-1][0] if stack else 0)
        out.tells.append(tells or ())
        out.tokens.append(Token("open", name, element))
        if name in VOID or m[3].endswith("/"):
            continue
        stack.append((element, name in RAW or tells is None or bool(stack and stack[-1][1])))
        opened[name] += 1
        if name in RAW:
            at = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at).end()
            pop(len(stack) - 1)
    pop(0)
    return out


# ---- blocks and their features ----


class Block(NamedTuple):
    text: str
    n: int  # its words
    first: int  # its first and last run of text among the tokens
    last: int
    element: int
    own: tuple[str, ...]  # what the block itself tells
    around: dict[str, float]  # what the elements around it tell


def blocks(page: Page) -> list[Block]:
    """The page's blocks that have words, in page order."""
    every: dict[int, dict[str, float]] = {0: {}}

    def around(element: int) -> dict[str, float]:
        """What all elements around tell. What stands outside an article or main is another thing than what stands in it."""
        path = []
        while element not in every:
            path.append(element)
            element = page.parents[element]
        for e in reversed(path):
            up, tells = every[page.parents[e]], page.tells[e]
            if not tells:
                every[e] = up
                continue
            if page.names[e] in ("article", "main"):
                up = {f"o:{k[2:]}" if k.startswith("c:") else k: v for k, v in up.items() if not k.startswith("in:") or k == "in:main"}
            up = up | {k: max(v, up.get(k, 0.0)) for k, v in tells}
            up.pop("in:plain", None)
            if ("in:article" in up or "in:main" in up) and not any(k.startswith("c:") or k in NEVER_PLAIN for k in up):
                up["in:plain"] = 1.0  # in an article, with no class of any name and no part of a page around
            every[e] = up
        return every[path[0] if path else element]

    out: list[Block] = []
    runs: list[int] = []
    link, plain = 0, False

    def end() -> None:
        nonlocal runs, plain
        if runs:
            text = " ".join("".join(page.tokens[i].text if page.tokens[i].kind == "word" else " " for i in runs).split())
            if text:
                wordy = [i for i in runs if page.tokens[i].kind == "word"]
                element = page.tokens[wordy[0]].element
                while element and page.names[element] not in BLOCK:
                    element = page.parents[element]
                n = text.count(" ") + 1
                own = [f"block:{page.names[element]}", f"len:{min(5, n.bit_length())}"]
                own += ["end"] * text.endswith(SENTENCE) + ["link"] * (not plain)
                outer = around(element)
                inner = "a:" * ("in:article" in outer or "in:main" in outer)  # a short line in an article tells another thing than one outside
                out.append(Block(text, n, wordy[0], wordy[-1], element, tuple(inner + x for x in own), outer))
        runs, plain = [], False

    for i, t in enumerate(page.tokens):
        if t.kind == "word":
            runs.append(i)
            plain = plain or not link and any(c.isalnum() for c in t.text)
        elif t.text == "a":
            link = max(0, link + (1 if t.kind == "open" else -1))
        elif t.text == "br":
            if runs:
                runs.append(i)
        elif t.text in BLOCK:
            end()
    end()
    return out


# ---- weights from labelled pages ----

def labelled_pages(count: int = 360, seed: int = 11) -> list[str]:
    """Pages made by rule, with the article's parts between <x-edge> tags: menus, slogans, notices, adverts, sidebars, footers and
    comments, with classes or without, around and inside an article under several elements, or straight in the body."""
    rng = random.Random(seed)
    say = lambda n: " ".join(f"word{rng.randrange(97)}" for _ in range(n))
    some = lambda a, b: say(rng.randint(a, b))
    stop = lambda share: "." * (rng.random() < share)
    name = lambda kind: rng.choice(OUTSIDE[kind].split())
    cls = lambda kind: rng.choice([f" class='{name(kind)}'", f" id='{name(kind)}'", f" class='{name(kind)}-{rng.choice(EITHER + OUTSIDE[kind].split())}'"])

    def links(n):
        return "".join(f"<li><a href='/'>{some(1, 3)}</a></li>" for _ in range(n))

    def outside(kind, marked):
        mark = cls(kind) if marked else ""
        if kind == "nav":
            return rng.choice([f"<nav{mark}><ul>{links(5)}</ul></nav>", f"<div{mark}><ul>{links(6)}</ul></div>", f"<table{mark}><tr><td><ul>{links(3)}</ul></td></tr></table>", f"<header{mark}><div>{some(1, 4)}</div><ul>{links(4)}</ul></header>", f"<div{mark}><a>{some(1, 2)}</a> | <a>{some(1, 2)}</a></div>"])
        if kind == "side":
            return rng.choice([f"<aside{mark}><h3>{some(1, 3)}</h3><ul>{links(4)}</ul></aside>", f"<div{mark}><p>{some(6, 30)}{stop(0.5)}</p></div>" if marked else f"<aside><p>{some(6, 30)}{stop(0.5)}</p></aside>"])
        if kind == "foot":
            return rng.choice([f"<footer{mark}>{some(3, 12)}</footer>", f"<footer><p>{some(3, 12)}{stop(0.5)}</p></footer>", f"<div{mark}>{some(2, 7)}</div>"])
        if kind == "form":
            return f"<form{mark}><p>{some(2, 9)}{stop(0.5)}</p><label>{some(1, 3)}</label><input><button>{say(1)}</button></form>"
        if kind == "note" and not marked:
            return f"<dialog><p>{some(4, 15)}{stop(0.5)}</p></dialog>"
        if not marked:
            return f"<div>{some(2, 6)}</div>"
        return rng.choice([f"<div{mark}><p>{some(4, 25)}{stop(0.5)}</p></div>", f"<div{mark}>{some(3, 20)}{stop(0.5)}</div>", f"<section{mark}><h3>{some(1, 4)}</h3><p>{some(4, 25)}{stop(0.5)}</p></section>"])

    def inside():
        part = rng.choice(["p", "p", "p", "p", "short", "h2", "ul", "quote", "pre", "table", "div", "section", "figure", "links", "span", "span", "span"])
        either, own = rng.choice(EITHER), rng.choice(OWN)
        mark = rng.choice(["", "", f" class='{either}'", f" class='{either}-{own}'", f" class='{own}'", f" id='{own}'"])
        return {
            "p": f"<p{mark}>{some(8, 60)}{stop(0.9)}</p>", "short": f"<p{mark}>{some(1, 4)}{stop(0.5)}</p>", "h2": f"<h2>{some(1, 6)}</h2>", "ul": f"<ul><li>{some(2, 12)}</li><li>{some(2, 12)}.</li></ul>", "quote": f"<blockquote><p>{some(6, 30)}.</p></blockquote>",
            "pre": f"<pre>{some(3, 20)}</pre>", "table": f"<table><tr><th>{say(1)}</th><td>{some(1, 5)}</td></tr></table>", "div": f"<div{mark}><p>{some(2, 40)}{stop(0.9)}</p></div>", "section": f"<section{mark}><h3>{some(1, 5)}</h3><p>{some(2, 40)}{stop(0.9)}</p></section>",
            "figure": f"<figure><figcaption>{some(3, 12)}.</figcaption></figure>", "links": f"<ul><li><a>{some(1, 6)}</a></li><li><a>{some(1, 6)}</a></li></ul>", "span": f"<div{mark}>{some(1, 20)}</div>" if held else f"<div{mark}>{some(12, 40)}.</div>",
        }[part]

    out = []
    for k in range(count):
        marked = rng.random() < 0.7
        wrap = ["article", "main", "div id='content'", "div class='post'", "", "div", "section"][k % 7]
        held = wrap in ("article", "main") or rng.random() < 0.1
        parts = [f"<h1>{some(2, 8)}</h1>" if rng.random() < 0.7 or not held else f"<header><h1>{some(2, 8)}</h1><p>{some(2, 9)}</p></header>"]
        for _ in range(rng.randint(1, 8)):
            parts.append(inside() if held else rng.choice([inside(), f"<p>{some(8, 60)}{stop(0.9)}</p>", f"<p>{some(5, 30)}{stop(0.7)}</p>"]))
            if rng.random() < 0.25:
                parts.append("</x-edge>" + outside(rng.choice(["ad", "ad", "more", "form", "note", "side", "comment"] + ["nav", "foot"] * held), True) + "<x-edge>")
        if rng.random() < 0.4:
            parts.append("</x-edge>" + outside("comment", True) + "<x-edge>")
        outer = rng.choice(["", "", "", f"<div class='{name('side')}'>", f"<div class='{rng.choice(EITHER)}'>"]) if wrap == "article" else ""
        before = [outside("nav", marked), *(outside(x, marked) for x in rng.sample(["ad", "note", "form", "side"], rng.randint(0, 3)))]
        after = [*(outside(x, True) for x in rng.sample(["side", "more", "comment", "ad"], rng.randint(0, 2))), outside("foot", marked)]
        if wrap == "article" and rng.random() < 0.2:
            after.insert(0, f"<div{cls('comment')}><article><p>{some(3, 20)}.</p></article></div>")
        open_, shut = (f"<{wrap}>", f"</{wrap.split()[0]}>") if wrap else ("", "")
        if not held and rng.random() < 0.15:
            open_, shut = f"<table><tr><td><ul>{links(4)}</ul></td><td>", "</td></tr></table>"
        out.append(f"<html><body>{''.join(before)}{outer}{open_}<x-edge>{''.join(parts)}</x-edge>{shut}{'</div>' if outer else ''}{''.join(after)}</body></html>")
    return out


class Weights(NamedTuple):
    words: dict[str, float]  # by feature, and "bias"
    tags: dict[str, float]  # by element
    tag: float  # of other elements


def fit(pages: list[str], steps: int = 1500) -> Weights:
    """The logistic model of blocks (each as its words' square root), and tags' log odds."""
    rows, labels, sizes = [], [], []
    inside, outside = Counter(), Counter()
    for source in pages:
        page, edges = read(source), []
        now = False
        for t in page.tokens:
            if t.text == "x-edge" and t.kind != "word":
                now = t.kind == "open"
            elif t.kind != "word" and t.text not in ("html", "body"):
                (inside if now else outside)[t.text] += 1
            edges.append(now)
        for b in blocks(page):
            rows.append({x: 1.0 for x in b.own} | b.around)
            labels.append(edges[b.first])
            sizes.append(math.sqrt(b.n))
    names = sorted({x for r in rows for x in r})
    at = {x: k for k, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for k, r in enumerate(rows):
        for f, v in r.items():
            x[k, at[f]] = v
    y, size = np.array(labels, float), np.array(sizes) / sum(sizes)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = x.T @ (size * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    a, b = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 0.5) / a) - math.log((outside[k] + 0.5) / b) for k in inside.keys() | outside.keys()}
    return Weights(dict(zip([*names, "bias"], w.tolist())), {k: max(-2.0, min(-0.05, 0.5 * x)) for k, x in odds.items()}, -0.1)


@cache
def default_weights() -> Weights:
    return fit(labelled_pages())


# ---- the scan ----


def best_region(scores: list[float]) -> tuple[int, int]:
    """The stretch with the highest sum, the first of equals; (0, 0) if none is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


#: The part of their score that words against the article count; and the sum of the weights of what stands around a block below
#: which it is left out of the region.
AGAINST, DOUBT = 0.25, -0.7


def block_score(block: Block, weights: Weights) -> float:
    """Of each of its words: from -1 to 1."""
    w = weights.words
    z = w["bias"] + sum(w.get(f, 0.0) for f in block.own) + sum(w.get(f, 0.0) * v for f, v in block.around.items())
    return math.tanh(z / 2)


def extract(page: str | None, weights: Weights | None = None) -> str:
    """The main text of a page."""
    weights = weights or default_weights()
    source = read(page or "")
    found = blocks(source)
    if not found:
        return ""
    against = lambda b, but=(): sum(weights.words.get(f, 0.0) * v for f, v in b.around.items() if f not in but) < DOUBT
    each = [block_score(b, weights) for b in found]
    if max(each) <= 0:
        each = [-1.0 if against(b) or b.own[-1].endswith("link") else 1.0 for b in found]
    scores = [0.0 if t.kind == "word" or t.text in MATH else weights.tags.get(t.text, weights.tag) for t in source.tokens]
    for b, x in zip(found, each):
        for i in range(b.first, b.last + 1):  # tags within a block's line tell nothing
            scores[i] = 0.0
        if x > 0:
            scores[b.first] = b.n * x
        elif "in:article" not in b.around and "in:main" not in b.around and not against(b, PAGE_PARTS):
            scores[b.first] = AGAINST * b.n * x
    lo, hi = best_region(scores)
    part = [(b, x) for b, x in zip(found, each) if lo <= b.first < hi]
    # the smallest element around the region: elements are numbered as they open
    if not part:
        return ""
    a, z = part[0][0].element, part[-1][0].element
    while a != z:
        if a > z:
            a = source.parents[a]
        else:
            z = source.parents[z]
    but = PAGE_PARTS if source.names[a] in ("page", "html", "body") else ()
    return "\n".join(b.text for b, x in part if x > 0 or not against(b, but))


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), weights: Weights | None = None) -> DataFrame:
    """(id, *keep, text, n_chars) of every page."""
    spark = df.sparkSession
    short_batches(spark)
    shared = weights or default_weights()
    names = [id_col, html_col, *keep]

    def run(batches):
        for b in sliced(batches, 1):
            texts = [extract(x, shared) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, *keep, "text", "n_chars"])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return df.select(*(F.col(c) for c in names)).mapInArrow(run, f"{schema}, text string, n_chars bigint")
