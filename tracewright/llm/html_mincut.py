"""Main text of web pages by a minimum cut between content and boilerplate.

A page's text falls into blocks at the borders of block-level elements. A logistic classifier of each block (words of it
and its neighbours, share of link text, sentence ends, element, place, depth, names) gives the costs of calling it
content or boilerplate; with what the page's elements say of it they are its capacities to the two terminals. Neighbours in the page and blocks under one parent are tied by smoothness edges,
the stronger the closer they lie in the document tree. A maximum flow finds the cheapest cut; the blocks on the source's
side are the article.

The classifier is fitted to pages that mark their article by an element: their blocks inside and outside are the two
classes, and that mark is no feature. The sample is of bounded expected size (``FIT_PAGES`` pages, by a hash of the url and
the html's length); without such pages hand-set weights stand in.

Class and id names that are common for boilerplate lower a block's score, and a block with enough prose outweighs them.
They count nothing on elements that hold the page's main text (<main>, an article that is not small beside the page's
longest, or over half of the prose), nor where they say what a layout has or lacks ("has-sidebar"). Elements named as readers' comments, of any size and
``article`` ones too, are boilerplate once some prose has come before them, unless they hold the page's main text.

Nulls: a null page is empty; a page without content has the empty text. Markup that is broken or cut off is read as far
as it goes. Repeated rows and null ids keep their rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import mapped

# Element names of the HTML standard by kind.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noembed noframes xmp iframe textarea title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER = set("head title script style noscript noembed noframes iframe template nav footer aside form button select option textarea input label fieldset legend menu dialog svg math canvas object audio video search".split())
BAD_NAMES = set("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login nav navbar navigation menu sidebar rail breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social comment comments commentlist respond reply replies disqus related recommended widget search form copyright legal alert skip".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_NAMES = set("article content post entry story main".split())
#: Names of readers' comments, and the letters of prose that come before these.
TALK, OPENING = set("comment comments commentlist respond reply replies disqus".split()), 80
#: First words of names that tell what a layout has or lacks, not what the element is.
STATES = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "without_")
STATE_ENDS = ("-open", "_open", "-closed", "_closed")
#: Elements of NEVER that are boilerplate unless they hold the page's main text: some pages lie in one form.
WRAPS = {"form", "fieldset"}

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|!--(?:.*?--!?>|.*+)|[!?/][^>]*+>)""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
SENTENCE = re.compile(r"[.!?…。]['\"”’)]*\s*$")
NAME = re.compile(r"[a-z0-9]+")
#: Elements kept open at once; of those nested deeper only the names are kept, and they count as part of the last.
DEEPEST = 512
#: What elements say of a block, in log-odds, and the weights of the smoothness edges; capacities are whole 1 / UNITths.
INSIDE, OUTSIDE, NEVER_CONTENT = 4.0, -2.5, -8.0
NEXT, SIBLING, UNIT = 1.0, 0.8, 1000
#: Pages that the classifier is fitted to (expected), those that have to be there, its ridge penalty and its widest score.
FIT_PAGES, LEAST_PAGES, PENALTY, WIDEST = 300, 20, 1.0, 4.0
MOST_WORDS = 40
KINDS = {"p": "text", "blockquote": "quote", "pre": "quote", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell"}
FEATURES = ("one", "words", "before", "after", "links", "stop", "named", "place", "depth", "text", "quote", "heading", "item", "cell")
#: Weights by feature where no page can be learned from.
BY_HAND = np.array([-1.0, 3.2, 0.0, 0.0, -3.0, 0.8, -4.0, 0.0, 0.0, 1.0, 0.8, 0.5, -0.5, -0.3])


@dataclass(eq=False)
class Open:
    """An element. ``never``, ``wraps``, ``named`` and ``fine`` are its own marks (``never`` with those above it);
    ``bad``, ``good`` and ``doubt`` are what they and the page's text come to, with what lies above."""

    tag: str
    number: int
    above: Open | None
    link: bool
    never: bool = False
    wraps: bool = False
    named: bool = False
    fine: bool = False
    core: bool = False
    marked: bool = False
    talk: bool = False
    chars: int = 0
    before: int = 0
    holds: bool = False
    bad: bool = False
    good: bool = False
    doubt: bool = False


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]
    links: float
    top: Open

    bad = property(lambda self: self.top.bad)
    good = property(lambda self: self.top.good)
    doubt = property(lambda self: self.top.doubt)


def opened(tag: str, attributes: str, number: int, above: Open) -> Open:
    """An element on the stack, with its own marks."""
    names, roles, hidden = set(), set(), False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for word in value.split():
                if not word.startswith(STATES) and not word.endswith(STATE_ENDS):
                    names.update(NAME.findall(word))
        elif name == "role":
            roles.update(value.split())
        elif name == "hidden":
            hidden = True
    e = Open(tag, number, above, tag == "a" or above.link, above.never)
    e.named = bool(names & BAD_NAMES)
    e.talk = bool(names & TALK) and tag not in ("html", "body", "main")
    e.marked = above.marked or tag in ("article", "main")
    e.core = tag in ("article", "main") or bool(roles & {"main", "article"})
    if not e.core and tag not in ("html", "body"):
        e.never = e.never or hidden or tag in NEVER and tag not in WRAPS
        e.wraps = tag in WRAPS or bool(roles & BAD_ROLES)
        e.fine = bool(names & GOOD_NAMES)
    return e


def settle(root: Open, elements: list[Open]) -> None:
    """What the marks of the elements, in the order of their start tags, come to on the whole page."""
    for e in reversed(elements):
        if not e.never:
            e.above.chars += e.chars
    longest = max((e.chars for e in elements if e.core and not e.never), default=0)
    leads = {e.number for e in elements if e.core and not e.never and (e.tag == "main" or not e.named and 4 * e.chars >= longest)}
    for e in reversed(elements):
        e.above.holds = e.above.holds or e.holds or e.number in leads
    for e in elements:
        up, free = e.above, e.holds or 2 * e.chars > root.chars
        named = e.named and not free and not e.core and e.tag not in ("html", "body")
        e.good = up.good or e.core or e.fine and not named
        e.bad = up.bad or e.never or e.talk and e.before >= OPENING and not e.holds or not free and (e.wraps or e.tag == "header" and not e.good)
        e.doubt = (up.doubt or named) and e.number not in leads


def blocks_of(page: str) -> list[Block]:
    """Non-empty text blocks in page order."""
    out: list[Block] = []
    root = Open("", 0, None, False)
    elements: list[Open] = []
    stack: list[Open] = []
    deeper: list[str] = []
    many: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []
    number = at = prose = 0
    loose = False

    def flush() -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            total = sum(len(t) for t, _ in held)
            inner = next((e.tag for e in reversed(stack) if e.tag in BLOCKS), "")
            parents = tuple(e.number for e in stack if e.tag in BLOCKS)
            out.append(Block(text, inner, parents, sum(len(t) for t, a in held if a) / total, stack[-1] if stack else root))
        held.clear()

    def say(raw: str) -> None:
        nonlocal prose
        if raw:
            top = stack[-1] if stack else root
            held.append((html.unescape(raw), top.link))
            if not top.link:
                top.chars += len(raw.strip())
                prose += 0 if top.never else len(raw.strip())

    def close(tags: set[str], within: set[str]) -> None:
        """Closes the innermost open element of ``tags`` and all in it, unless one of ``within`` lies between."""
        if not any(many[t] for t in tags):
            return
        depth = len(stack) + len(deeper)
        for k in range(depth - 1, -1, -1):
            tag = stack[k].tag if k < len(stack) else deeper[k - len(stack)]
            if tag in tags:
                gone = [*(e.tag for e in stack[k:]), *deeper[max(k - len(stack), 0) :]]
                if any(t in BLOCKS for t in gone):
                    flush()
                many.subtract(gone)
                del deeper[max(k - len(stack), 0) :], stack[k:]
                return
            if tag in within or within and depth - k > DEEPEST:
                return

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        m = None if loose else TAG.match(page, lt)
        if m is None:
            m = LOOSE.match(page, lt)
            loose = loose or m is not None  # an open quote runs to the end; the rest is read without quotes
        if m is None:
            if re.match(r"<[a-zA-Z/!]", page[lt : lt + 2]) and page.find(">", lt) < 0:
                break  # a tag that is cut off
            say("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS and tag not in VOID:
                if not many[tag]:
                    flush()
                close({tag}, set())
            elif tag not in VOID:
                close({tag}, BLOCKS - {tag})
            continue
        if tag in BLOCKS:
            flush()
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "body"})
            if tag in CLOSES:
                close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"} - CLOSES[tag])
        if tag == "br":
            held.append(("\n", False))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        number += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        many[tag] += 1
        if len(stack) < DEEPEST:
            stack.append(opened(tag, m[3], number, stack[-1] if stack else root))
            elements.append(stack[-1])
            stack[-1].before = prose
        else:
            deeper.append(tag)
    flush()
    settle(root, elements)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Blocks x FEATURES, each about 0 to 1; the elements' own word on content is none of them."""
    n = len(blocks)
    words = np.array([min(b.text.count(" ") + 1, MOST_WORDS) for b in blocks]) / MOST_WORDS
    kinds = np.array([[KINDS.get(b.tag) == k for k in FEATURES[9:]] for b in blocks], float).reshape(n, -1)
    rest = [[b.links, bool(SENTENCE.search(b.text)), b.doubt, k / max(n - 1, 1), min(len(b.path), 20) / 20] for k, b in enumerate(blocks)]
    return np.column_stack([np.ones(n), words, np.append(0.0, words[:-1]), np.append(words[1:], 0.0), np.array(rest, float).reshape(n, -1), kinds])


def fitted(pages: list[str]) -> np.ndarray | None:
    """Weights from pages that mark their article and have text outside it; None if those are too few."""
    x, y, used = [], [], 0
    for page in pages:
        blocks = blocks_of(page)
        inside = [b.top.marked for b in blocks]
        if any(inside) and not all(inside):
            x.append(features(blocks))
            y += inside
            used += 1
    if used < LEAST_PAGES:
        return None
    x, y = np.concatenate(x), np.array(y, float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, ridge = np.zeros(x.shape[1]), PENALTY * np.eye(x.shape[1])
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - PENALTY * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(pages: DataFrame, most: int = FIT_PAGES) -> np.ndarray:
    """Weights for a table of pages, from about ``most`` of those that mark their article, or all if there are fewer."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    n = marked.count()
    draw = F.pmod(F.xxhash64(F.col("url").cast("string"), F.length("html"), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = fitted([r[0] for r in marked.where(draw < min(1.0, most / n)).select("html").collect()]) if n else None
    return BY_HAND if got is None else got


def scores(blocks: list[Block], weights: np.ndarray = BY_HAND) -> list[float]:
    """Log-odds of content."""
    marked = any(b.good and not b.bad and not b.doubt for b in blocks)
    own = np.clip(features(blocks) @ weights, -WIDEST, WIDEST)
    return [NEVER_CONTENT if b.bad else s + (INSIDE if b.good and not b.doubt else OUTSIDE if marked else 0.0) for b, s in zip(blocks, own.tolist())]


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: page neighbours by tree distance, and the last block before under the same parent."""
    out, last = [], {}
    inner = {e for b in blocks for e in b.path[:-1]}
    for k, b in enumerate(blocks):
        if k:
            p, q = blocks[k - 1].path, b.path
            same = next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
            out.append((k - 1, k, round(UNIT * NEXT / (1 + len(p) + len(q) - 2 * same))))
        parent = b.path[-1:] if b.path[-1:] and b.path[-1] in inner else b.path[-2:-1]  # loose text lies in its element itself
        if parent in last:
            out.append((last[parent], k, round(UNIT * SIBLING)))
        last[parent] = k
    return out


def source_side(to_source: list[int], to_sink: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut (Dinic's maximum flow on residual capacities)."""
    n = len(to_source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[int] = []

    def tie(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(head))
        head.append(b)
        room.append(there)
        graph[b].append(len(head))
        head.append(a)
        room.append(back)

    for k in range(n):
        direct = min(to_source[k], to_sink[k])  # flows straight through
        tie(s, k, to_source[k] - direct, 0)
        tie(k, t, to_sink[k] - direct, 0)
    for a, b, c in ties:
        tie(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not room[e])
                a = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[a] < len(graph[a]):
                e = graph[a][nxt[a]]
                if room[e] and level[head[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(graph[a]):
                path.append(graph[a][nxt[a]])
                a = head[path[-1]]
            elif path:
                level[a] = -1
                a = head[path.pop() ^ 1]
            else:
                break


def main_text(page: str | None, weights: np.ndarray = BY_HAND) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, yes in zip(blocks, content(blocks, weights)) if yes)


def content(blocks: list[Block], weights: np.ndarray = BY_HAND) -> list[bool]:
    """Which blocks the minimum cut leaves on the side of content."""
    cost = [(round(UNIT * math.log1p(math.exp(s))), round(UNIT * math.log1p(math.exp(-s)))) for s in scores(blocks, weights)]
    return source_side([c for c, _ in cost], [c for _, c in cost], edges(blocks))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; without ``weights`` they are learned from the pages."""
    weights = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), weights) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", F.col("html")), run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
