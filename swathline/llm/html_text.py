"""Main-text extraction by minimum-cut labelling.

A page is cut into text blocks.  A linear classifier over a block's own text, its element and the names of what it
lies in gives the log odds that it is content; these are terminal capacities.  Edges carry smoothness: between
neighbours in page order, the weaker the more steps of the element tree lie between them, and between a block and the
one before it in the same parent.  The minimum cut, found by maximum flow, is the cheapest labelling: what a block's
own features leave open, its neighbours decide.

The classifier is a logistic regression fitted on generated labelled pages (PAGES of them, seeded, of many layouts, with
and without telling names); the two edge weights are those of a small grid with the most blocks right on the pages left
out of the fit.  Both depend on no input and are fitted once, on the driver.

Tags are read as browsers do: a quote opens a value only after "=", and a tag that never ends by these rules ends at
its next ">" or takes the rest of the page.  Null or empty html has an empty text.  Each input row gives one output
row, whatever its ids.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][^\s/>]*+)")
_NAME = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?")
_EQUALS, _BARE = re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*$")
NAMED = {"class", "id", "role", "itemprop"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title iframe object svg math canvas audio video select option textarea button datalist".split())
RAW = set("script style noscript template iframe textarea title svg math".split())
MARKUP = set("template svg math".split())  # of RAW, those whose content is markup; that of the others is plain up to the end tag
BOILER_TAGS = set("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = {"article", "main"}
BOILER_WORDS = set("ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert menu nav navigation navbar sidebar footer masthead breadcrumb breadcrumbs comment comments reply replies disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay pagination pager widget login signup search toolbar copyright disclaimer complementary contentinfo".split())
CONTENT_WORDS = {"article", "main", "story", "post", "entry", "articlebody", "content"}
FEATURES = ["bias", "in content", "in boilerplate by name", "in boilerplate by tag", "link share", "all links", "length", "few words", "sentence", "heading", "item", "paragraph", "copyright"]
PAGES = 600  # generated pages that the classifier is fitted on, a quarter of them for the edges
GRID = (0.0, 0.8, 1.6, 2.4, 3.2)  # edge weights to choose from
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW - MARKUP}


class _Element:
    __slots__ = ("tag", "content", "boiler", "silent", "number", "link", "block", "above", "depth")

    def __init__(self, tag: str, names: dict[str, str], up: _Element | None, number: int):
        parts = {x.lower() for v in names.values() for x in _PART.findall(v)}
        opens = tag in CONTENT_TAGS or names.get("role", "").lower() == "main" or names.get("itemprop", "").lower() == "articlebody"
        hard = tag in BOILER_TAGS
        soft = bool(parts & BOILER_WORDS) and tag not in ("body", "html") or tag == "header" and not (up and up.content)
        self.tag, self.number = tag, number
        self.silent = tag in SILENT or bool(up and up.silent)
        self.link = tag == "a" or bool(up and up.link)
        within = up.boiler if up else 0
        # 2: an element that only holds boilerplate; 1: named so, which an article inside takes back
        self.boiler = 2 if hard and tag != "form" or within == 2 else max(within * (not opens), int(soft or hard) and (1 if not (up and up.content) else 2))
        self.content = opens or bool(up and up.content) or bool(parts & CONTENT_WORDS) and not self.boiler
        # the nearest element that isn't inline, itself or above, and the next one above that
        over = up.block if up else None
        self.block, self.above = (over, None) if tag in INLINE else (self, over)
        self.depth = over.depth + 1 if over else 0


def _hops(a: _Element | None, b: _Element | None) -> int:
    """Steps of the element tree between two blocks' elements."""
    n = 0
    while a is not b:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        n += 1
    return n


def _end(page: str, at: int, tag: str) -> int:
    """Where the end tag of a plain element starts, or the page's end."""
    m = _ENDS[tag].search(page, at)
    return m.start() if m else len(page)


def _tag(page: str, at: int, dead: dict[str, int]) -> tuple[int, dict[str, str], bool]:
    """Where a tag ends whose name ends at a place, its naming attributes, and whether it closes itself.  dead holds
    from where on a quote isn't found any more."""
    begin, names = at, {}
    while True:
        m = _NAME.match(page, at)
        at = m.end()
        if m[1] is None:
            if at < len(page):  # ">"
                return at + 1, names, page[at - 1] == "/"
            end = page.find(">", begin)
            return (end + 1 if end >= 0 else len(page)), names, False
        e = _EQUALS.match(page, at)
        if not e:
            continue
        at, quote = e.end(), page[e.end() : e.end() + 1]
        end = -1
        if quote in ("'", '"') and at < dead.get(quote, len(page)):
            end = page.find(quote, at + 1)
            if end < 0:
                dead[quote] = at
        value = page[at + 1 : end] if end >= 0 else _BARE.match(page, at)[0]
        at = end + 1 if end >= 0 else at + len(value)
        names.setdefault(key, value) if (key := m[1].lower()) in NAMED else None


def _features(text: str, links: float, top: _Element | None) -> tuple[float, ...]:
    tag = top.tag if top else ""
    return (
        1.0, float(bool(top and top.content and not top.boiler)), float(bool(top and top.boiler == 1)), float(bool(top and top.boiler == 2)),
        links, float(links > 0.95), math.log1p(len(text) / 60), float(text.count(" ") < 4), float(bool(_SENTENCE.search(text[-8:]))),
        float(bool(re.fullmatch("h[1-6]", tag))), float(tag in ("li", "dt", "dd", "td", "th")), float(tag in ("p", "blockquote", "pre")), float("©" in text[:20]),
    )


def blocks(page: str) -> list[dict]:
    """The page's text blocks in order: text, features, the parent element's number, and the steps of the element tree
    from the block before."""
    stack: list[_Element] = []
    opened: Counter = Counter()
    out: list[dict] = []
    parts: list[str] = []
    dead: dict[str, int] = {}
    links = count = at = seek = 0
    skip, before = "", None

    def flush() -> None:
        nonlocal parts, links, before
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1].block if stack else None
            out.append({"text": text, "x": _features(text, links / len(text), top), "parent": top.number if top else 0, "hops": _hops(before, top) if out else 0, "up": top.above.number if top and top.above else 0})
            before = top
        parts, links = [], 0

    def add(text: str) -> None:
        nonlocal links
        if text and not (stack and stack[-1].silent):
            text = html.unescape(text)
            parts.append(text)
            if stack and stack[-1].link:
                links += len(text.strip())

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    while m := _START.search(page, seek):
        names, closed = {}, False
        if m[2]:
            end, names, closed = (m.end() + 1, names, False) if page[m.end() : m.end() + 1] == ">" else _tag(page, m.end(), dead)
        else:
            end = page.find({"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">"), m.start() + 2)
            end = len(page) if end < 0 else end + (1 if len(m[0]) == 2 else 3)
        seek, tag = end, (m[2] or "").lower()
        if skip:
            if not (m[1] and tag == skip):
                if tag in _ENDS and not m[1] and not closed:
                    seek = _end(page, seek, tag)
                continue
            skip = ""
        else:
            add(page[at : m.start()])
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            if opened[tag] > 0:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # a block ends an open paragraph; an item ends the item before it
            ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    cut(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag == "body":
            cut(0)
        count += 1
        stack.append(_Element(tag, names, stack[-1] if stack else None, count))
        opened[tag] += 1
        if closed and tag in ("svg", "math"):
            cut(len(stack) - 1)
        elif tag in RAW:
            skip = tag
            if tag in _ENDS:
                seek = _end(page, seek, tag)
    if not skip:
        add(page[at:])
    flush()
    return out


def _page(r: random.Random) -> tuple[str, set[str]]:
    """A generated page and the texts of its content blocks."""
    kept: set[str] = set()

    def words(lo: int, hi: int, end: str = "") -> str:
        return " ".join("".join(r.choice(["ka", "lo", "mi", "ter", "un", "ves", "or", "en", "sta"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))).capitalize() + end

    def link(text: str) -> str:
        return f'<a href="/{r.randrange(99)}">{text}</a>'

    def menu(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(n)) + "</ul>"

    def wrapped(inner: str, tags: list[str], names: list[str]) -> str:
        kind = r.random()
        if kind < 0.45:
            tag = r.choice(tags)
            return f"<{tag}>{inner}</{tag}>"
        return f'<div class="{r.choice(names)}">{inner}</div>' if kind < 0.8 else f"<div>{inner}</div>"

    def text(lo: int, hi: int, end: str = "") -> str:
        kept.add(x := words(lo, hi, end))
        return x

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.6:
            return f"<p>{text(8, 90, '.')}</p>"
        if kind < 0.75:
            return f"<p>{text(1, 5, r.choice(['', '.', '!']))}</p>"
        if kind < 0.82:
            return f"<p>{link(text(2, 12))}</p>"
        if kind < 0.9:
            return f"<h{(k := r.randint(2, 4))}>{text(1, 8)}</h{k}>"
        return "<ul>" + "".join(f"<li>{text(1, 14)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"

    def inside() -> str:
        """Boilerplate that lies in an article."""
        kind = r.random()
        if kind < 0.5:
            return f'<div class="{r.choice(["ad", "sponsored", "promo-box"])}">{words(2, 14, ".")}</div>'
        if kind < 0.7:
            return f'<div class="share">{menu(r.randint(2, 4))}</div>'
        if kind < 0.85:
            return f"<form><label>{words(1, 3)}</label><p>{words(3, 12, '.')}</p></form>"
        return f"<aside>{menu(3)}</aside>"

    body = [f"<h1>{text(2, 12)}</h1>"] * (r.random() < 0.85) + [x for _ in range(r.randint(1, 9)) for x in [paragraph()] + [inside()] * (r.random() < 0.08)]
    comments = "".join(f"<p>{words(2, 40, '.')}</p>" for _ in range(r.randint(1, 5)))
    teasers = "".join(f"<div>{link(words(3, 8))}<p>{words(4, 16, '.')}</p></div>" for _ in range(r.randint(1, 4)))
    before = [
        (0.6, lambda: wrapped(f"<p>{words(1, 3)}</p>" + menu(r.randint(2, 7)), ["header"], ["header", "masthead"])),
        (0.8, lambda: wrapped(menu(r.randint(3, 9)), ["nav"], ["menu", "navbar", "top"])),
        (0.4, lambda: f'<div class="{r.choice(["cookie-notice", "banner", "alert"])}">{words(4, 25, ".")}</div>'),
        (0.4, lambda: f'<div class="{r.choice(["ad", "advert", "sponsored"])}">{words(2, 14, ".")}</div>'),
    ]
    after = [
        (0.3, lambda: f'<div id="{r.choice(["comments", "disqus", "replies"])}"><h3>{words(1, 2)}</h3>{comments}</div>'),
        (0.5, lambda: wrapped(f"<h3>{words(1, 2)}</h3>" + r.choice([menu(4), teasers]), ["aside"], ["sidebar", "related", "box"])),
        (0.9, lambda: wrapped(f"<p>{r.choice(['© ', ''])}{words(1, 6)}</p>" + menu(r.randint(1, 4)), ["footer"], ["footer", "copyright", "bottom"])),
    ]
    some = lambda parts: "".join(f() for p, f in parts if r.random() < p)
    return f"<html><body>{some(before)}{wrapped(''.join(body), ['article', 'main'], ['content', 'post', 'entry-body', 'text'])}{some(after)}</body></html>", kept


def examples(n: int, seed: int) -> list[tuple[list[dict], list[bool]]]:
    """Generated pages as blocks with their labels."""
    r, out = random.Random(seed), []
    for _ in range(n):
        page, kept = _page(r)
        found = blocks(page)
        out.append((found, [b["text"] in kept for b in found]))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w.round(4)


@functools.cache
def model() -> tuple[tuple[float, ...], float, float]:
    """(weights, near, sibling): the classifier's weights and those of the edges."""
    pages = examples(PAGES, 11)
    learn, held = [p for i, p in enumerate(pages) if i % 4], pages[::4]
    weights = tuple(fit(np.array([b["x"] for found, _ in learn for b in found]), np.array([k for _, kept in learn for k in kept], dtype=float)).tolist())
    right = lambda near, sibling: sum(a == b for found, kept in held for a, b in zip(labels(found, (weights, near, sibling)), kept, strict=True))
    near, sibling = max(((a, b) for a in GRID for b in GRID), key=lambda e: right(*e))
    return weights, near, sibling


def score(b: dict, weights: tuple[float, ...]) -> float:
    """The classifier's log odds that a block is content."""
    return sum(w * v for w, v in zip(weights, b["x"], strict=True))


def edges(found: list[dict], near: float, sibling: float) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(found):
        if i and near:
            out.append((i - 1, i, near / (1 + b["hops"])))
        for key, w in ((("p", b["parent"]), sibling), (("u", b["up"]), sibling / 2)):
            if w and key in last:
                out.append((last[key], i, w))
            last[key] = i
    return out


def labels(found: list[dict], fitted: tuple[tuple[float, ...], float, float] | None = None) -> list[bool]:
    """Which blocks are content."""
    weights, near, sibling = fitted or model()
    return min_cut([score(b, weights) for b in found], edges(found, near, sibling))


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: a positive cost is paid for calling a node false, a negative one for
    true, and an edge's weight where its ends differ.  Dinic's maximum flow."""
    n = len(costs)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for i, c in enumerate(costs):
        if c > 0:
            arc(s, i, c, 0.0)
        elif c < 0:
            arc(i, t, -c, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at, path, u = [0] * (n + 2), [], s
        while True:  # augment along the level graph, without recursion
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[u] < len(head[u]):
                e = head[u][at[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
                continue
            path.append(head[u][at[u]])
            u = to[path[-1]]


def main_text(page: str | None, fitted: tuple[tuple[float, ...], float, float] | None = None) -> str:
    found = blocks(page or "")
    return " ".join(b["text"] for b, k in zip(found, labels(found, fitted), strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, the page's main text and its length in code points."""
    rows, fitted = pages.select(*keep, pages[html_col].alias("_html")), model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x, fitted) for x in batch.column("_html").to_pylist()]
            added = [pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], [*keep, "text", "n_chars"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
