"""Main text of HTML pages by gradient-boosted trees over DOM-node features, decoded hierarchically.

A page becomes a tree of block nodes. Each node has features: how dense its subtree is in text, links and markup, hashed
tokens of its tag, class, id and role and of its ancestors', its depth, and how it compares with its siblings. Boosted
trees give the probability that a node belongs to the article. Decoding finds the likeliest consistent labelling of the
tree: a node is article or not together with all below it, so that no descendant contradicts it, or leaves the choice to its
children at a price.

The model is trained in numpy on a bounded sample: pages of the table itself, SAMPLE at most. No page has labels, so they
label themselves: elements with a plain meaning (article, nav, footer, ...) and plain class names (the lists ARTICLE and
OTHER) say what is article and what is not. With them go re-dressed copies of the same blocks, in which names, nesting and
order are redrawn and sidebars, notices, forms, adverts and reader comments are added around them.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 100
COPIES = 3
TREES = 40
DEPTH = 4
RATE = 0.3
#: Log-likelihood that a node gives up to leave the choice to its children.
MIXED = 1.0
BINS = 32
BUCKETS = 160
#: Nodes of pages whose features are in memory together, beside one page of any length.
TOGETHER = 20_000

# Fixed values of HTML: elements without content, of raw text, inline ones, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title svg iframe object canvas select textarea button".split())
RAW = frozenset("script style title textarea iframe".split())
# What may stand in a head: with content, all dropped, and without; and parts of a page, which no control holds.
HEAD, HEAD_VOID = frozenset("script style title template noscript".split()), frozenset("base basefont bgsound link meta head html".split())
SECTIONS = frozenset("article main section nav aside header footer".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form blockquote td th figure".split())

# Elements and attribute words that name what is and what is not an article, for labels.
ARTICLE = re.compile(r"^(article|main)$")
OTHER = re.compile(r"^(nav|footer|aside|header|form|menu)$|\b(ads?|advert\w*|banner|sidebar|menu|cookie|comments?|promo|newsletter|share|related|breadcrumbs?)\b")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "links", "depth", "index", "score")

    def __init__(self, tag: str, words: str, parent: Node | None) -> None:
        self.tag, self.words, self.parent = tag, words, parent
        self.children: list[Node] = []
        self.text = self.links = ""
        self.depth = parent.depth + 1 if parent else 0


class Builder(HTMLParser):
    """A tree of block nodes; a run of inline text is a leaf `#text`, and dropped elements are left out.

    skip holds a dropped element and those open inside it. It ends at the element's own end tag; a head also at what cannot
    stand in it, and all but raw text also at the end of an element around it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "", None)
        self.open: list[tuple[str, Node]] = [("#root", self.root)]
        self.tags: Counter[str] = Counter()  # of the open elements, so that a very deep page is not searched for what it lacks
        self.skip: list[str] = []
        self.run: list[str] = []
        self.linked: list[str] = []
        self.in_link = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            here = self.open[-1][1]
            leaf = Node("#text", "", here)
            leaf.text, leaf.links = text, " ".join("".join(self.linked).split())
            here.children.append(leaf)
        self.run, self.linked = [], []

    def close_to(self, depth: int) -> None:
        self.flush()
        self.drop(depth)

    def drop(self, depth: int) -> None:
        self.tags.subtract(t for t, _ in self.open[depth:])
        del self.open[depth:]

    def leaves(self, tag: str) -> bool:
        """Whether this start tag cannot be part of the dropped element."""
        if self.skip[-1] in RAW:
            return False
        if self.skip[0] == "head":
            return tag == "body" or len(self.skip) == 1 and tag not in HEAD and tag not in HEAD_VOID
        return self.skip[0] in ("button", "select") and tag in SECTIONS

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip and not self.leaves(tag):
            if self.skip[-1] not in RAW and tag not in VOID and tag not in HEAD_VOID:
                if tag in ("button", "select") and tag in self.skip:  # these do not nest
                    del self.skip[self.skip.index(tag) :]
                self.skip.append(tag)
            return
        self.skip = []
        if tag == "body":
            self.flush()
        if tag in DROPPED:
            self.skip.append(tag)
            return
        if tag == "br":
            self.flush()
            return
        if tag in INLINE:
            self.in_link += tag == "a"
            return
        self.flush()
        if tag in VOID:
            return
        if tag in ENDS_P and self.tags["p"]:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    self.drop(k)
                    break
                if self.open[k][0] in SCOPE:
                    break
        if any(self.tags[t] for t in SIBLINGS.get(tag, ())):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in SIBLINGS[tag]:
                    self.drop(k)
                    break
                if self.open[k][0] in SCOPE:
                    break
        values = dict(attrs)
        words = " ".join(str(values.get(k) or "") for k in ("class", "id", "role", "itemprop", "aria-label")).lower()
        if "hidden" in values or "display:none" in str(values.get("style") or "").replace(" ", "").lower():
            words += " hidden"
        node = Node(tag, words, self.open[-1][1])
        self.open[-1][1].children.append(node)
        self.open.append((tag, node))
        self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag not in RAW or tag == "iframe":
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip and (tag == self.skip[-1] or self.skip[-1] not in RAW):
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
                return
            if self.skip[-1] in RAW or not (tag == "a" and self.in_link or self.tags[tag]):
                return
            self.skip = []
        if tag in INLINE:
            self.in_link = max(0, self.in_link - (tag == "a"))
            return
        for k in range(len(self.open) - 1, 0, -1) if self.tags[tag] else ():
            if self.open[k][0] == tag:
                self.close_to(k)
                return

    def handle_data(self, data: str) -> None:
        if self.skip == ["head"] and data.strip():
            self.skip = []
        if not self.skip:
            self.run.append(data)
            if self.in_link:
                self.linked.append(data)


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html)
    if b.skip and b.skip[-1] in ("script", "style", "title", "textarea"):
        b.rawdata = ""
    b.close()
    b.flush()
    return b.root


def nodes(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    for i, n in enumerate(out):
        n.index = i
    return out


WORD = re.compile(r"[a-z]+|\d+")


def _tokens(n: Node) -> list[str]:
    return [f"t:{n.tag}", *(f"w:{w}" for w in WORD.findall(n.words))]


def features(every: list[Node]) -> np.ndarray:
    """A row for each node."""
    n = len(every)
    parent = np.array([x.parent.index if x.parent else -1 for x in every])
    chars = np.array([len(x.text) for x in every], np.float64)
    links = np.array([len(x.links) for x in every], np.float64)
    marks = np.array([sum(x.text.count(c) for c in ".,!?;:") for x in every], np.float64)
    size, leaves = np.ones(n), (chars > 0).astype(np.float64)
    for i in range(n - 1, 0, -1):  # children come after their parents
        for v in (chars, links, marks, size, leaves):
            v[parent[i]] += v[i]
    total = max(chars[0], 1.0)
    before = np.zeros(n)
    place, count = np.zeros(n), np.ones(n)
    seen = 0.0
    for x in every:
        before[x.index] = seen
        seen += len(x.text)
        for k, c in enumerate(x.children):
            place[c.index], count[c.index] = k / max(1, len(x.children) - 1), len(x.children)
    of = np.maximum(parent, 0)
    alike = np.ones(n)
    for x in every:
        tags = Counter(c.tag for c in x.children)
        for c in x.children:
            alike[c.index] = tags[c.tag] / len(x.children)
    dense = np.column_stack([
        np.log1p(chars), links / np.maximum(chars, 1), marks / np.maximum(chars, 1), np.log1p(size), np.log1p(chars / size), np.log1p(chars / np.maximum(leaves, 1)),
        chars / total, chars / np.maximum(chars[of], 1), [x.depth for x in every], place, np.log1p(count), before / total, alike, np.log1p(chars[of]), links[of] / np.maximum(chars[of], 1), np.full(n, np.log1p(total)),
    ])
    own, up = np.zeros((n, BUCKETS), np.uint8), np.zeros((n, BUCKETS), np.uint8)
    for x in every:
        i = x.index
        if x.parent:
            up[i] = np.maximum(up[parent[i]], own[parent[i]])
        for t in _tokens(x):
            own[i, zlib.crc32(t.encode()) % BUCKETS] = 1
    return np.column_stack([dense.astype(np.float32), own, up])


def _edges(column: np.ndarray) -> np.ndarray:
    """Where to cut a feature: halfway between its values, or at quantiles where there are many."""
    values = np.unique(column)
    return (values[1:] + values[:-1]) / 2 if len(values) <= BINS else np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))


class Boosted:
    """Gradient boosting for a yes or no, with histogram splits; each tree is a full one in arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Boosted:
        self.edges = [_edges(c) for c in x.T]
        b = np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]).astype(np.int64)
        self.depth, self.trees, f = depth, [], np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            feature, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for k in range(x.shape[1]):
                    if not len(self.edges[k]):
                        continue
                    cell = (node - first) * (BINS + 1) + b[:, k]
                    gs, hs = (np.bincount(cell, v, width * (BINS + 1)).reshape(width, -1) for v in (g, h))
                    gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    top = gain.argmax(1)
                    value = gain[np.arange(width), top]
                    better = np.flatnonzero(value > best)
                    best[better] = value[better]
                    feature[first + better], at[first + better] = k, top[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > at[node])
            leaf = node - (2**depth - 1)
            value = -RATE * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            self.trees.append((feature, at, value))
            f += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.column_stack([np.searchsorted(e, c, "right").astype(np.uint8) for e, c in zip(self.edges, x.T)])
        f, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > at[node])
            f += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-f))


def decode(every: list[Node], p: np.ndarray, mixed: float = MIXED) -> list[str]:
    """Blocks of the article in page order, by the likeliest consistent labelling of the tree.

    A node is all article, all not, or mixed, at a price; under either of the first two all its descendants agree with it.
    """
    p = np.clip(p, 0.02, 0.98)
    yes, no = np.log(p), np.log(1 - p)
    best = np.maximum(yes, no)
    below = np.zeros(len(every))
    for x in reversed(every):
        i = x.index
        if x.children:
            best[i] = max(yes[i], no[i], below[i] - mixed)
        if x.parent:
            up = x.parent.index
            yes[up] += yes[i]
            no[up] += no[i]
            below[up] += best[i]
    out, stack = [], [every[0]]
    while stack:
        x = stack.pop()
        i = x.index
        if x.children and below[i] - mixed > max(yes[i], no[i]):
            stack.extend(reversed(x.children))
        elif yes[i] > no[i]:
            out += [y.text for y in nodes_below(x) if y.text]
    return out


def nodes_below(x: Node) -> Iterator[Node]:
    stack = [x]
    while stack:
        y = stack.pop()
        yield y
        stack.extend(reversed(y.children))


def labelled(every: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """1 inside an article, 0 outside; weight 0 where a node holds both."""
    inside, outside = np.zeros(len(every), bool), np.zeros(len(every), bool)
    for x in every[1:]:
        up = x.parent.index
        named = OTHER.search(x.words) or OTHER.match(x.tag)
        inside[x.index] = (inside[up] or bool(ARTICLE.match(x.tag)) or "articlebody" in x.words) and not named
        outside[x.index] = outside[up] or (bool(named) and not inside[x.index])
    has = inside.copy()
    for x in reversed(every[1:]):
        has[x.parent.index] |= has[x.index]
    y = inside & ~outside
    known = np.array([y[x.index] or not has[x.index] for x in every])
    chars = np.array([len(x.text) for x in every], np.float64)
    for x in reversed(every[1:]):
        chars[x.parent.index] += chars[x.index]
    return y.astype(np.float64), known * np.log1p(chars)


# Names that sites give to the parts of a page, for the re-dressed copies.
BODY = ['article', 'main', 'div class="post-content"', 'div id="content"', 'div class="entry-content"', 'section class="story-body"', 'div class="article-body"', 'div itemprop="articleBody"', 'div', 'td']
PARTS = {
    "menu": ['nav', 'ul class="menu"', 'div id="nav"', 'div class="navbar top"', 'div role="navigation"', 'div class="breadcrumbs"', 'header'],
    "side": ['aside', 'div class="sidebar"', 'div id="related"', 'section class="widget recent-posts"', 'div class="toc"', 'aside class="newsletter"'],
    "ad": ['div class="ad"', 'div id="advert"', 'aside class="sponsored"', 'div class="banner promo"', 'section class="ads"', 'p class="advertisement"'],
    "note": ['div class="cookie-notice"', 'div id="cookie-banner"', 'div role="alert"', 'div class="notice"', 'div class="share social"', 'p class="disclaimer"'],
    "form": ['form class="subscribe"', 'form id="search"', 'form'],
    "comments": ['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div id="disqus_thread"'],
    "foot": ['footer', 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div class="legal"'],
}


def redressed(blocks: list[str], others: list[str], draw: np.random.Generator) -> tuple[str, list[str]]:
    """A page with these blocks as its article and parts of a site around it, and its text."""
    pick = lambda v: v[int(draw.integers(len(v)))]
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    filler = lambda n: safe(" ".join(pick(others).split()[:n]) or "More")

    def part(kind: str) -> str:
        name = pick(PARTS[kind])
        if kind in ("menu", "side") and draw.random() < 0.7:
            inner = "<ul>" + "".join(f'<li><a href="/{k}">{filler(int(draw.integers(1, 5)))}</a></li>' for k in range(int(draw.integers(3, 9)))) + "</ul>"
        elif kind == "comments":
            inner = "".join(f'<div class="comment"><b>{filler(2)}</b><p>{filler(int(draw.integers(5, 60)))}</p></div>' for _ in range(int(draw.integers(1, 6))))
        elif kind == "form":
            inner = f"<label>{filler(3)}</label><input type=text><p>{filler(6)}</p>"
        else:
            inner = "".join(f"<p>{filler(int(draw.integers(3, 40)))}</p>" if draw.random() < 0.6 else filler(int(draw.integers(3, 25))) for _ in range(int(draw.integers(1, 3))))
        return f"<{name}>{inner}</{name.split()[0]}>"

    def article() -> str:
        out = [f"<h1>{safe(blocks[0])}</h1>"]
        for b in blocks[1:]:
            kind = draw.random()
            out.append(f"<h2>{safe(b)}</h2>" if kind < 0.05 else f"<ul><li>{safe(b)}</li></ul>" if kind < 0.1 else f"<blockquote><p>{safe(b)}</p></blockquote>" if kind < 0.15 else f"<div>{safe(b)}</div>" if kind < 0.2 else f"<p>{safe(b)}</p>")
        return "".join(out)

    before = [part(k) for k in ("menu", "note", "ad", "side", "form") if draw.random() < 0.6]
    after = [part(k) for k in ("comments", "side", "ad", "note", "form", "foot") if draw.random() < 0.6]
    name = pick(BODY)
    body = f"<{name} data-article>{article()}</{name.split()[0]}>"
    if draw.random() < 0.4:
        body = f'<div class="container">{body}{after.pop(0) if after else ""}</div>'
    if draw.random() < 0.3:
        body = f'<div id="wrapper">{"".join(before)}{body}</div>'
        before = []
    return f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>", blocks


def train(pages: list[str], copies: int = COPIES, seed: int = 0) -> Boosted:
    """A model from pages with plain elements and from re-dressed copies of their blocks."""
    draw = np.random.default_rng(seed)
    xs, ys, ws, corpus = [], [], [], []
    for html in pages:
        every = nodes(parse(html))
        y, w = labelled(every)
        if y.any():
            xs.append(features(every))
            ys.append(y)
            ws.append(w)
            corpus.append([x.text for x in every if x.text and y[x.index]])
    every_block = [b for blocks in corpus for b in blocks] or ["A short text, with a comma and an end."]
    for blocks in corpus or [every_block]:
        for _ in range(copies):
            some = blocks[: int(draw.integers(1, len(blocks) + 1))]
            html, _ = redressed([re.sub(r"\s+", " ", b) for b in some], every_block, draw)
            every = nodes(parse(html))
            marked, at = np.zeros(len(every)), html.index(" data-article>")
            root = _marked(every, html[:at])
            inside = {x.index for x in nodes_below(root)}
            marked[list(inside)] = 1
            above = set()
            up = root.parent
            while up:
                above.add(up.index)
                up = up.parent
            xs.append(features(every))
            ys.append(marked)
            ws.append(np.array([0.0 if x.index in above else 1 + np.log1p(len(x.text)) for x in every]))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def _marked(every: list[Node], before: str) -> Node:
    """The node whose start tag ends `before`: in a parse of that much of the page it is the last one, and stands at the same place."""
    last = nodes(parse(before + ">"))[0]
    path = []
    while last.children and last.children[-1].tag != "#text":
        path.append(len(last.children) - 1)
        last = last.children[-1]
    x = every[0]
    for k in path:
        x = x.children[k]
    return x


def extract_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page; the trees run over the nodes of some pages together."""
    out, held = [], []

    def run() -> None:
        p = model.predict(np.concatenate([features(t) for t in held if t])) if any(held) else np.zeros(0)
        at = 0
        for t in held:
            out.append("\n".join(decode(t, p[at : at + len(t)])) if t else "")
            at += len(t)
        held.clear()
    for html in pages:
        held.append(nodes(parse(html)) if html else [])
        if sum(map(len, held)) > TOGETHER:
            run()
    run()
    return out


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Boosted:
    """A model from the sample different pages, whatever their length, whose html has the smallest hashes; only these come to the driver."""
    hashed = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not least:
        return train([])
    some = hashed.where(F.col("h") <= max(least)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    return train([r.html for r in some])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages, in which blocks of the article are joined by a line break.

    A null or empty page, and one without an article, has an empty text. Broken markup is read as far as it goes. Repeated
    rows and null ids are kept. Other columns are left out. An empty table gives no rows.
    """
    packed = pickle.dumps(fit(pages, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for b in batches:
            html = b.column(2).to_pylist()
            texts = [t for i in range(0, len(html), 64) for t in extract_texts(html[i : i + 64], model)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
