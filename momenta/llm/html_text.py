"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read into leaf blocks (runs of text between block-level tags) with the tags, classes and ids above them.
Each block gets features from those ancestors and from its text; the chain of a page's blocks is labelled main text or
not by Viterbi's algorithm. Weights are learnt from labelled pages, small pages of known layout in which each
block's label is known, and travel with the job. Pages are independent, so the job is a map over the table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>"
    r"|<[a-zA-Z/][^<>]*+\Z",
    re.S,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")
#: Tags whose content is no text of the page.
_RAW = frozenset("script style template textarea iframe select title annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math semantics mrow mi mo mn ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mspace mstyle".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PARA = frozenset(("p", "li", "dt", "dd", "option", "tr", "td", "th", *_HEADINGS))
#: An opening tag of the left ends an open element of the right, up to the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold the paragraphs of an article, or of something else.
_HOLDS = frozenset("div section article main aside nav header footer td form body".split())
_SCOPE = frozenset("div section article main aside nav header footer ul ol dl table form body html blockquote figure".split())


class Tree:
    """The block elements of a page by number: the parent's number, tag and marks. Number 0 stands for the page itself; parents come before children."""

    def __init__(self) -> None:
        self.parent, self.tag, self.marks = [0], [""], [""]

    def add(self, parent: int, tag: str, marks: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.marks.append(marks)
        return len(self.tag) - 1


@dataclass
class Block:
    """text, the element right around it (a number of the page's tree), and characters in links."""

    text: str
    tree: Tree
    node: int = 0
    linked: int = 0


def _marks(attributes: str) -> str:
    """The words of class, id and role, cut where capitals begin one (siteHeader)."""
    return " ".join(_CAMEL.sub("-", a or b or c).lower() for a, b, c in _ATTR.findall(attributes)) if attributes else ""


class _Open:
    """The open elements, outermost first, with the places of each tag, of blocks and of scopes, so that no step looks through them all."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.links = 0

    def last(self, name: str) -> int:
        at = self.places.get(name)
        return at[-1] if at else -1

    def push(self, name: str, node: int) -> None:
        at = len(self.stack)
        self.stack.append((name, node))
        self.places.setdefault(name, []).append(at)
        if name not in _INLINE:
            self.blocks.append(at)
        if name in _SCOPE:
            self.scopes.append(at)
        self.links += name == "a"

    def cut(self, k: int) -> None:
        """Ends the elements from place k on."""
        while len(self.stack) > k:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name not in _INLINE:
                self.blocks.pop()
            if name in _SCOPE:
                self.scopes.pop()
            self.links -= name == "a"

    def node(self) -> int:
        return self.stack[self.blocks[-1]][1] if self.blocks else 0

    def ended_by(self, name: str) -> int:
        """Where the element begins that an opening block tag ends: an open paragraph, or the item before, in the same container; -1 if none."""
        k = max(self.last(x) for x in ("p", *_ENDS.get(name, ()), *(_HEADINGS if name in _PARA else ())))
        return k if not self.scopes or k > self.scopes[-1] else -1

    def closed_by(self, name: str) -> int:
        """Where the element begins that a closing tag ends; an inline one does not reach beyond the block it is in."""
        k = self.last(name)
        return k if name not in _INLINE or not self.blocks or k > self.blocks[-1] else -1


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; markup may be broken: what isn't closed ends with its container. Time and memory grow with the page, however deep it nests."""
    tree, open_, out, at = Tree(), _Open(), [], 0
    text: list[str] = []
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal text, linked
        t = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if t:
            out.append(Block(t, tree, open_.node(), linked))
        text, linked = [], 0

    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(piece)
            linked += len(piece) if open_.links else 0
        if m is None:
            break
        at = m.end()
        close, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        empty = attributes.endswith("/")
        if name in _RAW and not close and not empty:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif name == "br":
            text.append(" ")
        elif name == "hr":
            flush()
        elif name and name not in _VOID:
            inline = name in _INLINE
            if not inline:
                flush()
            if close:
                if (k := open_.closed_by(name)) >= 0:
                    open_.cut(k)
                continue
            if not inline and (k := open_.ended_by(name)) >= 0:
                open_.cut(k)
            if not empty:
                open_.push(name, 0 if inline else tree.add(open_.node(), name, _marks(attributes)))
    flush()
    return out


_HINTS = (
    ("menu", "nav menu navbar breadcrumb breadcrumbs tabs toc sitemap pagination pager"),
    ("head", "header masthead banner topbar logo branding"),
    ("foot", "footer copyright colophon legal bottom disclaimer imprint"),
    ("side", "sidebar aside related widget rail recommended trending popular more teaser"),
    ("note", "notice cookie consent gdpr popup modal alert overlay message warning newsletter subscribe signup paywall"),
    ("ad", "ad ads advert advertisement sponsored sponsor promo banner-ad adsense"),
    ("talk", "comment comments reply replies respond response responses disqus discussion reader feedback"),
    ("share", "share social follow tags meta byline author-box search login form"),
    ("main", "article content main post entry story body text page-content article-body"),
)
_HINT_OF = {w: h for h, ws in _HINTS for w in ws.split()}
_MARK = re.compile(r"[a-z]+(?:-[a-z]+)*")


@lru_cache(maxsize=4096)
def _hints(marks: str) -> tuple[str, ...]:
    found = set()
    for m in _MARK.findall(marks):
        for w in (m, *m.split("-")):
            if w in _HINT_OF:
                found.add(_HINT_OF[w])
    return tuple(sorted(found))


@lru_cache(maxsize=4096)
def _own_features(tag: str, marks: str, wide: bool) -> tuple[frozenset[str], str]:
    """What an element gives to all text in it: its tag, what its marks hint at, and which of either comes last.

    Marks of the root and of elements around nearly all text of the page (wide) are about its layout and count apart, but for comments.
    """
    out, last = set(), ""
    if tag in _SCOPE or tag in ("button", "fieldset", "figcaption", "address", "menu", "dialog", "details", "noscript"):
        if tag not in ("html", "body", "div"):
            out.add(f"in={tag}")
            last = f"near={tag}"
    for h in _hints(marks) if tag not in ("html", "body") else ():
        if wide and h not in ("talk", "main"):
            out.add(f"wide={h}")
        else:
            out.add(f"hint={h}")
            last = f"near={h}"
    return frozenset(out), last


#: Share of a page's text from which an element is about all of it, words by which blocks differ, and those that are counted in one.
WIDE = 0.8
SOME = 4
PROSE = 12
MANY = 40


def _n_words(text: str) -> int:
    """The words of text, up to MANY."""
    return len([*islice(_WORD.finditer(text), MANY)])


def _ancestors(tree: Tree, node: int) -> Iterator[int]:
    """The element and those around it, innermost first."""
    while node:
        yield node
        node = tree.parent[node]


def features(chain: list[Block]) -> list[list[str]]:
    """Features of each block of a page: its ancestors', its text's, and how much of the page's text its container holds."""
    words, linked = [_n_words(b.text) for b in chain], [b.linked / len(b.text) for b in chain]
    prose = [len(b.text) if w >= SOME and x < 0.4 else 0 for b, w, x in zip(chain, words, linked, strict=True)]
    total = sum(prose)
    if not chain:
        return []
    tree, n_nodes = chain[0].tree, len(chain[0].tree.tag)
    # from the page down: nearest container, and whether an article, main or heading is around
    container, headed = [0] * n_nodes, [False] * n_nodes
    for i in range(1, n_nodes):
        container[i] = i if tree.tag[i] in _HOLDS else container[tree.parent[i]]
        headed[i] = headed[tree.parent[i]] or tree.tag[i] in ("article", "main", "h1")
    containers = [container[b.node] for b in chain]
    # from the leaves up: prose inside each element
    held, own = [0] * n_nodes, Counter()
    for b, c, n in zip(chain, containers, prose, strict=True):
        held[b.node] += n
        own[c] += n
    for i in range(n_nodes - 1, 0, -1):
        held[tree.parent[i]] += held[i]
    best = max(own, key=own.__getitem__, default=0)
    here = [k for k, (c, n) in enumerate(zip(containers, prose, strict=True)) if c == best and n] if total else []
    head = next((b.node for b in chain if headed[b.node]), None)
    wide = [False] * n_nodes
    if total:
        spine = range(1, n_nodes) if head is None else _ancestors(tree, head)
        for i in spine:
            wide[i] = held[i] >= WIDE * total
    given: list[tuple[frozenset[str], str]] = [(frozenset(), "")] * n_nodes
    for i in range(1, n_nodes):
        (above, last), (mine, mine_last) = given[tree.parent[i]], _own_features(tree.tag[i], tree.marks[i], wide[i])
        given[i] = (above if mine <= above else above | mine, mine_last or last)
    out = []
    for k, b in enumerate(chain):
        size = "0" if words[k] < SOME else "1" if words[k] < PROSE else "2" if words[k] < MANY else "3"
        around, last = given[b.node]
        f = [*sorted({"bias", f"tag={tree.tag[b.node]}"} | around), last or "near=", f"size={size}", "links=" + ("no" if linked[k] == 0 else "few" if linked[k] < 0.4 else "most")]
        if "©" in b.text and words[k] < MANY or b.text[0] == "™":
            f.append("copyright")
        if b.text[-1] in ".!?。":
            f.append("stop")
        if here:
            f.append("own=" + ("best" if containers[k] == best else "some" if 5 * own[containers[k]] >= own[best] else "few"))
            f.append("at=" + ("before" if k < here[0] else "after" if k > here[-1] else "within"))
            f += [f"{f[-1]},size={size}", f"{f[-1]},{'linked' if linked[k] >= 0.4 else 'not'}"]
        out.append(f)
    return out


class ChainModel:
    """A two-label linear chain: weights of features by label, of label pairs, and of the first label."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.w = np.zeros((len(names), 2))
        self.t = np.zeros((2, 2))

    def ids(self, chain: list[list[str]]) -> list[np.ndarray]:
        return [np.array([self.names[x] for x in f if x in self.names], np.int64) for f in chain]

    def scores(self, ids: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[i].sum(axis=0) for i in ids])

    def viterbi(self, chain: list[list[str]]) -> list[int]:
        """The best labels; of equal ones those with the lower label."""
        if not chain:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        s = self.scores(self.ids(chain)).tolist()
        (a, b), back = s[0], []
        for x, y in s[1:]:
            back.append((0 if a + t00 >= b + t10 else 1, 0 if a + t01 >= b + t11 else 1))
            a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        label = 0 if a >= b else 1
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return out[::-1]

    def gradient(self, ids: list[np.ndarray], labels: list[int], gw: np.ndarray, gt: np.ndarray) -> float:
        """Adds the gradient of the log-likelihood of one labelled page, by the forward and backward sums; returns that likelihood."""
        s, n = self.scores(ids), len(ids)
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        up[0] = s[0]
        for k in range(1, n):
            up[k] = np.logaddexp(up[k - 1, 0] + self.t[0], up[k - 1, 1] + self.t[1]) + s[k]
        for k in range(n - 2, -1, -1):
            down[k] = np.logaddexp(self.t[:, 0] + s[k + 1, 0] + down[k + 1, 0], self.t[:, 1] + s[k + 1, 1] + down[k + 1, 1])
        z = np.logaddexp(up[-1, 0], up[-1, 1])
        p = np.exp(up + down - z)
        for k, i in enumerate(ids):
            np.add.at(gw, i, (np.arange(2) == labels[k]) - p[k])
        value = s[np.arange(n), labels].sum() - z
        for k in range(1, n):
            pair = np.exp(up[k - 1][:, None] + self.t + (s[k] + down[k])[None, :] - z)
            gt -= pair
            gt[labels[k - 1], labels[k]] += 1
            value += self.t[labels[k - 1], labels[k]]
        return value


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> ChainModel:
    """Maximum likelihood with a quadratic penalty, by adaptive gradient steps over all pages at once.

    ChainModel.gradient() is the same for one page; here the forward and backward sums go over all pages, padded.
    """
    chains = [features(b) for b, _ in pages]
    names = {x: k for k, x in enumerate(sorted({x for c in chains for f in c for x in f}))}
    model = ChainModel(names)
    n, most = len(chains), max(map(len, chains))
    x = np.zeros((sum(map(len, chains)), len(names)))
    at, inside = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    label = np.zeros((n, most), np.int64)
    row = 0
    for p, (c, (_, y)) in enumerate(zip(chains, pages, strict=True)):
        for k, f in enumerate(c):
            x[row, [names[v] for v in f]] = 1
            at[p, k], inside[p, k], label[p, k] = row, True, y[k]
            row += 1
    seen = np.zeros((len(x), 2))
    seen[at[inside], label[inside]] = 1
    pairs = np.zeros((2, 2))
    both = inside[:, 1:]
    np.add.at(pairs, (label[:, :-1][both], label[:, 1:][both]), 1)
    sw, st = np.full_like(model.w, 1e-8), np.full_like(model.t, 1e-8)
    add = np.logaddexp
    for _ in range(rounds):
        s, t = (x @ model.w)[at], model.t
        up, down = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        up[:, 0] = s[:, 0]
        for k in range(1, most):
            up[:, k] = add(up[:, k - 1, :1] + t[0], up[:, k - 1, 1:] + t[1]) + s[:, k]
        for k in range(most - 2, -1, -1):
            later = s[:, k + 1] + down[:, k + 1]
            down[:, k] = np.where(inside[:, k + 1, None], add(t[:, 0] + later[:, :1], t[:, 1] + later[:, 1:]), 0)
        z = add(up[:, 0, 0] + down[:, 0, 0], up[:, 0, 1] + down[:, 0, 1])
        expected = np.exp(up + down - z[:, None, None])[inside]
        pair = np.exp(up[:, :-1, :, None] + t + (s + down)[:, 1:, None, :] - z[:, None, None, None])[both].sum(axis=0)
        gw = x[at[inside]].T @ (seen[at[inside]] - expected) - decay * n * model.w
        gt = pairs - pair - decay * n * model.t
        sw += gw * gw
        st += gt * gt
        model.w += rate * gw / np.sqrt(sw)
        model.t += rate * gt / np.sqrt(st)
    return model


#: Layouts of the labelled pages: (opening tags, kind of text, label), the closing tags follow from the opening ones.
_BEFORE = (
    ("<nav><ul><li><a>", "link", 0), ("<div class='nav'><ul><li><a>", "link", 0), ("<header><h1><a>", "few", 0), ("<header><p>", "some", 0), ("<div class='header'><p>", "some", 0),
    ("<div class='ad'>", "some", 0), ("<div class='advert'><p>", "prose", 0), ("<aside><p>", "prose", 0), ("<div id='cookie-notice'><p>", "prose", 0), ("<div class='menu'><a>", "link", 0),
    ("<form><label>", "few", 0), ("<div class='breadcrumb'><a>", "link", 0), ("<div role='banner'><p>", "some", 0), ("<div class='notice'><p>", "some", 0), ("<section class='popup'><p>", "prose", 0),
)
_AFTER = (
    ("<footer>", "legal", 0), ("<footer><p>", "some", 0), ("<div class='footer'><p>", "legal", 0), ("<aside><h3>", "few", 0), ("<aside><ul><li><a>", "link", 0), ("<div class='sidebar'><p>", "prose", 0),
    ("<div class='related'><ul><li><a>", "link", 0), ("<section class='comments'><div class='comment'><p>", "prose", 0), ("<div id='comments'><p>", "prose", 0), ("<ol class='comment-list'><li><p>", "prose", 0),
    ("<div class='share'><a>", "link", 0), ("<form><p>", "some", 0), ("<div class='newsletter'><form><p>", "some", 0), ("<div class='ad'>", "prose", 0), ("<nav><a>", "link", 0), ("<div class='widget'><p>", "prose", 0),
)
_INSIDE = (
    ("<h1>", "few", 1), ("<p>", "prose", 1), ("<p>", "prose", 1), ("<p>", "prose", 1), ("<p>", "some", 1), ("<p>", "few", 1), ("<h2>", "few", 1), ("<h3>", "few", 1), ("<ul><li>", "some", 1), ("<blockquote><p>", "prose", 1),
    ("<ol><li>", "few", 1), ("<table><tr><td>", "few", 1), ("<pre>", "some", 1), ("<figure><figcaption>", "some", 1), ("<div>", "prose", 1), ("<p><b>", "some", 1), ("<dl><dt>", "few", 1), ("<section><p>", "prose", 1), ("<ul><li><a>", "link", 1),
    ("<div class='ad'>", "some", 0), ("<aside><p>", "some", 0), ("<div class='share'><a>", "link", 0), ("<nav><ul><li><a>", "link", 0), ("<div class='comments'><p>", "prose", 0), ("<header><p>", "few", 0), ("<footer><p>", "few", 0), ("<form><p>", "few", 0), ("<div class='newsletter'><p>", "some", 0),
)
_HOLDERS = ("<article>", "<main>", "<main><article>", "<div class='content'>", "<div id='main'>", "<div class='post'>", "<div class='article-body'>", "<div>", "", "<div role='main'>", "<section class='story'>", "<div class='wrapper'><article class='post'>")


#: Marks that mislead: of wrappers around a whole page, and what stands for the usual words of a mark.
_MISLEADING = ("has-header has-footer sidebar-right", "popular-science", "page-header-fixed", "promo-layout", "with-sidebar", "comment-enabled-false", "ad-free", "menu-open", "related-topics", "news-alert-theme")
_OTHER = {"header": "siteHeader", "footer": "pageFooter", "ad": "adBox", "advert": "advertSlot", "menu": "mainMenu", "nav": "topNav", "comments": "userComments", "comment": "userComment", "sidebar": "rightSidebar", "related": "relatedPosts", "share": "shareBar", "cookie-notice": "cookieBanner", "notice": "siteNotice", "newsletter": "newsletterBox", "widget": "widgetArea", "content": "mainContent", "post": "blogPost"}


def labelled_pages(n: int = 240, seed: int = 7, noise: float = 0.0) -> list[tuple[list[Block], list[int]]]:
    """Pages of the layouts above in random order, with each block's label; the words mean nothing, no feature looks at them.

    With that chance each, a page's marks are left out, or written otherwise, and a wrapper with a misleading mark is
    put around it or its article.
    """
    rng = np.random.default_rng(seed)

    def text(kind: str) -> str:
        least, most = {"link": (1, 4), "few": (1, 8), "some": (4, 25), "prose": (15, 120), "legal": (3, 10)}[kind]
        words = " ".join("w" * int(k) for k in rng.integers(2, 9, int(rng.integers(least, most))))
        return f"© {words}" if kind == "legal" else words + ("." if kind in ("some", "prose") and rng.random() < 0.8 else "")

    def closing(opening: str) -> str:
        return "".join(f"</{t}>" for t in re.findall(r"<(\w+)", opening)[::-1])

    pages = []
    for _ in range(n):
        label, parts, holder = [], [], _HOLDERS[rng.integers(len(_HOLDERS))]
        bare, other, wrapped, around_article = (rng.random(4) < noise).tolist() if noise else [False] * 4

        def marked(opening: str, bare=bare, other=other) -> str:
            if bare:
                return re.sub(r" (?:class|id|role)='[^']*'", "", opening)
            return re.sub(r"'([^']*)'", lambda m: f"'{_OTHER.get(m[1], m[1])}'", opening) if other else opening

        wrapper = f"<div class='{_MISLEADING[rng.integers(len(_MISLEADING))]}'>" if wrapped or around_article else ""
        if around_article:
            holder = wrapper + holder
        groups = ((_BEFORE, int(rng.integers(0, 5)), ""), (_INSIDE, int(rng.integers(1, 14)), holder), (_AFTER, int(rng.integers(0, 6)), ""))
        for options, count, around in groups:
            body = []
            for k in rng.integers(0, len(options), count):
                opening, kind, y = options[k]
                if bare and opening.startswith("<div") and not y and (kind not in ("link", "legal") or options is _INSIDE):
                    continue  # nothing tells it from the article's own
                for _ in range(int(rng.integers(1, 7)) if kind == "link" else 1):
                    body.append(marked(opening) + text(kind) + closing(opening))
                    label.append(y)
            parts.append(marked(around) + "".join(body) + closing(around))
        whole = "".join(parts)
        found = blocks("<body>" + (wrapper + whole + "</div>" if wrapped and not around_article else whole) + "</body>")
        if found and len(found) == len(label):
            pages.append((found, label))
    return pages


_model: list[ChainModel] = []


def model() -> ChainModel:
    """The model of this process, trained when first asked for; the pages and the steps are fixed, so all are equal."""
    if not _model:
        _model.append(train(labelled_pages() + labelled_pages(360, 11, 0.35)))
    return _model[0]


def main_text(page: str | None, chain: ChainModel) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, chain.viterbi(features(found)), strict=True) if keep)


def extract(pages: DataFrame, chain: ChainModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html; other columns are not read).

    text is the page's main text: character references decoded, white space within a block one space, blocks joined by
    one. A null or empty page, and one without main text, gives the empty text. chain is a model from train(), by
    default that of labelled_pages(). Rows that repeat a page_id each come back. An empty table gives none.
    """

    use = chain or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py(), use) for h in batch["html"]]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(text, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = rows.mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
