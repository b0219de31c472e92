"""Main-text extraction with a tree-structured graphical model of the DOM.

Every block-level element and every run of text in one is a node with a hidden
label, content or not.  A node's potential comes from its tag, its class and id
words, its text, and how much of the page's text and links lie below it and
where; every parent and child share a potential of their two
labels.  On a tree, sum-product messages passed upward and then downward give
exact marginals, for all pages of a batch at once, level by level.  The weights
maximise the likelihood of labelled pages, with the same messages as gradient.

A page's text is its runs with a content marginal of one half or more.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import production, table, tidy

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video noframes textarea select title".split())
HEAD_ONLY = frozenset(("head",))
BLOCK = frozenset(
    "html body address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th caption ul center button".split()
)
CLOSES_P = BLOCK - frozenset("html body dd dt li tbody thead tfoot tr td th caption button summary".split()) | {"hr"}
#: A start tag that ends an open element of the given kinds, inside the given bounds.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}
SCOPE = frozenset("html body table td th caption button article section div main".split()) - {"div", "section", "article", "main"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Words in class, id, role and label attributes, by what they hint at.
HINTS = {
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pager pagination toc sitemap skip tabs",
    "header": "header masthead topbar top logo branding hero site",
    "footer": "footer foot copyright colophon legal contentinfo bottom imprint",
    "side": "sidebar side aside widget widgets rail complementary related recommended recommendations trending popular more secondary teaser",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup paywall toast privacy message",
    "comment": "comment comments commentlist reply replies disqus discussion responses respond thread reader readers feedback",
    "form": "form search searchbox login contact register input",
    "share": "share sharing social follow tags tag tools toolbar actions meta print",
    "content": "article content post entry story main body text prose copy page",
}
_HINT = {w: h for h, words in HINTS.items() for w in words.split()}
TAGS = sorted(BLOCK - {"html", "hr"})
FEATURES = [
    "bias", "leaf", *(f"tag:{t}" for t in TAGS), *(f"hint:{h}" for h in HINTS), "hidden",
    *(f"in:{t}" for t in ("p", "li", "h", "td", "div", "other")), *(f"words:{k}" for k in range(6)), *(f"links:{k}" for k in range(4)), "stop", "mark", "mixed",
    *(f"bulk:{k}" for k in range(6)), *(f"linked:{k}" for k in range(5)), *(f"runs:{k}" for k in range(4)), *(f"starts:{k}" for k in range(4)), *(f"ends:{k}" for k in range(3)), "marks", *(f"says:{h}" for h in HINTS), *(f"said:{h}" for h in HINTS), *(f"after:{h}" for h in HINTS), "bare:0", "bare:1", "bare:2",
]
_AT = {f: i for i, f in enumerate(FEATURES)}
_HEADINGS = frozenset(_AT[f"tag:h{k}"] for k in range(1, 7))
_MARK = re.compile("©|\\(c\\) ?\\d{4}|all rights reserved|copyright", re.I)


def _features_of(tag: str, attrs: str) -> tuple[int, ...]:
    out, hints = {_AT["bias"]}, set()
    if f"tag:{tag}" in _AT:
        out.add(_AT[f"tag:{tag}"])
    for name, value in _ATTR.findall(attrs) if attrs.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-type"):
            for w in _WORD.findall(value):
                if w.lower() in _HINT:
                    out.add(_AT[f"hint:{_HINT[w.lower()]}"])
                    hints.add(_HINT[w.lower()] == "content")
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value == "true"):
            out.add(_AT["hidden"])
    if len(hints) == 2:
        out.add(_AT["mixed"])
    return tuple(sorted(out))


#: Attributes of at most so many characters are looked up among those seen.
_KNOWN_CHARS = 200
_known_features = lru_cache(maxsize=1 << 14)(_features_of)


def _element_features(tag: str, attrs: str) -> tuple[int, ...]:
    return _known_features(tag, attrs) if len(attrs) <= _KNOWN_CHARS else _features_of(tag, attrs)


class Tags:
    """The tags of a page in order, in time linear in its length.

    A quoted attribute may hold ``>``.  Where a quote is never closed, tags from
    there on end at their first ``>``.  Without a ``>`` ahead the rest is text."""

    def __init__(self, html: str):
        self.html = html
        self.quotes = True
        self.last = html.rfind(">")
        self.missing: set[str] = set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """``(start, end, closing, name, attributes)`` of the first tag at or
        after at; comments and declarations have no name."""
        html = self.html
        while True:
            start = html.find("<", at)
            if start < 0:
                return None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, (end + 3 if end >= 0 else len(html)), False, "", ""
            if start > self.last:
                start = html.find("<!--", start)
                return None if start < 0 else (start, len(html), False, "", "")
            if html.startswith(("<!", "<?"), start):
                return start, html.index(">", start) + 1, False, "", ""
            closing = html.startswith("/", start + 1)
            name = _NAME.match(html, start + 1 + closing)
            if not name:
                at = start + 1
                continue
            end = 0
            if self.quotes:
                m = _QUOTED.match(html, name.end())
                self.quotes = m is not None
                end = m.end() if m else 0
            end = end or html.index(">", name.end()) + 1
            return start, end, closing, name[0].lower(), html[name.end() : end - 1]

    def after_end_tag(self, tag: str, at: int) -> int:
        """Where the first end tag of this name after at ends, or -1."""
        if tag in self.missing:
            return -1
        m = _end_tag(tag).search(self.html, at)
        end = self.html.find(">", m.end()) if m else -1
        if end < 0:
            self.missing.add(tag)
        return end + 1 if end >= 0 else -1


@cache
def _end_tag(tag: str) -> re.Pattern:  # of RAW names only
    return re.compile(rf"</{tag}", re.I)


_BODY = re.compile(r"</head\s*+>|<body\b", re.I)


class Open:
    """The open elements, with the places of each tag and of the blocks."""

    def __init__(self, root: int):
        self.stack: list[tuple[str, int]] = [("html", root)]
        self.at: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]

    def node(self) -> int:
        return self.stack[-1][1]

    def block(self) -> str:
        return self.stack[self.blocks[-1]][0]

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def cut(self, to: int) -> int:
        """Close all from this place on; the number of links among them."""
        links = 0
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.at[tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            links += tag == "a"
        return links


#: Words of short runs that say what follows, in four languages, by the hint.
SAYINGS = {
    "nav": "menu home accueil startseite inicio", "side": "related similaires verwandte relacionados recommended popular trending ähnliche", "ad": "advertisement sponsored werbung anzeige publicité publicidad anuncio", "notice": "cookies cookie newsletter subscribe abonnieren suscribirse privacy",
    "comment": "comments comment commentaires commentaire kommentare kommentar comentarios comentario replies antworten réponses respuestas responses discussion", "form": "search suche recherche buscar login register", "share": "share teilen partager compartir follow tags", "footer": "copyright imprint impressum",
}
_SAYING = {w: h for h, words in SAYINGS.items() for w in words.split()}


def _short_hint(text: str) -> str | None:
    """What a run of at most four words says by one of them."""
    if len(text) > 60 or text.count(" ") > 3:
        return None
    return next((_SAYING[w] for w in re.findall(r"[^\W\d_]+", text.lower()) if w in _SAYING), None)


class Tree:
    """The nodes of one page: parent and features, and the text of leaves."""

    def __init__(self, html: str):
        self.parent: list[int] = []
        self.features: list[tuple[int, ...]] = []
        self.depth: list[int] = []
        self.leaves: list[tuple[int, str]] = []
        self.linked: list[int] = []  # characters of each leaf that are links
        self._build(html)
        self._measure()

    def _node(self, parent: int, features: tuple[int, ...]) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return len(self.parent) - 1

    def _build(self, html: str) -> None:
        root = self._node(-1, (_AT["bias"],))
        open_ = Open(root)  # inline elements have their block's node
        tags = Tags(html)
        run: list[str] = []
        linked = links = in_link = 0

        def flush() -> None:
            nonlocal run, linked, links
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.leaves.append((self._node(open_.node(), self._leaf_features(text, linked, links, open_.block())), text))
                    self.linked.append(min(linked, len(text)))
                run = []
            linked = links = 0

        at, end = 0, len(html)
        while at < end:
            found = tags.next(at)
            stop = found[0] if found else end
            if stop > at:
                piece = html[at:stop]
                if "&" in piece:
                    piece = unescape(piece)
                run.append(piece)
                if in_link:
                    linked += len(piece)
            if not found:
                break
            _, at, closing, tag, attrs = found
            if not tag:
                continue
            if closing:
                if tag == "a" and in_link:
                    in_link -= 1
                k = open_.last((tag,))
                if k > 0 and (tag in BLOCK or k > open_.blocks[-1]):
                    if tag in BLOCK:
                        flush()
                    gone = open_.cut(k)
                    in_link = max(0, in_link - (gone if tag != "a" else 0))
                elif k <= 0 and tag == "p":
                    flush()
                continue
            if tag in RAW or tag in HEAD_ONLY:
                if tag == "head":
                    flush()
                    after = None if "head" in tags.missing else _BODY.search(html, at)
                    if not after:
                        tags.missing.add("head")
                    else:
                        at = after.end() if after[0].startswith("</") else after.start()
                    continue
                if not attrs.rstrip().endswith("/"):
                    after = tags.after_end_tag(tag, at)
                    at = after if after >= 0 else (end if tag in ("script", "style", "title", "textarea") else at)
                run.append(" ")
                continue
            if tag in ("html", "body"):
                flush()
                if tag == "body" and len(open_.stack) == 1:
                    open_.push("body", self._node(root, _element_features(tag, attrs)))
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr", "img", "input"):
                    run.append(" " if tag != "wbr" else "")
                continue
            if tag not in BLOCK:
                if tag == "a":
                    in_link += 1
                    links += 1
                open_.push(tag, open_.node())
                continue
            flush()
            kinds, bounds = IMPLIED.get(tag, ((), ()))
            if tag in CLOSES_P:
                kinds, bounds = ("p",), SCOPE
            k = open_.last(kinds)
            if k > 0 and k > open_.last(bounds):
                open_.cut(k)
                in_link = 0
            open_.push(tag, self._node(open_.node(), _element_features(tag, attrs)))
        flush()

    def _measure(self) -> None:
        """Features of what lies below each element and where in the page."""
        n, count = len(self.parent), len(self.leaves)
        chars, linked, runs, first, last, mark = [0] * n, [0] * n, [0] * n, [count] * n, [-1] * n, [0] * n
        says: list[str | None] = [None] * n
        for i, ((k, text), of) in enumerate(zip(self.leaves, self.linked, strict=True)):
            chars[k], linked[k], runs[k], first[k], last[k], mark[k] = len(text), of, 1, i, i, bool(_MARK.search(text))
            said = _short_hint(text)
            if said:
                says[k] = said
                self.features[k] += (_AT[f"said:{said}"],)
            p = self.parent[k]
            if count > 1 and (p == 0 or _AT["tag:body"] in self.features[p]):  # no other element holds it
                self.features[k] += (_AT[f"bare:{0 if i == 0 else 2 if i == count - 1 else 1}"],)
        for k in range(n - 1, 0, -1):  # children come after their parents
            p = self.parent[k]
            chars[p] += chars[k]
            linked[p] += linked[k]
            runs[p] += runs[k]
            mark[p] += mark[k]
            # an element says what its first run says
            if first[k] < first[p]:
                first[p], says[p] = first[k], says[k]
            last[p] = max(last[p], last[k])
        # what a short run says holds for the elements after it, up to the next heading
        holds: dict[int, str | None] = {}
        for k in range(1, n):
            p = self.parent[k]
            if runs[k] == 1 and says[k]:
                holds[p] = says[k]
            elif not _HEADINGS.isdisjoint(self.features[k]):
                holds[p] = None
            elif holds.get(p):
                self.features[k] += (_AT[f"after:{holds[p]}"],)
        leaf = {k for k, _ in self.leaves}
        total = max(chars[0], 1)
        for k in range(1, n):
            if k in leaf or not runs[k]:
                continue
            share, links = chars[k] / total, linked[k] / max(chars[k], 1)
            out = [_AT[f"bulk:{sum(share > x for x in (0.02, 0.1, 0.3, 0.6, 0.9))}"], _AT[f"linked:{sum(links > x for x in (0, 0.1, 0.4, 0.8))}"], _AT[f"runs:{sum(runs[k] > x for x in (1, 4, 12))}"]]
            out += [_AT[f"starts:{0 if first[k] == 0 else 1 + sum(first[k] / count > x for x in (0.3, 0.7))}"], _AT[f"ends:{2 if last[k] == count - 1 else int(last[k] / count > 0.6)}"]]
            if mark[k] and chars[k] < 300:
                out.append(_AT["marks"])
            if says[k]:
                out.append(_AT[f"says:{says[k]}"])
            self.features[k] += tuple(out)

    def _leaf_features(self, text: str, linked: int, links: int, tag: str) -> tuple[int, ...]:
        where = {"p": "p", "li": "li", "td": "td", "th": "td", "div": "div"}.get(tag, "h" if len(tag) == 2 and tag[0] == "h" else "other")
        words = text.count(" ") + 1
        share = linked / max(len(text), 1)
        out = [_AT["leaf"], _AT[f"in:{where}"], _AT[f"words:{sum(words > k for k in (1, 3, 8, 20, 60))}"], _AT[f"links:{0 if not links else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]]
        if text[-1] in ".!?…:\"”»":
            out.append(_AT["stop"])
        if _MARK.search(text):
            out.append(_AT["mark"])
        return tuple(out)


class Forest:
    """The trees of many pages as flat arrays, for messages by level."""

    def __init__(self, trees: list[Tree]):
        base = np.cumsum([0, *(len(t.parent) for t in trees)])
        self.n = int(base[-1])
        parent = [p + b if p >= 0 else -1 for t, b in zip(trees, base.tolist(), strict=False) for p in t.parent]
        self.parent = np.array(parent, np.int64)
        self.depth = np.array([d for t in trees for d in t.depth], np.int64)
        size = [len(f) for t in trees for f in t.features]
        self.col = np.array([c for t in trees for f in t.features for c in f], np.int64)
        self.row = np.repeat(np.arange(self.n), size)
        self.leaf = np.zeros(self.n, np.int64)
        for t, b in zip(trees, base.tolist(), strict=False):
            for k, _ in t.leaves:
                self.leaf[b + k] = 1
        order = np.argsort(self.depth, kind="stable")
        cut = np.searchsorted(self.depth[order], np.arange(1, (self.depth.max() if self.n else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]  # below the roots
        self.base = base

    def marginals(self, weight: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials in; P(content) by node and P(parent, child) by node
        out.  edge: leaf or not x parent's label x child's label."""
        local = np.zeros((self.n, 2))
        local[:, 1] = np.bincount(self.row, weights=weight[self.col], minlength=self.n)
        up = local.copy()  # a node's own potential and all that comes from below
        sent = np.zeros((self.n, 2))
        for level in reversed(self.levels):
            t = edge[self.leaf[level]] + up[level][:, None, :]
            sent[level] = np.logaddexp(t[:, :, 0], t[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        belief = up.copy()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels:
            p = self.parent[level]
            above = belief[p] - sent[level]
            t = above[:, :, None] + edge[self.leaf[level]] + up[level][:, None, :]
            t -= t.max(axis=(1, 2), keepdims=True)
            both = np.exp(t)
            both /= both.sum(axis=(1, 2), keepdims=True)
            joint[level] = both
            belief[level] = up[level] + np.logaddexp(above[:, 0, None] + edge[self.leaf[level]][:, 0, :], above[:, 1, None] + edge[self.leaf[level]][:, 1, :])
        belief -= belief.max(axis=1, keepdims=True)
        belief = np.exp(belief)
        return belief[:, 1] / belief.sum(axis=1), joint


def train(pages: list[tuple[str, list[str]]], steps: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights from labelled pages: (html, texts of the content blocks).

    A run is content if its text is among its page's; an element is if
    something below it is.  Gradient steps on the likelihood of the labels."""
    trees = [Tree(h) for h, _ in pages]
    f = Forest(trees)
    y = np.zeros(f.n, np.int64)
    for t, b, (_, wanted) in zip(trees, f.base.tolist(), pages, strict=False):
        wanted = set(wanted)
        for k, text in t.leaves:
            if text in wanted:
                k += b
                while k >= 0 and not y[k]:
                    y[k] = 1
                    k = int(f.parent[k])
    weight, edge = np.zeros(len(FEATURES)), np.zeros((2, 2, 2))
    seen_w = np.bincount(f.col, weights=y[f.row], minlength=len(FEATURES))
    child = np.flatnonzero(f.parent >= 0)
    seen_e = np.zeros((2, 2, 2))
    np.add.at(seen_e, (f.leaf[child], y[f.parent[child]], y[child]), 1)
    size_w = np.bincount(f.col, minlength=len(FEATURES)) / 4 + 5
    vw, ve = np.zeros_like(weight), np.zeros_like(edge)
    for _ in range(steps):
        p, joint = f.marginals(weight, edge)
        gw = (seen_w - np.bincount(f.col, weights=p[f.row], minlength=len(FEATURES))) / size_w - ridge * weight
        want = np.zeros((2, 2, 2))
        np.add.at(want, f.leaf[child], joint[child])
        ge = (seen_e - want) / (len(child) / 8) - ridge * edge
        vw, ve = 0.8 * vw + 0.25 * gw, 0.8 * ve + 0.25 * ge
        weight, edge = weight + vw, edge + ve
    return weight, edge


def extract_pages(html: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[str, int, int]]:
    """``(text, blocks kept, blocks)`` of each page."""
    trees = [Tree(h or "") for h in html]
    f = Forest(trees)
    p = f.marginals(*model)[0] if f.n else np.zeros(0)
    out = []
    for t, b in zip(trees, f.base.tolist(), strict=False):
        kept = [text for k, text in t.leaves if p[b + k] >= 0.5]
        out.append(("\n".join(kept), len(kept), len(t.leaves)))
    return out


def labelled_pages(count: int = 400, seed: int = 20240607) -> list[tuple[str, list[str]]]:
    """Pages written by rule with their content blocks: many layouts, with and
    without telling class names, closed and unclosed tags, prose everywhere."""
    rng = random.Random(seed)
    parts = "an be co da el fi gu ha in jo ka lo mi no or pe qui ra se ta ul vo wen xi ya zu the ing tion ment lich que ción eau".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a=1, b=5: " ".join(words(1, 16).capitalize() + "." for _ in range(rng.randint(a, b)))
    pick = rng.choice
    chance = lambda p: rng.random() < p
    links = lambda: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8)))
    named = lambda *names: f' {pick(["class", "id"])}="{pick(names)}"'

    def noise(kind: str) -> str:
        if kind == "nav":
            return pick([f"<nav><ul>{links()}</ul></nav>", f"<nav{named('main-nav', 'menu')}>{''.join(f'<a href=#>{word()}</a> ' for _ in range(5))}</nav>", f"<div{named('menu', 'navbar', 'breadcrumbs', 'nav-bar')}><ul>{links()}</ul></div>"])
        if kind == "header":
            return pick([f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", f"<header><a href=/>{words(1, 2)}</a><p>{prose(1, 1)}</p></header>", f"<div{named('header', 'masthead', 'topbar')}><p>{prose(1, 2)}</p></div>", f"<header>{noise('nav')}</header>"])
        if kind == "footer":
            return pick([f"<footer>© {word()}.{word()} · {prose(1, 2)}</footer>", f"<footer><p>{prose(1, 2)}</p><ul>{links()}</ul></footer>", f"<div{named('footer', 'site-footer')}>{prose(1, 2)}</div>", f"<footer>{prose(1, 3)}</footer>"])
        if kind == "side":
            return pick([f"<aside><h2>{words(1, 3)}</h2><ul>{links()}</ul></aside>", f"<aside><p>{prose()}</p></aside>", f"<div{named('sidebar', 'related-posts', 'widget', 'right-rail')}><h3>{words(1, 3)}</h3><p>{prose(1, 3)}</p></div>"])
        if kind == "ad":
            return pick([f"<div{named('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo')}>{prose(1, 3)}</div>", f"<section{named('advertisement', 'sponsor')}><p>{prose(1, 2)}</p></section>", f"<div class=\"ad\"><a href=#>{words(2, 6)}</a></div>"])
        if kind == "notice":
            return pick([f"<div{named('cookie-notice', 'consent', 'cookie-banner', 'notice', 'newsletter')}><p>{prose(1, 3)}</p><button>{word()}</button></div>", f'<div role="alert">{prose(1, 2)}</div>', f"<dialog><p>{prose(1, 2)}</p></dialog>", f"<section{named('gdpr', 'popup', 'site-notice')}>{prose(1, 2)}</section>"])
        if kind == "form":
            return pick([f"<form><label>{words(1, 3)}</label><input name=q><button>{word()}</button></form>", f"<form{named('search', 'signup')}><p>{prose(1, 2)}</p><input><button>{words(1, 2)}</button></form>", f"<form><fieldset><p>{words(2, 8)}</p><label>{prose(1, 1)}</label><textarea>{words(1, 3)}</textarea></fieldset></form>"])
        return pick([
            f"<section{named('comments', 'comment-section', 'discussion')}><h2>{words(1, 2)}</h2>{''.join(f'<div class=comment><p>{prose(1, 4)}</p></div>' for _ in range(rng.randint(1, 4)))}</section>",
            f"<div{named('comments', 'reader-comments', 'disqus_thread', 'replies')}>{''.join(f'<p>{prose(1, 4)}</p>' for _ in range(rng.randint(1, 4)))}</div>",
            f"<ol{named('commentlist', 'comment-list')}>{''.join(f'<li><p>{prose(1, 3)}</p></li>' for _ in range(rng.randint(1, 4)))}</ol>",
            f"<div{named('comments')}>{''.join(f'<article class=comment><p>{prose(1, 3)}</p></article>' for _ in range(rng.randint(1, 3)))}</div>",
        ])

    pages = []
    for _ in range(count):
        wanted: list[str] = []

        def keep(text: str) -> str:
            wanted.append(text)
            return text

        def block() -> str:
            k = rng.random()
            if k < 0.6:
                text = keep(prose(1, 6) if chance(0.85) else pick([word(), words(1, 3), word().capitalize() + ".", "All rights reserved.", f"© {word()}. All rights reserved. {prose(1, 1)}"]))
                return pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<p>{text}<br></p>"])
            if k < 0.7:
                return f"<h2>{keep(words(1, 7))}</h2>"
            if k < 0.78:
                tag = pick(["ul", "ol"])
                return f"<{tag}>{''.join(f'<li>{keep(pick([prose(1, 1), words(1, 9)]))}</li>' for _ in range(rng.randint(2, 5)))}</{tag}>"
            if k < 0.84:
                return f"<blockquote><p>{keep(prose(1, 2))}</p></blockquote>"
            if k < 0.88:
                return f"<table>{''.join(f'<tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 3))}</td></tr>' for _ in range(rng.randint(1, 3)))}</table>"
            if k < 0.92:
                return f"<figure><img src=x><figcaption>{keep(prose(1, 1))}</figcaption></figure>"
            if k < 0.96:
                return f"<div>{keep(prose(1, 4))}</div>"
            return f"<section><h3>{keep(words(1, 5))}</h3><p>{keep(prose(1, 4))}</p></section>"

        inside = []
        title = words(2, 10)
        if chance(0.85):
            h = f"<h1>{keep(title)}</h1>"
            inside.append(f"<header>{h}</header>" if chance(0.15) else h)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            inside.append(block())
            if chance(0.06):
                inside.append(noise(pick(["ad", "side", "form", "notice"])))
            if chance(0.03):
                inside.append(f"<div{named('share', 'social')}><a href=#>{word()}</a> <a href=#>{word()}</a></div>")
        open_, close = pick([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post-body">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("", "")])
        if chance(0.15):
            inside.append(noise("comment"))
        before = [noise(k) for k in ("header", "nav", "notice", "ad", "side", "form") if chance({"nav": 0.8, "ad": 0.6}.get(k, 0.3))]
        after = [noise(k) for k in ("comment", "side", "ad", "form", "notice", "footer", "nav") if chance({"footer": 0.85}.get(k, 0.25))]
        rng.shuffle(before)
        body = "".join(before) + open_ + "".join(inside) + close + "".join(after)
        if chance(0.2):
            body = f"<div{named('wrapper', 'page', 'container')}>{body}</div>"
        head = f'<head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        pages.append((f"<!DOCTYPE html><html>{head}<body>{body}" + pick(["</body></html>", ""]), wanted))
    return pages


def other_pages(count: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages unlike the others' layouts: tables that place everything, elements
    without telling names, names that mislead, definition lists, comments that only
    their heading tells, markup of content systems."""
    rng = random.Random(seed)
    parts = "al ber cor den est fan gor hil ist jun kel lor mar nen ost pir qua ron sil tor und ver wol yor zan er en ly ness able heit keit mente eur".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a=1, b=5: " ".join(words(3, 16).capitalize() + rng.choice([".", ".", "!", "?"]) for _ in range(rng.randint(a, b)))
    pick, chance = rng.choice, lambda p: rng.random() < p
    links = lambda a=3, b=8, sep=" ": sep.join(f'<a href="/{word()}">{words(1, 3).capitalize()}</a>' for _ in range(rng.randint(a, b)))
    blank = lambda: pick(["", "", f' class="c{rng.randint(1, 99)}"', f' class="{word()}"', f' id="x{rng.randint(1, 99)}"', ' style="float:left"'])
    misleading = lambda: f' class="{pick(["article-more-text social-page", "post comments-open", "content-header-wide", "text sidebar-right-layout", "story footer-less", "article tags-on", "main-banner-layout content", "page-menu-open", "entry related-topic", "with-ads body-text", "no-sidebar", "popular-post", "message-body", "top-story", "social-content"])}"'
    saying = lambda kind: pick(SAYINGS[kind].split()).capitalize()

    pages = []
    for _ in range(count):
        wanted: list[str] = []

        def keep(text: str) -> str:
            wanted.append(text)
            return text

        def block() -> str:
            k = rng.random()
            if k < 0.5:
                return f"<p{blank()}>{keep(prose(1, 6) if chance(0.9) else words(1, 6).capitalize())}</p>"
            if k < 0.6:
                return f"<{(h := pick(['h2', 'h3']))}>{keep(words(1, 6).capitalize())}</{h}>"
            if k < 0.7:
                return f"<dl>{''.join(f'<dt>{keep(words(1, 3).capitalize())}</dt><dd>{keep(pick([words(1, 4), prose(1, 1)]))}</dd>' for _ in range(rng.randint(1, 4)))}</dl>"
            if k < 0.78:
                return f"<{(t := pick(['ul', 'ol']))}>{''.join(f'<li>{keep(pick([words(1, 8), prose(1, 1)]))}</li>' for _ in range(rng.randint(2, 5)))}</{t}>"
            if k < 0.84:
                return f"<table>{''.join(f'<tr><th>{keep(words(1, 2))}</th><td>{keep(words(1, 4))}</td></tr>' for _ in range(rng.randint(2, 4)))}</table>"
            if k < 0.9:
                return f"<div{pick([blank(), misleading()])}>{keep(prose(1, 4))}</div>"
            before, after = pick([("<blockquote>", "</blockquote>"), ("<pre>", "</pre>"), ("<figure><img src=a><figcaption>", "</figcaption></figure>")])
            return before + keep(pick([prose(1, 2), words(3, 9)])) + after

        title = f"<h1>{keep(words(2, 8).capitalize())}</h1>" if chance(0.85) else ""
        text = title + "".join(block() for _ in range(pick([1, 2, 2, 3, 4, 6, 9])))
        menu, foot = pick([links(), links(3, 8, " | "), links(3, 8, "<br>"), f"<ul><li>{links(3, 7, '</li><li>')}</li></ul>"]), pick([f"Copyright 20{rng.randint(10, 26)} {words(1, 3).capitalize()} Ltd.", f"© {words(1, 2)}. All rights reserved.", f"{links(2, 5, ' · ')} © {word()}", f"{words(2, 5).capitalize()} {links(2, 4)}"])
        comments = f"<{(h := pick(['h2', 'h3', 'h4', 'b', 'p']))}>{pick(['', f'{rng.randint(1, 40)} '])}{saying('comment')}</{h}>" + pick(["".join(f"<div><b>{word()}</b><p>{prose(1, 3)}</p></div>" for _ in range(rng.randint(1, 4))), f"<ul>{''.join(f'<li>{word()}: {prose(1, 2)}</li>' for _ in range(rng.randint(1, 4)))}</ul>", "".join(f"<p>{prose(1, 3)}</p>" for _ in range(rng.randint(1, 3)))])
        comments = pick([f"<div{blank()}>{comments}</div>", f"<section>{comments}</section>"]) if chance(0.3) else ""
        side = pick([f"<h3>{saying('side')}</h3>{pick([links(2, 6, '<br>'), f'<ul><li>{links(2, 6, chr(60) + "/li>" + chr(60) + "li>")}</li></ul>'])}", f"<h4>{saying('ad')}</h4><p>{prose(1, 1)}</p>", f"<p>{saying('notice')} {words(2, 6)}</p><button>{word()}</button>"]) if chance(0.5) else ""
        kind = pick(["table", "soup", "misled", "cms", "plain"])
        if kind == "table":
            body = f"<table width=100%>{f'<tr><td colspan=2>{words(1, 3)}</td></tr>' if chance(0.5) else ''}<tr>{pick([f'<td>{menu}</td><td>{text}{comments}</td>', f'<td colspan=2>{menu}</td></tr><tr><td>{text}{comments}</td><td>{side}</td>', f'<td>{menu}{side}</td><td>{text}{comments}</td>'])}</tr>{f'<tr><td colspan=2>{foot}</td></tr>' if chance(0.8) else ''}</table>"
        elif kind == "soup":
            side = f"<div{blank()}>{side}</div>" if side else ""
            body = f"<div{blank()}><div{blank()}>{menu}</div>{side if chance(0.5) else ''}<div{blank()}>{text}{comments if chance(0.3) else ''}</div>{comments}<div{blank()}>{foot}</div></div>" if not comments or chance(0.5) else f"<div{blank()}>{menu}</div><div{blank()}>{text}</div><div{blank()}>{comments}</div><div{blank()}>{foot}</div>"
        elif kind == "misled":
            tag = pick(["div", "div", "section", "article"])
            inner = f"<{tag}{misleading()}>{text}</{tag}>"
            body = pick([inner, f"<nav>{menu}</nav>{inner}", f"<div{misleading()}>{inner}</div><footer>{foot}</footer>", f"<header>{menu}</header>{inner}<aside>{side or links()}</aside><footer>{foot}</footer>"])
        elif kind == "cms":
            body = f'<div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title">{words(1, 3)}</p><nav class="main-navigation">{menu}</nav></header><div id="content" class="site-content"><main class="site-main"><article class="post type-post hentry"><header class="entry-header">{title}</header><div class="entry-content">{text[len(title):]}</div></article>{f"<div class=comments-area>{comments}</div>" if comments else ""}</main></div>{f"<aside class=widget-area>{side}</aside>" if side else ""}<footer class="site-footer">{foot}</footer></div>'
        else:
            main = pick(["main", "article", "body"])
            body = f"<main>{text}</main>" if main == "main" else f"<article>{text}</article>" if main == "article" else text
            body = pick(["", f"<p>{menu}</p>", f"<div>{menu}</div>", f"{menu}<hr>"]) + body + comments + pick(["", f"<hr><p>{foot}</p>", f"<div>{foot}</div>", f"<hr>{foot}"])
        pages.append((f"<html><head><title>{words(1, 4)}</title></head><body>{body}" + pick(["</body></html>", ""]), wanted))
    return pages


@cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train([*labelled_pages(), *other_pages()])


#: Pages whose trees are in memory at once, and the characters of HTML in them.
BATCH_PAGES, BATCH_CHARS = 256, 2_000_000


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of pages: the id, the columns of keep, ``text``,
    ``blocks_kept`` and ``blocks``.

    Null html counts as empty; a page without content has an empty text.  Text
    of one block has character references decoded and white space made one
    blank; a line break is white space.  Blocks stand in page order, one a line,
    and repeats stay.  Markup that is not well formed is repaired by the usual
    implied end tags.  Whole pages are parsed whatever their length; rows that
    repeat are each on their own; other columns are not looked at; an empty
    table gives no rows."""
    packed = pickle.dumps(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        for batch in batches:
            at = 0
            html = batch.column(batch.num_columns - 1)
            while at < batch.num_rows:
                part: list = []
                chars = 0
                while at + len(part) < batch.num_rows and len(part) < BATCH_PAGES and chars < BATCH_CHARS:
                    part.append(html[at + len(part)].as_py())
                    chars += len(part[-1] or "")
                got = extract_pages(part, m)
                rest = [c.slice(at, len(part)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=[*batch.schema.names[:-1], "text", "blocks_kept", "blocks"])
                at += len(part)

    src = pages.select(F.col(id_col), *keep, F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1])
    return src.mapInArrow(tidy(run), f"{kinds}, text string, blocks_kept long, blocks long")


@production
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
