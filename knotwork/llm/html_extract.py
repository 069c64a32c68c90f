"""Main-text extraction: gradient-boosted trees over DOM-node features, and a hierarchical decoding over the tree.

A page becomes a tree of block elements (inline markup belongs to the block around it). Each node has features: tag,
attribute tokens of its own and of the nodes around it, depth, place among its siblings and their sizes, and the density
of text, links, punctuation and form controls in its subtree. The trees give each node the log odds of being main text;
the decoding then picks the likeliest set of kept nodes in which no node is kept under a dropped one (a sum over the tree,
from the leaves up), so that ancestors and descendants can't contradict each other.

There are no labelled pages, so the model is fitted on PAGES pages that a seeded simulator makes with their labels: sites of
many layouts, with semantic tags or class names only, and boilerplate of every kind around and inside the article. The
number of pages is a parameter; fitting doesn't depend on the input.

Defined results: null html counts as empty and gives an empty text, n_chars 0. A page without markup is all main text.
Unclosed, crossed and unknown tags never fail: an end tag closes what it matches, or nothing. Character references are
decoded, white space in a block (and a line break element) becomes one space, blocks are trimmed and joined by a line feed,
empty ones are left out. Repeated rows count each, an empty table gives an empty result, and input columns named like an
added one are replaced.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from knotwork.llm import boosting
from knotwork.llm.common import map_columns

PAGES = 1000
SEED = 11

# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp title svg math object".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
LIMITS = frozenset("ul ol dl table td th div section article main body select button".split())
CONTROLS = frozenset("input button select textarea label option".split())
TAGS = ["p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset", "table tbody tr td th", "figure figcaption picture", "blockquote pre", "button select label textarea option legend", "body html"]
GOOD = frozenset("article articlebody content contents body bodytext post entry story text prose main maincontent page copy markdown".split())
BAD = [frozenset(x.split()) for x in (
    "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar skip pagination pager tabs",
    "header masthead banner logo brand hero footer foot colophon copyright legal bottom",
    "sidebar side aside rail widget related recommended trending popular more links tags tagcloud archive",
    "ad ads adv advert advertisement sponsor sponsored promo promotion partner outbrain taboola adslot dfp",
    "cookie cookies consent gdpr notice alert message popup modal overlay toast newsletter subscribe subscription signup paywall",
    "comment comments reply replies discussion disqus thread respond share sharing social follow login search form author bio",
)]

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """The tree of a page: for each node its parent, tag, attribute tokens and own text; and the text in order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens = [-1], ["html"], [frozenset()]
        self.text: list[tuple[int, str | None]] = []  # (node, text), or (node, None): a block's edge
        self.linked: list[bool] = []
        self.controls = [0]
        stack: list[tuple[str, int]] = [("html", 0)]  # (tag, node it belongs to)
        # places in the stack, but the first: of each tag, of all that aren't inline, of limits; so no step looks down the stack
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.limits: list[int] = []
        endless: set[str] = set()  # raw elements that nothing ends from here on
        at = 0
        while True:
            m = _TAG.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece:
                self.text.append((stack[-1][1], entities.unescape(piece)))
                self.linked.append(bool(self.open.get("a")))
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(stack, name)
            elif name in RAW:
                if not m[3].endswith("/"):
                    end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    if end is None:
                        endless.add(name)
                    at = end.end() if end else len(source) if name in ("script", "style") else at
            else:
                self._start(stack, name, m[3])

    def _push(self, stack: list, name: str, node: int) -> None:
        k = len(stack)
        stack.append((name, node))
        self.open.setdefault(name, []).append(k)
        if name not in INLINE:
            self.blocks.append(k)
        if name in LIMITS:
            self.limits.append(k)

    def _pop(self, stack: list, k: int) -> None:
        """Close everything from place k of the stack."""
        for tag, node in stack[k:]:
            self.open[tag].pop()
            if tag not in INLINE:
                self._edge(node)
        del stack[k:]
        for places in (self.blocks, self.limits):
            while places and places[-1] >= k:
                places.pop()

    def _top(self, name: str) -> int:
        """The last place of a tag in the stack; 0: it isn't open."""
        places = self.open.get(name)
        return places[-1] if places else 0

    def _edge(self, node: int) -> None:
        self.text.append((node, None))
        self.linked.append(False)

    def _end(self, stack: list, name: str) -> None:
        k = self._top(name)
        if k and not (name in INLINE and self.blocks and self.blocks[-1] > k):
            self._pop(stack, k)

    def _start(self, stack: list, name: str, attributes: str) -> None:
        if name in CONTROLS:
            self.controls[stack[-1][1]] += 1
        if name in ("html", "head"):
            return
        if name == "br":
            self.text.append((stack[-1][1], " "))
            self.linked.append(False)
            return
        if name in CLOSES_P or name in SAME:
            k = max(map(self._top, (*SAME.get(name, ("p",)), *(("p",) if name in CLOSES_P else ()))))
            if k and not (self.limits and self.limits[-1] > k):
                self._pop(stack, k)
        if name in INLINE:
            if name not in VOID and not attributes.endswith("/"):
                self._push(stack, name, stack[-1][1])
            return
        if name in VOID:
            self._edge(stack[-1][1])
            return
        node = len(self.parent)
        self.parent.append(stack[-1][1])
        self.tag.append(name)
        words = " ".join(a or b or c or "" for a, b, c in _NAMED.findall(attributes))
        self.tokens.append(frozenset(x.lower() for x in _PART.findall(words)))
        self.controls.append(0)
        self._edge(node)
        self._push(stack, name, node)

    def features(self) -> np.ndarray:
        """A row of features for each node."""
        n = len(self.parent)
        parent = np.array(self.parent)
        own, link, marks, signs, before = (np.zeros(n) for _ in range(5))
        seen = 0.0
        started = np.zeros(n, bool)
        for (node, t), linked in zip(self.text, self.linked, strict=True):
            if t is None:
                if not started[node]:
                    started[node], before[node] = True, seen
                continue
            size = len(t.strip())
            if size:
                own[node] += size
                link[node] += size * linked
                marks[node] += t.count(",") + t.count(".") + t.count("。")
                signs[node] += t.count("©") + t.count("®") + ("ll rights" in t)
                seen += size
        sums = {k: v.copy() for k, v in (("text", own), ("link", link), ("marks", marks), ("signs", signs), ("controls", np.array(self.controls, float)), ("nodes", np.ones(n)))}
        is_p = np.array([t in ("p", "blockquote", "pre") for t in self.tag], float)
        sums["p"] = is_p * own
        for v in range(n - 1, 0, -1):  # a node comes after its parent
            for s in sums.values():
                s[parent[v]] += s[v]
        depth, place, count = np.zeros(n), np.zeros(n), np.zeros(n)
        good, bad = (np.zeros((n, 1 if k == 0 else len(BAD))) for k in range(2))
        around_good, around_bad = np.zeros((n, 1)), np.zeros((n, len(BAD)))
        kinds = np.zeros((n, len(TAGS)))
        around = np.zeros((n, len(TAGS)))
        previous = np.zeros(n)
        last: dict[int, int] = {}
        following = np.zeros(n)
        for v in range(n):
            kind = _kind(self.tag[v])
            if kind is not None:
                kinds[v, kind] = 1
            tokens = self.tokens[v]
            if tokens:
                good[v, 0] = bool(tokens & GOOD)
                for k, words in enumerate(BAD):
                    bad[v, k] = bool(tokens & words)
            if v:
                u = parent[v]
                depth[v] = depth[u] + 1
                place[v] = count[u]
                count[u] += 1
                around[v] = np.maximum(around[u], kinds[u])
                around_good[v] = np.maximum(around_good[u], good[u])
                around_bad[v] = np.maximum(around_bad[u], bad[u])
                if u in last:
                    previous[v] = sums["text"][last[u]]
                    following[last[u]] = sums["text"][v]
                last[u] = v
        siblings = count[parent]
        siblings[0] = 1
        total = max(1.0, sums["text"][0])
        safe = np.maximum(1, sums["text"])
        scalar = np.stack(
            [depth, np.log1p(own), np.log1p(sums["text"]), link / np.maximum(1, own), sums["link"] / safe, np.log1p(sums["text"] / sums["nodes"]), count, siblings, place / np.maximum(1, siblings), np.log1p(previous), np.log1p(following),
             sums["text"] / total, before / total, marks / np.maximum(1, own) * 100, sums["marks"] / safe * 100, np.minimum(3, sums["signs"]), np.minimum(5, sums["controls"]), np.log1p(sums["p"]), sums["p"] / safe, np.log1p(sums["text"][parent]), sums["p"][parent] / np.maximum(1, sums["text"][parent])],
            axis=1,
        )
        return np.concatenate([scalar, good, bad, around_good, around_bad, kinds, around], axis=1)

    def kept(self, odds: np.ndarray) -> np.ndarray:
        """The likeliest kept nodes among those sets in which no node is kept under a dropped one. The root is kept."""
        n = len(self.parent)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        drop, keep = no.copy(), yes.copy()
        for v in range(n - 1, 0, -1):
            u = self.parent[v]
            drop[u] += drop[v]
            keep[u] += max(drop[v], keep[v])
        out = np.zeros(n, bool)
        out[0] = True
        for v in range(1, n):
            out[v] = out[self.parent[v]] and keep[v] > drop[v]
        return out

    def main_text(self, kept: np.ndarray) -> str:
        blocks: list[str] = []
        held: list[str] = []
        for node, t in self.text:
            if t is None:
                if held:
                    blocks.append(" ".join("".join(held).split()))
                    held = []
            elif kept[node]:
                held.append(t)
        if held:
            blocks.append(" ".join("".join(held).split()))
        return "\n".join(b for b in blocks if b)


@functools.cache
def _kind(tag: str) -> int | None:
    return next((k for k, x in enumerate(TAGS) if tag in x.split()), None)


def simulated(seed: int) -> tuple[str, list[bool]]:
    """A page, and for each node of its tree (the root left out) whether it holds main text."""
    r = random.Random(seed)
    out: list[str] = []
    labels: list[bool] = []
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "le", "un", "ge", "ar"]) for _ in range(r.randint(1, 3))) for _ in range(60)]

    def say(low: int, high: int) -> str:
        style = r.random()
        if style < 0.08:  # one word again and again
            return " ".join([r.choice(words)] * r.randint(low, high))
        if style < 0.16:
            return " ".join(r.choice(words) + r.choice(["###", "%%", "$$$", " |", "!!"]) for _ in range(r.randint(low, high)))
        if style < 0.22:
            return " ".join(r.choice(words) for _ in range(r.randint(low, high))).upper()
        parts = [r.choice(words) + (r.choice([",", ".", ".", "?"]) if r.random() < 0.12 else "") for _ in range(r.randint(low, high))]
        return " ".join(parts).capitalize() + r.choice([".", ".", "", "!"])

    def tag(name: str, keep: bool, inside, names: str = "", end: bool = True) -> None:
        shown = f' class="{names}"' if names and r.random() < 0.85 else ""
        out.append(f"<{name}{shown}>")
        labels.append(keep)
        inside() if callable(inside) else out.append(inside)
        if end:
            out.append(f"</{name}>")

    def links(n: int, low: int = 1, high: int = 4) -> None:
        def items() -> None:
            for _ in range(n):
                tag("li", False, f'<a href="/x">{say(low, high)}</a>')

        tag(r.choice(["ul", "ul", "ol"]), False, items)

    def paragraphs(n: int) -> None:
        for _ in range(n):
            kind = r.random()
            if kind < 0.72:
                tag("p", True, r.choice(["", "", "<b>"]) + (say(1, 10) if r.random() < short else say(15, 110)), end=r.random() < 0.9)
            elif kind < 0.8:
                tag(r.choice(["h2", "h3"]), True, say(2, 8))
            elif kind < 0.86:
                tag(r.choice(["ul", "ol"]), True, lambda: [tag("li", True, say(4, 25)) for _ in range(r.randint(2, 6))])
            elif kind < 0.91:
                tag(r.choice(["blockquote", "pre"]), True, say(8, 50))
            elif kind < 0.95:
                tag("div", True, say(15, 80))
            else:
                tag("p", True, f'{say(4, 12)} <a href="/y">{say(1, 5)}</a> {say(4, 30)}')
        if r.random() < 0.3:
            tag("p", True, r.choice(["Licensed under the ", "Published under "]) + say(2, 5))

    short = r.choice([0.1, 0.2, 0.5, 1.0])

    def junk(kind: str) -> None:
        if kind == "nav":
            tag(r.choice(["nav", "nav", "div"]), False, lambda: links(r.randint(3, 9), 1, 2), r.choice(["nav", "main-menu", "navbar", "breadcrumbs"]))
        elif kind == "header":
            tag(r.choice(["header", "div"]), False, lambda: (tag("div", False, f"<a href='/'>{say(1, 3)}</a>", "logo"), tag("p", False, say(2, 8))), r.choice(["header", "masthead", "site-header"]))
        elif kind == "footer":
            style = r.random()
            inside = (lambda: out.append(f"&copy; {r.choice(words)}.example.com &middot; {say(3, 22)}")) if style < 0.5 else lambda: (links(r.randint(2, 6)), tag("p", False, f"&copy; {say(3, 18)}"))
            tag(r.choice(["footer", "footer", "div"]), False, inside, r.choice(["footer", "site-footer", "bottom legal"]))
        elif kind == "side":
            tag(r.choice(["aside", "aside", "div"]), False, lambda: [(tag(r.choice(["h3", "h4"]), False, say(1, 4)), r.choice([lambda: links(r.randint(2, 7), 2, 9), lambda: tag("p", False, say(5, 40))])()) for _ in range(r.randint(1, 3))], r.choice(["sidebar", "widget", "related", "right-rail"]))
        elif kind == "ad":
            tag(r.choice(["div", "div", "aside", "section"]), False, r.choice([lambda: out.append(say(3, 20)), lambda: tag("p", False, say(3, 25)), lambda: out.append(f'<a href="/buy">{say(2, 9)}</a>')]), r.choice(["ad", "ads", "advert", "sponsored", "ad-banner", "promo"]))
        elif kind == "notice":
            tag(r.choice(["div", "section", "dialog"]), False, lambda: (tag("p", False, say(6, 40)), tag("button", False, say(1, 2))) if r.random() < 0.7 else out.append(say(6, 40)), r.choice(["cookie-notice", "consent", "notice", "alert", "gdpr", "newsletter popup"]))
        elif kind == "form":
            tag("form", False, lambda: (r.random() < 0.5 and tag("p", False, say(3, 20)), tag("label", False, say(1, 3)), out.append("<input type=text>"), tag("button", False, say(1, 2))), r.choice(["search", "subscribe", "login", "comment-form", ""]))
        elif kind == "comments":
            def thread() -> None:
                tag(r.choice(["h2", "h3"]), False, say(1, 3))
                for _ in range(r.randint(1, 5)):
                    tag(r.choice(["div", "li", "article"]), False, lambda: (r.random() < 0.6 and tag("div", False, say(1, 3), r.choice(["author", "meta"])), tag("p", False, say(3, 60))), r.choice(["comment", "reply", "comment-item"]))

            tag(r.choice(["section", "div"]), False, thread, r.choice(["comments", "discussion", "comment-list", "responses comments"]))
        elif kind == "share":
            tag("div", False, lambda: r.choice([lambda: links(r.randint(2, 4), 1, 2), lambda: out.append(f'<a href="#">{say(1, 2)}</a> <a href="#">{say(1, 2)}</a>')])(), r.choice(["share", "social", "tags"]))

    def article() -> None:
        if r.random() < 0.85:
            if r.random() < 0.2:
                tag("header", True, lambda: tag("h1", True, say(3, 14)))
            else:
                tag("h1", True, say(1, 14))
        if r.random() < 0.3:  # the first paragraph may be as short as a title
            tag("p", True, r.choice(["<b>", ""]) + say(2, 12) + r.choice(["", "<br>"]), end=r.random() < 0.5)
        n = r.choice([1, 1, 2, 3, 5, 8, 12, 20])
        inner = [k for k in ("ad", "share", "notice", "form", "side") if r.random() < 0.12]
        for k in inner:
            m = r.randint(0, n)
            paragraphs(m)
            n -= m
            junk(k)
        paragraphs(max(1, n))
        if r.random() < 0.15:
            junk("comments")

    def whole() -> None:
        before = [k for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        r.shuffle(before)
        for k in before:
            junk(k)
        if r.random() < 0.2:
            junk("side")
        shape = r.random()
        named = r.choice(["content", "article-body", "post", "entry-content", "main", "story", ""])
        if shape < 0.4:
            tag("article", True, article, named)
        elif shape < 0.65:
            tag("main", True, lambda: tag(r.choice(["article", "div", "section"]), True, article, named), "")
        elif shape < 0.9:
            tag("div", True, lambda: tag("div", True, article, named), r.choice(["wrapper", "container", "page"]))
        else:
            article()
        after = [k for k in ("comments", "side", "share", "form", "ad", "notice") if r.random() < 0.35]
        r.shuffle(after)
        for k in after:
            junk(k)
        if r.random() < 0.85:
            junk("footer")

    if r.random() < 0.9:
        out.append("<html><head><title>t</title></head>")
        tag("body", True, whole)
    else:
        whole()
    return "".join(out), labels


@functools.cache
def fit(pages: int = PAGES, seed: int = SEED) -> dict:
    rows, marks = [], []
    for k in range(pages):
        source, labels = simulated(seed * 1_000_003 + k)
        x = Page(source).features()[1:]
        if len(x) == len(labels):
            rows.append(x)
            marks += labels
    return boosting.fit(np.concatenate(rows), np.array(marks, float))


def extract(pages: list[str | None], model: dict) -> list[str]:
    trees = [Page(p or "") for p in pages]
    made = [t.features() for t in trees]
    odds = boosting.decide(model, np.concatenate(made)) if made else np.zeros(0)
    out, at = [], 0
    for t, x in zip(trees, made, strict=True):
        out.append(t.main_text(t.kept(odds[at : at + len(x)])))
        at += len(x)
    return out


def main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None, model: dict | None = None) -> DataFrame:
    """keep's columns (all but html by default), text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())  # some hundred small trees

    def work():
        def of(sources: list) -> list[tuple]:
            out = []
            for at in range(0, len(sources), 64):
                out += [(t, len(t)) for t in extract(sources[at : at + 64], shared.value)]
            return out

        return of

    keep = [c for c in pages.columns if c != html] if keep is None else keep
    return map_columns(pages, html, keep, {"text": "string", "n_chars": "long"}, work)
