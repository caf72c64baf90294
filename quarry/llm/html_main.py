"""Operator 1: main text of HTML pages by a tree-structured graphical model.

A page is parsed into its tree of block elements. Every node is content or not; a node's
features (tag, words of class, id and role, length, share of link text) give its own
potential, and one potential per kind of child couples it with its parent. Messages go up
from the leaves to the root and down again (sum-product), all pages of a batch together
level by level, and yield every node's marginal. The text runs of nodes with a marginal of
at least one half are the main text.

``fit`` learns both kinds of potentials by maximum likelihood from labelled pages:

* a bounded sample of the given pages whose own markup labels them (inside ``article`` or
  ``main``: content; menus, headers, footers, adverts and the like: not); in half of them the
  telling tags are replaced by ``div``, so that the rest of the features has to carry;
* pages laid out by ``layouts`` (a seeded grammar of common page layouts, with sidebars,
  notices, forms, comments ...), filled with sentences of the sampled pages.

Head, comments and the contents of ``RAW`` elements (scripts, styles, templates ...) are never
text; nor are block elements that the page itself hides, with all they hold: by a ``hidden``
attribute (but ``until-found``), by ``aria-hidden="true"`` or by ``display: none`` in ``style``.
The words of other attributes hide nothing. ``math``, ``object`` and ``xmp`` are text like any
other, ``xmp`` with its markup as written. Blocks follow the page order; white space inside one
becomes a single space.

Defined cases: null, empty or text-free html gives the empty text; a page without any
markup is one block of text; unclosed or stray tags are closed or skipped as browsers do, but
an unclosed ``RAW`` element ends at the next block (``script``, ``style`` and ``xmp``: where the
block around it ends) and not with the page; repeated pages are extracted each; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_slices

SAMPLE_PAGES = 600
LAYOUT_PAGES = 900
SEED = 5

#: fixed values of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea template iframe noembed noframes noscript svg title annotation annotation-xml".split())
#: what stands in these is not markup, even where it looks so
LITERAL = {"script", "style", "xmp"}
BLOCK = set(
    "html body address article aside blockquote button center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup label legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"button", "label", "option", "select", "legend", "caption", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: a start tag ends these open elements, up to one of the second set
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
}

#: a quote opens a string only after "="; elsewhere in a tag it is part of a name or value
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?][^>]*>|<[!?/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = {"class", "id", "role", "itemprop"}
_START_OR_END = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_CLOSING = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?>", re.I) for t in (*RAW, "xmp")}
_CSS_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_NAMES = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")
_SPACES = re.compile(r"\s+")


def attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag by name in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_hidden(attrs: dict[str, str]) -> bool:
    """Whether an element with these attributes hides itself."""
    if "hidden" in attrs and attrs["hidden"].strip().lower() != "until-found":
        return True
    if attrs.get("aria-hidden", "").strip().lower() == "true":
        return True
    display = ("", False)  # the last declaration counts, one marked important before others
    for one in _CSS_COMMENT.sub("", entities.unescape(attrs["style"])).lower().split(";") if "style" in attrs else ():
        name, _, value = one.partition(":")
        value, mark, important = value.partition("!")
        important = mark and important.strip() == "important"
        if name.strip() == "display" and (important or not display[1]):
            display = (value.strip(), bool(important))
    return display[0] == "none"


class Page:
    """Block elements in page order: ``tag``, ``parent``, ``names``, ``text`` and ``link`` characters,
    ``words``, and ``runs``: (element, text) in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["#root"], [-1], [()]
        self.hidden = [False]
        self.runs: list[tuple[int, str]] = []
        self.chars, self.link, self.n_words = [0], [0], [0]
        self._parse(source)

    def _push(self, stack, tag, attrs):
        names, found = [], attributes(attrs) if attrs else {}
        for name, value in found.items():
            if name in _NAMED:
                names += [("r=" if name == "role" else "c=") + n.lower() for n in _NAMES.findall(value)]
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.names.append(tuple(dict.fromkeys(names)))
        self.hidden.append(self.hidden[stack[-1]] or is_hidden(found))
        for x in (self.chars, self.link, self.n_words):
            x.append(0)
        stack.append(len(self.tag) - 1)

    def _parse(self, source):
        stack, buffer, linked, in_link = [0], [], 0, False
        in_head = False

        def flush():
            nonlocal linked
            if buffer:
                text = _SPACES.sub(" ", "".join(buffer)).strip()
                buffer.clear()
                if text:
                    at = stack[-1]
                    if not self.hidden[at]:
                        self.runs.append((at, text))
                    self.chars[at] += len(text)
                    self.n_words[at] += text.count(" ") + 1
                    self.link[at] += min(linked, len(text))
            linked = 0

        pos, never_closed = 0, set()
        while m := _TOKEN.search(source, pos):
            if m.start() > pos and not in_head:
                piece = source[pos : m.start()]
                buffer.append(entities.unescape(piece))  # a reference doesn't go on behind a tag
                if in_link:
                    linked += len(piece)
            pos = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
            if not end and (tag in RAW or tag == "xmp"):
                if tag == "svg" and attrs.endswith("/"):
                    continue
                closing = None if tag in never_closed else _CLOSING[tag].search(source, pos)
                if closing:
                    stop, after = closing.span()
                else:
                    never_closed.add(tag)
                    stop = after = self._end_of_unclosed(source, pos, tag, stack, in_head)
                if tag == "xmp":  # a block like pre, its text as written
                    flush()
                    in_head = in_link = False
                    self._close(stack, {"p"}, {"button", "td", "th"}, one=True)
                    self._push(stack, "pre", attrs)
                    buffer.append(source[pos:stop])
                    flush()
                    stack.pop()
                pos = after
                continue
            if tag == "head":
                in_head = not end
                continue
            if tag == "body" and not end:
                in_head = False
            if tag == "a":
                in_link = not end
                continue
            if tag in ("br", "hr"):
                if tag == "br":
                    buffer.append(" ")
                else:
                    flush()
                continue
            if tag not in BLOCK or tag in VOID:
                if in_head and tag not in VOID and tag != "title":
                    in_head = False
                continue
            in_head = False
            flush()
            in_link = False
            if not end:
                if tag in CLOSES_P:
                    self._close(stack, {"p"}, {"button", "td", "th"}, one=True)
                if tag in ENDS:
                    self._close(stack, *ENDS[tag])
                if tag in ("html", "body") and tag in (self.tag[i] for i in stack):
                    continue
                self._push(stack, tag, attrs)
                if attrs.endswith("/") and tag in ("p", "div"):
                    continue
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == tag:
                        del stack[i:]
                        break
        if pos < len(source) and not in_head:
            buffer.append(entities.unescape(source[pos:]))
        flush()

    def _end_of_unclosed(self, source, pos, tag, stack, in_head):
        """Where an element of ``RAW`` (or ``xmp``) without an end tag ends."""
        around, inner = {self.tag[i] for i in stack[1:]} | ({"head"} if in_head else set()), {}
        for m in _START_OR_END.finditer(source, pos):
            t = m[2].lower()
            if m[1]:
                if inner.get(t):
                    inner[t] -= 1
                elif t in around:
                    return m.start()
            elif t in BLOCK:
                if tag not in LITERAL or (t == "body" and in_head):
                    return m.start()
                inner[t] = inner.get(t, 0) + 1
        return len(source)

    def _close(self, stack, what, until, one=False):
        for i in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[i]]
            if t in until:
                return
            if t in what:
                del stack[i:]
                if one:
                    return
                return self._close(stack, what, until)


KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "td": 3, "tr": 3, "ul": 4, "ol": 4, "table": 4, "div": 5, "section": 5, "blockquote": 1, "pre": 1, "figure": 1}
N_KINDS = 6


def node_features(page: Page) -> list[list[str]]:
    """Names of the features of every node."""
    n = len(page.tag)
    chars, link, words = list(page.chars), list(page.link), list(page.n_words)
    kids = [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        link[p] += link[i]
        words[p] += words[i]
        kids[p] += 1
    whole = max(1, chars[0])
    out = []
    for i in range(n):
        c = chars[i]
        f = ["bias", "t=" + page.tag[i], *page.names[i]]
        f.append(f"words{min(9, words[i].bit_length())}" if kids[i] else "leaf")
        f.append(f"link{int(4 * link[i] / c) if c else 5}")
        f.append(f"share{int(4 * c / whole)}")
        f.append(f"own{min(8, page.n_words[i].bit_length())}")
        f.append(f"kids{min(3, kids[i].bit_length())}")
        out.append(f)
    return out


class Forest:
    """Nodes of many pages as arrays, by depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.begin[-1])
        self.parent = np.empty(n, np.int64)
        self.kind = np.zeros(n, np.int64)
        depth = np.zeros(n, np.int64)
        for p, a in zip(pages, self.begin):
            d = [0] * len(p.tag)
            for i in range(1, len(p.tag)):
                d[i] = d[p.parent[i]] + 1
            depth[a : a + len(d)] = d
            self.parent[a : a + len(d)] = np.array(p.parent) + a
            self.kind[a : a + len(d)] = [KINDS.get(t, 0) for t in p.tag]
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2 if n else 1))
        self.levels = np.split(order, cuts)[:-1] if n else []


def sum_product(forest: Forest, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the nodes, and of (parent, child) pairs, by messages up and down.

    ``own``: log potentials (nodes x 2); ``pair``: log potentials (kinds x 2 parent x 2 child).
    """
    up = own.copy()  # own potential and messages from the children
    message = np.zeros_like(own)
    for level in reversed(forest.levels[1:]):
        x = pair[forest.kind[level]] + up[level][:, None, :]
        message[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(up, forest.parent[level], message[level])
    belief = up.copy()
    joint = np.zeros((len(own), 2, 2))
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - message[level]  # the parent without this child
        x = pair[forest.kind[level]] + rest[:, :, None]
        belief[level] = up[level] + np.logaddexp(x[:, 0], x[:, 1])
        joint[level] = x + up[level][:, None, :]
    z = np.logaddexp(belief[:, 0], belief[:, 1])
    marginal = np.exp(belief - z[:, None])
    joint = np.exp(joint - z[:, None, None])
    return marginal, joint, z


def train(pages: list[Page], labels: list[list[int]], steps: int = 400) -> dict:
    """Maximum likelihood by Adam; features seen in at least two pages."""
    names = [node_features(p) for p in pages]
    seen: dict[str, int] = {}
    for page in names:
        for f in {f for node in page for f in node}:
            seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= 2))}
    forest = Forest(pages)
    y = np.concatenate([np.array(x) for x in labels])
    lists = [[index[f] for f in node if f in index] for page in names for node in page]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.fromiter((c for x in lists for c in x), np.int64)
    child = np.concatenate(forest.levels[1:])
    gold = np.zeros((len(y), 2, 2))
    gold[child, y[forest.parent[child]], y[child]] = 1.0
    w, pair = np.zeros(len(index)), np.zeros((N_KINDS, 2, 2))
    theta = np.zeros(len(index) + pair.size)
    mom, vel = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, pair = theta[: len(index)], theta[len(index) :].reshape(pair.shape)
        own = np.zeros((len(y), 2))
        own[:, 1] = np.bincount(row, w[col], len(y))
        marginal, joint, _ = sum_product(forest, own, pair)
        g = np.bincount(col, (marginal[:, 1] - y)[row], len(index))
        gp = np.zeros_like(pair)
        np.add.at(gp, forest.kind[child], (joint - gold)[child])
        grad = np.concatenate([g, gp.ravel()]) / len(pages) + 5e-4 * theta
        mom, vel = 0.9 * mom + 0.1 * grad, 0.999 * vel + 0.001 * grad * grad
        theta = theta - 0.08 * (mom / (1 - 0.9**step)) / (np.sqrt(vel / (1 - 0.999**step)) + 1e-8)
    return {"index": index, "w": theta[: len(index)].copy(), "pair": theta[len(index) :].reshape(pair.shape).copy()}


#: words in class, id or role that say what an element is (fixed values, common on the web)
BOILER = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie consent disqus footer form header menu "
    "nav navbar navigation newsletter notice pager pagination popup promo related respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget widgets modal overlay login search tags".split()
)
_NOT_TEXT = {"nav", "aside", "footer", "form", "button", "select", "option", "label", "dialog", "menu", "search"}


def own_labels(page: Page) -> list[int] | None:
    """Labels that the page's markup states itself, None if it has no article or main element."""
    main = [t in ("article", "main") or "r=main" in page.names[i] or "c=articlebody" in page.names[i] for i, t in enumerate(page.tag)]
    if not any(main):
        return None
    state = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        boiler = page.tag[i] in _NOT_TEXT or any(x[2:] in BOILER for x in page.names[i])
        state[i] = 0 if boiler else 1 if main[i] else state[page.parent[i]]
    return state


_TAGS = re.compile(r"<(/?)(article|main|nav|header|footer|aside)\b([^>]*)>", re.I)


def disguised(source: str, rng: random.Random) -> str:
    """The page with its telling tags as div; a class name of the kind stands in some."""
    names = {"article": ("post", "entry-content", "story", "article-body", "content"), "main": ("main", "content"), "nav": ("menu", "navbar", "nav"), "header": ("header", "top", "masthead"), "footer": ("footer", "bottom"), "aside": ("sidebar", "widget")}

    def swap(m):
        kind = m[2].lower()
        return "</div>" if m[1] else f'<div class="{rng.choice(names[kind])}"{m[3]}>'

    return _TAGS.sub(swap, source)


def layouts(sentences: list[str], n: int, seed: int = SEED) -> tuple[list[str], list[list[int]]]:
    """``n`` pages of common layouts with the labels of their nodes (by a marker attribute)."""
    rng = random.Random(seed)

    def say(a, b):
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(a, b)))

    def few(n):
        return " ".join(rng.choice(sentences).split()[: rng.randint(1, n)])

    def attr(names, p=0.9):
        if rng.random() > p:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}{rng.choice(("", "", "-wrap", "_box", " clearfix", "-1"))}"'

    def links(k):
        kind = rng.choice(("ul", "div", "p"))
        items = [f'<a href="/{i}">{few(3)}</a>' for i in range(k)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if kind == "ul" else f"<{kind}>{' | '.join(items)}</{kind}>"

    def el(tags, names, inside, p=0.9):
        tag = rng.choice(tags)
        role = f' role="{rng.choice(("navigation", "banner", "complementary", "contentinfo"))}"' if tag == "div" and rng.random() < 0.1 else ""
        return f"<{tag}{attr(names, p)}{role}>{inside}</{tag}>"

    def comments():
        one = lambda: el(("li", "div", "article"), ("comment", "comment-body", "reply"), f"<p>{few(2)}</p><p>{say(1, 3)}</p>", 0.95)
        return el(("section", "div", "ol"), ("comments", "comment-list", "respond", "disqus-thread", "reader-comments"), f"<h3>{few(2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))), 1.0)

    def boiler():
        return rng.choice(
            (
                lambda: el(("nav", "div", "ul"), ("menu", "nav", "navbar", "navigation", "breadcrumb", "topnav"), links(rng.randint(2, 8)), 0.8),
                lambda: el(("header", "div"), ("header", "site-header", "masthead", "banner", "top"), f"<div>{few(4)}</div>{links(rng.randint(2, 6))}"),
                lambda: el(("div", "aside", "section", "ins"), ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "sponsored", "banner-ad"), rng.choice((say(1, 2), f"<p>{say(1, 2)}</p>", f'<a href="/x">{few(8)}</a>')), 1.0),
                lambda: el(("div", "section", "aside", "dialog"), ("notice", "cookie", "cookie-notice", "consent", "alert", "gdpr", "popup", "modal"), f"<p>{say(1, 2)}</p><button>{few(2)}</button>", 1.0),
                lambda: el(("aside", "div"), ("sidebar", "widget", "related", "rail", "side"), f"<h4>{few(3)}</h4>{rng.choice((links(4), f'<p>{say(1, 3)}</p>'))}", 0.95),
                lambda: f"<form{attr(('search', 'signup', 'newsletter', 'subscribe', 'login', 'contact'), 0.7)}><label>{few(3)}</label><input><p>{say(1, 1)}</p><button>{few(2)}</button><select><option>{few(1)}</option></select></form>",
                lambda: el(("div", "ul", "section"), ("share", "social", "related", "tags", "pagination", "newsletter"), f"<p>{few(4)}</p>" + links(3), 1.0),
                comments,
            )
        )()

    def good():
        kind = rng.random()
        if kind < 0.22:
            return f"<p>{few(5)}</p>"
        if kind < 0.72:
            return f"<p>{say(1, 6)}</p>"
        if kind < 0.8:
            return f"<{rng.choice(('h2', 'h3'))}>{few(7)}</{rng.choice(('h2', 'h3'))}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{say(1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{rng.choice((say(1, 2), f'<p>{say(1, 2)}</p>'))}</blockquote>"
        if kind < 0.93:
            return f"<pre>{few(8)}</pre>"
        if kind < 0.96:
            return f"<table><tr><td>{few(3)}</td><td>{few(3)}</td></tr><tr><td>{few(3)}</td><td>{few(3)}</td></tr></table>"
        if kind < 0.98:
            return f"<figure><figcaption>{few(8)}</figcaption></figure>"
        return f"<div>{rng.choice((say(1, 4), f'<p>{say(1, 4)}</p>'))}</div>"

    pages, marks = [], []
    for _ in range(n):
        parts = [good() for _ in range(rng.choice((1, 2, 4, 8, 14, 30)))]
        if rng.random() < 0.15:  # line by line
            parts = [f"<p>{few(3)}</p>" for _ in parts]
        if rng.random() < 0.7:
            parts.insert(0, f"<h1>{few(8)}</h1>")
        for _ in range(rng.choice((0, 0, 1, 2))):  # inside the article
            parts.insert(rng.randint(1, len(parts)), "\1" + boiler() + "\2")
        tag, name = rng.choice((("article", ()), ("main", ()), ("div", ("content", "post", "entry", "entry-content", "article", "article-body", "story", "main", "main-content", "page-content", "text")), ("section", ("content", "post", "article", "story", "body"))))
        body = f"<{tag}{attr(name, 0.95) if name else ''}>{''.join(parts)}</{tag}>"
        if rng.random() < 0.4:
            body = f"<div{attr(('container', 'wrapper', 'page', 'row', 'layout'), 0.7)}>\1{boiler()}\2{body}\1{boiler()}\2</div>"
        before = "".join("\1" + boiler() + "\2" for _ in range(rng.randint(0, 3)))
        after = "".join("\1" + boiler() + "\2" for _ in range(rng.randint(0, 3)))
        foot = "\1" + el(("footer", "div"), ("footer", "site-footer", "copyright", "bottom"), rng.choice((f"&copy; {few(6)}", f"<p>&copy; {few(8)}</p>{links(3)}"))) + "\2"
        page = f"<html><body>{before}\3{body}\4{after}{foot}</body></html>"
        pages.append(page)
        marks.append([])
    return pages, marks


def _marked(source: str) -> tuple[Page, list[int]]:
    """A page of ``layouts`` without its marks, and the labels they give.

    The marks become text runs of their own: \\3 \\4 open and close the main part, \\1 \\2
    what does not belong to it. The label of a node is that of the place where it begins.
    """
    clean = re.sub(r"[\1-\4]", "", source)
    page = Page(clean)
    # the k-th block start tag of the source is node k: walk the tags with the marks in place
    labels, depth, inside = [0], 0, 0
    for m in re.finditer(r"[\1-\4]|<([a-z][a-z0-9]*)", source):
        c = m[0]
        if c == "\1":
            depth += 1
        elif c == "\2":
            depth -= 1
        elif c == "\3":
            inside = 1
        elif c == "\4":
            inside = 0
        elif m[1] in BLOCK:
            labels.append(int(inside and not depth))
    return page, labels


def fit(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES, layout_pages: int = LAYOUT_PAGES, seed: int = SEED) -> dict:
    """Train on about ``sample_pages`` given pages (a bounded sample) and ``layout_pages`` layouts."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("html is not null")
    n = rows.count()
    unit = F.xxhash64("page_id", F.lit(seed)) / F.lit(2.0**64) + 0.5
    some = rows.where(unit < 2.0 * sample_pages / max(1, n)).orderBy(unit, "page_id").limit(sample_pages)  # bounded
    sources = sorted(r["html"] for r in some.select("html").toLocalIterator())
    rng = random.Random(seed)
    train_pages, labels, sentences = [], [], []
    for s in sources:
        page = Page(s)
        got = own_labels(page)
        sentences += [x for at, t in page.runs for x in t.split(". ")][:20]
        if got is not None:
            if rng.random() < 0.5:
                page = Page(disguised(s, rng))
            if len(page.tag) == len(got):
                train_pages.append(page)
                labels.append(got)
    sentences = [x for x in sentences if len(x.split()) > 2] or ["A sentence with a few words in it", "Another one follows here"]
    for s in layouts(sentences, layout_pages, seed)[0]:
        page, got = _marked(s)
        if len(got) == len(page.tag):
            train_pages.append(page)
            labels.append(got)
    return train(train_pages, labels)


def content(model: dict, sources: list[str | None]) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    memo, index, w = {}, model["index"], model["w"]
    own = np.zeros((len(forest.parent), 2))
    at = 0
    for p in pages:
        for f in node_features(p):
            total = 0.0
            for name in f:
                x = memo.get(name)
                if x is None:
                    i = index.get(name)
                    memo[name] = x = 0.0 if i is None else float(w[i])
                total += x
            own[at, 1] = total
            at += 1
    marginal, _, _ = sum_product(forest, own, model["pair"])
    yes = marginal[:, 1] >= 0.5
    out = []
    for p, a in zip(pages, forest.begin):
        if len(p.tag) == 1:  # no markup at all
            out.append("\n".join(t for _, t in p.runs))
        else:
            out.append("\n".join(t for i, t in p.runs if yes[a + i]))
    return out


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""

    def run(batches):
        for batch in batches:
            for part, sources in text_slices(batch, "html"):
                texts = content(model, sources)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
