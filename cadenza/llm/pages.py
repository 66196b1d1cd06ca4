"""Main text of web pages: boosted trees judge DOM nodes, and a hierarchical decoder makes their judgements agree."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.boosting import BoostedTrees

# Element names by how the HTML standard treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("noscript template svg math object canvas audio video select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
# Words in class, id and role attributes that tell boilerplate or content.
BAD_TOKENS = "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget related recommended share sharing social comment comments reply replies respond discussion cookie cookies consent notice gdpr popup modal subscribe newsletter signup login form search tags meta toolbar pager pagination skip".split()
GOOD_TOKENS = "article content main body text post entry story page prose markdown blog news".split()

# A quote opens a value only behind an equals sign; elsewhere it is a character like others, so a tag ends at its next ">".
_TOKEN = re.compile(r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*>?|</(?:>|[^a-zA-Z>][^>]*>?)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?|[^=>])*+)>|([^<]+|<)")
_BLOCK = re.compile(r"<(?:p|div|article|main|section|h[1-6]|ul|ol|table|blockquote|body|footer|header|nav|aside)\b", re.I)
_ATTRS = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_BAD, _GOOD = frozenset(BAD_TOKENS), frozenset(GOOD_TOKENS)


@dataclass(slots=True)
class Node:
    """An element, or a run of text between block elements (tag ``#text``) with its pieces."""

    tag: str
    parent: int
    depth: int
    attrs: str = ""
    children: list[int] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    place: int = 0  # among its siblings


def _end_of(page: str, tag: str, at: int, ends: dict[str, re.Match | None]) -> re.Match | None:
    """The next end tag of ``tag``; ``ends`` keeps what was found, so that a page is searched once a tag."""
    found = ends.get(tag, False)
    if found is False or found is not None and found.start() < at:
        found = ends[tag] = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
    return found


def parse(page: str) -> list[Node]:
    """Block elements and their runs of text, in page order; inline elements and line breaks only mark up runs.

    Only elements whose content is raw text by the HTML standard hide what follows up to their end tag, or to the end of
    the page without one. Embedded things and controls hide their content if they end before any block begins; else
    their tag alone is left out. A slash before ">" does not close an element. A tag that never ends is no text.
    """
    nodes = [Node("#root", -1, 0)]
    stack, run, in_link = [0], -1, 0
    at, n = 0, len(page)
    ends: dict[str, re.Match | None] = {}
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        close, tag, attrs, text = m.groups()
        if text == "<" and page[at : at + 1].strip("/").isalpha():
            break
        if text is not None:
            if run < 0:
                if text.isspace():
                    continue
                run = len(nodes)
                nodes.append(Node("#text", stack[-1], len(stack), place=len(nodes[stack[-1]].children)))
                nodes[stack[-1]].children.append(run)
            nodes[run].pieces.append(text)
            if in_link:
                nodes[run].links += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW or tag in SKIPPED:
            if not close and not (tag in ("svg", "math") and attrs.endswith("/")):
                end = _end_of(page, tag, at, ends)
                if tag in RAW:
                    at = end.end() if end else n
                elif end and (tag in ("noscript", "template", "svg", "math") or not _BLOCK.search(page, at, end.start())):
                    at = end.end()
            if run >= 0:
                nodes[run].pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if close else 1
            elif tag == "br" and run >= 0:
                nodes[run].pieces.append(" ")
            continue
        run, in_link = -1, 0
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P and nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in SAME_CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in SAME_CLOSES[tag]:
                    break
                if t == tag or (tag in ("td", "th") and t in ("td", "th")) or (tag in ("dt", "dd") and t in ("dt", "dd")):
                    del stack[k:]
                    break
        if tag in ("html", "head", "body"):
            continue
        nodes.append(Node(tag, stack[-1], len(stack), attrs, place=len(nodes[stack[-1]].children)))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if tag not in VOID:
            stack.append(len(nodes) - 1)
    return nodes


# Kinds of elements, in the order of their feature.
TAG_KIND = {t: k for k, names in enumerate(("#text #root", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "div", "section", "article main", "header", "nav", "aside", "footer", "form fieldset", "table tbody thead tr td th", "figure figcaption", "address details summary hr")) for t in names.split()}
N_KINDS = 17
N_FEATURES = 24


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node: kind, attribute words (own and above), subtree size and density, depth, and siblings."""
    n = len(nodes)
    chars, links, marks, tags, paras = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            text = "".join(node.pieces)
            chars[i], links[i] = len(text), node.links
            marks[i] = text.count(".") + text.count(",")
        elif node.tag == "p":
            paras[i] += 1
        if i:
            p = node.parent
            chars[p] += chars[i]
            links[p] += links[i]
            marks[p] += marks[i]
            tags[p] += tags[i]
            paras[p] += paras[i]
    total = chars[0] or 1
    x = np.zeros((n, N_FEATURES), np.float32)
    bad, good, upper = [0] * n, [0] * n, [0] * n
    seen = 0
    rows = []
    for i, node in enumerate(nodes):
        kind = TAG_KIND.get(node.tag, N_KINDS - 1)
        own_bad = own_good = 0
        if node.attrs:
            for m in _ATTRS.finditer(node.attrs):
                for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()):
                    own_bad += w in _BAD
                    own_good += w in _GOOD
        p = node.parent
        if i:
            bad[i] = bad[p] + own_bad + (8 <= kind <= 12)
            good[i] = good[p] + own_good + (kind == 7)
            upper[i] = kind if 7 <= kind <= 12 else upper[p]
            family = nodes[p].children
            place = node.place
            pc, pl, pt = chars[p], links[p], tags[p]
            share = chars[i] / (pc or 1)
        else:
            family, place, pc, pl, pt, share = [0], 0, total, links[0], tags[0], 1.0
        c = chars[i]
        rows.append((
            kind, own_bad, own_good, bad[i], good[i], upper[i], c, c / total, links[i] / (c or 1), marks[i] / (c or 1), c / tags[i], tags[i], paras[i], node.depth,
            len(family), place / len(family), share, pl / (pc or 1), pc / pt, paras[p] if i else paras[0], seen / total, len(node.children), TAG_KIND.get(nodes[p].tag, N_KINDS - 1) if i else 0, marks[p] / (pc or 1) if i else 0,
        ))
        if node.tag == "#text":
            seen += c
    x[:] = rows
    x[:, 6] = np.log1p(x[:, 6])
    x[:, 10] = np.log1p(x[:, 10])
    return x


def decode(nodes: list[Node], margins: np.ndarray) -> list[bool]:
    """Keep or drop each node so that a kept node's ancestors are kept, at the highest sum of margins of kept nodes.

    A subtree is worth its own margin and those of the children that are worth keeping, or nothing when dropped. Runs
    of text under a kept element are judged like its other children.
    """
    n = len(nodes)
    worth = [float(m) for m in margins]
    for i in range(n - 1, 0, -1):
        if nodes[i].tag != "#text" and not nodes[i].children:
            worth[i] = 0.0
        if worth[i] > 0:
            worth[nodes[i].parent] += worth[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[nodes[i].parent] and worth[i] > 0
    return keep


def block_text(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def extract(nodes: list[Node], keep: list[bool]) -> str:
    blocks = (block_text(node.pieces) for i, node in enumerate(nodes) if node.tag == "#text" and keep[i])
    return "\n".join(b for b in blocks if b)


def training_page(rng: random.Random) -> str:
    """An invented page in one of many layouts, marked up with ``data-k`` on each element: 1 content, 0 not."""
    word = lambda: "".join(rng.choice(("la", "mi", "tor", "en", "sha", "po", "ver", "ist")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentences = lambda a, b: " ".join(words(3, 14).capitalize() + rng.choice((".", ".", ",", "?")) for _ in range(rng.randint(a, b)))
    inline = lambda t: f"<b>{t}" if rng.random() < 0.05 else f"{t} <a href='x'>{word()}</a> {word()}" if rng.random() < 0.2 else t
    named = lambda tag, names, k, body: f"<{tag}{' ' + rng.choice(('class', 'id')) + '=' + chr(34) + rng.choice(names) + chr(34) if names else ''} data-k={k}>{body}</{tag}>"
    item = lambda: f"<li data-k=0>{rng.choice((f'<a href=x>{words(1, 3)}</a>', words(1, 4)))}</li>"
    menu = lambda: "<ul data-k=0>" + "".join(item() for _ in range(rng.randint(2, 9))) + "</ul>"
    para0 = lambda: f"<p data-k=0>{sentences(1, 3)}</p>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p data-k=1>{inline(sentences(1, 7) if rng.random() < 0.85 else words(1, 3) + '.')}" + rng.choice(("</p>", "</p>", "<br>"))
        if kind < 0.82:
            return f"<h{(d := rng.randint(2, 4))} data-k=1>{words(1, 6)}</h{d}>"
        if kind < 0.90:
            return "<ul data-k=1>" + "".join(f"<li data-k=1>{sentences(1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote data-k=1><p data-k=1>{sentences(1, 3)}</p></blockquote>"
        return f"<table data-k=1><tr data-k=1><td data-k=1>{words(1, 5)}<td data-k=1>{words(1, 5)}</tr></table>"

    nav = named(rng.choice(("nav", "div", "nav")), ("nav", "menu main-menu", "navbar", "site-navigation", "breadcrumb"), 0, menu())
    head = named(rng.choice(("header", "div")), ("header", "masthead", "site-header"), 0, rng.choice(("", f"<h1 data-k=0>{words(1, 2)}</h1>")) + rng.choice((nav, f"<p data-k=0>{words(2, 5)}</p>")))
    foot = named(rng.choice(("footer", "footer", "div")), ("footer", "site-footer", "foot"), 0, rng.choice((f"&copy; {words(1, 3)} &middot; {sentences(1, 2)}", menu(), para0() + menu())))
    ad = lambda: named(rng.choice(("div", "aside", "section")), ("ad", "advert banner", "sponsored", "promo", "ads top"), 0, rng.choice((sentences(1, 3), para0())))
    side = named(rng.choice(("aside", "div")), ("sidebar", "side widget", "related", "recommended", "widget-area"), 0, f"<h3 data-k=0>{words(1, 3)}</h3>" + rng.choice((menu(), para0())))
    notice = named("div", ("cookie-notice", "consent", "notice", "gdpr popup", "newsletter subscribe"), 0, rng.choice((sentences(1, 3), para0())))
    form = f"<form data-k=0><p data-k=0>{words(2, 6)}</p><label>{words(1, 2)}</label><input></form>"
    said = lambda: named(rng.choice(("div", "li", "article")), ("comment", "comment reply"), 0, f"<p data-k=0><b>{word()}</b> {words(1, 2)}</p>" + para0())
    comments = named(rng.choice(("section", "div", "div")), ("comments", "discussion", "comment-list", "respond"), 0, f"<h2 data-k=0>{words(1, 2)}</h2>" + "".join(said() for _ in range(rng.randint(1, 5))))
    share = named("div", ("share social", "tags", "meta post-meta"), 0, rng.choice((words(1, 4), menu())))
    title = f"<h1 data-k=1>{words(2, 8)}</h1>"
    body = "".join(paragraph() + (ad() if rng.random() < 0.04 else "") for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12, 20))))
    inner = title + (share if rng.random() < 0.15 else "") + body + (comments if rng.random() < 0.1 else "")
    main = rng.choice((
        lambda: f"<article data-k=1>{inner}</article>",
        lambda: f"<article data-k=1>{inner}</article>",
        lambda: f"<main data-k=1>{rng.choice((inner, '<article data-k=1>' + inner + '</article>'))}</main>",
        lambda: named("div", ("content", "post-body entry", "article-text", "story", "main page-content"), 1, inner),
        lambda: named("section", ("content", "post", "entry"), 1, inner),
        lambda: f"<div data-k=1>{inner}</div>",
    ))()
    order = [x for x, share_ in ((notice, 0.3), (head, 0.5), (nav, 0.8), (ad(), 0.6)) if rng.random() < share_]
    after = [x for x, share_ in ((share, 0.2), (side, 0.4), (ad(), 0.3), (form, 0.3), (comments, 0.4), (notice, 0.1), (foot, 0.9)) if rng.random() < share_]
    if rng.random() < 0.3:
        main = f"<div class='wrap' data-k=1>{main}{side if rng.random() < 0.5 else ''}</div>"
    return "<html><body>" + "".join(order) + main + "".join(after) + "</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 450, seed: int = 5) -> BoostedTrees:
    """The model: fitted on invented pages only, the same at every call. A text run has its element's mark."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(training_page(rng))
        marks = [1.0] * len(nodes)
        for i, node in enumerate(nodes[1:], 1):
            m = re.search(r"data-k=([01])", node.attrs)
            marks[i] = float(m[1]) if m else marks[node.parent]
        xs.append(features(nodes))
        ys.append(marks)
    return BoostedTrees.fit(np.concatenate(xs), np.concatenate(ys))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text of the article and its length.

    Null or empty html gives an empty text. White space inside a block becomes one blank, character references are
    decoded, blocks are joined by line feeds. Pages are handled row by row in Arrow batches; repeated rows repeat;
    other columns are ignored. The model is fixed in size and goes along with the code.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 200):
                batch = big.slice(at, 200)
                parsed = [parse(h or "") for h in batch.column(2).to_pylist()]
                margins = model.margins(np.concatenate([features(p) for p in parsed])) if parsed else []
                texts, done = [], 0
                for nodes in parsed:
                    texts.append(extract(nodes, decode(nodes, margins[done : done + len(nodes)])))
                    done += len(nodes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
