"""Main text of raw web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks in page order. Each has features of
its own (words, link density, what encloses it) and of its neighbours (words and
link density of the blocks before and after). A decision tree grown on the blocks
of a few labelled pages says which are main text. Names of classes are a feature
like others: how sure the name is, how far out it stands and what share of the
page's text it holds, for a name around most of a page is about its layout.

Defined results: null and empty pages have an empty text; markup that is cut
off or never closed ends with the page; a page of any length is worked through
whole; repeated rows are extracted once each; carried columns with the name of a
result column are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import carried

#: Elements that break a line of text, and those whose content isn't text.
BLOCK = set(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|noscript|template|iframe|svg|math|object|textarea|audio|video"
HEADINGS = {f"h{k}" for k in range(1, 7)}
#: Elements that are kept on the stack because they enclose text.
ENCLOSING = set("title article main nav header footer aside form menu dialog button select head section div ul ol table figure details p li td th h1 h2 h3 h4 h5 h6 a".split())
#: Elements that never hold main text, whatever their size.
NOT_MAIN = set("nav footer aside menu dialog button select head title".split())
#: Parts of names that mostly mean what isn't main text; those that may as well mean something else; those that say of a layout what it has; and those of main text.
SURE = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu footer masthead sidebar sidebars breadcrumb breadcrumbs "
    "share sharing social cookie cookies consent gdpr popup modal comments comment commentlist disqus replies related recommended recommendations newsletter subscribe "
    "widget widgets pagination pager toolbar copyright contentinfo complementary".split()
)
UNSURE = set("side header search form notice notices alert alerts legal skip overlay login signup subscription banner-text meta links more".split())
LAYOUT = set("with without has have no is not and".split())
MAIN = set("main content article post entry story body text prose".split())
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=|/)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
#: What follows a tag's name; a quoted value may hold "<" and ">".
REST = r"""(?:[^<>=]++|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>]){REST}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{REST})>|<[!?][^<>]*>|<[a-zA-Z/!?][^<>]*\Z",
    re.S | re.I,
)
FEATURES = (
    "words", "link_density", "words_before", "links_before", "words_after", "links_after",
    "in_article", "in_main_name", "heading", "list_item", "element", "sure_name", "unsure_name", "levels", "share",
)

#: The labelled pages: a block that begins with "+" is main text, one with "-" is not; {n} are n words.
LABELLED = (
    # an article, with menus, adverts and a footer around it
    "<head><title>-{6}</title></head><nav><ul><li><a>-{1}</a><li><a>-{2}</a><li><a>-{1}</a></ul></nav><div class=ad>-{9}</div><article><h1>+{8}</h1><p>+{60}</p><p>+{1}</p><p>+{25}</p><p>+{3}</p></article><footer>-{7}</footer>",
    "<header><a>-{1}</a></header><nav><a>-{1}</a> <a>{1}</a></nav><div class=promo>-{25}</div><article><h1>+{3}</h1><p>+{2}</p></article><div class=ad-slot>-{60}</div><footer>-{40}</footer>",
    "<article><h1>+{5}</h1><p>+{90} <a>{12}</a></p><ul><li>+{3} <a>{4}</a><li>+<a>{2}</a><li>+{1}</ul><h2>+{2}</h2><p>+{14}</p><div class=share-buttons>-{3} <a>{1}</a></div><div class=comments><p>-{30}<p>-{4}</div></article>",
    "<article><header><h1>+{7}</h1><p>+{4}</p></header><p>+{35}</p><aside>-{20}</aside><p>+{45}</p><form>-{4}<button>-{1}</button></form><div class=related-posts><a>-{6}</a><p>-{12}</p></div><p>+{8}</p></article><div id=cookie-notice>-{14}</div>",
    # paragraphs and lists of many links that are text
    "<article><p>+{20} <a>{10}</a></p><p>+{5} <a>{6}</a></p><p>+<a>{9}</a> {2}</p><ul><li>+<a>{3}</a><li>+<a>{4}</a> {3}</ul><p>+{11}</p></article><ul><li><a>-{3}</a><li><a>-{2}</a></ul>",
    "<article><p>+<a>{4}</a></p><p>+{30} <a>{20}</a></p><div class=tags-and-share>-<a>{1}</a> <a>{1}</a></div><h3>+<a>{5}</a></h3><p>+{8} <a>{3}</a></p></article><p>-<a>{3}</a></p>",
    "<div class=content><p>+{30} <a>{15}</a></p><p>+{25} <a>{9}</a></p><p>+{7} <a>{4}</a> {5}</p></div><p>+{60} <a>{20}</a></p><div>-<a>{2}</a> {1}</div>",
    "<div><p>+{40} <a>{16}</a></p><p>+{12}</p><p>+{22} <a>{8}</a></p></div><div>-<a>{6}</a></div><div>-<a>{3}</a> {1} <a>{2}</a></div>",
    # short ends of articles before links
    "<article><p>+{4}</p><p>+{2}</p></article><ul><li><a>-{1}</a><li><a>-{1}</a></ul>", "<ul><li><a>-{1}</a></ul><article><p>+{3}</p></article><div><a>-{4}</a></div>", "<article><h1>+{2}</h1><p>+{1}</p></article><p>-<a>{3}</a></p>",
    "<p>-<a>{2}</a></p><p>-{2}</p><p>-<a>{4}</a></p><article><p>+{6}</p><p>+{2} <a>{1}</a></p><p>+{12}</p><p>+{5}</p></article><p>-<a>{2}</a></p><p>-{1}</p><p>-<a>{2}</a></p>",
    # names in an article that mean something else
    "<article><h2 class=section-header>+{3}</h2><p>+{30}</p><div class=legal><p>+{40}<p>+{6}</div><div class=search-results-in-court>+{15}</div><p class=notice>+{18}</p></article><div class=legal>-{12}</div>",
    "<main><h1 class=header>+{4}</h1><p>+{9}</p><div class=side-effects><p>+{22}<p>+{5}</div></main><div class=side>-{10} <a>{3}</a></div><div class=login>-{2}</div>",
    "<nav><a>-{2}</a></nav><article><p>+{21}</p><div class=alert><p>+{7}</div><div class=header>+{2}</div><p class=more>+{9}</p></article><div class=more>-{2}</div><div class=alert>-{9}</div>",
    "<article><div class=meta>+{3}</div><p>+{26}</p><p class=legal-notice>+{13}</p></article>",
    # names around a whole page
    "<div class=side-streets><p>+{40}</p><p>+{38}</p></div>", "<div class=notice-board><h1>+{2}</h1><p>+{24}</p><p>+{3}</p></div><div class=side>-{6}</div>", "<section id=alerts-explained><p>+{31}</p></section><div class=meta>-{3}</div><div class=links><a>-{2}</a></div>",
    "<body class=has-sidebar><div class='content with-sidebar'><h1>+{6}</h1><p>+{70}</p><p>+{4}</p><p>+{33}</p></div><div class=sidebar>-{8}<ul><li><a>-{3}</a><li><a>-{2}</a></ul></div><div class=footer>-{5}</div>",
    "<div id=search-engines><h1>+{3}</h1><p>+{50}</p><p>+{12}</p><p>+{2}</p></div><div class=search>-{1}</div><div class=notice>-{11}</div>",
    "<form id=aspnet><div class=menu><a>-{1}</a> <a>{1}</a></div><div id=page><h1>+{4}</h1><p>+{80}</p><p>+{6}</p><p>+{28}</p></div><div class=copyright>-{6}</div></form>",
    "<div class=widget-page><h2>+{5}</h2><p>+{65}</p><p>+{3}</p><div class=widget>-{7}</div></div><form>-{3} {2}</form>",
    # no article: divisions, tables, quotations
    "<div class=menu><ul><li><a>-{1}</a><li><a>-{1}</a><li><a>-{2}</a></ul></div><div class=main><h1>+{4}</h1><p>+{30}</p><blockquote>+{5}</blockquote><p>+{40}</p><p>+{2}</p></div><div class=footer>-{9}</div>",
    "<ul><li><a>-{1}</a><li><a>-{2}</a><li><a>-{1}</a></ul><div>+{55}</div><p>+{3}</p><p>+{20}</p><ul><li>+{9}<li>+{7}</ul><p>+{36}</p><p>-<a>{2}</a> <a>{1}</a></p>",
    "<table><tr><td><a>-{1}</a><td><a>-{2}</a></table><h1>+{6}</h1><table><tr><td>+{44}<tr><td>+{18}<tr><td>+{2}</table><p>+{27}</p><div>-{2} <a>{1}</a> <a>{2}</a></div><div><a>-{4}</a></div>",
    "<div><a>-{2}</a></div><div>-{3}</div><div><a>-{1}</a></div><div><a>-{3}</a></div><h1>+{5}</h1><p>+{48} <a>{6}</a></p><p>+{10}</p><p>+{31}</p><div><a>-{5}</a></div><div>-{2}</div><div><a>-{4}</a></div>",
    "<div class=post><h2>+{7}</h2><p>+{16}</p><p>+{1}</p></div><div class=comments><p>-{45}<p>-{12}<p>-{3}</div><div>-{1} <a>{5}</a></div><div><a>-{7}</a></div>",
    # short pages, and pages without main text
    "<p>+{4}</p>", "<p>+{1}</p>", "<div>+{9}</div>", "<h1>+{2}</h1><p>+{6}</p>", "<div class=content>+{3}</div>", "<title>-{3}</title><p>+{12}</p>", "<h2>+{4}</h2><div>+{7}</div><div>+{2}</div>",
    "<nav><a>-{1}</a></nav><p>+{5}</p><footer>-{3}</footer>", "<ul><li><a>-{2}</a><li><a>-{1}</a></ul><p>+{7}</p>",
    "<nav><ul><li>-{3}<li><a>-{1}</a></ul></nav><footer>-{50}</footer>", "<footer>-{4}</footer>", "<ul><li><a>-{3}</a><li><a>-{4}</a><li><a>-{2}</a></ul>", "<aside><p>-{70}</aside>", "<div class=cookie-banner>-{16}</div><p>+{19}</p>",
)


@dataclass
class Node:
    """Of a decision tree: ``feature <= cut`` goes left; a leaf has a value."""

    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """A classification tree by Gini impurity; ties go to the first feature and the lowest cut."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * least or node.value in (0.0, 1.0):
        return node
    best = (2 * node.value * (1 - node.value) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            gini = sum(2 * p * (1 - p) * n for p, n in ((y[m].mean(), m.sum()) for m in (left, ~left)))
            if gini < best[0] - 1e-9:
                best = (gini, f, float(cut))
    if best[1] < 0:
        return node
    left = x[:, best[1]] <= best[2]
    node.feature, node.cut = best[1], best[2]
    node.left, node.right = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return node


def predict(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    work = [(tree, np.arange(len(x)))]
    while work:
        node, at = work.pop()
        if node.left is None:
            out[at] = node.value
            continue
        left = x[at, node.feature] <= node.cut
        work += [(node.left, at[left]), (node.right, at[~left])]
    return out


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    in_main_name: bool
    heading: bool
    list_item: bool
    element: bool
    sure: bool
    unsure: bool
    levels: int
    #: Number of the innermost element that speaks against main text; -1 for none.
    against: int


def _name_of(rest: str) -> tuple[bool, bool, bool]:
    """Whether an element's names surely, or possibly, mean what isn't main text, and whether they mean main text."""
    sure = unsure = main = False
    for m in _NAMES.findall(rest):
        for name in " ".join(filter(None, m)).lower().split():
            parts = set(re.split("[_-]+", name))
            told = not parts & LAYOUT
            sure |= told and bool(parts & SURE)
            unsure |= bool(parts & UNSURE) or not told and bool(parts & SURE)
            main |= bool(parts & MAIN)
    return sure, unsure and not sure, main


@dataclass
class _Open:
    """Enclosing elements, innermost last, with how many of each sort are open."""

    stack: list[tuple[str, bool, bool]] = field(default_factory=list)
    names: dict[str, int] = field(default_factory=dict)
    never: int = 0
    main: int = 0
    #: Elements whose name or kind speaks against main text: level, number, sure.
    against: list[tuple[int, int, bool]] = field(default_factory=list)
    number: int = 0

    def push(self, name: str, rest: str) -> None:
        never = name in NOT_MAIN or name == "header" and not (self.names.get("article") or self.names.get("main")) or bool(rest and _HIDDEN.search(rest))
        sure, unsure, main = _name_of(rest) if rest.strip() else (False, False, False)
        if name in ("body", "html", "article", "main"):
            never = sure = unsure = False
        sure |= name == "form"
        self.stack.append((name, never, main))
        self.names[name] = self.names.get(name, 0) + 1
        self.never += never
        self.main += main
        if sure or unsure:
            self.against.append((len(self.stack), self.number, sure))
            self.number += 1

    def pop(self, name: str) -> None:
        while self.names.get(name):
            top, never, main = self.stack.pop()
            self.names[top] -= 1
            self.never -= never
            self.main -= main
            if self.against and self.against[-1][0] > len(self.stack):
                self.against.pop()
            if top == name:
                return


def blocks_of(source: str | None) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    out: list[Block] = []
    source = source or ""
    opened, texts, linked, at = _Open(), [], [], 0

    def close() -> None:
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            names = opened.names
            heading = any(names.get(h) for h in HEADINGS)
            in_links = len(html.unescape(" ".join(linked)).split())
            words = text.count(" ") + 1
            level, number, sure = opened.against[-1] if opened.against else (len(opened.stack), -1, False)
            in_article = bool(names.get("article") or names.get("main"))
            levels = min(len(opened.stack) - level, 9)
            out.append(Block(text, words, min(words, in_links), in_article, opened.main > 0, heading, bool(names.get("li")), opened.never > 0, sure, number >= 0 and not sure, levels, number))
        texts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text:
            texts.append(text)
            if opened.names.get("a"):
                linked.append(text)

    for m in _TOKEN.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            close()
        elif name in ("br", "wbr"):
            add(" " if name == "br" else "")
        if name in ENCLOSING:
            if m["end"]:
                opened.pop(name)
            elif not (m["rest"].endswith("/") and name not in ("a", "p", "div")):
                if name in ("p", "li", "td", "th", "a") and opened.names.get(name) and opened.stack[-1][0] == name:
                    opened.pop(name)
                elif name in HEADINGS or name in ("div", "section", "article", "ul", "ol", "table", "nav", "footer", "aside", "form", "main", "header"):
                    opened.pop("p")
                opened.push(name, m["rest"])
        elif name == "body":
            opened.pop("head")
    add(source[at:])
    close()
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    words = np.array([0, *[b.words for b in blocks], 0], float)
    links = np.array([0, *[b.linked / b.words for b in blocks], 0], float)
    plain = np.array([b.words - b.linked for b in blocks], float)
    against = np.array([b.against for b in blocks])
    held = np.bincount(against + 1, plain)  # words outside links by the element that speaks against them
    share = np.where(against >= 0, held[against + 1] / max(plain.sum(), 1), 0)
    own = np.array([[b.in_article, b.in_main_name, b.heading, b.list_item, b.element, b.sure, b.unsure, b.levels] for b in blocks], float).reshape(-1, 8)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own, share])


def labelled_blocks(pages: tuple[str, ...] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages, each page also with a third and with three times the words."""
    x, y = [], []
    for page, times in itertools.product(pages, (1 / 3, 1, 3)):
        blocks = blocks_of(re.sub(r"\{(\d+)\}", lambda m: " ".join(["w"] * max(1, round(times * int(m[1])))), page))
        x.append(features_of(blocks))
        y += [b.text.lstrip("w ").startswith("+") for b in blocks]
    return np.concatenate(x), np.array(y, float)


def default_tree() -> Node:
    return grow(*labelled_blocks(), depth=9)


def main_text(source: str | None, tree: Node) -> str:
    blocks = blocks_of(source)
    if not blocks:
        return ""
    keep = predict(tree, features_of(blocks)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extracted(df: DataFrame, html_column: str = "html", carry: list[str] | None = None, tree: Node | None = None) -> DataFrame:
    """The columns of ``carry`` (all but the html by default), ``text`` and ``n_chars``."""
    carry = carried(df, carry, (html_column, "text", "n_chars"))
    tree = tree or default_tree()
    schema = T.StructType([*[df.schema[c] for c in carry], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x, tree) for x in part.column(len(carry)).to_pylist()]
                n = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), n], names=schema.names)

    return df.select(*carry, F.col(html_column).alias("_html")).mapInArrow(run, schema)
