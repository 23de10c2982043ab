"""HTML extraction (operator 10): flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks.  Each has its words and link density, those of the
blocks around it, and where it stands: in an article, in an element of page furniture, in one whose name says so, in a
heading or list.  A decision tree says which are main text; it is trained on the blocks of the small labelled pages below, whose features
are taken as those of any page.

Reading a page takes time in proportion to its length, whatever is unclosed in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, and words that name page furniture.
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select", "button", "object", "canvas", "math")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset(["nav", "footer", "aside", "menu", "dialog"])
#: Elements that may be furniture or hold the whole page.
_HOLDERS = frozenset(["form", "fieldset", "header"])
#: Raw elements whose text runs to the end of the page if nothing closes them.
_TO_THE_END = frozenset(["script", "style", "title", "textarea", "iframe"])
#: Names of what readers have written: furniture, however much of the page it is.
_READERS = frozenset("comment comments discussion disqus replies reply respond".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Words that may stand beside one of those in a name of furniture.
_PLACE_WORDS = frozenset("area bar block bottom box btn button buttons container footer global header icons inner item left link links list main outer page panel primary right secondary section site slot the top unit wrap wrapper".split())
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_LISTED = frozenset(["li", "td", "th", "dt", "dd"])
_IMPLIED = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"""=\s*(["'])|>""")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Labelled pages.  A step is markup, or a block: element, words, words in links, and whether it is main text.
LABELLED = (
    # pages without elements or names that tell
    "li 1 1 0; li 1 1 0; li 2 2 0; li 1 1 0; h1 7 0 1; p 50 0 1; p 60 4 1; p 15 0 1; p 80 0 1; li 6 6 0; li 5 5 0; li 7 7 0; p 3 0 0",
    "h1 5 0 1; p 120 0 1",
    "p 4 0 1",
    "div 9 0 1",
    "p 60 0 1; p 1 0 1; p 40 0 1; p 2 0 1; p 70 10 1",
    "div 1 1 0; div 2 2 0; div 1 1 0; h1 6 0 1; p 3 0 1; p 50 0 1; h2 2 0 1; p 35 0 1; li 4 0 1; li 5 0 1; li 3 0 1; p 45 0 1; div 20 14 0; div 4 0 0",
    "li 1 1 0; li 1 1 0; p 90 0 1; div 2 2 0; div 2 2 0",
    "li 3 3 0; li 4 4 0; li 2 2 0; h2 8 0 1; p 25 2 1; p 30 12 1; h2 6 0 1; p 40 0 1; div 30 25 0; div 12 12 0; div 2 0 0; div 1 1 0",
    "div 3 3 0; div 3 0 0; div 3 3 0; h1 9 0 1; p 200 8 1; li 2 2 0; li 2 2 0; div 3 0 0; li 2 2 0",
    "div 2 2 0; p 12 0 1; p 14 0 1; p 11 0 1; p 2 2 0",
    "p 30 0 1; p 20 20 0; p 28 0 1; div 8 8 0; div 9 9 0",
    # pages with an article
    "<nav>; li 1 1 0; li 1 1 0; li 4 4 0; </nav>; <article>; h1 8 0 1; p 45 0 1; p 1 0 1; p 20 20 1; p 60 24 1; li 1 1 1; li 2 2 1; p 300 0 1; <div class=ad>; p 12 0 0; p 60 0 0; </div>; p 5 5 1; h2 3 0 1; p 30 0 1; <aside>; p 35 0 0; </aside>; </article>; <footer>; p 10 0 0; p 25 3 0; </footer>",
    "<nav>; li 2 2 0; </nav>; <article>; p 5 0 1; </article>; <footer>; p 4 0 0; </footer>",
    "<header>; p 4 0 0; p 15 0 0; </header>; <article>; <header>; h1 6 6 1; p 3 1 1; </header>; p 55 0 1; </article>; <section id=comments>; p 40 0 0; p 70 2 0; p 3 0 0; </section>; <form>; p 12 0 0; </form>",
    "<article>; h1 4 0 1; p 2 0 1; p 2 0 1; </article>; <aside>; h2 3 0 0; p 60 0 0; p 80 10 0; </aside>; <div class=newsletter>; p 30 0 0; </div>",
    "<div class=cookie-notice>; p 25 1 0; </div>; <main>; h1 6 0 1; p 30 0 1; p 8 8 1; <div class=related>; li 5 5 0; li 6 6 0; </div>; </main>; <div class=sidebar>; p 50 0 0; li 2 2 0; </div>",
    "div 2 0 0; li 1 1 0; <article>; h1 5 0 1; p 40 0 1; </article>; div 3 3 0; div 2 0 0",
    "p 40 0 1; <article>; p 25 0 1; </article>; p 30 1 1; div 6 6 0",
    # short blocks in articles, in all places
    "<article>; p 1 0 1; p 1 0 1; </article>",
    "<article>; p 3 0 1; </article>",
    "<article>; p 2 2 1; p 1 0 1; </article>; <footer>; p 9 0 0; </footer>",
    "li 1 1 0; li 3 3 0; <article>; p 2 0 1; p 3 0 1; li 1 1 1; p 1 0 1; </article>; li 2 2 0; div 2 0 0; div 1 0 0",
    "<nav>; li 1 1 0; </nav>; <article>; p 2 0 1; p 60 0 1; p 1 0 1; </article>; <footer>; p 12 0 0; </footer>",
    "div 2 2 0; <article>; p 1 0 1; </article>; div 3 3 0; div 1 0 0",
    "<nav>; li 2 2 0; </nav>; <div class=ad>; p 9 0 0; </div>; <article>; h1 4 0 1; p 40 0 1; p 3 0 1; </article>; <aside>; p 2 0 0; li 3 3 0; </aside>; <footer>; p 2 0 0; </footer>",
    # pages whose names tell
    "<div class=header>; p 4 0 0; p 12 0 0; </div>; <div class=menu>; li 1 1 0; li 2 2 0; li 3 0 0; </div>; <div class=content>; h1 7 0 1; p 45 0 1; p 30 3 1; p 80 0 1; </div>; <div class=sidebar>; p 30 0 0; h2 2 0 0; p 45 0 0; </div>; <div class=ad>; p 15 0 0; </div>; <div class=comments>; p 60 0 0; p 20 0 0; p 90 0 0; </div>; <div class=footer>; p 25 0 0; </div>",
    "<nav>; li 1 1 0; </nav>; <div>; h2 5 0 1; p 35 0 1; p 14 0 1; </div>; <div class=banner>; p 30 0 0; </div>; p 50 0 1; <footer>; p 40 0 0; </footer>",
)


def _page_of(steps: str) -> tuple[str, list[int]]:
    """The markup of a labelled page, and its blocks' labels."""
    out, labels = [], []
    for step in steps.split("; "):
        if step.startswith("<"):
            out.append(step)
            continue
        name, words, linked, label = step.split()
        link, rest = int(linked), int(words) - int(linked)
        out.append(f"<{name}>" + (f"<a href=x>{'w ' * link}</a>" if link else "") + "w " * rest + f"</{name}>")
        labels.append(int(label))
    return "".join(out), labels


@cache
def tree():
    """The tree: nested (feature, cut, below or equal, above), leaves 0 or 1; splits by Gini impurity."""
    rows, labels = [], []
    for steps in LABELLED:
        page, known = _page_of(steps)
        rows += features(blocks(page))
        labels += known
    x, y = np.array(rows, float), np.array(labels)

    def grow(rows: np.ndarray, depth: int):
        own = y[rows]
        if depth == 0 or own.min() == own.max():
            return int(own.mean() >= 0.5)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[rows, f] <= cut
                gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (own[low], own[~low]))
                if best is None or gini < best[0] - 1e-9:
                    best = (gini, f, float(cut), low)
        if best is None:
            return int(own.mean() >= 0.5)
        _, f, cut, low = best
        return (f, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))

    return grow(np.arange(len(y)), 12)


def classify(row: tuple) -> int:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


class _Holder:
    """An element that may be furniture: by its name, or a form or header."""

    __slots__ = ("own", "parent", "readers", "released", "words")

    def __init__(self, parent, readers):
        self.parent, self.readers = parent, readers
        self.released, self.words, self.own = False, 0, False


class _Block:
    __slots__ = ("article", "heading", "holder", "linked", "listed", "named", "sure", "text", "words")

    def __init__(self, text, linked, article, sure, holder, heading, listed):
        self.text, self.words, self.linked = text, len(text.split()), linked
        self.article, self.sure, self.holder, self.heading, self.listed = article, sure, holder, heading, listed
        self.named = False

    @property
    def density(self) -> float:
        return min(1.0, self.linked / self.words) if self.words else 0.0


#: What the tree looks at, in order; a block without a neighbour has -1 there.
FEATURES = ("words", "link density", "words before", "words after", "link density before", "link density after", "article", "element", "name", "heading", "list")


def features(found: list[_Block]) -> list[tuple]:
    """A row of FEATURES for each block of a page."""
    out = []
    for k, b in enumerate(found):
        p, q = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
        side = lambda x: (x.words, x.density) if x is not None else (-1, -1.0)
        (pw, pd), (qw, qd) = side(p), side(q)
        out.append((b.words, b.density, pw, qw, pd, qd, b.article, b.sure, b.named, b.heading, b.listed))
    return out


def _names(rest: str) -> tuple[bool, bool]:
    """Whether a class, id or role as a whole names furniture (words for it, and words for places beside them), and readers' words."""
    found = readers = False
    if "=" in rest:
        for m in _NAMED.finditer(rest):
            for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", html.unescape(m[2] or m[3] or m[4] or "")).lower().split():
                words = set(re.findall(r"[^\W\d_]+", name))
                if words & _FURNITURE_WORDS and words <= _FURNITURE_WORDS | _PLACE_WORDS:
                    found = True
                    readers = readers or bool(words & _READERS)
    return found, readers


def _tokens(page: str):
    """(kind, name or text, attributes): "text", "open" and "close" in page order, without comments and raw elements.

    What is looked for in vain once is not looked for again, and tags whose quotes do not close are retried
    within a bound of the page's length; beyond it a tag ends at the next ">".
    """
    gone: set[str] = set()
    retries = 4 * len(page) + (1 << 16)

    def find(what: str, start: int) -> int:
        k = -1 if what in gone else page.find(what, start)
        if k < 0:
            gone.add(what)
        return k

    def tag_end(start: int) -> int:
        nonlocal retries
        k = start
        while retries > 0:
            m = _STOP.search(page, k)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            k = find(m[1], m.end()) + 1
            if not k:
                k = len(page)
                break
        retries -= k - start
        return find(">", start)

    at = begin = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        m = _NAME.match(page, lt + 1)
        if m is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            at = lt + 1  # a sign like any other
            continue
        if lt > begin:
            yield "text", page[begin:lt], ""
        if m is None:
            mark = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = find(mark, lt + 2)
            if end < 0 and mark == "]]>":
                mark, end = ">", find(">", lt + 2)
            at = begin = end + len(mark) if end >= 0 else len(page)
            continue
        end = tag_end(m.end())
        if end < 0:
            begin = len(page)  # a tag that the page ends in
            break
        name, at = m[1].lower(), end + 1
        begin = at
        if page[lt + 1] == "/":
            yield "close", name, ""
            continue
        if name in _RAW:
            close = None if f"</{name}" in gone else _CLOSE[name].search(page, at)
            if close is not None:
                end = find(">", close.end())
                at = begin = end + 1 if end >= 0 else len(page)
            else:
                gone.add(f"</{name}")
                if name in _TO_THE_END:
                    begin = len(page)
                    break
            continue
        yield "open", name, page[m.end() : end]
    if begin < len(page):
        yield "text", page[begin:], ""


_NOWHERE = ("", False, False, None)


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page in page order, empty ones left out."""
    out: list[_Block] = []
    # open elements: name, in an article, in an element of furniture, the nearest element that may be furniture
    stack: list[tuple[str, bool, bool, _Holder | None]] = []
    opened: Counter[str] = Counter()
    holders: list[_Holder] = []
    parts: list[str] = []
    linked, link, head = 0, 0, False
    articles = found_main = False  # whether an article that no name says to be furniture has begun; or any holder of the page's text

    def close():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            name, article, sure, holder = stack[-1] if stack else _NOWHERE
            out.append(_Block(text, linked, article, sure, holder, name in _HEADINGS, name in _LISTED))
            if holder is not None:
                holder.words += out[-1].words
        parts, linked = [], 0

    for kind, name, rest in _tokens(page):
        if kind == "text":
            if not head:
                parts.append(name)
                if link:
                    linked += len(name.split())
            continue
        if name == "head":
            head = kind == "open"
            continue
        if name == "body":
            head = False
        if name == "br":
            parts.append(" ")
            continue
        if name not in _BLOCKS:
            if name == "a":
                link = int(kind == "open")
            continue
        head = False
        close()
        link = 0
        if kind == "close":
            if opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            continue
        if name in _VOID:
            continue
        while stack and name in _IMPLIED.get(stack[-1][0], ()):
            opened[stack.pop()[0]] -= 1
        _, article, sure, holder = stack[-1] if stack else _NOWHERE
        named, readers = _names(rest)
        if name in ("article", "main"):
            if name == "main" or not named and not articles:
                up = holder
                while up is not None and not up.released:  # what holds the page's text is no furniture, whatever its name
                    up.released = True
                    up = up.parent
                found_main = True
            articles = articles or name == "article" and not named
            article = True
        elif name in _FURNITURE:
            sure = True
        elif named or name in _HOLDERS and not (name == "header" and article):
            holder = _Holder(holder, readers)
            holders.append(holder)
        stack.append((name, article, sure, holder))
        opened[name] += 1
    close()
    total = sum(b.words for b in out if not b.sure)
    for h in reversed(holders):
        if h.parent is not None:
            h.parent.words += h.words
    for h in holders:  # on a page without an article, what holds most of its text is no furniture either
        whole = not found_main and not h.readers and 2 * h.words > total
        h.own = not (h.released or whole) or (h.parent is not None and h.parent.own)
    for b in out:
        b.named = b.holder is not None and b.holder.own
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: its main blocks, joined by newlines."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found)) if classify(row))


def extract_html(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    A null or empty page, or one without main text, gives an empty text; null ids and urls are carried;
    repeated rows are kept; other columns are not read; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
