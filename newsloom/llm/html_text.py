"""Main text of HTML pages by a tree-structured graphical model.

Every block element of a page, and every inline one with a class or id, is a node
that is content or not. What a node looks like (tag, words of class and id, how
much text and link text it holds) gives its own potential; the tag of a child and
the two labels give the potential of each parent-child edge. Both are counted on
labelled pages. Messages go up the tree and down again, and each node's marginal
decides on the text that it holds directly.

The labelled pages are laid out by :func:`labelled_pages` from lists of element
names, each part with its label; no model comes from outside.

Cases: null or empty html gives an empty text; unclosed and stray tags are closed
or ignored as browsers do; scripts, styles, comments and the head never hold
text; pages of any length and depth are read whole; other columns are not read.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newsloom.llm.common import add_columns, fresh, table

#: A comment, declaration, or tag. Attribute values that are quoted directly after ``=`` may hold ``>``.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)>", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

# How HTML elements behave.
HIDDEN = {"script", "style", "template", "noscript", "svg", "iframe", "object", "math", "title", "head"}
RAW = {"script", "style", "noscript", "iframe", "title"}
#: Foreign elements, which ``/>`` closes, and the HTML elements that end them if they are open.
FOREIGN = {"svg", "math"}
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre"
    " ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Where HTML is at home within foreign elements.
INTEGRATION = {"foreignobject", "desc", "title", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
#: What a head may hold; any other element closes it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "noframes", "template", "head", "html"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section select"
    " summary table tbody td textarea tfoot th thead tr ul label".split()
)
CLOSES_P = BLOCKS - {"html", "body", "button", "option", "select", "td", "th", "tr", "tbody", "tfoot", "thead", "caption", "label", "legend", "textarea"}
#: What is in these ends nothing around them.
INERT = {"template", "object"}
#: What a new element ends if it is open, and where the search for it stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", *INERT}),
    "dt": ({"dt", "dd"}, {"dl", *INERT}),
    "dd": ({"dt", "dd"}, {"dl", *INERT}),
    "tr": ({"tr", "td", "th"}, {"table", *INERT}),
    "td": ({"td", "th"}, {"tr", "table", *INERT}),
    "th": ({"td", "th"}, {"tr", "table", *INERT}),
    "option": ({"option"}, {"select", *INERT}),
}


class Page:
    """The nodes of a page and its blocks of text, each piece with the node that holds it."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words = ["html"], [-1], [()]
        self.text_size, self.link_size = [0], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._read(source)

    def _open(self, tag: str, parent: int, words: tuple[str, ...]) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text_size.append(0)
        self.link_size.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements and the node at each
        block: list[tuple[int, str]] = []
        node, links, hidden, foreign, place = 0, 0, 0, 0, 0
        lower = None
        objects_end = -1  # where the last object ends

        def close(to: int) -> None:
            nonlocal links, hidden, foreign
            for name, _ in stack[to:]:
                foreign -= name in FOREIGN
                links -= name == "a"
                hidden -= name in HIDDEN
            del stack[to:]

        def find(names: set[str], stops: set[str]) -> int:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in stops:
                    break
            return -1

        def lowered() -> str:
            nonlocal lower
            lower = source.lower() if lower is None else lower
            if len(lower) != size:  # some letters change their number in lower case
                lower = re.sub("[A-Z]", lambda m: m[0].lower(), source)
            return lower

        size = len(source)
        while place <= size:
            found = _MARKUP.search(source, place)
            end = found.start() if found else size
            if stack and stack[-1][0] == "head" and not source[place:end].isspace() and end > place:
                close(len(stack) - 1)
            if end > place and not hidden:
                text = html.unescape(source[place:end])
                block.append((node, text))
                n = len(text.strip())
                self.text_size[node] += n
                self.link_size[node] += n if links else 0
            if not found:
                break
            place = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCKS or tag in ("br", "hr"):
                if block:
                    self.blocks.append(block)
                    block = []
            if found[1]:
                i = find({tag}, {"template"})
                if i >= 0:
                    close(i)
                    node = stack[-1][1] if stack else 0
                continue
            if tag not in HEAD and stack and stack[-1][0] == "head":
                close(len(stack) - 1)
            while foreign and tag in BREAKOUT and (i := find(FOREIGN, INTEGRATION | INERT)) >= 0:
                close(i)
            if tag in VOID or (foreign or tag in FOREIGN) and found[3].endswith("/"):
                continue
            if tag == "object":
                objects_end = lowered().rfind("</object") if objects_end < 0 else objects_end
                if objects_end < place:  # never closed: it hides nothing
                    continue
            if tag in CLOSES_P and (i := find({"p"}, {"button", "table", "td", "th", *INERT})) >= 0:
                close(i)
            if tag in SIBLINGS and (i := find(*SIBLINGS[tag])) >= 0:
                close(i)
            node = stack[-1][1] if stack else 0
            if tag in RAW:
                stop = lowered().find("</" + tag, place)
                place = size if stop < 0 else stop
                if stop < 0:
                    break
            words: tuple[str, ...] = ()
            if found[3]:
                named = " ".join(" ".join(x for x in m[1:] if x) for m in _ATTRIBUTE.findall(found[3]))
                words = tuple(dict.fromkeys(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())))
            if not hidden and (tag in BLOCKS and tag not in ("html",) or words and tag not in HIDDEN):
                node = self._open(tag, node, words)
            stack.append((tag, node))
            links += tag == "a"
            hidden += tag in HIDDEN
            foreign += tag in FOREIGN
        if block:
            self.blocks.append(block)

    def looks(self) -> list[tuple[str, ...]]:
        """What can be seen of each node by itself."""
        out = []
        for tag, words, size, linked in zip(self.tag, self.words, self.text_size, self.link_size, strict=True):
            amount = 0 if not size else 1 if size < 25 else 2 if size < 100 else 3
            share = 0 if not size else 0 if linked * 5 < size else 2 if linked * 2 > size else 1
            out.append((f"<{tag}>", f"text{amount}", f"link{share}", *words))
        return out


class TreeModel:
    """Potentials of nodes and edges, counted on labelled pages."""

    def __init__(self, pages: list[tuple[Page, list[int]]]):
        seen: dict[str, list[float]] = {}
        edges: dict[str, list[list[float]]] = {}
        labels = [1.0, 1.0]
        for page, truth in pages:
            for node, (look, y) in enumerate(zip(page.looks(), truth, strict=True)):
                labels[y] += 1
                for word in look:
                    seen.setdefault(word, [0.5, 0.5])[y] += 1
                if page.parent[node] >= 0:
                    table_ = edges.setdefault(page.tag[node], [[0.5, 0.5], [0.5, 0.5]])
                    table_[truth[page.parent[node]]][y] += 1
        total = [sum(t[p][y] for t in edges.values()) for p in (0, 1) for y in (0, 1)]
        self.prior = math.log(labels[1] / labels[0])
        self.weight = {w: math.log(one / labels[1]) - math.log(zero / labels[0]) for w, (zero, one) in seen.items()}
        share = lambda t: [[v / sum(row) for v in row] for row in t]
        self.edge = {tag: share(t) for tag, t in edges.items()}
        self.other = share([total[:2], total[2:]])

    def own(self, look: tuple[str, ...]) -> float:
        """Log-odds of content from what a node looks like; unknown words say nothing."""
        return sum(self.weight.get(w, 0.0) for w in look)

    def marginals(self, page: Page) -> list[float]:
        """Log-odds of content for every node: messages up, then down."""
        log, exp = math.log, math.exp
        n = len(page.tag)
        belief = [self.own(look) for look in page.looks()]
        table_ = [self.edge.get(tag, self.other) for tag in page.tag]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):  # a parent comes before its children
            e = exp(max(-60.0, min(60.0, belief[i])))
            (aa, ab), (ba, bb) = table_[i]
            up[i] = log((ba + bb * e) / (aa + ab * e))
            belief[page.parent[i]] += up[i]
        belief[0] += self.prior
        for i in range(1, n):
            e = exp(max(-60.0, min(60.0, belief[page.parent[i]] - up[i])))
            (aa, ab), (ba, bb) = table_[i]
            belief[i] += log((ab + bb * e) / (aa + ba * e))
        return belief

    def text(self, source: str) -> str:
        """The content of a page: its blocks in order, white space as one space."""
        page = Page(source)
        content = self.marginals(page)
        blocks = (" ".join("".join([t for node, t in block if content[node] > 0]).split()) for block in page.blocks)
        return " ".join(b for b in blocks if b)


# Names that pages give to their parts.
CONTENT_NAMES = ["content", "post body", "entry content", "article body", "story", "main text", "post content", "article", "blog post", "page content"]
OTHER_NAMES = (
    "ad|ads|advert|advertisement|sponsor|sponsored promo|banner|sidebar|side widget|menu|main menu|navbar nav|navigation|breadcrumb|breadcrumbs"
    "|notice|cookie notice|cookie banner|alert notice|consent|newsletter|newsletter signup|subscribe|share|social share|social links"
    "|related|related posts|recommended|popular|comments|comment list|comment|reader comments|discussion replies|reply|disqus thread"
    "|footer|page footer|site footer|header|site header|masthead|topbar|login|search form|search|popup|modal|tags|pagination|copyright|legal disclaimer|toolbar"
).split("|")
OTHER_TAGS = ["nav", "header", "footer", "aside", "form", "menu", "dialog"]


def labelled_pages(number: int = 400, seed: int = 7) -> list[tuple[Page, list[int]]]:
    """Pages of many layouts with the label of every node; ``number`` bounds the training."""
    rng = random.Random(seed)
    pages = []
    for _ in range(number):
        page = Page("")
        truth = [0]

        def add(tag, parent, label, words=(), size=0, linked=0):
            node = page._open(tag, parent, tuple(words))
            page.text_size[node], page.link_size[node] = size, linked
            truth.append(label)
            return node

        def size():
            return rng.choice([3, 8, 20, 60, 150, 400, 900])

        def other(parent):
            tag, names = rng.choice(["div", "div", "div", "section"]), rng.choice(OTHER_NAMES).split()
            if rng.random() < 0.5:
                tag, names = rng.choice(OTHER_TAGS), names if rng.random() < 0.3 else []
            top = add(tag, parent, 0, names, size() if rng.random() < 0.4 else 0)
            for _ in range(rng.randrange(5)):
                n = size()
                kind = rng.choice(["p", "p", "li", "div", "ul", "h3", "label", "button", "section", "blockquote", "article"] if tag != "nav" else ["li", "ul"])
                add(kind, top, 0, (), n, n if rng.random() < 0.4 else 0)
                if rng.random() < 0.4:
                    add(rng.choice(["p", "li", "div", "h4"]), len(truth) - 1, 0, (), size())

        body = add("body", 0, 0)
        if rng.random() < 0.3:
            body = add("div", body, 0, rng.choice([["page"], ["wrapper"], ["container"], []]))
        for _ in range(rng.randrange(4)):
            other(body)
        if rng.random() < 0.3:
            body = add("main", body, 0 if rng.random() < 0.5 else 1)
        names = rng.choice(CONTENT_NAMES).split()
        if rng.random() < 0.65:
            top = add("article", body, 1, names if rng.random() < 0.3 else [])
        else:
            top = add(rng.choice(["div", "div", "section", "main"]), body, 1, names)
        if rng.random() < 0.25:
            top = add(rng.choice(["div", "section"]), top, 1, rng.choice(CONTENT_NAMES).split() if rng.random() < 0.7 else [])
        if rng.random() < 0.8:
            add("h1", top, 1, (), size())
        for _ in range(rng.randrange(1, 14)):
            kind = rng.choice(["p"] * 10 + ["ul"] * 3 + ["ol"] * 2 + ["h2", "h3", "blockquote", "pre", "figure", "table", "div", "section"])
            n = size()
            node = add(kind, top, 1, (), n if kind in ("p", "h2", "h3", "pre", "div") else 0, n if rng.random() < 0.05 else 0)
            inner = {"ul": "li", "ol": "li", "blockquote": "p", "figure": "figcaption", "table": "tr", "section": "p", "div": "p"}.get(kind)
            for _ in range(rng.randrange(1, 4) if inner else 0):
                child = add(inner, node, 1, (), size() if inner != "tr" else 0)
                if inner == "tr":
                    add("td", child, 1, (), size())
            if rng.random() < 0.06:
                other(top)
        for _ in range(rng.randrange(4)):
            other(body if rng.random() < 0.7 else top)
        pages.append((page, truth))
    return pages


@functools.lru_cache(maxsize=1)
def model() -> TreeModel:
    """The model, trained once per worker; the same everywhere."""
    return TreeModel(labelled_pages())


def main_text(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the source."""

    def make(batch: pa.RecordBatch) -> list:
        tree = model()
        return [[tree.text(v.as_py() or "") for v in batch.column(batch.schema.get_field_index(source))]]

    return add_columns(pages, source, [T.StructField(text, T.StringType())], make, drop_text=True)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = main_text(pages, text=fresh(pages, "text"))
    return made.selectExpr("page_id", "url", "text", "CAST(char_length(text) AS bigint) AS n_chars")
