"""Main text of web pages by tree scoring.

A page is read once, tag by tag, into a tree of elements (implied ends of p, li,
table cells and the like as browsers do it) and its runs of text between block borders.
Elements that cannot be article text are left out: scripts, styles, forms, navigation,
asides, footers, hidden ones, and those whose class or id names them as a menu, notice,
advert, side bar, comment list and the like. Each remaining paragraph of `LEAST` or
more characters has points for itself, its commas and its length, which go to its
next five ancestors, fewer the farther they are; a container's points are discounted by the
share of its text that is link text. The best container is kept, with the article
around it, and so are siblings that are text blocks or have a fifth of its points.
In what is kept, lists of nothing but links are left out as menus, and nothing else.

Pages are rows of their own: one narrow stage, no shuffle; memory is that of a page.

Defined results: null or empty html, or no article text: text '', n_chars 0; a page
that ends early: what is there of it; equal scores: the first container of the page;
repeated rows: one result each; no rows: no rows; further columns are kept by
`extract`, but for `text` and `n_chars`, and ignored by the query.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table, trim

#: Characters of a paragraph that has points.
LEAST = 25
#: Share of the best container's points with which a sibling is kept, link share up to which it is, and that of a menu.
SIBLING, LINKED, MENU = 0.2, 0.5, 0.9
#: Ancestors that have a part of a paragraph's points.
ANCESTORS = 5
#: Points that an element has by its name.
BONUS = {"article": 25, "main": 15, "div": 5, "section": 3, "td": 3, "blockquote": 3, "pre": 3}
COMMAS = re.compile("[,،、，]")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li dd dt td th caption figcaption summary address".split())
#: A start tag ends an open element of these names, up to an element of those.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])), "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])), "a": (frozenset(["a"]), frozenset(["td", "th", "p", "li", "div"])),
}
SCOPE = frozenset("html body table td th caption button object".split())
#: Never article text.
NEVER = frozenset(
    """aside audio button canvas datalist dialog embed footer head iframe input map menu meter nav noscript object progress script search select
    style svg template textarea title video""".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words of a class or id that name what is no article text.
CLUTTER = frozenset(
    """ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie
    cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager
    pagination paywall popup promo promotion recommendations recommended related replies respond share sharing sidebar signup skip social
    sponsor sponsored subscribe subscription toolbar topbar trending widget""".split()
)
#: Before such a word they only say what a page has beside the element.
BESIDE = frozenset("has no not with without".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?P<whole>>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


class Tree:
    """Elements in page order (a parent before its children) and runs of text; None is a block border."""

    def __init__(self, page: str) -> None:
        self.names, self.parents, self.attributes, self.linked = ["html"], [-1], [""], [False]
        self.pieces: list[tuple[int, str] | None] = []
        self.open, self.count = [0], Counter()
        at = 0
        while at < len(page):
            tag = _TAG.search(page, at)
            text = page[at : tag.start()] if tag else page[at:]
            if text:
                self.pieces.append((self.open[-1], text))
            if tag is None:
                break
            at = tag.end()
            if tag["name"] and tag["whole"]:
                name = tag["name"].lower()
                (self.close if tag["end"] else self.start)(name, tag["attributes"])
                if name in RAW and not tag["end"]:
                    end = _RAW_END[name].search(page, at)
                    at = end.start() if end else len(page)

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            self.attributes[0] += attributes
            return
        if name in BLOCKS:
            self.pieces.append(None)
            self.end_open(frozenset(["p"]), SCOPE)
            if name in HEADINGS and self.names[self.open[-1]] in HEADINGS:
                self.end(slice(len(self.open) - 1, None))
        elif name == "br":
            self.pieces.append((self.open[-1], " "))
        if name in IMPLIED:
            self.end_open(*IMPLIED[name])
        if name in VOID:
            return
        parent = self.open[-1]
        self.names.append(name)
        self.parents.append(parent)
        self.attributes.append(attributes.strip())
        self.linked.append(self.linked[parent] or name == "a")
        self.open.append(len(self.names) - 1)
        self.count[name] += 1

    def end(self, which: slice) -> None:
        self.count.subtract(self.names[i] for i in self.open[which])
        del self.open[which]

    def end_open(self, names: frozenset[str], border: frozenset[str]) -> None:
        """End the innermost open element of these names, unless a border is nearer."""
        if not any(self.count[name] for name in names):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.names[self.open[depth]]
            if name in names:
                self.end(slice(depth, None))
                return
            if name in border:
                return

    def close(self, name: str, _: str) -> None:
        if name in BLOCKS:
            self.pieces.append(None)
        if not self.count[name]:
            return
        inside = name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption")
        for depth in range(len(self.open) - 1, 0, -1):
            other = self.names[self.open[depth]]
            if other == name:
                if name in BLOCKS or not any(self.names[o] in BLOCKS for o in self.open[depth + 1 :]):
                    self.end(slice(depth, None))
                else:  # an inline element across blocks: only it ends
                    self.end(slice(depth, depth + 1))
                return
            if not inside and other in ("td", "th", "caption"):
                return


def _clutter(name: str, attributes: str) -> tuple[bool, bool]:
    """(is hidden or has a role beside the article, is named as clutter)."""
    if not attributes:
        return False, False
    hidden = named = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values))
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            hidden = True
        elif key == "style":
            hidden = hidden or "display:none" in value.lower().replace(" ", "")
        elif key in ("class", "id"):
            for label in value.split():
                words = [w.lower() for w in _WORD.findall(label)]
                found = [w for before, w in zip(["", *words], words, strict=False) if w in CLUTTER and before not in BESIDE]
                named = named or any(not (w == "header" and name in HEADINGS) for w in found)
    return hidden, named


def _dropped(tree: Tree, by_name: bool) -> list[bool]:
    """Which elements are left out, with all that is in them."""
    around = [False] * len(tree.names)  # holds the article, or its heading
    for i, name in enumerate(tree.names):
        if name in ("article", "main", "h1"):
            up = tree.parents[i]
            while up >= 0 and not around[up]:
                around[up] = True
                up = tree.parents[up]
    out, within = [False] * len(tree.names), [False] * len(tree.names)
    for i in range(1, len(tree.names)):
        name, parent = tree.names[i], tree.parents[i]
        within[i] = within[parent] or name in ("article", "main")
        hidden, named = _clutter(name, tree.attributes[i])
        gone = name in NEVER or hidden
        if name == "header":  # of an article, its headings stay
            gone = gone or not (within[i] and around[i])
        elif name == "form":
            gone = gone or not around[i]
        elif by_name and named and name not in ("main",):
            gone = gone or not around[i]
        if not gone and name not in HEADINGS and tree.names[parent] == "header" and name in BLOCKS and not around[i]:
            gone = True
        out[i] = out[parent] or gone
    return out


def _runs(tree: Tree, out: list[bool]) -> list[tuple[int, str, int]]:
    """(innermost element around it, text, characters of links) of each run of text between block borders."""
    runs, held = [], []

    def close() -> None:
        if not held:
            return
        text = " ".join("".join(html.unescape(t) for _, t in held).split())
        if text:
            links = sum(len(" ".join(html.unescape(t).split())) for n, t in held if tree.linked[n])
            host = next((n for n, t in held if t.strip()), held[0][0])
            while host > 0 and tree.names[host] not in BLOCKS:
                host = tree.parents[host]
            runs.append((host, text, links))
        held.clear()

    for piece in tree.pieces:
        if piece is None:
            close()
        elif not out[piece[0]]:
            held.append(piece)
    close()
    return runs


def main_text(page: str) -> str:
    """The article's blocks, joined by line feeds."""
    tree = Tree(page)
    for by_name in (True, False):
        out = _dropped(tree, by_name)
        runs = _runs(tree, out)
        if runs:
            return "\n".join(_kept(tree, out, runs))
    return ""


def _kept(tree: Tree, out: list[bool], runs: list[tuple[int, str, int]]) -> list[str]:
    names, parents = tree.names, tree.parents
    count = len(names)
    points, chars, links, entries = [0.0] * count, [0] * count, [0] * count, [0] * count
    for host, text, linked in runs:
        size = len(text)
        chars[host] += size
        links[host] += linked
        worth = 1 + len(COMMAS.findall(text)) + min(size / 100, 3) if size >= LEAST else 0
        up = parents[host] if names[host] in PARAGRAPHS and host else host
        for level in range(ANCESTORS if worth else 0):
            if up < 0:
                break
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = parents[up]
    for i in range(count - 1, 0, -1):  # children come after their parents
        chars[parents[i]] += chars[i]
        links[parents[i]] += links[i]
        entries[parents[i]] += entries[i] + (names[i] == "a" and not out[i])
    share = [min(1.0, links[i] / chars[i]) if chars[i] else 0.0 for i in range(count)]
    score = [(points[i] + (BONUS.get(names[i], 0) if chars[i] else 0)) * (1 - share[i]) if names[i] in BLOCKS and not out[i] else -1.0 for i in range(count)]
    best = max(range(count), key=lambda i: (score[i], -i))
    for around in ("article", "main"):
        up = best
        while up >= 0 and names[up] != around:
            up = parents[up]
        if up >= 0:
            best = up
            break
    kept = [False] * count  # a parent's answer is there before its children's
    for i in range(count):
        sibling = parents[i] == parents[best] and not out[i] and chars[i] > 0 and share[i] < LINKED and (names[i] in TEXT_BLOCKS or score[i] >= max(10.0, SIBLING * score[best]))
        menu = names[i] in ("ul", "ol", "dl", "div", "section", "table") and entries[i] > 1 and share[i] > MENU
        kept[i] = (i == best or sibling or (i > 0 and kept[parents[i]])) and not menu
    return [text for host, text, _ in runs if kept[host]]


def extract(pages: DataFrame) -> DataFrame:
    """All columns of pages but html, and the main text with its number of code points."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column("html")]
            columns = [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])
            trim()

    rows = pages.select(*kept, pages["html"].cast("string").alias("html"))
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema] + ["text string, n_chars long"])
    return rows.mapInArrow(run, shape)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: What the tables of the tests hold: one article element a page, without clutter in it. SQL has no trees; tests on other pages use a brute-force version.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS inside FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(inside, '</?(p|h1)>', chr(1), 'g'), chr(1)) AS parts FROM a),
c AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?[a-z]+[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g'))), lambda x: x <> '') AS texts FROM b)
SELECT page_id, url, coalesce(array_to_string(texts, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(texts, chr(10)), '')) AS BIGINT) AS n_chars FROM c
"""
