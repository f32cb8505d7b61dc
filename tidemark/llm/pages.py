"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; block tags cut the stream into lines. Each
line has a ratio of text to tags. The ratios are smoothed by a Gaussian over neighbouring
lines, and a threshold between two clusters of them parts content from clutter. The
content lines decide which regions are taken: the articles most of whose text is content, or
else the smallest container with all content. Inside a region every line counts, however
short, but for elements whose tag or role, or whose class names and density, say what they
are; such elements are dropped where they stand, in the middle of a line too. Text around a
region that is no article stays unless it is links.

Elements are numbered as they open, so an element holds the numbers up to its last one, and
sums over elements are taken from the last to the first: a page costs what its length is.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.lineage import small_batches
from tidemark.llm.wordcache import tidy

SIGMA = 1.5
#: Least part of the usual ratio that text with a name of clutter must have to count as an article's text.
NEAR = 0.85
#: Tags that never hold main text, block tags, and tags without an end.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea title head".split())
CLUTTER = frozenset("nav header footer aside menu dialog button label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main body div section td html table center blockquote form".split())
#: Blocks whose text belongs to the page's text wherever it is not flagged.
TEXTS = HEADINGS | frozenset("p li dt dd pre blockquote figcaption caption td th summary".split())
#: What a new block of a kind ends besides an open paragraph.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: Words of class and id, and roles, that say what an element is.
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup paywall nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside related recommended recommendations widget share sharing social comment comments commentlist disqus respond replies reply reviews discussion footer header masthead toolbar pagination pager tags skip search login form".split()
)
#: Of these the words for what readers write; it is as dense as prose, so the name alone decides. A discussion is theirs as a class, but may be an article's section as an id.
READERS, READERS_CLASS = frozenset("comment comments commentlist disqus respond replies reply".split()), frozenset({"discussion"})
#: The mark of a name with one of these words.
BY_READERS = "by readers"
#: Words that may stand beside those in one name without changing what it says.
PLAIN = frozenset(
    "area article articles aux bar block blog body bottom box btn button buttons col column container content entry full global icon icons inner item items left link links list main mobile module outer page pages panel post posts primary right row secondary section site slot small sticky sub tag tags text title top user wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: The only tags that a head holds; any other ends it.
HEADS = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
WHOLE = frozenset({"html", "body", "article", "main"})


@dataclass
class Line:
    """The text of one line that one element flagged as clutter, or none, is around."""

    number: int
    node: int
    text: str
    tags: int
    linked: int
    block: str
    heading: bool


def named(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """The words of class and id that name clutter.

    A name counts only as a whole: each of its words names clutter or says nothing, so
    "cookie-notice" and "share-buttons" do, "side-by-side" and "has-sidebar" do not. A
    heading's id is made of its own text.
    """
    found: set[str] = set()
    for key, value in attrs:
        if value and (key == "class" or key == "id" and tag not in HEADINGS):
            for name in value.split():
                words = {w.lower() for w in PARTS.findall(name)}
                if all(w in NAMES or w in PLAIN or w.isdigit() for w in words):
                    found |= words & NAMES
                    if words & READERS or key == "class" and words & READERS_CLASS:
                        found.add(BY_READERS)
    return found


def is_clutter(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a tag, a role or being hidden says that an element is clutter, whatever it holds."""
    if tag in CLUTTER:
        return True
    if tag in WHOLE:
        return False
    for key, value in attrs:
        if key == "role" and value and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class Page(HTMLParser):
    """The lines of a page and the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: The text that the last end of a comment was looked for in, and where that is.
        self.ends_in, self.last_end = "", -1
        #: Of each element: tag, parent, last element inside, clutter around (1 headers only, 2 other), innermost flagged element.
        self.tag, self.parent, self.last, self.clutter, self.owner = ["page"], [0], [0], [0], [-1]
        #: Innermost container, whether an article or a main, whether inside an article, inside either, and names of clutter.
        self.home, self.is_article, self.in_article, self.in_region, self.flag = [0], [False], [False], [False], [None]
        self.open: list[int] = [0]
        self.blocks: list[int] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.silent = self.links = self.tags = self.number = 0
        self.block = ""
        self.lines: list[Line] = []
        #: The current line's text by flagged element, in order, and per such element where it is and its link characters.
        self.pieces: list[tuple[int, str]] = []
        self.spots: dict[int, list[int]] = {}
        #: Of each line the order of its pieces, as (element, text).
        self.orders: list[list[tuple[int, str]]] = []

    def cut(self) -> None:
        if self.pieces:
            texts: dict[int, list[str]] = {}
            for owner, text in self.pieces:
                texts.setdefault(owner, []).append(text)
            whole = {o: " ".join("".join(t).split()) for o, t in texts.items()}
            if any(whole.values()):
                heading = self.block in HEADINGS
                first = True
                for owner, text in whole.items():
                    if text:
                        node, linked = self.spots[owner]
                        self.lines.append(Line(len(self.orders), node, text, max(1, self.tags) if first else 1, linked, self.block, heading and self.in_region[node]))
                        first = False
                self.orders.append(self.pieces)
            self.pieces, self.spots = [], {}
        self.tags, self.block = 0, ""

    def enter(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        up, node = self.open[-1], len(self.tag)
        clutter = is_clutter(tag, attrs)
        names = {"form"} if tag == "form" else named(tag, attrs) if attrs and not clutter and tag not in {"html", "body", "main"} and not (tag in HEADINGS and self.in_region[up]) else None
        article = tag in {"article", "main"} or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs
        self.tag.append(tag)
        self.parent.append(up)
        self.last.append(node)
        self.clutter.append(max(self.clutter[up], (1 if tag == "header" else 2) if clutter else 0))
        self.owner.append(node if clutter or names else self.owner[up])
        self.home.append(node if tag in CONTAINERS or article else self.home[up])
        self.is_article.append(article)
        self.in_article.append(self.in_article[up] or tag == "article")
        self.in_region.append(self.in_region[up] or tag in {"article", "main"})
        self.flag.append(names or None)
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(node)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def leave(self, at: int) -> None:
        """Close the elements from a place of the stack on."""
        end = len(self.tag) - 1
        for node in reversed(self.open[at:]):
            tag = self.tag[node]
            self.last[node] = end
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[at:]

    def end_head(self) -> None:
        if self.places["head"]:
            self.leave(self.places["head"][0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        top = self.tag[self.open[-1]]
        if tag not in HEADS and (tag == "body" or top == "head" or top == "title" and tag in BLOCKS):
            self.end_head()
        if tag in BLOCKS:
            self.cut()
            # A new block ends an open paragraph, and a new item the one before it.
            while self.blocks and ((inner := self.tag[self.open[self.blocks[-1]]]) == "p" or inner in ENDS.get(tag, ())):
                self.leave(self.blocks[-1])
            self.block, self.tags = tag, 1
        elif tag == "br":
            self.handle_data(" ")
        if tag not in VOID:
            self.enter(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        at = self.places[tag][-1] if self.places[tag] else None
        # The end of an inline element does not reach over a block.
        if at is not None and (tag in BLOCKS or not self.blocks or self.blocks[-1] < at):
            self.leave(at)

    def handle_data(self, data: str) -> None:
        if self.tag[self.open[-1]] == "head" and data.strip():
            self.end_head()
        if not self.silent:
            node = self.open[-1]
            owner = self.owner[node]
            self.pieces.append((owner, data))
            spot = self.spots.setdefault(owner, [node, 0])
            spot[0] = node
            if self.links:
                spot[1] += len(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without an end takes the rest of the page; the end is looked for once, not again at each."""
        if self.ends_in is not self.rawdata:
            self.ends_in, self.last_end = self.rawdata, max(self.rawdata.rfind("-->"), self.rawdata.rfind("--!>"))
        return super().parse_comment(i, report) if i < self.last_end else len(self.rawdata)

    def close_all(self) -> None:
        self.close()
        self.cut()
        self.leave(1)
        self.last[0] = len(self.tag) - 1

    def holds(self, node: int, line: Line) -> bool:
        return node <= line.node <= self.last[node]

    def sums(self, *values: list[float]) -> list[list[float]]:
        """For each measure of lines its sum over all lines inside each element."""
        out = []
        for value in values:
            total = [0] * len(self.tag)
            for line, x in zip(self.lines, value, strict=True):
                total[line.node] += x
            for node in range(len(total) - 1, 0, -1):
                total[self.parent[node]] += total[node]
            out.append(total)
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / total


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of values, by alternating means."""
    low, high = float(values.min()), float(values.max())
    border = (low + high) / 2
    for _ in range(50):
        below, above = values[values < border], values[values >= border]
        if not len(below) or not len(above):
            break
        new = (below.mean() + above.mean()) / 2
        if abs(new - border) < 1e-9:
            break
        border = new
    return border


def is_out(page: Page, line: Line) -> bool:
    """Whether a line is clutter by tag or role; an article's headline counts in its header."""
    clutter = page.clutter[line.node]
    return clutter == 2 or clutter == 1 and not line.heading


def named_clutter(page: Page, ratios: np.ndarray, dense: np.ndarray, marks: np.ndarray) -> set[int]:
    """The elements with a name of clutter that are clutter by density too.

    What readers wrote is, wherever it stands and however long, if any content is without it.
    Of the rest none that holds most content or the page's article; of sections inside an article or a
    main only those of links, of other elements inside an article only those without most of
    their text dense or with a ratio below that of the page's other content. Elsewhere the name decides between short and long, as of comments; so
    it does for forms everywhere, and for articles that what has no flag outweighs.
    """
    flagged = [n for n, names in enumerate(page.flag) if names]
    if not flagged:
        return set()
    plain = [0 if is_out(page, x) else max(0, len(x.text) - x.linked) for x in page.lines]
    size = [0 if is_out(page, x) else len(x.text) for x in page.lines]
    linked = [0 if is_out(page, x) else x.linked for x in page.lines]
    weight = [p if m else 0 for p, m in zip(plain, marks, strict=True)]
    thick = [p if d else 0 for p, d in zip(plain, dense, strict=True)]
    by_ratio = [n * r for n, r in zip(size, ratios.tolist(), strict=True)]
    holds, sizes, links, dense_in, ratio_in = page.sums(weight, size, linked, thick, by_ratio)
    around, by_readers = [False] * len(page.tag), [False] * len(page.tag)
    for node in range(1, len(around)):
        around[node] = around[page.parent[node]] or bool(page.flag[node])
        by_readers[node] = by_readers[page.parent[node]] or BY_READERS in (page.flag[node] or ())
    if not any(w and not by_readers[x.node] for x, w in zip(page.lines, weight, strict=True)):
        by_readers = [False] * len(page.tag)
    free = sum(w for x, w in zip(page.lines, weight, strict=True) if not around[x.node])
    # The mean ratio of content that has no flag, by its characters.
    usual = sum(w * r for x, w, r in zip(page.lines, weight, ratios.tolist(), strict=True) if not around[x.node]) / max(1, free)
    # An article that is named as a comment or a teaser itself stands for the page only if it outweighs what has no flag.
    articles = [n for n, a in enumerate(page.is_article) if a and sizes[n] and not by_readers[n] and (not page.flag[n] or holds[n] >= free)]
    kept = set()
    if articles:
        node = max(articles, key=lambda n: (holds[n], sizes[n], -n))
        while node:
            kept.add(node)
            node = page.parent[node]
    out = set()
    for f in flagged:
        if f not in kept and by_readers[f]:
            out.add(f)
            continue
        if f in kept or 2 * holds[f] > holds[0]:
            continue
        if page.tag[f] == "form":
            clutter = True
        elif page.tag[f] == "article":
            clutter = holds[f] < free
        elif page.tag[f] == "section" and page.in_region[page.parent[f]]:
            clutter = 2 * links[f] > sizes[f]
        else:
            clutter = not page.in_article[page.parent[f]] or 2 * dense_in[f] <= sizes[f] or ratio_in[f] < NEAR * usual * sizes[f]
        if clutter:
            out.add(f)
    return out


def unnamed_region(page: Page, lines: list[Line], content: list[bool]) -> list[Line]:
    """The lines of a page that names no article.

    The core is the smallest container with all content, and every line of it counts but for
    containers of nothing but links at its ends. Around it only lines that are mostly links go,
    and loose text without a mark at the page's ends.
    """
    text = [i for i, x in enumerate(lines) if 2 * x.linked <= len(x.text)]
    if not text:
        return list(lines)
    held = [lines[i].node for i in [i for i in text if content[i]] or text]
    low, high = min(held), max(held)
    # The containers around all content, from the innermost.
    shared, node = [], page.home[low]
    while node:
        if page.last[node] >= high and page.tag[node] not in {"body", "html"}:
            shared.append(node)
        node = page.home[page.parent[node]]
    inside = {i for i, x in enumerate(lines) if shared and page.holds(shared[0], x) and (text[0] <= i <= text[-1] or page.home[x.node] == shared[0])}
    around = inside.union(text)
    firm = [i for i in around if i in inside or content[i] or lines[i].block in TEXTS or shared and page.holds(shared[-1], lines[i])]
    first, last = (min(firm), max(firm)) if firm else (0, len(lines))
    return [lines[i] for i in sorted(around) if first <= i <= last]


def articles_of(page: Page, lines: list[Line], content: list[bool]) -> list[int]:
    """The articles that are the page's text: the heaviest one, and others most of whose text is content.

    Of articles within each other the outermost with the most content stands for both.
    """
    weight, size = [0] * len(page.tag), [0] * len(page.tag)
    for x, is_content in zip(lines, content, strict=True):
        weight[x.node] += max(0, len(x.text) - x.linked) if is_content else 0
        size[x.node] += len(x.text)
    for node in range(len(weight) - 1, 0, -1):
        weight[page.parent[node]] += weight[node]
        size[page.parent[node]] += size[node]
    found = [n for n, a in enumerate(page.is_article) if a and size[n]]
    if not found:
        return []
    heaviest = max(found, key=lambda n: (weight[n], size[n], -n))
    taken, reach = [heaviest], 0
    for n in found:
        apart = n > reach and not (n <= heaviest <= page.last[n] or heaviest <= n <= page.last[heaviest])
        if apart and 2 * weight[n] >= size[n]:
            taken.append(n)
            reach = page.last[n]
    return taken


def main_text(html: str) -> str:
    """The regions' lines, white space inside each made one blank, joined by line feeds."""
    page = Page()
    page.feed(html)
    page.close_all()
    if all(is_out(page, x) for x in page.lines):
        return ""
    ratios = np.array([math.log1p(max(0, len(x.text) - x.linked) / x.tags) for x in page.lines])
    # Parts of a line inside an element of their own are judged by themselves.
    whole = np.array([i == 0 or x.number != page.lines[i - 1].number for i, x in enumerate(page.lines)])
    smooth = ratios.copy()
    smooth[whole] = smoothed(ratios[whole])
    # A line is content by its neighbourhood, or by itself where that is thin.
    dense = ratios >= threshold(ratios)
    marks = (smooth >= threshold(smooth[whole])) | dense
    out = named_clutter(page, ratios, dense, marks)
    # Around each element: 1 if only headers that are no part of the text, 2 if other such elements.
    dropped = [0] * len(page.tag)
    for node in range(1, len(dropped)):
        dropped[node] = max(dropped[page.parent[node]], 0 if node not in out else 1 if page.flag[node] == {"header"} else 2)
    stays = [not is_out(page, x) and (dropped[x.node] == 0 or dropped[x.node] == 1 and x.heading) for x in page.lines]
    lines = [x for x, s in zip(page.lines, stays, strict=True) if s]
    if not lines:
        return ""
    content = [bool(m) for m, s in zip(marks, stays, strict=True) if s]
    if regions := set(articles_of(page, lines, content)):
        inside = [False] * len(page.tag)
        for node in range(1, len(inside)):
            inside[node] = node in regions or inside[page.parent[node]]
        taken = [x for x in lines if inside[x.node]]
    else:
        taken = unnamed_region(page, lines, content)
    kept: dict[int, set[int]] = {}
    for x in taken:
        kept.setdefault(x.number, set()).add(page.owner[x.node])
    texts = (" ".join("".join(t for o, t in page.orders[number] if o in owners).split()) for number, owners in kept.items())
    return "\n".join(t for t in texts if t)


def extract_main_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, url, main text and its number of code points.

    Null or empty html, and pages without main text, give an empty text. Repeated rows
    give repeated rows; other columns are not read.
    """
    small_batches(pages.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
