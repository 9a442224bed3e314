"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Element names of HTML by their use here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVE = frozenset("aside button canvas dialog fieldset footer form head input menu nav object option select svg".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that begin or end the class or id of what isn't the article.
AWAY = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer "
    "disqus discussion gdpr menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promotion related replies reply response responses share sharing sidebar social sponsor sponsored subscribe subscription toolbar tooltip topbar widget widgets".split()
)
#: Of these, words of readers' comments, which can be longer than the article.
READERS = frozenset("comment comments disqus discussion replies reply response responses".split())
#: Words beside these that leave a class or id one of the readers' blocks; `comments-open` or `no-comments` say something else.
BESIDE = frozenset("a all area article block blog body box child container content depth entry even group item items latest list new odd old page parent post row section site thread threads top tree user users visitor wrap wrapper".split())
#: Words that a section of an article can have as well.
SECTIONS = frozenset("discussion response responses".split())
#: Beginnings of class names that say what an element has or lacks, not what it is.
STATES = ("has-", "no-", "not-", "with-", "without-", "is-", "has_", "no_", "with_")
ALIKE = frozenset("article body content entry main page post story text".split())
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
CLOSES_ITSELF = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
SCOPE = frozenset("html table ul ol dl select".split())
#: Points of an element before any text counts.
START = {"article": 30, "main": 20, "div": 5, "section": 3, "td": 3, "pre": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
#: Ancestors that a paragraph's points reach; farther ones would get next to nothing.
LEVELS = 12


class _Node:
    __slots__ = ("tag", "parent", "hard", "soft", "names", "points", "chars", "linked", "holds", "out", "branch")

    def __init__(self, tag: str, parent: _Node | None, hard: bool, soft: frozenset[str], names: frozenset[str]):
        self.tag, self.parent, self.hard, self.soft, self.names = tag, parent, hard, soft, names
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.holds, self.out = int(tag in ("article", "main") and not hard), False
        self.branch: _Node | None = None


def _is_hard(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element can't be part of an article by its tag, role or style; inside: it stands in an article."""
    if tag in LEAVE or tag == "header" and not inside:
        return True
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))


def _named(attributes: dict[str, str], inside: bool) -> tuple[frozenset[str], frozenset[str], bool]:
    """Words of an element's classes and id, those of AWAY that begin or end one of them, and whether it is the readers'.

    inside: the element stands in an article, where sections may have some of the readers' words.
    """
    names, away, readers = set(), set(), False
    for one in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [x.lower() for x in WORDS.findall(one)]
        if parts and not one.lower().startswith(STATES):
            names.update(parts)
            away.update(AWAY.intersection((parts[0], parts[-1])) - (SECTIONS if inside else frozenset()))
            own = READERS.intersection(parts) - (SECTIONS if inside else frozenset())
            readers |= bool(own) and all(p in READERS or p in BESIDE or p.isdigit() for p in parts)
            if "header" in (parts[0], parts[-1]) and not ALIKE.intersection(parts):
                away.add("header")
    return frozenset(names), frozenset(away), readers


class _Page:
    """A page's tree, built in one pass. Places of open elements are kept by tag, so nothing is looked for in the stack."""

    def __init__(self, page: str):
        self.root = _Node("#root", None, False, frozenset(), frozenset())
        self.nodes, self.stack = [self.root], [self.root]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self.blocks, self.walls = [0], []  # of block elements, and of those that stop or are a paragraph
        self.found: list[tuple[_Node, str]] = []  # (innermost block element, text) in page order
        self.held: list[str] = []
        self.linked = 0
        self._read(page)

    def _flush(self) -> None:
        if self.held:
            if text := " ".join(html.unescape("".join(self.held)).split()):
                node = self.stack[self.blocks[-1]]
                self.found.append((node, text))
                node.chars += len(text)
                node.linked += min(self.linked, len(text))
            self.held.clear()
        self.linked = 0

    def _close(self, k: int) -> None:
        if any(x.tag in BLOCK or x.hard or x.soft for x in self.stack[k:]):
            self._flush()
        while len(self.stack) > k:
            node = self.stack.pop()
            self.open[node.tag].pop()
            for places in (self.blocks, self.walls):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def _end(self, tag: str) -> None:
        k = self._last((tag,))
        if tag in BLOCK or tag in ("td", "th"):
            if k:
                self._close(k)
            elif tag == "p":
                self._flush()
        elif k > self.blocks[-1]:
            self._close(k)
        if tag in ("td", "th"):
            self.held.append(" ")

    def _begin(self, tag: str, raw: str) -> None:
        if tag in BLOCK:
            if self.walls and self.stack[self.walls[-1]].tag == "p":
                self._close(self.walls[-1])
            self._flush()
        if tag in CLOSES_ITSELF:
            while (k := self._last(CLOSES_ITSELF[tag])) > self._last(SCOPE):
                self._close(k)
                if tag != "tr":
                    break
        if tag in VOID:
            return
        attributes: dict[str, str] = {}
        if raw.strip(" /"):
            for name, value in ATTRIBUTE.findall(raw):
                attributes.setdefault(name.lower(), html.unescape(value.strip("\"'")))
        inside = bool(self.open["article"])
        names, away, readers = _named(attributes, inside)
        soft = away if tag not in ("body", "html", "article", "main") and not (tag in HEADINGS and away == {"header"}) else frozenset()
        hard = _is_hard(tag, attributes, inside) or readers and tag not in ("body", "html", "main")
        if hard or soft:
            self._flush()
        if raw.rstrip().endswith("/") and tag not in BLOCK:
            return
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        if tag in ("td", "th"):
            self.held.append(" ")
        if tag in ("p", "table", "td", "th", "button"):
            self.walls.append(len(self.stack))
        self.open[tag].append(len(self.stack))
        self.stack.append(_Node(tag, self.stack[-1], hard, soft, names))
        self.nodes.append(self.stack[-1])

    def _read(self, page: str) -> None:
        at, last = 0, page.rfind(">")
        while at < len(page):
            start = page.find("<", at)
            m = TAG.search(page, start, last + 1) if 0 <= start <= last else None
            if m is None and 0 <= start and (comment := page.find("<!--", max(start, last))) >= 0:
                page = page[:comment]  # an open comment goes to the end
            text = page[at : m.start() if m else len(page)]
            if text:
                self.held.append(text)
                if self.open["a"]:
                    self.linked += len(text)
            if not m:
                break
            at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, last + 1)
                at = end.end() if end else len(page)
            elif tag == "br":
                self.held.append(" ")
            else:
                self._begin(tag, m[3] or m[6] or "")
        self._flush()

    def settle(self) -> None:
        """Sums of the tree, and which elements are out: those that no article holds, and all in them.

        Readers' blocks are out whatever they hold, and count nowhere. An element whose class only looks like a menu, sidebar
        or notice stays if it holds all article and main elements of the page and more than a trifle of its plain text, or
        most of that text where the page has no such element. One that has a readers' word among others must hold both.
        """
        for node in reversed(self.nodes[1:]):
            if not node.hard:
                node.parent.chars += node.chars
                node.parent.linked += node.linked
                node.parent.holds += node.holds
        most = (self.root.chars - self.root.linked) / 2
        for node in self.nodes[1:]:
            plain, all_held = node.chars - node.linked, 0 < self.root.holds == node.holds
            if node.soft & READERS:
                stays = all_held and plain > most
            else:
                stays = all_held and plain > most / 4 or not self.root.holds and plain > most
            node.out = node.parent.out or node.hard or bool(node.soft) and not stays


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, each on one line, joined by an empty line; an empty text if there is none.

    Every block gives points for length and commas to its ancestors, the nearest most. Points are discounted by the share
    of linked text. The container with most points is kept, widened to the article or main element around it, with the
    siblings that read like text. Elements that no article holds (menus, forms, adverts, comments, hidden parts and so
    on) are left out everywhere. A null or empty page, one without tags and a broken one are read like any other; time
    and memory grow with the length of the page, however deep or broken it is.
    """
    tree = _Page(page or "")
    tree.settle()
    found = [(node, text) for node, text in tree.found if not node.out]
    if not found:
        return ""
    scored: dict[int, _Node] = {}
    for node, text in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        # a paragraph's points go to the elements around it; text that stands in a container directly counts there
        up = node.parent if node.tag in ("p", "pre", "blockquote", "li", "tr", *HEADINGS) and node.parent is not None else node
        level = 0
        while up is not None and level < LEVELS:
            if id(up) not in scored:
                scored[id(up)] = up
                up.points = START.get(up.tag, 0) + (15 if up.names & ALIKE else 0)
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    density = lambda n: n.linked / n.chars if n.chars else 0
    worth = lambda n: n.points * (1 - density(n))
    best = max(scored.values(), key=worth)
    above = []
    up: _Node | None = best
    while up is not None:
        above.append(up)
        up = up.parent
    wider = next((x for tag in ("article", "main") for x in above if x.tag == tag), None)
    kept = {id(wider or best)}
    if wider is None:
        for node in tree.nodes[1:]:
            node.branch = node if node.parent is best.parent else node.parent.branch
        least = max(10, 0.2 * worth(best))
        for node, text in found:
            own = node.branch
            if own is None or own is best or id(own) in kept:
                continue
            reads = own.tag in ("p", *HEADINGS) and (density(own) < 0.25 and len(text) > 80 or density(own) == 0 and (own.tag in HEADINGS or re.search(r"[.!?]\s*$", text)))
            if worth(own) >= least and id(own) in scored or reads:
                kept.add(id(own))
    inside: set[int] = set()
    for node in tree.nodes:
        if id(node) in kept or node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    return "\n\n".join([text for node, text in found if id(node) in inside])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). See main_text; a null page counts as empty.

    The whole page is read, and every row stands alone: nothing is shuffled. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls in slices(batches, 64):
            texts = [main_text(h) for h in htmls]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
