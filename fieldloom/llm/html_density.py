"""Main text of web pages by composite text density of their DOM nodes."""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import prepare, slices, with_column

# Element names of HTML by their part in a page, and words that class, id
# and role give to what is mostly not the article; LEFT_OUT and OTHER_PARTS are hints.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("head nav footer aside form button select option dialog menu datalist".split())
#: Of these, elements that are never around a page's text; much text of their own says nothing.
NEVER_AROUND = frozenset("head nav footer button select option datalist".split())
KEPT_WHATEVER = frozenset("html body article main h1 h2 h3 h4 h5 h6 pre code".split())
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
OTHER_PARTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie "
    "cookies consent disqus dropdown footer header masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion recommended related replies reply share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription teaser toolbar widget widgets alert gdpr login search complementary contentinfo".split()
)

#: Words that say how a part is built, not what it is about: "comment-list" is a list of comments, "related-work" no part.
BUILD = frozenset(
    "area bar block body bottom box button buttons col column container content desktop feed form group header holder icon icons inner inline "
    "item items left link links list main mobile outer page panel post posts reader readers right row section site slot stories story tags text "
    "thread top unit user users wrap wrapper zone".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: How sure a hint is: a compound of a part's name and another word is weak.
NO_HINT, WEAK, STRONG = 0, 1, 2


def _hint(name: str, attributes: str, inside_article: bool) -> int:
    """How sure name or attributes are that an element is no part of an article."""
    if name in LEFT_OUT or (name == "header" and not inside_article):
        return STRONG
    if not attributes or name in KEPT_WHATEVER:
        return NO_HINT
    found = NO_HINT
    for match in _ATTRIBUTE.finditer(attributes):
        key, value = (match[1] or "").lower(), (match[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return STRONG
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return STRONG
        elif key in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                if any(w in OTHER_PARTS for w in words):
                    whole = all(w in OTHER_PARTS or w in BUILD for w in words)
                    found = max(found, STRONG if whole and name in BLOCK else WEAK)
    return found


class _Tags:
    """Ends of tags in a page, in time that grows with the page alone.

    A quoted value may hold ">". A tag whose quotes never let it end stops at the first ">"; where such
    a tag has been met, the ends of all further ones are worked out once, from the last to the first.
    """

    def __init__(self, source: str):
        self.source, self.last, self.specials = source, source.rfind(">"), None

    def end(self, at: int) -> int:
        """The place after the ">" that ends the tag whose name stops at ``at``; -1 without any."""
        if at > self.last:
            return -1
        if self.specials is None:
            if found := _REST.match(self.source, at):
                return found.end()
            self._work_out(at)
        k = bisect_left(self.specials, at)
        end = self.ends[k] if k < len(self.ends) else -1
        return end if end >= 0 else self.source.find(">", at) + 1

    def _work_out(self, at: int) -> None:
        source = self.source
        self.specials = [m.start() for m in _SPECIAL.finditer(source, at)]
        self.ends, following = [-1] * len(self.specials), {}
        for k in range(len(self.specials) - 1, -1, -1):
            char = source[self.specials[k]]
            if char == ">":
                self.ends[k] = self.specials[k] + 1
            else:
                closing = following.get(char)
                self.ends[k] = self.ends[closing + 1] if closing is not None and closing + 1 < len(self.ends) else -1
                following[char] = k


class Page:
    """The nodes of a page that may hold its article, in document order.

    ``events`` are (node, text) in page order; a text of None ends a block.
    """

    def __init__(self, source: str):
        self.names, self.parents, self.events = ["#page"], [-1], []
        self.links, self.hints = [False], [NO_HINT]
        #: Depths of the open nodes of each name, and of those that are blocks, from the outside in.
        self.depths, self.blocks = defaultdict(list), []
        self._read(source)
        self._leave_out()

    def _read(self, source: str) -> None:
        open_nodes, at, end, begin = [0], 0, len(source), 0
        tags = _Tags(source)
        while True:
            at = source.find("<", at)
            if at < 0 or at > tags.last and not source.startswith("<!--", at) and not source.startswith("<![CDATA[", at):
                at = end
            name, closing, attributes, stop = "", False, "", -1
            if at < end:
                closing = source.startswith("/", at + 1)
                if source.startswith("<!--", at):
                    stop = self._after(source, "-->", at + 4)
                elif source.startswith("<![CDATA[", at):
                    stop = self._after(source, "]]>", at + 9)
                elif source.startswith(("!", "?"), at + 1):
                    stop = source.find(">", at) + 1
                elif found := _NAME.match(source, at + 1 + closing):
                    name = found[0].lower()
                    stop = tags.end(found.end())
                    attributes = source[found.end() : stop - 1]
                else:
                    at += 1
                    continue
            if at > begin:
                self.events.append((open_nodes[-1], entities.unescape(source[begin:at])))
            if at >= end:
                break
            if source.startswith("<![CDATA[", at):
                self.events.append((open_nodes[-1], source[at + 9 : stop].removesuffix("]]>")))
            at = begin = stop
            if not name:
                continue
            if closing:
                self._close(open_nodes, name)
                continue
            if name in RAW and not attributes.endswith("/"):
                ending = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = begin = ending.end() if ending else end
                continue
            if name in VOID:
                self.events.append((open_nodes[-1], None if name == "hr" else " " if name == "br" else ""))
                if name == "hr":
                    self._end_paragraph(open_nodes)
                continue
            if self.names[open_nodes[-1]] == "head":
                self._pop_to(open_nodes, len(open_nodes) - 1)
            if name in BLOCK:
                self._end_paragraph(open_nodes)
                if name in CLOSES:
                    self._imply_end(open_nodes, *CLOSES[name])
            hint = _hint(name, attributes, bool(self.depths["article"] or self.depths["main"]))
            if hint == STRONG and attributes.endswith("/"):
                self.events.append((open_nodes[-1], None))
                continue
            node = len(self.names)
            self.names.append(name)
            self.parents.append(open_nodes[-1])
            self.links.append(name == "a" or self.links[open_nodes[-1]])
            self.hints.append(hint)
            if hint == STRONG or name in BLOCK:
                self.events.append((node, None))
            self.depths[name].append(len(open_nodes))
            if name in BLOCK:
                self.blocks.append(len(open_nodes))
            open_nodes.append(node)

    @staticmethod
    def _after(source: str, mark: str, at: int) -> int:
        found = source.find(mark, at)
        return len(source) if found < 0 else found + len(mark)

    def _left(self, stays: list[bool]) -> list[bool]:
        """Which nodes are left if elements that do not stay go with all inside."""
        left = [True] * len(stays)
        for node in range(1, len(stays)):
            left[node] = stays[node] and left[self.parents[node]]
        return left

    def _believed(self, plain: list[int], whole: list[int]) -> list[bool]:
        """Which hints count. Inside a line of text none does; a weak one needs text that is mostly links, or none."""
        n = len(self.names)
        block = [0] * n
        for node in range(1, n):
            block[node] = node if self.names[node] in BLOCK else block[self.parents[node]]
        out = [False] * n
        for node in range(1, n):
            if self.hints[node]:
                inline = self.names[node] not in BLOCK and plain[block[node]] > plain[node]
                links = 2 * (whole[node] - plain[node]) >= whole[node]
                out[node] = self.names[node] in LEFT_OUT or self.hints[node] == STRONG or not inline and links
        return out

    def _leave_out(self) -> None:
        """Take hinted elements away, but none that the page is inside of.

        An element that holds an article, a main or, footers and the like aside, more than
        half of the page's text outside links stays. If no article has text and less than a
        tenth of that text is left, the largest element taken comes back, with what in it
        holds more than half of its own.
        """
        if not any(self.hints):
            return
        n = len(self.names)
        own, whole = [0] * n, [0] * n
        for node, text in self.events:
            if text:
                size = len("".join(text.split()))
                whole[node] += size
                if not self.links[node]:
                    own[node] += size
        holds, plain = [name in ("article", "main") for name in self.names], own[:]
        children: list[list[int]] = [[] for _ in range(n)]
        for node in range(n - 1, 0, -1):
            up = self.parents[node]
            plain[up] += plain[node]
            whole[up] += whole[node]
            holds[up] = holds[up] or holds[node]
            children[up].append(node)
        hinted = self._believed(plain, whole)
        stays = [not hinted[k] or holds[k] or 2 * plain[k] > plain[0] and self.names[k] not in NEVER_AROUND for k in range(n)]
        left, taken, text_left = self._left(stays), [], 0
        for node in range(n):
            if left[node]:
                text_left += own[node]
            elif left[self.parents[node]]:
                taken.append((-plain[node], node))
        heapq.heapify(taken)
        named = any(plain[k] for k in range(n) if self.names[k] in ("article", "main"))
        while taken and not named and 10 * text_left < plain[0]:
            back = heapq.heappop(taken)[1]
            some = [back]
            while some:
                node = some.pop()
                left[node] = True
                text_left += own[node]
                for child in children[node]:
                    if stays[child] or 2 * plain[child] > plain[back]:
                        some.append(child)
                    else:
                        heapq.heappush(taken, (-plain[child], child))
        number, place = 0, [0] * n
        for node in range(1, n):
            number += left[node]
            place[node] = number if left[node] else place[self.parents[node]]
        self.events = [(place[k], text) for k, text in self.events if left[k] or text is None]
        some = [k for k in range(n) if left[k]]
        self.parents = [-1, *(place[self.parents[k]] for k in some[1:])]
        self.names, self.links = [self.names[k] for k in some], [self.links[k] for k in some]

    def _pop_to(self, open_nodes: list[int], depth: int) -> None:
        for node in open_nodes[depth:]:
            self.depths[self.names[node]].pop()
            if self.names[node] in BLOCK:
                self.blocks.pop()
                self.events.append((node, None))
        del open_nodes[depth:]

    def _innermost(self, names) -> int:
        return max((self.depths[name][-1] for name in names if self.depths[name]), default=0)

    def _end_paragraph(self, open_nodes: list[int]) -> None:
        if self.blocks and self.names[open_nodes[self.blocks[-1]]] == "p":
            self._pop_to(open_nodes, self.blocks[-1])

    def _imply_end(self, open_nodes: list[int], names: tuple, around: tuple) -> None:
        while (depth := self._innermost(names)) > self._innermost(around):
            name = self.names[open_nodes[depth]]
            self._pop_to(open_nodes, depth)
            if name == names[0] or len(names) < 3:
                return

    def _close(self, open_nodes: list[int], name: str) -> None:
        depth = self._innermost((name,))
        if depth and (name in BLOCK or not self.blocks or self.blocks[-1] < depth):
            self._pop_to(open_nodes, depth)
        elif not depth and name == "p":
            self.events.append((open_nodes[-1], None))

    def _counts(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Characters, tags, link characters and link tags of every node's subtree."""
        n = len(self.names)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.events:
            if text:
                size = len("".join(text.split()))
                chars[node] += size
                if self.links[node]:
                    link_chars[node] += size
        for node in range(n - 1, 0, -1):
            up = self.parents[node]
            chars[up] += chars[node]
            tags[up] += tags[node] + 1
            link_chars[up] += link_chars[node]
            link_tags[up] += link_tags[node] + (self.names[node] == "a")
        return chars, tags, link_chars, link_tags

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of every node, and the sum of its children's."""
        chars, tags, link_chars, link_tags = self._counts()
        page_links = link_chars[0] / max(1, chars[0])
        density, sums = [0.0] * len(chars), [0.0] * len(chars)
        for node in range(len(chars) - 1, -1, -1):
            c, lc = chars[node], link_chars[node]
            if c:
                t = max(1, tags[node])
                base = math.log(c / max(1, c - lc) * lc + page_links * c + math.e)
                density[node] = c / t * math.log(max(c / max(1, lc) * (t / max(1, link_tags[node])), 1.0 + 1e-9)) / base
            if node:
                sums[self.parents[node]] += density[node]
        return density, sums

    def article(self) -> int:
        """The node to take: the largest sum of densities among those above the threshold.

        The threshold is the lowest density on the way from the node of the largest sum to
        the body. The innermost article or main element around the node found is taken
        instead, or one inside it if all that this drops is link text.
        """
        density, sums = self.densities()
        body = next((k for k, name in enumerate(self.names) if name == "body"), 0)
        best, way = max(range(len(sums)), key=lambda k: (sums[k], k)), []
        node = best
        while node > body:
            way.append(density[node])
            node = self.parents[node]
        threshold = min(way, default=0.0)
        fit = [k for k in range(len(sums)) if density[k] >= threshold and sums[k] > 0]
        node = found = max(fit, key=lambda k: (sums[k], k), default=body)
        while node > 0:
            if self.names[node] in ("article", "main"):
                return node
            node = self.parents[node]
        chars, _, link_chars, _ = self._counts()
        plain = [c - lc for c, lc in zip(chars, link_chars)]
        inside, whole = [False] * len(chars), []
        for node in range(found, len(chars)):
            inside[node] = node == found or inside[self.parents[node]]
            if inside[node] and self.names[node] in ("article", "main") and plain[node] == plain[found] > 0:
                whole.append(node)
        return max(whole, key=lambda k: chars[k], default=found)

    def text(self, top: int) -> str:
        """The blocks of a node, in page order."""
        inside = [False] * len(self.names)
        blocks, words = [], []
        for node in range(top, len(self.names)):
            inside[node] = node == top or inside[self.parents[node]]
        for node, text in [*self.events, (top, None)]:
            if text is None:
                if words:
                    block = " ".join("".join(words).split())
                    words = []
                    if block:
                        blocks.append(block)
            elif inside[node]:
                words.append(text)
        return "\n\n".join(blocks)


def main_text(source: str | None) -> str:
    """Main text of a page; empty for a null or empty one."""
    if not source:
        return ""
    page = Page(source)
    return page.text(page.article())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its id, url, main text and the text's code points.

    White space inside a block becomes one space, blocks are joined by an empty line.
    A null or empty page has an empty text, null ids and urls stay, repeated rows
    stay; other columns are ignored; an empty table gives an empty one.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    schema = with_column(with_column(rows.select("page_id", "url").schema, "text", "string"), "n_chars", "bigint")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, schema)
