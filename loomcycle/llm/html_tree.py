"""A forgiving HTML reader: nodes with parents, and text with the block it stands in."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript textarea iframe noembed noframes xmp svg math object canvas audio video datalist".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes: the open elements that it ends, and those that stop the search.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_ENDS |= {t: ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")}
_ENDS |= {t: ({"p"}, {"button", "td", "th", "caption", "table", "body", "html"}) for t in BLOCK - {"li", "dt", "dd", "tr", "td", "th", "option", "tbody", "thead", "tfoot", "html", "body"}}


_LI_STOPS = {"div", "section", "article", "td"}
#: These close all of them above the stop, not just the innermost.
_ENDS_ALL = frozenset(("tr", "tbody", "thead", "tfoot", "dd", "dt"))


@dataclass
class Tree:
    """Parallel lists over nodes in page order; a text node's tag is "#text"."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attrs: list[dict[str, str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attrs: dict[str, str], text: str, block: int) -> int:
        for column, value in zip((self.parent, self.tag, self.attrs, self.text, self.block), (parent, tag, attrs, text, block)):
            column.append(value)
        return len(self.parent) - 1


class _Open:
    """The open elements: a stack that knows where each tag stands in it, so that no search walks it."""

    def __init__(self, root: int):
        self.nodes, self.tags = [root], ["#root"]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, depth: int) -> bool:
        """Closes all from a depth on; says whether a block was among them."""
        block = bool(self.blocks) and self.blocks[-1] >= depth
        while len(self.nodes) > depth:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        return block

    def last(self, tags) -> int:
        """The depth of the innermost of some tags; 0 if none is open."""
        return max((found[-1] for t in tags if (found := self.places.get(t))), default=0)

    def first_above(self, tags, depth: int) -> int:
        """The depth of the outermost of some tags above a depth; 0 if there is none."""
        above = [found[at] for t in tags if (found := self.places.get(t)) and (at := bisect_right(found, depth)) < len(found)]
        return min(above, default=0)


def parse(page: str) -> Tree:
    tree = Tree()
    stack, block, at = _Open(tree.add(-1, "#root", {}, "", 0)), 0, 0
    said: list[str] = []
    endless: set[str] = set()  # tags that have no end from here on

    def say(text: str) -> None:
        if not text:
            return
        if tree.tag[-1] == "#text" and tree.parent[-1] == stack.nodes[-1] and tree.block[-1] == block:
            said.append(text)
        else:
            hush()
            tree.add(stack.nodes[-1], "#text", {}, "", block)
            said.append(text)

    def hush() -> None:
        """Gives the last text node what was said since it began."""
        if said:
            tree.text[-1] = "".join(said)
            said.clear()

    def add(tag: str, attrs: dict[str, str]) -> int:
        hush()
        return tree.add(stack.nodes[-1], tag, attrs, "", block)

    while at < len(page):
        open_ = page.find("<", at)
        if open_ < 0:
            say(html.unescape(page[at:]))
            break
        if open_ > at:
            say(html.unescape(page[at:open_]))
        m = _TOKEN.match(page, open_) or _LOOSE.match(page, open_)
        if m is None:
            if page[open_ + 1 : open_ + 2].isalpha() or page[open_ + 1 : open_ + 2] == "/":
                break  # a tag that never ends
            say("<")
            at = open_ + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not stack.places.get("p"):
                block += 1
            depth = stack.last((tag,))
            if depth and (tag in BLOCK or not stack.blocks or stack.blocks[-1] < depth):  # an inline end can't cross a block
                block += stack.cut(depth)
            continue
        if tag in _ENDS:
            closes, stops = _ENDS[tag]
            stop = stack.last(stops | _LI_STOPS if tag == "li" else stops)
            depth = stack.first_above(closes, stop) if tag in _ENDS_ALL else stack.last(closes)
            if depth > stop:
                stack.cut(depth)
        if tag == "br":
            say("\n")
            continue
        if tag in BLOCK:
            block += 1
        if tag in UNSEEN and tag != "head":
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                break  # all that follows is its raw text
            else:
                endless.add(tag)  # never closed: what follows is shown
            continue
        if tag == "head":
            at = _after_head(page, at)
            continue
        attrs = {a.lower(): html.unescape(x or y or z) for a, x, y, z in _ATTR.findall(m[3])} if m[3] else {}
        if tag in VOID:
            add(tag, attrs)
            if tag == "hr":
                block += 1
            continue
        stack.push(add(tag, attrs), tag)
    hush()
    return tree


_IN_HEAD = frozenset("meta link base title style script noscript template".split())


def _after_head(page: str, at: int) -> int:
    """Where the head stops: its end tag, or the first thing that can't be in it."""
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            return len(page)
        if page[at : m.start()].strip():
            return at
        if not m[2]:
            at = m.end()
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "head":
                return m.end()
            at = m.end() if tag in _IN_HEAD else at
            if tag not in _IN_HEAD:
                return m.start()
            continue
        if tag not in _IN_HEAD:
            return m.start()
        at = m.end()
        if tag in RAW or tag in ("noscript", "template"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
