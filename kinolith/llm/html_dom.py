"""Blocks of a web page: a forgiving HTML reader that keeps what a tree model of main text needs."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements of HTML by what they do to the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Never text of the page: their content is passed over.
HIDDEN = frozenset("applet audio button canvas datalist embed head map noscript object optgroup option select svg template video".split())
#: Their content is not even markup.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag of these closes an open paragraph.
CLOSE_P = BLOCKS - frozenset("body caption html tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("body button caption html object table td template th".split())
#: start tag -> (open elements it closes, elements where looking for them ends)
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("dir menu ol table td th ul".split())),
    "dd": (frozenset("dd dt".split()), frozenset("dl table td th".split())),
    "td": (frozenset("caption td th".split()), frozenset(["table"])),
    "tr": (frozenset("caption td th tr".split()), frozenset(["table"])),
    "tbody": (frozenset("caption tbody td tfoot th thead tr".split()), frozenset(["table"])),
}
_CLOSES |= {"dt": _CLOSES["dd"], "th": _CLOSES["td"], "thead": _CLOSES["tbody"], "tfoot": _CLOSES["tbody"]}
_TABLE = frozenset("caption table tbody td tfoot th thead tr".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?\Z"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Page:
    """Block elements and runs of text in page order; a parent stands before its children.

    The first node is the body, whose parent is -1; tag is 'run' for text, whose
    collapsed text is in texts by node. link counts its characters in links.
    """

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    marks: list[tuple[str, ...]] = field(default_factory=list)
    texts: dict[int, str] = field(default_factory=dict)
    link: dict[int, int] = field(default_factory=dict)

    def pruned(self) -> Page:
        """Without elements that hold no text."""
        full = [t == "run" for t in self.tag]
        for i in range(len(full) - 1, 0, -1):
            if full[i] and self.parent[i] >= 0:
                full[self.parent[i]] = True
        at, place = [-1] * len(full), 0
        for i, keep in enumerate(full):
            if keep:
                at[i], place = place, place + 1
        kept = [i for i, keep in enumerate(full) if keep]
        return Page(
            [at[self.parent[i]] if self.parent[i] >= 0 else -1 for i in kept],
            [self.tag[i] for i in kept],
            [self.marks[i] for i in kept],
            {at[i]: t for i, t in self.texts.items()},
            {at[i]: n for i, n in self.link.items()},
        )


def _marks(attributes: str) -> tuple[str, ...]:
    """Words of class and id, role and itemprop of a tag."""
    found: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            found += (w.lower() for w in _WORD.findall(html.unescape(value)))
        elif name in ("role", "itemprop"):
            found.append(f"{name}={value.lower()}")
        elif name in ("hidden", "aria-hidden") and value.lower() != "false":
            found.append("hidden=")
    return tuple(dict.fromkeys(found))


class _Reader:
    def __init__(self):
        # a page has a body, whether it says so or not
        self.page = Page([-1], ["body"], [()])
        self.stack = [("body", 0)]  # (tag, node); inline and hidden elements have the node around them
        self.open = {"body": 1}
        self.hidden = 0
        self.pieces: list[str] = []
        self.linked: list[str] = []

    def node(self) -> int:
        return self.stack[-1][1]

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                page, at = self.page, len(self.page.parent)
                page.parent.append(self.node())
                page.tag.append("run")
                page.marks.append(())
                page.texts[at] = text
                page.link[at] = len(" ".join("".join(self.linked).split()))
            self.pieces.clear()
            self.linked.clear()

    def text(self, raw: str) -> None:
        if self.open.get("head") and not raw.isspace():
            self.close_to("head")
        if not self.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.open.get("a"):
                self.linked.append(text)

    def pop(self) -> None:
        tag = self.stack[-1][0]
        if tag in BLOCKS:
            self.flush()
        self.stack.pop()
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN

    def close_to(self, tag: str) -> None:
        while self.stack:
            top = self.stack[-1][0]
            self.pop()
            if top == tag:
                return

    def close_in_scope(self, tags: frozenset[str], until: frozenset[str]) -> None:
        """Close the outermost open element of tags that no element of until is around."""
        if not any(self.open.get(t) for t in tags):
            return
        last = None
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                last = i
            elif tag in until:
                break
        while last is not None and len(self.stack) > last:
            self.pop()

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += tag in HIDDEN

    def start(self, tag: str, attributes: str) -> None:
        if self.open.get("head") and tag not in IN_HEAD:
            self.close_to("head")
        if tag == "br":
            self.text(" ")
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSE_P:
                self.close_in_scope(frozenset(["p"]), _SCOPE)
            if tag in _CLOSES:
                self.close_in_scope(*_CLOSES[tag])
            if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
                self.pop()
            if tag in VOID:
                return
            page, at = self.page, len(self.page.parent)
            page.parent.append(self.node())
            page.tag.append(tag)
            page.marks.append(_marks(attributes) if attributes.strip(" /") else ())
            self.push(tag, at)
        elif tag not in VOID:
            if tag == "a" and self.open.get("a"):
                self.end("a")
            self.push(tag, self.node())

    def end(self, tag: str) -> None:
        if not self.open.get(tag) or tag == "body":
            return  # text behind the body's end belongs to the page as well
        wide = _TABLE if tag not in _TABLE else frozenset(["table"])
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                if tag in BLOCKS or tag in HIDDEN or all(t not in BLOCKS for t, _ in self.stack[i:]):
                    while len(self.stack) > i:
                        self.pop()
                else:  # an inline element that crosses blocks ends here, they don't
                    del self.stack[i]
                    self.open[tag] -= 1
                return
            if name in wide and tag not in _TABLE:
                return


def read(text: str) -> Page:
    """The blocks of a page, however malformed; time and memory grow with its length.

    Paragraphs, list items, cells and headings end where HTML ends them without
    an end tag. Comments, scripts, styles, form controls and the head are passed
    over, and whatever an unclosed one of them swallows in its own element.
    Character references are decoded, white space is one space.
    """
    reader, at, size = _Reader(), 0, len(text)
    while at < size:
        found = _TOKEN.search(text, at)
        if found is None:
            reader.text(text[at:])
            break
        if found.start() > at:
            reader.text(text[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            reader.end(name)
            continue
        attributes = found.group(3)
        if name in RAW:
            last = _RAW_END[name].search(text, at)
            at = last.start() if last else size
            continue
        reader.start(name, attributes)
    while reader.stack:
        reader.pop()
    return reader.page.pruned()
