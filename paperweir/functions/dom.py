"""A small HTML tree: enough to read, change and write article markup.

Nothing here recurses, and a tree is at most MAX_DEPTH deep, so hostile nesting costs no more than other markup.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html import escape

from paperweir.functions.markup import RAW, tokens

#: Elements nested deeper become children of the element at this depth, as in browsers; no text is lost.
MAX_DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags that stand apart as blocks in the visible text.
BLOCK_TAGS = frozenset(
    """address article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre
    section table tbody td tfoot th thead tr ul""".split()
)
_CLOSES_P = BLOCK_TAGS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"form", "nav", "center"}
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order, as they are when their parent is reached."""
        stack = [iter(list(self.children))]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(list(c.children)))
                    break
            else:
                stack.pop()

    def events(self) -> Iterator[tuple[str, Node | str]]:
        """("text", string), ("open", element) and ("close", element) of all that is inside, in order."""
        stack: list[tuple[Node | None, Iterator]] = [(None, iter(self.children))]
        while stack:
            node, rest = stack[-1]
            for c in rest:
                if isinstance(c, str):
                    yield "text", c
                    continue
                yield "open", c
                stack.append((c, iter(c.children)))
                break
            else:
                stack.pop()
                if node is not None:
                    yield "close", node

    def find_all(self, *tags: str, where: Callable[[Node], bool] | None = None) -> list[Node]:
        return [n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n))]

    def find(self, *tags: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next((n for n in self.walk() if (not tags or n.tag in tags) and (where is None or where(n))), None)

    def text(self) -> str:
        return "".join(c for kind, c in self.events() if kind == "text")

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None

    def replace(self, *nodes: Node | str) -> None:
        i, parent = self.index(), self.parent
        for n in nodes:
            if isinstance(n, Node):
                n.parent = parent
        parent.children[i : i + 1] = nodes
        self.parent = None

    def unwrap(self) -> None:
        self.replace(*self.children)

    def next_element(self) -> Node | None:
        return next((c for c in self.parent.children[self.index() + 1 :] if isinstance(c, Node)), None)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def inner(self, xml: bool = False) -> str:
        """Markup of what is inside."""
        out, raw = [], int(self.tag in RAW)
        for kind, c in self.events():
            if kind == "text":
                out.append(c if raw else escape(c, quote=False))
            elif kind == "open":
                out.append(c._start(xml))
                raw += c.tag in RAW
            elif c.tag not in VOID:
                out.append(f"</{c.tag}>")
                raw -= c.tag in RAW
        return "".join(out)

    def _start(self, xml: bool) -> str:
        attrs = "".join(f' {k}="{escape(v).replace("&#x27;", chr(39))}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}{'/' if xml and self.tag in VOID else ''}>"

    def outer(self, xml: bool = False) -> str:
        return self._start(xml) if self.tag in VOID else f"{self._start(xml)}{self.inner(xml)}</{self.tag}>"


def fold(root: Node, leave: Callable[[Node, list], object], enter: Callable[[Node], object] | None = None) -> object:
    """A value of the tree from the leaves up: leave(element, the values of its children), strings standing for themselves.

    enter(element) may give the value of an element without its children; None lets them be visited.
    """
    stack: list[tuple[Node, Iterator, list]] = [(root, iter(list(root.children)), [])]
    while True:
        node, rest, done = stack[-1]
        for c in rest:
            if isinstance(c, str):
                done.append(c)
            elif enter is not None and (value := enter(c)) is not None:
                done.append(value)
            else:
                stack.append((c, iter(list(c.children)), []))
                break
        else:
            stack.pop()
            value = leave(node, done)
            if not stack:
                return value
            stack[-1][2].append(value)


class _Builder:
    def __init__(self):
        self.root = Node("#root")
        self.at = self.root
        self.depth = 0
        self.open: Counter[str] = Counter()  # open elements by tag: what is not open need not be looked for
        self.once: set[str] = set()

    def _leave(self, node: Node) -> None:
        """Closes node, an open element, and all inside it."""
        while self.at is not node:
            self._up()
        self._up()

    def _up(self) -> None:
        self.open[self.at.tag] -= 1
        self.depth -= 1
        self.at = self.at.parent

    def _within(self, tags: set[str], until: set[str]) -> Node | None:
        """The innermost open element of the tags, not looked for beyond those in until."""
        if not any(self.open[t] for t in tags):
            return None
        n = self.at
        while n is not self.root and n.tag not in until:
            if n.tag in tags:
                return n
            n = n.parent
        return None

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body", "head"):
            if tag in self.once:
                return
            self.once.add(tag)
        if tag in _ENDS:
            tags, until = _ENDS[tag]
            while (n := self._within(tags, until)) is not None:
                self._leave(n)
        if tag in _CLOSES_P and (p := self._within({"p"}, _P_STAYS)) is not None:
            self._leave(p)
        while self.depth >= MAX_DEPTH:
            self._up()
        node = Node(tag, attrs)
        self.at.append(node)
        if tag not in VOID:
            self.at = node
            self.depth += 1
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        within = () if tag in _LEAVES_CELLS else ("table", "td")
        if (n := self._within({tag}, within if tag not in within else ())) is not None:
            self._leave(n)


# elements inside which a paragraph outside stays open
_P_STAYS = frozenset("li td th div blockquote body article main section".split())
# end tags that reach beyond a table's cell
_LEAVES_CELLS = frozenset("table tr tbody div body html main article".split())


def parse_html(markup: str) -> Node:
    b = _Builder()
    for kind, value, attrs in tokens(markup):
        if kind == "text":
            b.at.append(value)
        elif kind == "start":
            b.start(value, attrs)
        else:
            b.end(value)
    return b.root


def text_for_hash(node: Node | str) -> str:
    """Visible text: text as it is, a line break one space, blocks set off by spaces."""
    if isinstance(node, str):
        return node
    out = []
    for kind, c in node.events():
        if kind == "text":
            out.append(c)
        elif c.tag == "br":
            out.append(" " if kind == "open" else "")
        elif c.tag in BLOCK_TAGS:
            out.append(" ")
    text = "".join(out)
    return " " if node.tag == "br" else f" {text} " if node.tag in BLOCK_TAGS else text
