"""A small element tree for listing pages, used inside tasks only.

Listing pages nest same-named elements, which regular expressions cannot
follow.  The tree answers the few questions the card readers ask; everything
that is computed from the found texts is done by Spark expressions afterwards.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
# elements that a new element of the given kind ends, if they are innermost
ENDS = {
    "p": {"p"}, "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
}
UNSEEN = ("script", "style", "template")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag = tag
        self.attrs = {k: v or "" for k, v in attrs}
        self.children: list[Node | str] = []
        self.parent = parent

    def _below(self, skip=()):
        """Everything below this one in document order; a stack of its own
        instead of recursion, as pages nest without bound."""
        waiting = self.children[::-1]
        while waiting:
            child = waiting.pop()
            yield child
            if isinstance(child, Node) and child.tag not in skip:
                waiting.extend(reversed(child.children))

    def walk(self):
        """Elements below this one, in document order."""
        return (child for child in self._below() if isinstance(child, Node))

    def texts(self):
        return (child for child in self._below(UNSEEN) if isinstance(child, str))

    def text(self) -> str:
        """Visible text, every text node stripped, nothing between them."""
        return "".join(t.strip() for t in self.texts())

    def all(self, *tags, cls=None, **patterns):
        """Elements below with one of the tags, a class that matches ``cls``
        and attributes that match their patterns."""
        for node in self.walk():
            if tags and node.tag not in tags:
                continue
            if cls and not any(cls.search(c) for c in node.attrs.get("class", "").split()):
                continue
            if all(p.search(node.attrs.get(a, "\0")) for a, p in patterns.items()):
                yield node

    def first(self, *tags, **conditions) -> Node | None:
        return next(self.all(*tags, **conditions), None)

    def up(self, tag) -> Node | None:
        node = self.parent
        while node is not None and node.tag != tag:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("")
        self.open = Counter()

    def _close(self):
        self.open[self.here.tag] -= 1
        self.here = self.here.parent

    def handle_starttag(self, tag, attrs):
        while self.here.tag in ENDS.get(tag, ()):
            self._close()
        node = Node(tag, attrs, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, attrs, self.here))

    def handle_endtag(self, tag):
        if not self.open[tag]:  # an end without beginning
            return
        while self.here.tag != tag:
            self._close()
        self._close()

    def handle_data(self, data):
        self.here.children.append(data)


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root
