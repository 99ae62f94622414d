"""A small HTML tree and selector matcher for tasks; pure Python, no Spark.

Void elements, implied ends of p, li, dt, dd, option, tr, td and th, and stray end tags
are handled; formatting elements aren't reconstructed (texts don't change by that).
Selectors: type, #id, .class, [a], [a=v], [a*=v], [a^=v], [a$=v], the i flag,
:nth-of-type, :nth-child, :has(> x), descendant, >, ~ and comma lists.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: start tag -> open elements that it ends, up to a boundary
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"),
}
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
STOP = frozenset("ul ol dl table select body html article div td th".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "index", "end")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []  # nodes and strings
        self.index = self.end = 0

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(parts)

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]

    def _written(self) -> list:
        """Children from last to first, texts as they are written."""
        raw = self.tag in ("script", "style", "#document")
        return [(c if raw else _escape(c)) if isinstance(c, str) else c for c in reversed(self.children)]

    def inner(self) -> str:
        """The children's html; without recursion, for pages may nest at any depth."""
        parts, todo = [], self._written()
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            parts.append(x.start())
            if x.tag not in VOID:
                todo.append(f"</{x.tag}>")
                todo.extend(x._written())
        return "".join(parts)

    def start(self) -> str:
        return f"<{self.tag}" + "".join(f' {k}="{_escape(v, True)}"' for k, v in self.attrs.items()) + ">"

    def outer(self) -> str:
        return self.start() + ("" if self.tag in VOID else f"{self.inner()}</{self.tag}>")


def escaped(name: str) -> str:
    """An identifier as selectors write it (CSSOM, "serialize an identifier")."""
    out = []
    for i, c in enumerate(name):
        first = i == 0 or (i == 1 and name[0] == "-")
        if c == "\0":
            out.append("�")
        elif c < " " or c == "\x7f" or (first and "0" <= c <= "9"):
            out.append(f"\\{ord(c):x} ")
        elif c >= "\x80" or c in "-_" and name != "-" or c.isalnum():
            out.append(c)
        else:
            out.append("\\" + c)
    return "".join(out)


def _escape(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\u00a0", "&nbsp;")
    return text.replace('"', "&quot;") if attribute else text.replace("<", "&lt;").replace(">", "&gt;")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)
        self.order: list[Node] = []

    def _close(self, tags, stops=STOP):
        x = self.at
        while x.parent is not None and x.tag not in stops:
            if x.tag in tags:
                self.at = x.parent
                return
            x = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(ENDS[tag], STOP - set(ENDS[tag]))
        if tag in BLOCK:
            self._close(("p",))
        own: dict[str, str] = {}
        for k, v in attrs:  # in their order; of two with one name the first counts
            own.setdefault(k, "" if v is None else v)
        node = Node(tag, own, self.at)
        node.index = len(self.order)
        self.order.append(node)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> list[Node]:
    """All elements of a page in document order; `end` is past an element's last descendant."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for node in reversed(tree.order):
        node.end = max([node.index + 1, *(c.end for c in node.elements())])
    return tree.order


_SIMPLE = re.compile(
    r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iI])?\s*)?\]
    |:nth-(?P<nth>of-type|child)\((?P<n>\d+)\)|:has\(\s*>?\s*(?P<has>[^()]*(?:\([^()]*\)[^()]*)*)\)""",
    re.X,
)


class Invalid(ValueError):
    pass


def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise Invalid(text)
        at = m.end()
        g = m.groupdict()
        if g["tag"]:
            if g["tag"] != "*":
                tests.append(lambda e, t=g["tag"].lower(): e.tag == t)
        elif g["id"]:
            tests.append(lambda e, v=g["id"]: e.attrs.get("id") == v)
        elif g["cls"]:
            tests.append(lambda e, v=g["cls"]: v in (e.attrs.get("class") or "").split())
        elif g["attr"]:
            name, op = g["attr"].lower(), g["op"]
            value = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), "")
            fold = str.lower if g["flag"] else str
            check = {
                None: lambda a, v: True, "=": lambda a, v: a == v, "*=": lambda a, v: v in a and v != "", "^=": lambda a, v: a.startswith(v) and v != "",
                "$=": lambda a, v: a.endswith(v) and v != "", "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(v + "-"),
            }[op]
            tests.append(lambda e, n=name, v=fold(value), f=fold, c=check: n in e.attrs and c(f(e.attrs[n]), v))
        elif g["nth"]:

            def nth(e, n=int(g["n"]), same=g["nth"] == "of-type"):
                peers = [x for x in e.parent.elements() if not same or x.tag == e.tag]
                return len(peers) >= n and peers[n - 1] is e

            tests.append(nth)
        else:
            inner = g["has"].strip()
            direct = re.match(r":has\(\s*>", m.group()) is not None
            matcher = compiled(inner)

            def has(e, matcher=matcher, direct=direct):
                pool = e.elements() if direct else _below(e)
                return any(matcher(x) for x in pool)

            tests.append(has)
    return lambda e: all(t(e) for t in tests)


def _below(e: Node) -> list[Node]:
    out, todo = [], e.elements()[::-1]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(x.elements()[::-1])
    return out


def _split(selector: str) -> list[tuple[str, str]]:
    """(combinator before, compound) parts, brackets and quotes respected."""
    parts, depth, quote, current, joint = [], 0, "", "", ""
    for c in selector.strip() + " ":
        if quote:
            quote = "" if c == quote else quote
            current += c
        elif c in "\"'" and depth:
            quote = c
            current += c
        elif c in "[(":
            depth += 1
            current += c
        elif c in "])":
            depth -= 1
            current += c
        elif depth == 0 and (c.isspace() or c in ">~+"):
            if current:
                parts.append((joint, current))
                current, joint = "", " "
            if c in ">~+":
                joint = c
        else:
            current += c
    if current or depth or quote or not parts:
        raise Invalid(selector)
    return parts


def _commas(selector: str) -> list[str]:
    out, depth, current = [], 0, ""
    for c in selector:
        depth += (c in "[(") - (c in "])")
        if c == "," and not depth:
            out.append(current)
            current = ""
        else:
            current += c
    return [*out, current]


@lru_cache(maxsize=4096)
def compiled(selector: str):
    """A test of an element against a selector; raises Invalid."""
    chains = []
    for one in _commas(selector):
        chains.append([(joint, _compound(text)) for joint, text in _split(one)])

    def match(e: Node, chain, i: int) -> bool:
        joint, test = chain[i]
        if e.parent is None or not test(e):
            return False
        if i == 0:
            return True
        if joint == ">":
            return match(e.parent, chain, i - 1)
        if joint in "~+":
            peers = e.parent.elements()
            before = peers[: next(k for k, x in enumerate(peers) if x is e)]
            return any(match(x, chain, i - 1) for x in (before[-1:] if joint == "+" else before))
        up = e.parent
        while up is not None:
            if match(up, chain, i - 1):
                return True
            up = up.parent
        return False

    return lambda e: any(match(e, chain, len(chain) - 1) for chain in chains)


def select(nodes: list[Node], selector: str, within: Node | None = None, first: bool = False) -> list[Node]:
    """Elements that match, in document order; within: only an element's descendants,
    though what stands above them in the selector may be anywhere."""
    test = compiled(selector)
    pool = nodes[within.index + 1 : within.end] if within is not None else nodes
    out = []
    for e in pool:
        if test(e):
            out.append(e)
            if first:
                break
    return out


def hidden(e: Node) -> bool:
    """Hidden by what static HTML says of the element itself."""
    style = re.sub(r"\s", "", (e.attrs.get("style") or "").lower())
    return "hidden" in e.attrs or "display:none" in style or "visibility:hidden" in style or re.search(r"opacity:0(;|$|\.0+(;|$))", style) is not None
