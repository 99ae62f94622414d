"""Selectors, contexts and structures of elements made on trees, one page at a time: what the
joins of `gleaner.operators.anchors` are compared with."""

from __future__ import annotations

import re
from typing import NamedTuple

from plain_reduce import classes, shorter

from gleaner.operators.reduce import USELESS
from gleaner.sources import html as H

#: Attributes that stay the same from load to load.
STABLE_ATTRS = ("role", "aria-label", "aria-posinset", "aria-describedby", "aria-labelledby", "data-testid", "data-ad-rendering-role", "data-sigil", "name", "type")
#: Generated ids and class names, in either case.
AUTO_ID = re.compile(r"^(mount_|react-aria[-_:]|headlessui-|r_[0-9]+_|^[Rr]_[a-z0-9]+:)", re.I)
AUTO_CLASS = re.compile(r"^(x[0-9a-z]{4,}|_[a-z0-9]+|html-)", re.I)
#: Ancestors and siblings shown, and levels below the element.
RADIUS, SIBLINGS, BELOW = 3, 2, 2
#: Fixed value: depth to which annotated elements of a structure are opened.
DEPTH = 8


class Anchor(NamedTuple):
    """An element's lasting marks: its id, or else tag, attributes and three classes."""

    tag: str
    id: str
    attrs: tuple[tuple[str, str], ...]
    names: tuple[str, ...]

    @classmethod
    def of(cls, e: H.Node) -> Anchor:
        own = e.attrs.get("id", "")
        if own and not AUTO_ID.search(own):
            return cls("", own, (), ())
        attrs = tuple((k, e.attrs[k]) for k in STABLE_ATTRS if e.attrs.get(k))
        return cls(e.tag, "", attrs, tuple(c for c in e.attrs.get("class", "").split() if not AUTO_CLASS.search(c))[:3])

    def bare(self) -> bool:
        return not (self.id or self.attrs or self.names)

    def fits(self, e: H.Node) -> bool:
        if self.id:
            return e.attrs.get("id") == self.id
        same = e.tag == self.tag and all(e.attrs.get(k) == v for k, v in self.attrs)
        return same and (not self.names or set(self.names) <= set(e.attrs.get("class", "").split()))

    def text(self) -> str:
        if self.id:
            return f"#{H.escaped(self.id)}"
        return self.tag + "".join(f'[{k}="{H.escaped(v)}"]' for k, v in self.attrs) + "".join(f".{H.escaped(c)}" for c in self.names)


def above(e: H.Node) -> list[H.Node]:
    """Ancestors from the parent on, up to the body."""
    out, up = [], e.parent
    while up.parent is not None and up.tag != "body":
        out.append(up)
        up = up.parent
    return out


def position(e: H.Node) -> str:
    peers = [x for x in e.parent.elements() if x.tag == e.tag]
    return f":nth-of-type({next(i for i, x in enumerate(peers, 1) if x is e)})" if len(peers) > 1 else ""


class Namer:
    """Selectors of one page's elements. What a chain of anchors matches is kept, so equal
    chains of neighbours are looked for once."""

    def __init__(self, nodes: list[H.Node]):
        self.nodes, self.found = nodes, {}

    def matches(self, chain: tuple[Anchor, ...]) -> list[H.Node]:
        """Elements of the last anchor with the others above them, in order."""
        if chain not in self.found:
            pool = self.matches(chain[1:]) if len(chain) > 1 else self.nodes
            self.found[chain] = [e for e in pool if self._holds(e, chain)]
        return self.found[chain]

    @staticmethod
    def _holds(e: H.Node, chain: tuple[Anchor, ...]) -> bool:
        left = len(chain) - 1
        if not chain[left].fits(e):
            return False
        while left and e.parent is not None:
            e = e.parent
            left -= e.parent is not None and chain[left - 1].fits(e)
        return not left

    def selector(self, e: H.Node) -> str:
        """The element's anchor, with those of ancestors until no other element matches;
        ancestors without marks are left out, and where the body is reached the element's
        place among those of its tag is added."""
        chain, rest = (Anchor.of(e),), above(e)
        while len(self.matches(chain)) > 1 and rest:
            up = Anchor.of(rest.pop(0))
            chain = chain if up.bare() else (up, *chain)
        joined = " ".join(a.text() for a in chain)
        return joined + (position(e) if len(self.matches(chain)) > 1 else "")


def path(e: H.Node) -> str:
    """Anchors from below the body to the element."""
    return " > ".join(Anchor.of(x).text() for x in (*reversed(above(e)), e))


# --- surroundings --------------------------------------------------------------------


def _wrap(e: H.Node, inner: str, names: int, mark: str = "") -> str:
    kept = " ".join(classes(e.attrs.get("class", "")).split()[:names])
    shown = (f' id="{e.attrs["id"]}"' if e.attrs.get("id") else "") + (f' class="{kept}"' if kept else "")
    return f"<{e.tag}{shown}{mark}>{inner}</{e.tag}>"


def _folded(x: H.Node | str, n: int | None = None, kind: str = "children") -> str:
    """A text cut short, or an element closed over the number of those in it."""
    if isinstance(x, str):
        return shorter(x, 60)
    n = len(x.elements()) if n is None else n
    return _wrap(x, f"+{n} {kind}" if n else x.text().strip(), 2)


def _opened(x: H.Node | str, level: int) -> str:
    if isinstance(x, str):
        return shorter(x, 60)
    if level > BELOW:
        return _folded(x, x.end - x.index - 1, "descendants")
    return _wrap(x, "".join(_opened(c, level + 1) for c in x.children), 2)


def context(target: H.Node, radius: int = RADIUS, siblings: int = SIBLINGS) -> str:
    """An element opened two levels down within its nearest ancestors, each with the
    siblings next to the way down, folded; what is left out is counted."""
    out, at = _wrap(target, "".join(_opened(c, 1) for c in target.children), 2, " data-annotated"), target
    for _ in range(radius):
        up = at.parent
        if up.parent is None or up.tag == "body":
            break
        i = next(k for k, c in enumerate(up.children) if c is at)
        first, last = max(0, i - siblings), min(len(up.children), i + 1 + siblings)
        parts = [f"<!-- {first} siblings before -->"] if first else []
        parts += [*map(_folded, up.children[first:i]), out, *map(_folded, up.children[i + 1 : last])]
        parts += [f"<!-- {len(up.children) - last} siblings after -->"] if last < len(up.children) else []
        out, at = _wrap(up, "".join(parts), 2), up
    return out


def structure(nodes: list[H.Node], selectors: list[str]) -> list[str]:
    """The body's children: ways to annotated elements are open and marked, every other
    element with elements in it is folded."""
    marked = set()
    for selector in selectors:
        for e in H.select(nodes, selector):
            marked.update((e.index, *(x.index for x in above(e))))

    def shown(x: H.Node | str, depth: int) -> str:
        if isinstance(x, str):
            return shorter(x, 60)
        if x.tag in USELESS or x.tag == "img":
            return ""
        hint = x.attrs.get("placeholder", "")[:30]
        mark = (f' placeholder="{hint}"' if hint else "") + (" [ANNOTATED]" if x.index in marked else "")
        if x.elements() and (x.index not in marked or depth >= DEPTH):
            return _wrap(x, f"+{len(x.elements())} children", 1, mark)
        return _wrap(x, "".join(shown(c, depth + 1) for c in x.children), 1, mark)

    body = next((e for e in nodes if e.tag == "body"), None)
    return [s for s in (shown(c, 0) for c in body.children) if s] if body else []
