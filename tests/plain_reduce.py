"""Shortened pages made on trees, one page at a time: what the joins of `gleaner.operators.reduce`
are compared with."""

from __future__ import annotations

import re

from gleaner.functions import text as X
from gleaner.operators.reduce import HIDDEN, HTML_CAP, LONG_TEXT, LONG_VALUE, NOISE, OPAQUE, SHOWN, SUMMARY_CAP, TEXT_CAP, USELESS
from gleaner.sources import html as H

_framework = [re.compile(p) for p in X.FRAMEWORK_CLASSES]
_whole = [re.compile(p) for p in X.KEPT_WHOLE]


def classes(value: str) -> str:
    return " ".join(t for t in value.split() if not any(p.search(t) for p in _framework))


def shorter(text: str, limit: int, whole=_whole) -> str:
    t = text.strip()
    return t if len(t) <= limit or any(p.search(t) for p in whole) else t[:limit] + "..."


def frame_prefix(e: H.Node) -> str:
    """What a selector begins with to reach into a frame: by id, name or place."""
    if e.attrs.get("id"):
        return f"iframe#{H.escaped(e.attrs['id'])}::"
    if e.attrs.get("name"):
        quoted = e.attrs["name"].replace("\\", "\\\\").replace('"', '\\"')
        return f'iframe[name="{quoted}"]::'
    place = 1 + next(i for i, x in enumerate(x for x in e.parent.elements() if x.tag == "iframe") if x is e)
    return f"iframe:nth-of-type({place})::"


def clean(nodes: list[H.Node]) -> list[H.Node]:
    """The page's elements without what nobody reads, frames with content marked; the tree is
    changed in place."""
    tests = [H.compiled(HIDDEN), H.compiled(", ".join(NOISE))]
    gone = [e for e in nodes if e.tag in USELESS or any(t(e) for t in tests)]
    for e in gone:
        e.parent.children = [c for c in e.parent.children if c is not e]
    dead = set()
    for e in gone:
        dead.update(range(e.index, e.end))
    left = [e for e in nodes if e.index not in dead]
    for e in left:
        attrs = {}
        for k, v in e.attrs.items():
            if k == "style" or k.startswith("on"):
                continue
            v = classes(v) if k == "class" else v
            if k != "class" or v:
                attrs[k] = v if len(v) <= LONG_VALUE else v[:LONG_VALUE] + "..."
        e.attrs = attrs
        if e.tag == "iframe" and e.children:
            e.attrs["data-iframe-prefix"] = frame_prefix(e)
        e.children = [(shorter(c, LONG_TEXT) if len(c.strip()) > LONG_TEXT else c) if isinstance(c, str) else c for c in e.children]
    return left


def _squeezed(html: str) -> str:
    return re.sub(r">\s+<", "><", re.sub(r"\n\s*\n", "\n", html))


def compress(e: H.Node, depth: int = 0) -> str:
    """Tags with a few attributes and short texts, down to depth 20."""
    if depth > 20 or e.tag in USELESS or e.tag == "img":
        return ""
    shown = "".join(f' {k}="{e.attrs[k]}"' for k in SHOWN if e.attrs.get(k))
    kept = classes(e.attrs.get("class", "")).split()[:2]
    shown += f' class="{" ".join(kept)}"' if kept else ""
    inner = "".join(shorter(c, 60) if isinstance(c, str) else compress(c, depth + 1) for c in e.children)
    return f"<{e.tag}{shown}>{inner}</{e.tag}>"


def unwrapped(nodes: list[H.Node]) -> None:
    """Wrappers without attributes around one element give way to it, innermost first."""
    for e in reversed(nodes):
        kids = e.elements()
        useful = any(k != "style" for k in e.attrs)
        if e.tag not in OPAQUE and len(kids) == 1 and not useful and kids[0].tag not in OPAQUE and e.parent is not None:
            kids[0].parent = e.parent
            e.parent.children = [kids[0] if c is e else c for c in e.parent.children]


def snapshot(page: str | None, html_cap: int = HTML_CAP, text_cap: int = TEXT_CAP, summary_cap: int = SUMMARY_CAP) -> dict:
    nodes = H.parse(page or "")
    top = [e for e in nodes if e.parent.tag == "#document"]
    title = next((e.text().strip() for e in nodes if e.tag == "title"), "")
    structure, body = "".join(compress(e) for e in top), next((e for e in nodes if e.tag == "body"), None)
    summary = body.text()[:summary_cap] if body else ""
    clean(nodes)
    out = _squeezed("".join(e.outer() for e in top))
    text = body.text().strip()[:text_cap] if body else ""
    return {"title": title, "html": out[:html_cap], "text": text, "structure": structure, "summary": summary}
