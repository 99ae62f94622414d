"""Column functions with the browser's string semantics, built from Spark's own."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser's trim and \s have it.
BLANKS = "\\t\\n\\u000B\\f\\r\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of that class.
WHITE = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(c: Column | str) -> Column:
    """Without white space at the ends, which alone are looked at."""
    return F.btrim(_col(c), F.lit(WHITE))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return trim(F.regexp_replace(_col(c), f"[{BLANKS}]+", " "))


# --- emptiness: six rules that differ on purpose -------------------------------------


def empty_value(c: Column | str) -> Column:
    """Required inputs (null or ''); for arrays see empty_output."""
    return _col(c).isNull() | (_col(c) == "")


def empty_output(c: Column | str, array: bool = False) -> Column:
    """Required outputs and all-empty extractions: null, '' or an array without items."""
    return _col(c).isNull() | (F.size(_col(c)) == 0 if array else _col(c) == "")


def empty_ratio_value(c: Column | str, array: bool = False) -> Column:
    """Ratios and duplicate signatures: white space alone is empty too."""
    return _col(c).isNull() | (F.size(_col(c)) == 0 if array else trim(c) == "")


def unpopulated(c: Column | str, array: bool = False) -> Column:
    """Record shapes: white space counts as populated."""
    return empty_output(c, array)


# --- URLs ----------------------------------------------------------------------------


def encode_component(c: Column | str) -> Column:
    """encodeURIComponent: letters, digits and - _ . ! ~ * ' ( ) stay."""
    pairs = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%2A", "*"))
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, F.url_encode(_col(c)))


def template_params(template: Column | str) -> Column:
    """Names in {{ name }}, distinct, in the order of their first appearance."""
    return F.array_distinct(F.regexp_extract_all(_col(template), F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)))


def resolve_template(template: Column | str, values: dict[str, Column], strict: bool = True) -> Column:
    """The template with each {{ name }} replaced by its encoded value. A name without a
    value raises MISSING_URL_PARAM, or with strict=False gives null."""
    out = _col(template)
    for name, value in values.items():
        text = encode_component(value.cast("string"))
        marked = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        pattern = F.lit(rf"\{{\{{\s*{name}\s*\}}\}}")
        out = F.when(out.rlike(rf"\{{\{{\s*{name}\s*\}}\}}"), F.regexp_replace(out, pattern, marked)).otherwise(out)
    missing = out.isNull() | out.rlike(r"\{\{\s*\w+\s*\}\}")
    failed = F.raise_error(F.lit("MISSING_URL_PARAM")) if strict else F.lit(None).cast("string")
    return F.when(missing, failed).otherwise(out)


def service_name(url: Column | str) -> Column:
    """The host without www.; a missing scheme is read as http."""
    u = _col(url)
    host = F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.try_parse_url(F.concat(F.lit("http://"), u), F.lit("HOST")))
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(_col(c)), f"[^A-Za-z0-9_{BLANKS}-]", "")
    s = F.regexp_replace(F.regexp_replace(s, f"[{BLANKS}_]+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", F.lit("service")).otherwise(s)


# --- shortening ----------------------------------------------------------------------

#: Texts that are kept whole (numbers and prices, dates, codes).
KEPT_WHOLE = (r"^[\d\s,.:$¥€£+-]+$", r"^\d{4}-\d{2}-\d{2}", r"^\d{1,2}/\d{1,2}/\d{2,4}", r"^[A-Z]{2,}[-_]?\w*$", r"^\w[\w-]*\d[-\w]*$")


def truncate_text(c: Column | str, limit: int = 60) -> Column:
    t = trim(c)
    whole = reduce(lambda a, b: a | b, [t.rlike(p) for p in KEPT_WHOLE], F.length(t) <= limit)
    return F.when(_col(c).isNull(), F.lit("")).when(whole, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("...")))


def head_tail(c: Column | str, cap: int, marker: str = "[CUT]", share: float = 0.4) -> Column:
    """At most about `cap` characters: a head and a tail with a marker between."""
    room = cap - 60
    head = int(room * share)
    cut = F.concat(F.left(_col(c), F.lit(head)), F.lit(marker), F.right(_col(c), F.lit(room - head)))
    return F.when(F.length(_col(c)) <= cap, _col(c)).otherwise(cut)


def container_html(c: Column | str, cap: int = 2000, tail: int = 1200) -> Column:
    """A container's html on one line; if it's long, its head and tail, for counts and
    labels stand at the end of records."""
    t = F.regexp_replace(F.regexp_replace(_col(c), "[ \\t]+", " "), f"[{BLANKS}]*\n[{BLANKS}]*", " ")
    note = F.concat(F.lit(" …[truncated "), F.length(t).cast("string"), F.lit(" chars, middle cut]… "))
    return F.when(F.length(t) <= cap, t).otherwise(F.concat(F.left(t, F.lit(cap - tail - 60)), note, F.right(t, F.lit(tail))))


def capped_html(c: Column | str, cap: int = 80_000) -> Column:
    note = F.concat(F.lit("[TRUNCATED "), F.length(_col(c)).cast("string"), F.lit(" chars] "))
    return F.when(F.length(_col(c)) > cap, F.concat(note, F.left(_col(c), F.lit(cap - 30)))).otherwise(_col(c))


def fingerprint(c: Column | str) -> Column:
    """djb2 modulo 2^32 of the squeezed text, 8 hex digits; 'empty' for nothing."""
    return F.arrow_udf(_djb2, "string")(squeeze(c))


#: Powers of 33 modulo 2^32; texts are taken so many code points at a time.
_POWERS = np.multiply.accumulate(np.array([1] + [33] * 65_536, np.uint32))


def _djb2(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts:
        codes, h = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32), 5381
        for lo in range(0, len(codes), len(_POWERS) - 1):
            some = codes[lo : lo + len(_POWERS) - 1]
            part = int((some * _POWERS[: len(some)][::-1]).sum(dtype=np.uint32))
            h = (h * int(_POWERS[len(some)]) + part) % 4294967296
        out.append(f"{h:08x}" if len(codes) else "empty")
    return pa.array(out, pa.string())


# --- classes, selectors, field names -------------------------------------------------

#: Class names that frameworks generate.
FRAMEWORK_CLASSES = (
    r"(?i)^(_ng|_nghost|_ngcontent|data-v-)",
    r"(?i)^(css-|sc-|styled-|StyledComponent__)",
    r"(?i)^_?(?=[a-z0-9]{6,}$)(?=.*\d)(?=.*[a-z])[a-z0-9]+$",
)
#: Generated classes and positions in selectors.
AUTO_CLASS = r"(?i)\.(?=x[0-9a-z]{4,}|_[a-z0-9]+|html-)[a-zA-Z0-9_-]+"
NTH = r":nth-(?:of-type|child)\(\d+\)"
#: Name endings of field types, in the order they are tried.
FIELD_TYPES = (
    ("time-like", r"(?i)time$|date$|created|published|updated"),
    ("count-like", r"(?i)count$|likes$|shares$|comments$|reactions$|views$|downloads$"),
    ("url-like", r"(?i)url$|link$|href$|profile$"),
    ("id-like", r"(?i)id$"),
)
#: Signs of an element that stands for one item of a list.
ITEM_SIGNS = (
    r"(?i)\[role=", r"(?i)\[aria-posinset\b", r"(?i)\[data-item", r"(?i)\[data-index", r"(?i)\[data-row",
    r"(?i)\[data-testid", r"(?i)\[data-cid", r"(?i)\[data-id", r"(?i)^(li|tr|option)\b",
    r"(?i)(?:^|[\s'.])(?:item|post|card|row|entry|result|product)-?\d", r"#[a-zA-Z_-]*\d",
)


def filter_classes(c: Column | str) -> Column:
    tokens = F.filter(F.split(_col(c), f"[{BLANKS}]+"), lambda t: t != "")
    noise = lambda t: reduce(lambda a, b: a | b, [t.rlike(p) for p in FRAMEWORK_CLASSES])
    return F.coalesce(F.array_join(F.filter(tokens, lambda t: ~noise(t)), " "), F.lit(""))


def strip_positional(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), NTH, "")


def stable_signature(c: Column | str) -> Column:
    return F.regexp_replace(strip_positional(c), AUTO_CLASS, "")


def normal_segment(c: Column | str) -> Column:
    """A path segment with what tells one list item from another taken out."""
    s = F.regexp_replace(_col(c), r"""\[([a-zA-Z-]+)=(?:"[^"]*"|'[^']*'|[^\]]+)\]""", "[$1]")
    s = F.regexp_replace(s, r"#[a-zA-Z_-]*\d[\w-]*", "[id]")
    return strip_positional(F.regexp_replace(s, r"\.([a-zA-Z]+)(-?)\d[\w-]*", ".$1$2"))


def item_like(c: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).rlike(p) for p in ITEM_SIGNS])


def field_type(name: Column | str) -> Column:
    last = F.element_at(F.split(_col(name), r"\."), -1)
    out = F.when(_col(name).isNull() | (_col(name) == ""), F.lit("text-like"))
    for kind, pattern in FIELD_TYPES:
        out = out.when(last.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit("text-like"))


def brittleness(selector: Column | str) -> Column:
    """Points for what makes a selector break: positions 35 each, a chain of more than 12
    (25) or 8 (15) segments, generated classes 20, no anchor 10, bare segments 5 each."""
    s = _col(selector)
    # fixed values: patterns and points
    nth = F.regexp_count(s, F.lit(r":nth-of-type\(\d+\)"))
    segments = F.size(F.filter(F.split(s, ">"), lambda x: trim(x) != ""))
    length = F.when(segments > 12, 25).when(segments > 8, 15).otherwise(0)
    generated = F.when(s.rlike(r"(?i)\.x[0-9a-f]+\b|\._[a-z0-9]+\b"), 20).otherwise(0)
    loose = F.when(~s.rlike(r"\[role=|\[aria-|\[data-|#\w") & (segments > 1) & (nth == 0), 10).otherwise(0)
    bare = F.regexp_count(s, F.lit(r">\s*[a-z]+\s*>"))
    return F.when(s.isNull() | (s == ""), F.lit(0)).otherwise(nth * 35 + length + generated + loose + bare * 5).cast("long")


def chain_brittleness(selectors: Column | str) -> Column:
    """struct(score, selector) of the worst of a list of selectors, the first of equal ones; a
    chain without points has no selector."""
    each = F.transform(_col(selectors), lambda s: F.struct(F.coalesce(brittleness(s), F.lit(0).cast("long")).alias("score"), s.alias("selector")))
    none = F.struct(F.lit(0).cast("long").alias("score"), F.lit(None).cast("string").alias("selector"))
    return F.aggregate(each, none, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))


# --- scripts and answers -------------------------------------------------------------


def time_budget(script: Column | str) -> Column:
    """Milliseconds of the literal waits of a script."""
    found = F.regexp_extract_all(_col(script), F.lit(r"(?:setTimeout\([^,()]*,\s*|sleep\(|\$wait\(|\$exists\([^,()]*,\s*)(\d+)"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


#: How an answer begins that is code as it stands.
CODE_START = r"^(?:[{\[]|//|(?:const|let|return|async|await) )"
JSON_LIKE = r"(?s)\{.*\}|\[.*\]"


def fenced(answer: Column | str) -> Column:
    """The last code block that isn't blank, closed or not. Without one: the answer without
    its first // ACK or // NACK line, if it begins as code or holds nothing like JSON; else
    what looks like JSON in it."""
    body = trim(F.regexp_replace(_col(answer), r"^\s*//\s*N?ACK:[^\n]*\n?", ""))
    pattern = "(?s)```[A-Za-z]*[ \\t]*\\r?\\n?(.*?)(?:\\r?\\n?```|\\z)"
    blocks = F.filter(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda b: trim(b) != "")
    whole = body.rlike(CODE_START) | ~body.rlike(JSON_LIKE)
    return F.when(F.size(blocks) > 0, trim(F.element_at(blocks, -1))).when(whole, body).otherwise(F.regexp_extract(body, JSON_LIKE, 0))
