"""Columns over scripts, patches and loosely written JSON."""

from __future__ import annotations

import json
from collections import Counter
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import trim

#: Ways a script leaves its page, in the order they are looked for.
NAVIGATION = (
    r"\bwindow\s*\.\s*location\s*\.\s*href\s*=", r"\bwindow\s*\.\s*location\s*\.\s*replace\s*\(", r"\bwindow\s*\.\s*location\s*\.\s*assign\s*\(",
    r"\bwindow\s*\.\s*location\s*=[^=]", r"\blocation\s*\.\s*href\s*=", r"\blocation\s*\.\s*replace\s*\(", r"\blocation\s*\.\s*assign\s*\(",
)
STRING = r'"(?:\\.|[^"\\])*"'


#: Keys whose values are code, which may hold quotes that nobody escaped.
CODE_KEYS = ("script", "functionBody", "expression", "code", "condition")
_CODE = rf"""(?:"(?:{"|".join(CODE_KEYS)})"|(?<![\w$"'.])(?:{"|".join(CODE_KEYS)}))\s*:\s*\""""


def navigation(script: str) -> Column:
    """The first forbidden navigation in a script, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(script, p, 0), F.lit("")) for p in NAVIGATION])


def without_comments(text: str | Column) -> Column:
    """Comments outside of JSON strings are taken out."""
    return F.regexp_replace(text, rf"({STRING})|//[^\n]*\n?|/\*(?s:.*?)(?:\*/|$)", "$1")


def code_escaped(text: Column) -> Column:
    """Quotes inside of the values of CODE_KEYS are escaped. Such a value ends at the first
    quote that a comma, a closing bracket or the end of the text follows, outside of the
    code's own brackets if there is one; a value without an end is left alone."""
    opening, mark, after = re.compile(_CODE), re.compile(r'\\.|["()\[\]{}]', re.S), re.compile(r"\s*(?:[,}\]]|$)")
    bare = re.compile(r'(\\.)|"', re.S)

    def end(s: str, at: int) -> int | None:
        depth, first = 0, None
        for m in mark.finditer(s, at):
            c = m[0]
            if c == '"' and after.match(s, m.end()):
                if not depth:
                    return m.start()
                first = m.start() if first is None else first
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(depth - 1, 0)
        return first

    def put(s: str) -> str:
        out, done = [], 0
        while (m := opening.search(s, done)) is not None:
            stop = end(s, m.end())
            stop = m.end() if stop is None else stop
            out += [s[done : m.end()], bare.sub(lambda q: q[1] or '\\"', s[m.end() : stop])]
            done = stop
        return "".join([*out, s[done:]])

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else put(x) for x in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def lenient_json(text: str | Column) -> Column:
    """Valid JSON text from a nearly valid one, or null: comments, single quotes, bare
    keys, missing, doubled and trailing commas and quotes within code are put right, other
    strings left alone."""
    given = F.col(text) if isinstance(text, str) else text
    valid = lambda c: F.try_parse_json(c).isNotNull()
    keep = lambda c, pattern, new: F.regexp_replace(c, rf"({STRING})|{pattern}", new)
    s = without_comments(F.coalesce(code_escaped(F.when(~valid(given) & given.rlike(_CODE), given)), given))
    s = keep(s, r"'((?:[^'\"\\]|\\.)*)'", "$1<q>$2<q>")
    s = F.replace(F.replace(s, F.lit("<q><q>"), F.lit("")), F.lit("<q>"), F.lit('"'))
    s = keep(s, r"(?<=[{,\s])([A-Za-z_$][\w$]*)(?=\s*:)", "$1<q>$2<q>")
    s = F.replace(F.replace(s, F.lit("<q><q>"), F.lit("")), F.lit("<q>"), F.lit('"'))
    s = keep(s, r"(,)(?:\s*,)+", "$1$2")
    s = F.regexp_replace(s, rf"({STRING}|\d|true|false|null|\}}|\])(\s*\n\s*)(?=\")", "$1,$2")
    s = keep(s, r",(\s*[}\]])", "$1$2")
    # s is long: as an array's only item it is made once, for rows that need it
    return F.when(valid(given), given).otherwise(F.transform(F.array(s), lambda x: F.when(valid(x), x))[0])


def _parts(text: str) -> dict[tuple, tuple]:
    """A JSON value as a table: path -> (kind, size or value), outer ones first. Numbers are
    one kind, truth values another."""
    out, todo = {}, [((), json.loads(text))]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict | list):
            inner = x.items() if isinstance(x, dict) else enumerate(x)
            out[path] = (type(x).__name__, len(x))
            todo += [((*path, k), v) for k, v in inner]
        else:
            out[path] = ("number" if isinstance(x, int | float) and not isinstance(x, bool) else type(x).__name__, x)
    return out


def predecessor(a: str, b: str) -> Column:
    """Whether JSON value a is an earlier stage of b: objects with a's members, arrays of
    one length with four of five such items, or equal values. Both become tables of their
    paths; from the inmost outwards, each part of a that b has counts for what holds it."""

    def earlier(x: dict[tuple, tuple], y: dict[tuple, tuple]) -> bool:
        met: Counter = Counter()
        for path in sorted(x, key=len, reverse=True):
            (kind, size), (other, same) = x[path], y.get(path, (None, None))
            fits = kind == other
            if kind == "dict":  # the other may have more members
                fits = fits and met[path] == size
            else:
                fits = fits and size == same and (kind != "list" or 5 * met[path] >= 4 * size)
            met[path[:-1] if path else None] += fits
        return met[None] == 1

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else earlier(_parts(p), _parts(q)) for p, q in pairs], pa.bool_())

    return F.arrow_udf(run, "boolean")(a, b)


def elided(step: str, final: str) -> Column:
    """A step's result, or a note if the final result has all of it."""
    same, part = F.lit("[elided: the final result]"), F.lit("[elided: an earlier stage of the final result]")
    return F.when(F.col(step) == F.col(final), same).when(predecessor(step, final), part).otherwise(F.col(step))


def first_link(text: str) -> Column:
    """The first link in a JSON value: a string that begins with http, or the href, link
    or url of a list's item, down to depth 3."""

    def find(x, depth=0):
        if depth > 3 or not isinstance(x, (dict, list)):
            return None
        values = list(x.values()) if isinstance(x, dict) else x
        for v in [x, *values] if isinstance(x, list) else values:
            if isinstance(v, str) and v.startswith("http"):
                return v
            if isinstance(v, list):
                links = (i.get(k) for i in v if isinstance(i, dict) for k in ("href", "link", "url"))
                hit = next((y for y in links if isinstance(y, str) and y), None)
            else:
                hit = find(v, depth + 1) if isinstance(v, dict) else None
            if hit:
                return hit
        return None

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else find(json.loads(t)) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def same_patch(old_script: str, new_script: str, old_flow: Column, new_flow: Column) -> Column:
    """A patch that changes nothing."""
    return (trim(old_script) == trim(new_script)) & old_flow.eqNullSafe(new_flow)


def resolved_patches(patches: DataFrame, steps: DataFrame, run: list[str], fallback: str) -> DataFrame:
    """Each patch with the step it's for: the one it names, or the fallback if it names
    none or one that isn't there; a second patch for a step is an error."""
    known = steps.select(*run, F.col("id").alias("_known"))
    named = patches.join(known, [*[patches[c] == known[c] for c in run], F.trim(patches["step_id"]) == known["_known"]], "left").select(patches["*"], "_known")
    target = F.coalesce("_known", fallback)
    w = Window.partitionBy(*run, "target").orderBy("ordinal")
    out = named.withColumn("target", target).withColumn("redirected", F.col("_known").isNotNull() & (F.col("_known") != F.col(fallback)))
    return out.withColumn("problem", F.when(F.row_number().over(w) > 1, F.lit("DUPLICATE_CLAIM")).when(F.col("_known").isNull() & F.col("step_id").isNotNull(), F.lit("UNKNOWN_STEP"))).drop("_known")


def restored(steps: DataFrame, best: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Steps with the values of the best attempt's snapshot; steps that aren't there any
    more are dropped, new ones stay as they are."""
    side = best.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = steps.join(side, key, "left")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}"), columns, out)


def producer(steps: DataFrame, run: list[str], pattern: str, before: Column) -> DataFrame:
    """The last step before a place whose script matches."""
    return steps.where(F.col("script").rlike(pattern) & (F.col("ordinal") < before)).groupBy(*run).agg(F.max_by("id", "ordinal").alias("producer"))


#: What a frame's selector begins with, and what stands between.
FRAME, BETWEEN = "iframe", "::"


def frames(selector: str) -> Column:
    """struct(frames, inner) of selectors such as iframe#a::iframe[name="b"]::td::before: what
    leads through frames, and the rest as it is."""
    parts = F.split(selector, BETWEEN)
    inside = F.transform(parts, lambda p: p.startswith(FRAME) & (F.length(p) > len(FRAME)))
    end = F.array_position(inside, False)
    n = F.when(end > 0, end - 1).otherwise(F.size(parts)).cast("int")
    return F.struct(F.slice(parts, F.lit(1), n).alias("frames"), F.array_join(F.slice(parts, n + 1, F.size(parts)), BETWEEN).alias("inner"))


def framed(chain: Column, inner: Column) -> Column:
    """The selector that `frames` takes apart; a missing part has no separator."""
    return F.array_join(F.filter(F.concat(chain, F.array(inner)), lambda p: F.coalesce(p, F.lit("")) != ""), BETWEEN)


#: Calls of a script that read lists of records, and those that read anything.
EXTRACTING = r"\$(extractList|extractListMulti|extractWithHover|list)\s*\("
PRODUCING = r"\$(hover|extract|extractList|extractListMulti|list)\s*\("


def upstream(steps: DataFrame, run: list[str], fallback: DataFrame, pattern: str = EXTRACTING) -> DataFrame:
    """(run, step): for each run of `fallback` (run, id) its last step whose script makes such a
    call, else the step given there."""
    found = steps.where(F.col("script").rlike(pattern)).groupBy(*run).agg(F.max_by("id", "ordinal").alias("_found"))
    return fallback.join(found, run, "left").select(*run, F.coalesce("_found", "id").alias("step"))


def no_op_fixes(patches: DataFrame, steps: DataFrame, fix: list[str], run: list[str]) -> DataFrame:
    """(fix, no_op): whether none of a fix's patches changes its step's script (white space at
    its ends aside), pointers or iterations. A patch for a step that isn't there is no
    no-op, and takes its fix with it."""
    columns = ("script", "on_success", "on_failure", "max_iterations")
    now = steps.select(*run, F.col("id").alias("step_id"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    often = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1))
    same = (trim(text("script")) == trim(text("_script"))) & (text("on_success") == text("_on_success")) & (text("on_failure") == text("_on_failure")) & (often("max_iterations") == often("_max_iterations"))
    return patches.join(now, [*run, "step_id"], "left").groupBy(*fix).agg(F.bool_and(F.coalesce(F.col("_there") & same, F.lit(False))).alias("no_op"))
