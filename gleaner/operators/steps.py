"""Step graphs as tables: validation, verdicts and topology rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import time_budget
from gleaner.sources import store

TERMINATE = "TERMINATE"


#: Steps of a graph up to which it is walked as an array; larger ones are joined.
SHORT = 64


def _parted(steps: DataFrame, graph: str, short: int) -> tuple[DataFrame, DataFrame | None, int]:
    """The steps of graphs of up to `short` steps, those of larger ones (None if there are none),
    and the most steps of one. Sizes are counts; only the graphs that are too large are joined."""
    large = steps.groupBy(graph).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > short)
    most = large.agg(F.max("_n")).first()[0]
    if most is None:
        return steps, None, 0
    large = store.kept(large.select(graph), "large")
    return steps.join(large, graph, "left_anti"), steps.join(large, graph, "left_semi"), most


def reachable(steps: DataFrame, graph: str = "graph", short: int = SHORT) -> DataFrame:
    """(graph, id) of what can be reached from each graph's first step (least ordinal), pointers
    to nowhere included. Graphs of up to `short` steps are walked in place; others by joins."""
    small, large, most = _parted(steps, graph, short)
    found = small.groupBy(graph).agg(_ordered("id", "on_success", "on_failure")).select(graph, F.explode(_reached()).alias("id"))
    return found if large is None else found.unionByName(_joined(large, graph, most))


def _ordered(*columns: Column | str) -> Column:
    """`_e`: a graph's steps in their order, one array."""
    return F.array_sort(F.collect_list(F.struct("ordinal", *columns))).alias("_e")


def _reached() -> Column:
    """Ids that can be reached in the graph `_e`. Pointers ahead are followed by going through
    the steps once; if that isn't all, as some lead back, as often as there are steps."""
    to = lambda e: F.filter(F.array(e["on_success"], e["on_failure"]), lambda x: x.isNotNull() & (x != TERMINATE))
    known = lambda seen, e: F.coalesce(F.array_contains(seen, e["id"]), F.lit(False))
    through = lambda seen: F.aggregate("_e", seen, lambda seen, e: F.when(known(seen, e), F.array_union(seen, to(e))).otherwise(seen))
    once = through(F.slice(F.transform("_e", lambda e: e["id"]), 1, 1))

    def all_of(seen: Column) -> Column:
        closed = F.forall("_e", lambda e: ~known(seen, e) | (F.size(F.array_except(to(e), seen)) == 0))
        return F.when(closed, seen).otherwise(F.aggregate(F.sequence(F.lit(1), F.size("_e")), seen, lambda seen, _: through(seen)))

    return F.transform(F.array(once), all_of)[0]


def _joined(steps: DataFrame, graph: str, most: int) -> DataFrame:
    """Each kind of pointer leads a step to one other, so who is 1, 2, 4 ... such pointers away
    is found by joining the table with itself, and all that follow some steps are found by a
    join with each of these. Both kinds take turns until nothing is new: the rounds are as
    many as the way changes its kind, however long it is. A hop of a chain is no round."""
    levels = max(int(most).bit_length(), 1)
    hops = {}
    for kind in ("on_success", "on_failure"):
        hop = store.kept(steps.where(F.col(kind).isNotNull() & (F.col(kind) != TERMINATE)).select(graph, "id", F.col(kind).alias("to")).distinct(), "hop")
        hops[kind] = []
        for level in range(levels):
            hops[kind].append(hop)
            if level + 1 < levels:
                hop = store.kept(hop.join(hop.select(graph, F.col("id").alias("to"), F.col("to").alias("_to")), [graph, "to"]).select(graph, "id", F.col("_to").alias("to")).distinct(), "hop")
                if not hop.take(1):
                    break
    first = steps.groupBy(graph).agg(F.min_by("id", "ordinal").alias("id"))
    found, count, quiet, turn = store.kept(first, "reached"), 0, 0, 0
    while quiet < 2:
        kind = ("on_success", "on_failure")[turn % 2]
        more = found
        for hop in hops[kind]:  # each used once, so the plan is a line
            near = more.join(hop, [graph, "id"], "left")
            more = near.select(graph, F.explode(F.array_compact(F.array("id", "to"))).alias("id")).distinct()
        found, before = store.kept(more, "reached"), count
        count = found.count()
        quiet, turn = (quiet + 1 if turn and count == before else 0), turn + 1
    return found


def problems(steps: DataFrame, graph: str = "graph", short: int = SHORT) -> DataFrame:
    """(graph, id, problem) rows: repeated ids, no script, bad iteration counts, pointers
    to nowhere or to SELF, and steps that can't be reached. Graphs of up to `short` steps
    are gathered once and judged as arrays; others by joins."""
    small, large, most = _parted(steps, graph, short)
    blank, bad = F.coalesce(F.trim("script"), F.lit("")) == "", F.coalesce(F.col("max_iterations") < 1, F.lit(False))
    one = small.groupBy(graph).agg(_ordered("id", "on_success", "on_failure", blank.alias("blank"), bad.alias("bad")))
    one = one.select(graph, "_e", F.transform("_e", lambda e: e["id"]).alias("_ids"), _reached().alias("_seen"))

    def told(e: Column) -> Column:
        pointer = lambda c: e[c].isNotNull() & ~e[c].isin(TERMINATE, "SELF") & ~F.coalesce(F.array_contains("_ids", e[c]), F.lit(False))
        return F.array_compact(F.array(
            F.when(F.size(F.filter("_ids", lambda x: x.eqNullSafe(e["id"]))) > 1, "DUPLICATE_ID"), F.when(e["blank"], "NO_SCRIPT"), F.when(e["bad"], "BAD_ITERATIONS"),
            F.when((e["on_success"] == "SELF") | (e["on_failure"] == "SELF"), "SELF_POINTER"), F.when(pointer("on_success") | pointer("on_failure"), "DANGLING_POINTER"),
            F.when(~F.coalesce(F.array_contains("_seen", e["id"]), F.lit(False)), "UNREACHABLE"),
        ))

    each = F.flatten(F.transform("_e", lambda e: F.transform(told(e), lambda p: F.struct(e["id"].alias("id"), p.alias("problem")))))
    found = one.select(graph, F.inline(F.array_distinct(each)))
    return found if large is None else found.unionByName(_problems_joined(large, graph, most))


def _problems_joined(steps: DataFrame, graph: str, most: int) -> DataFrame:
    w = Window.partitionBy(graph, "id")
    own = steps.select(graph, "id", "script", "max_iterations", "on_success", "on_failure", F.count(F.lit(1)).over(w).alias("_n"))
    flags = F.array(
        F.when(F.col("_n") > 1, F.lit("DUPLICATE_ID")),
        F.when(F.coalesce(F.trim("script"), F.lit("")) == "", F.lit("NO_SCRIPT")),
        F.when(F.col("max_iterations") < 1, F.lit("BAD_ITERATIONS")),
        F.when((F.col("on_success") == "SELF") | (F.col("on_failure") == "SELF"), F.lit("SELF_POINTER")),
    )
    local = own.select(graph, "id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("problem"))
    edges = steps.select(graph, "id", F.explode(F.array("on_success", "on_failure")).alias("dst")).where(f"dst is not null and dst not in ('{TERMINATE}', 'SELF')")
    lost = edges.join(steps.select(graph, F.col("id").alias("dst")), [graph, "dst"], "left_anti").select(graph, "id", F.lit("DANGLING_POINTER").alias("problem"))
    apart = steps.select(graph, "id").join(_joined(steps, graph, most), [graph, "id"], "left_anti").select(graph, "id", F.lit("UNREACHABLE").alias("problem"))
    return local.union(lost).union(apart).distinct()


def boosted(steps: DataFrame, graph: str = "graph", least: int = 30) -> DataFrame:
    """A success pointer to an earlier step lets every step in between run again: those
    whose iterations are unset or 1 get `least`."""
    place = steps.select(graph, F.col("id").alias("on_success"), F.col("ordinal").alias("_to"))
    back = steps.select(graph, "ordinal", "on_success").join(place, [graph, "on_success"]).where("_to < ordinal")
    spans = back.select(graph, F.explode(F.sequence("_to", "ordinal")).alias("ordinal")).distinct().withColumn("_b", F.lit(True))
    out = steps.join(spans, [graph, "ordinal"], "left")
    unset = F.coalesce("max_iterations", F.lit(1)) == 1
    return out.withColumn("max_iterations", F.when(F.col("_b") & unset, least).otherwise(F.coalesce("max_iterations", F.lit(1)))).drop("_b")


#: A step's script until it is annotated, keys by which a script says that it
#: isn't ready yet, and the iterations of a step that says so and has none set.
PENDING = "// PENDING_ANNOTATION"
SIGNAL = r"\b(done|ready|complete|finished|responseReady|generating|loading)\s*:"
POLLS = 30


def execution_notes(steps: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, id, note): steps without a script of their own, which keep a graph from running,
    and steps that may run again but whose script never says that it isn't ready."""
    script = F.coalesce(F.trim("script"), F.lit(""))
    notes = F.array(
        F.when(script.isin("", PENDING), F.lit("PENDING_ANNOTATION")),
        F.when((F.coalesce("max_iterations", F.lit(1)) > 1) & ~script.isin("", PENDING) & ~script.rlike(SIGNAL), F.lit("NO_SIGNAL")),
    )
    return steps.select(graph, "id", F.explode(F.array_compact(notes)).alias("note"))


#: Fixed value: milliseconds that a step may wait before its time is out.
STEP_TIMEOUT = 30_000


def verdicts(steps: DataFrame, graph: str = "graph", short: int = SHORT) -> DataFrame:
    """(graph, valid, step, error, warnings): one row for each graph. The error told is the first:
    steps in their order, each by its id, script, repetition and iterations; then steps
    that wait for their annotation; then pointers, step by step; then steps that nothing
    leads to. Only graphs that may run have warnings: waits longer than a step has time for,
    and polls whose script never says that they aren't ready. Graphs of up to `short` steps
    are gathered once and judged as arrays; others by joins."""
    small, large, most = _parted(steps, graph, short)
    script, no = F.coalesce(F.trim("script"), F.lit("")), F.lit(False)
    flags = {
        "blank": script == "", "pending": script == PENDING, "bad": F.coalesce(F.col("max_iterations") < 1, no), "late": F.coalesce(time_budget("script") > STEP_TIMEOUT, no),
        "silent": F.coalesce((F.coalesce("max_iterations", F.lit(1)) > 1) & ~F.col("script").rlike(SIGNAL), no),
    }
    one = small.groupBy(graph).agg(_ordered("id", "on_success", "on_failure", *[c.alias(k) for k, c in flags.items()]))
    one = one.select(graph, "_e", F.transform("_e", lambda e: e["id"]).alias("_ids"), _reached().alias("_seen"))

    def first(e: Column, i: Column) -> Column:
        """A step's errors of each phase, the first of them; `check` orders those of one step."""
        lost = lambda c: e[c].isNotNull() & ~e[c].isin("", TERMINATE, "SELF") & ~F.coalesce(F.array_contains("_ids", e[c]), no)
        again = F.exists(F.slice("_ids", 1, i), lambda x: x.eqNullSafe(e["id"]))
        phases = [
            F.when(F.coalesce(e["id"], F.lit("")) == "", "NO_ID").when(e["blank"], "NO_SCRIPT").when(again, "DUPLICATE_ID").when(e["bad"], "BAD_ITERATIONS"),
            F.when(e["pending"], "PENDING_ANNOTATION"),
            F.when(e["on_success"] == "SELF", "SELF_POINTER").when(lost("on_success"), "DANGLING_POINTER").when(e["on_failure"] == "SELF", "SELF_POINTER").when(lost("on_failure"), "DANGLING_POINTER"),
            F.when(~F.coalesce(F.array_contains("_seen", e["id"]), no), "UNREACHABLE"),
        ]
        tell = lambda k, c: F.when(c.isNotNull(), F.struct(F.lit(k).alias("phase"), e["ordinal"].alias("ordinal"), e["id"].alias("step"), c.alias("error")))
        return F.coalesce(*[tell(k, c) for k, c in enumerate(phases)])

    # the least phase of a step comes before its others, so the least of all is the graph's
    out = one.select(graph, "_e", F.array_min(F.transform("_e", first)).alias("_f"))
    named = lambda flag, said: F.transform(F.filter("_e", lambda e: e[flag] & e["id"].isNotNull()), lambda e: F.concat(F.lit(said), e["id"]))
    warned = F.when(F.col("_f").isNull(), F.concat(named("late", "LONG_DELAY:"), named("silent", "NO_SIGNAL:"))).otherwise(F.array().cast("array<string>"))
    found = out.select(graph, F.col("_f").isNull().alias("valid"), "_f.step", "_f.error", warned.alias("warnings"))
    return found if large is None else found.unionByName(_verdicts_joined(large, graph, most))


def _verdicts_joined(steps: DataFrame, graph: str, most: int) -> DataFrame:
    script = F.coalesce(F.trim("script"), F.lit(""))
    own = steps.select(graph, "id", "ordinal", "script", "max_iterations", "on_success", "on_failure").withColumn("_s", script)
    own = own.withColumn("_again", F.row_number().over(Window.partitionBy(graph, "id").orderBy("ordinal")) > 1)
    known = steps.select(graph, F.col("id").alias("_to"), F.lit(True).alias("_there")).distinct()

    def lost(c: str) -> DataFrame:
        to = own.where(F.col(c).isNotNull() & ~F.col(c).isin("", TERMINATE, "SELF")).withColumn("_to", F.col(c))
        return to.join(known, [graph, "_to"], "left_anti").select(graph, "id", "ordinal", F.lit(2).alias("phase"), F.lit(1 if c == "on_success" else 3).alias("check"), F.lit("DANGLING_POINTER").alias("error"))

    tell = lambda phase, check, what, code: F.when(what, F.struct(F.lit(phase).alias("phase"), F.lit(check).alias("check"), F.lit(code).alias("error")))
    local = [
        tell(0, 0, F.coalesce(F.col("id"), F.lit("")) == "", "NO_ID"), tell(0, 1, F.col("_s") == "", "NO_SCRIPT"), tell(0, 2, F.col("_again"), "DUPLICATE_ID"),
        tell(0, 3, F.col("max_iterations") < 1, "BAD_ITERATIONS"), tell(1, 0, F.col("_s") == PENDING, "PENDING_ANNOTATION"),
        tell(2, 0, F.col("on_success") == "SELF", "SELF_POINTER"), tell(2, 2, F.col("on_failure") == "SELF", "SELF_POINTER"),
    ]
    errors = own.select(graph, "id", "ordinal", F.inline(F.array_compact(F.array(*local)))).unionByName(lost("on_success")).unionByName(lost("on_failure"))
    apart = own.select(graph, "id", "ordinal").join(_joined(steps, graph, most), [graph, "id"], "left_anti")
    errors = errors.unionByName(apart.select(graph, "id", "ordinal", F.lit(3).alias("phase"), F.lit(0).alias("check"), F.lit("UNREACHABLE").alias("error")))
    first = errors.groupBy(graph).agg(F.min_by(F.struct(F.col("id").alias("step"), "error"), F.struct("phase", "ordinal", "check")).alias("_e"))
    late = F.when(time_budget("script") > STEP_TIMEOUT, F.concat(F.lit("LONG_DELAY:"), "id"))
    silent = F.when((F.coalesce("max_iterations", F.lit(1)) > 1) & ~F.col("script").rlike(SIGNAL), F.concat(F.lit("NO_SIGNAL:"), "id"))
    told = own.select(graph, F.inline(F.array(F.struct(F.lit(0).alias("_k"), "ordinal", late.alias("_w")), F.struct(F.lit(1).alias("_k"), "ordinal", silent.alias("_w")))))
    listed = told.groupBy(graph).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_w").isNotNull(), F.struct("_k", "ordinal", "_w")))), lambda x: x["_w"]).alias("_w"))
    out = listed.join(first, graph, "left").withColumn("valid", F.col("_e").isNull())
    return out.select(graph, "valid", "_e.step", "_e.error", F.when(F.col("valid"), F.col("_w")).otherwise(F.array().cast("array<string>")).alias("warnings"))


def with_defaults(steps: DataFrame) -> DataFrame:
    """steps whose iterations are unset and whose script has a signal run up to POLLS times."""
    unset = F.col("max_iterations").isNull() & F.coalesce(F.col("script").rlike(SIGNAL), F.lit(False))
    return steps.withColumn("max_iterations", F.when(unset, POLLS).otherwise(F.col("max_iterations")))


def appended(steps: list[dict], new: dict) -> list[dict]:
    """A step added at the end: what ended the chain by success now leads to it."""
    out = [dict(s) for s in steps]
    if out and out[-1].get("on_success") in (None, TERMINATE):
        out[-1]["on_success"] = new["id"]
    return [*out, {"on_success": TERMINATE, "on_failure": TERMINATE, **new}]


def removed(steps: list[dict], step_id: str) -> list[dict]:
    """A step taken out: pointers to it lead where it led."""
    gone = next(s for s in steps if s["id"] == step_id)
    after = gone.get("on_success") or TERMINATE
    after = TERMINATE if after == step_id else after
    moved = lambda p: after if p == step_id else p
    return [{**s, "on_success": moved(s.get("on_success")), "on_failure": moved(s.get("on_failure"))} for s in steps if s["id"] != step_id]


def added(steps: DataFrame, new: DataFrame, graph: str = "graph") -> DataFrame:
    """Tables of steps with one more step at the end of each graph that `new` names (a row
    each); what ended a graph by success leads to it. Unset values get defaults, an unset
    id is step-N, N the first free number after the number of steps. Graphs that aren't
    there get nothing. `new` has the columns of `steps` but for ordinal."""
    known = steps.groupBy(graph).agg(F.count(F.lit(1)).alias("_n"), F.max("ordinal").alias("_last"), F.collect_set("id").alias("_ids"))
    own = new.join(known, graph)
    free = F.filter(F.transform(F.sequence(F.col("_n") + 1, 2 * F.col("_n") + 1), lambda i: F.concat(F.lit("step-"), i.cast("string"))), lambda x: ~F.array_contains("_ids", x))
    or_else = lambda c, value: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))
    own = own.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), free[0])).withColumn("script", F.coalesce("script", F.lit("")))
    own = own.withColumn("on_success", or_else("on_success", TERMINATE)).withColumn("on_failure", or_else("on_failure", TERMINATE))
    own = own.withColumn("max_iterations", F.coalesce(F.nullif("max_iterations", F.lit(0)), F.lit(1))).withColumn("ordinal", F.col("_last") + 1)
    ends = own.select(graph, F.col("_last").alias("ordinal"), F.col("id").alias("_next"))
    linked = F.col("_next").isNotNull() & (F.coalesce("on_success", F.lit(TERMINATE)) == TERMINATE)
    old = steps.join(ends, [graph, "ordinal"], "left").withColumn("on_success", F.when(linked, F.col("_next")).otherwise(F.col("on_success")))
    return old.select(steps.columns).union(own.select(steps.columns))


def deleted(steps: DataFrame, gone: DataFrame, graph: str = "graph") -> DataFrame:
    """Tables of steps without those that `gone` (graph, id; one a graph) names; pointers to
    one lead where it led by success. Steps that aren't there change nothing. Changed
    steps are `answers.restored`, given a table of new values."""
    ends = F.when(F.col("on_success") == F.col("id"), F.lit(TERMINATE)).otherwise(F.coalesce("on_success", F.lit(TERMINATE)))
    out = steps.join(gone.select(graph, "id"), [graph, "id"], "left_semi").select(graph, F.col("id").alias("_gone"), ends.alias("_after"))
    moved = lambda c: F.when(F.col(c) == F.col("_gone"), F.col("_after")).otherwise(F.col(c))
    left = steps.join(out, graph, "left").where("_gone is null or id <> _gone")
    return left.withColumn("on_success", moved("on_success")).withColumn("on_failure", moved("on_failure")).select(steps.columns)


def condition(expression: str) -> Column:
    """A step's row condition: an expression that fails to be true is false."""
    return F.coalesce(F.expr(expression), F.lit(False))
