"""Order-dependent views of runs, events and conversations, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import trim
from gleaner.operators.places import numbered, summed


def last_per_step(rows: DataFrame, run: list[str], step: str, order: str) -> DataFrame:
    """The last row of each step, with the place of the step's first one. Null steps are
    one step. Two aggregates, no sort of a run."""
    names = [c for c in rows.columns if c not in (*run, step)]
    out = rows.groupBy(*run, step).agg(F.max_by(F.struct(*names), order).alias("_last"), F.min(order).alias("first_seen"))
    return out.select(*run, step, "first_seen", "_last.*")


def runs(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: (value, run, n, first, last)."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w))
    return marked.groupBy(*key, "run", value).agg(F.count(F.lit(1)).alias("n"), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"))


def streak(value: str, key: list[str], order: list[str]) -> Column:
    """Samples in a row that are equal, this one included (null is equal to nothing)."""
    w = Window.partitionBy(*key).orderBy(*order)
    n = F.row_number().over(w)
    return n, F.when(F.col(value).isNull() | (F.lag(value).over(w) != F.col(value)) | F.lag(value).over(w).isNull(), n)


def stable_at(rows: DataFrame, key: list[str], order: list[str], value: str, equal: int) -> DataFrame:
    """Where a key's samples first were the same `equal` times in a row."""
    n, start = streak(value, key, order)
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("_n", n).withColumn("_s", start)
    marked = marked.withColumn("_run", F.col("_n") - F.max("_s").over(w) + 1)
    done = marked.where(F.col(value).isNotNull() & (F.col("_run") >= equal))
    out = done.groupBy(*key).agg(F.min("_n").cast("long").alias("settled_at"))
    return rows.select(*key).distinct().join(out, key, "left").withColumn("settled", F.col("settled_at").isNotNull())


def gaps(rows: DataFrame, key: list[str], time: str, limit: float) -> DataFrame:
    """Sessions of a key's events that are parted by more than `limit` seconds."""
    w = Window.partitionBy(*key).orderBy(time)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    late = (micros(F.col(time)) - micros(F.lag(time).over(w)) > int(limit * 1_000_000)).cast("int")
    marked = rows.withColumn("_l", F.coalesce(late, F.lit(0))).withColumn("session", F.sum("_l").over(w))
    return marked.groupBy(*key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def recent_turns(turns: DataFrame, key: list[str], order: str, size: Column, limit: int, least: int = 2) -> DataFrame:
    """The latest turns of a conversation that fit `limit` characters, `least` at any rate."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    sized = turns.withColumn("_total", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return sized.where((F.col("_total") <= limit) | (F.col("_n") <= least)).drop("_total", "_n")


def repeated_feedback(rows: DataFrame, key: list[str], order: str, feedback: str) -> DataFrame:
    """How often in a row the same (trimmed) feedback has come."""
    n, start = streak("_f", key, [order])
    w = Window.partitionBy(*key).orderBy(order)
    marked = rows.withColumn("_f", trim(feedback)).withColumn("_n", n).withColumn("_s", start)
    return marked.withColumn("streak", (F.col("_n") - F.max("_s").over(w) + 1).cast("long")).drop("_f", "_n", "_s")


def refusals(turns: DataFrame, key: list[str], order: str, hint: Column, mark: str = "// NACK:") -> DataFrame:
    """Assistant turns that begin with a refusal right after a user turn holding the hint."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.lag("text").over(w).contains(F.left(hint, F.lit(40))) & (F.lag("role").over(w) == "user")
    hit = (F.col("role") == "assistant") & F.col("text").startswith(mark) & F.coalesce(before, F.lit(False))
    return turns.withColumn("_h", hit).groupBy(*key).agg(F.count_if("_h").alias("n_refusals"))


def activity(rows: DataFrame, key: list[str], name: Column, outcome: Column, order: str, top: int = 3) -> DataFrame:
    """Calls by name: count and sum of outcomes, the first `top` by first use, and how
    many more there are."""
    calls = rows.withColumn("call", name).groupBy(*key, "call").agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("total"), F.min(order).alias("_o"))
    w = Window.partitionBy(*key)
    calls = calls.withColumn("place", F.row_number().over(w.orderBy("_o", "call")).cast("long")).withColumn("more", F.greatest(F.count(F.lit(1)).over(w) - top, F.lit(0)))
    return calls.where(F.col("place") <= top).select(*key, "place", "call", "n", "total", "more")


def sampled(rows: DataFrame, key: list[str], order: list[str], k: int = 3) -> DataFrame:
    """The first k records of each key (a sampling operator)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("ordinal", F.row_number().over(w).cast("long")).where(F.col("ordinal") <= k)


def prompt_budget(elements: DataFrame, key: list[str], order: str, size: Column, each: int, total: int) -> DataFrame:
    """What of a prompt's elements goes in: whole, TRUNCATED at `each`, or SKIPPED, which
    once begun holds for the rest. Sums are taken by ranges of the order, so that a prompt
    may hold a third of all elements."""
    sized = elements.withColumn("used", F.least(size, F.lit(each)).cast("long"))
    sized = summed(sized, key, order, F.col("used"), "_sum")
    state = F.when(F.col("_sum") >= total, "SKIPPED").when(size > each, "TRUNCATED").otherwise("FULL")
    return sized.withColumn("state", state).drop("_sum")


def queue_positions(jobs: DataFrame, created: str, status: str) -> DataFrame:
    """First-in-first-out place of queued jobs, 0 for all others."""
    queued = jobs.where(F.col(status) == "queued").select("job_id", created)
    placed = numbered(queued, [], [created, "job_id"], "position").select("job_id", "position")
    return jobs.join(placed, "job_id", "left").withColumn("position", F.coalesce("position", F.lit(0)).cast("long"))


def retained(jobs: DataFrame, created: str, now: Column, hours: int = 24, last: int = 100) -> DataFrame:
    """Jobs younger than `hours`, the last `last` of them (a top-k, taken in each task first)."""
    fresh = jobs.where(F.col(created) > now - F.make_interval(hours=F.lit(hours)))
    return fresh.orderBy(F.desc(created), F.desc("job_id")).limit(last)


def failing_steps(events: DataFrame, run: list[str], step: str, preview: str, failed: Column) -> DataFrame:
    """Failed steps of a run: how often each ran, whether it always showed the same, and
    the likely cause."""
    out = events.groupBy(*run, step).agg(F.count(F.lit(1)).alias("iterations"), F.count_distinct(F.coalesce(preview, F.lit(""))).alias("previews"), F.bool_or(failed).alias("failed"))
    cause = F.when(F.col("iterations") == 1, "SCRIPT").when(F.col("previews") == 1, "NEVER_READY").otherwise("TOO_FEW_ITERATIONS")
    return out.where("failed").select(*run, step, "iterations", (F.col("previews") == 1).alias("all_same"), cause.alias("cause"))


def scroll_root(elements: DataFrame, key: list[str]) -> DataFrame:
    """The element that scrolls a page: overflowing, at least half as high again as its
    window, the highest; the first of equal ones."""
    fits = F.col("overflows") & (F.col("scroll_height") > 1.5 * F.col("client_height"))
    return elements.where(fits).groupBy(*key).agg(F.max_by("ordinal", F.struct("scroll_height", -F.col("ordinal"))).alias("ordinal"))


def new_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Responses met for the first time."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def scroll_stalls(rows: DataFrame, key: list[str], order: str, time: str, top: str, height: str, limit: int = 3, window: int = 3000) -> DataFrame:
    """(stalled_at, reason) where a scroll first came to nothing: `limit` samples in a row
    with neither growth nor movement, or `window` milliseconds without growth. Growth ends
    both waits, movement only the first. The first sample is where waiting begins; keys
    that never stall have no row."""
    w = Window.partitionBy(*key).orderBy(order)
    grew = F.coalesce(F.col(height) > F.lag(height).over(w), F.lit(True))
    moved = F.coalesce(F.col(top) != F.lag(top).over(w), F.lit(False))
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_g", grew).withColumn("_m", moved)
    idle = F.col("_n") - F.max(F.when(F.col("_g") | F.col("_m"), F.col("_n"))).over(w)
    waited = F.col(time) - F.last(F.when(F.col("_g"), F.col(time)), ignorenulls=True).over(w)
    hits = marked.withColumn("_idle", idle).withColumn("_late", waited >= window).where((F.col("_idle") >= limit) | F.col("_late"))
    reason = F.when(F.col("_late"), "stall_window_elapsed").otherwise("no_progress_count_elapsed")
    return hits.groupBy(*key).agg(F.min("_n").cast("long").alias("stalled_at"), F.min_by(reason, "_n").alias("reason"))


def accumulated(rows: DataFrame, key: list[str], poll: str, signature: str, target: int, stalls: int) -> DataFrame:
    """(polls, total, reason) of a feed read until `target` signatures are known or `stalls`
    polls in a row brought none; reason is null where it ended before."""
    first = rows.groupBy(*key, signature).agg(F.min(poll).alias(poll)).groupBy(*key, poll).agg(F.count(F.lit(1)).alias("_new"))
    every = rows.groupBy(*key, poll).agg(F.count(F.lit(1)).alias("_c")).drop("_c").join(first, [*key, poll], "left")
    w = Window.partitionBy(*key).orderBy(poll)
    marked = every.withColumn("polls", F.row_number().over(w).cast("long")).withColumn("total", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    marked = marked.withColumn("_idle", F.col("polls") - F.coalesce(F.max(F.when(F.col("_new") > 0, F.col("polls"))).over(w), F.lit(0)))
    reason = F.when(F.col("total") >= target, "target").when(F.col("_idle") >= stalls, "stalled")
    marked = marked.withColumn("reason", reason)
    ended = F.min_by(F.struct("polls", "total", "reason"), F.struct(F.col("reason").isNull(), F.when(F.col("reason").isNull(), -F.col("polls")).otherwise(F.col("polls"))))
    return marked.groupBy(*key).agg(ended.alias("e")).select(*key, "e.*")


def first_signatures(rows: DataFrame, key: list[str], signature: str, order: str, k: int = 50) -> DataFrame:
    """The k signatures of each key met first, by place (the cap of a prompt)."""
    met = rows.groupBy(*key, signature).agg(F.min(order).alias("_o"))
    w = Window.partitionBy(*key).orderBy("_o", signature)
    return met.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).drop("_o")
