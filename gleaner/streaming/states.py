"""Streams with keyed state of their own: feeds read to a target, and ids sent once."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed state needs a store that holds several kinds of it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while; a stream takes those it starts with."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(stream: DataFrame, batch, checkpoint: str, partitions: int | None = None) -> None:
    """A stream run to the end of what there is now; `batch` gets (rows, batch id). The number
    of state partitions is the session's unless given, and stays with the checkpoint."""
    spark = stream.sparkSession
    more = {} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)}
    with settings(spark, STORE | more):
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


class Feed(StatefulProcessor):
    """Unique signatures of a virtualised feed over its polls of `size` rows each: read until
    `target` are known or `stalls` polls in a row brought none. State of a key: the
    signatures it has met (at most `target` and a poll more, as the feed ends there) and five
    numbers; both are forgotten `ttl` milliseconds after they were written last, if given."""

    def __init__(self, key: str, order: str, signature: str, size: int, target: int, stalls: int, ttl: int | None):
        self.key, self.order, self.signature = key, order, signature
        self.size, self.target, self.stalls, self.ttl = size, target, stalls, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getMapState("met", "signature string", "poll long", self.ttl)
        self.feed = handle.getValueState("feed", "n long, total long, brought long, told boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, total, brought, told = self.feed.get() if self.feed.exists() else (0, 0, 0, False)
        if told:
            return
        reason = None
        for row in sorted(rows, key=lambda r: r[self.order]):
            value = row[self.signature]
            poll, n = n // self.size, n + 1
            if not self.met.containsKey((value,)):
                self.met.updateValue((value,), (poll,))
                total, brought = total + 1, poll
            if n % self.size == 0:
                reason = self._reason(poll, total, brought)
                if reason:
                    break
        poll = (n - 1) // self.size
        whole = n % self.size == 0
        out = reason if whole else self._reason(poll, total, brought)
        if whole and reason:
            self.met.clear()
        self.feed.update((n, total, brought, bool(whole and reason)))
        yield Row(**{self.key: key[0], "n": n, "polls": poll + 1, "total": total, "reason": out, "ended": bool(whole and reason)})

    def _reason(self, poll: int, total: int, brought: int) -> str | None:
        return "target" if total >= self.target else "stalled" if poll - brought >= self.stalls else None

    def close(self) -> None:
        pass


def feeds(stream: DataFrame, key: str, order: str, signature: str, size: int, target: int, stalls: int, ttl: int | None = None) -> DataFrame:
    """What each batch brings a feed to: (key, n, polls, total, reason, ended). A feed whose
    whole polls have come to an end is told once more and never again; until then each
    batch tells where it stands, a last poll that isn't whole yet taken as it is. Rows of a
    batch are taken in their order; batches must come in order."""
    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n long, polls long, total long, reason string, ended boolean"
    made = stream.select(key, order, signature).groupBy(key)
    return made.transformWithState(Feed(key, order, signature, size, target, stalls, ttl), schema, "Append", "None" if ttl is None else "ProcessingTime")


#: Groups of keys that `once` keeps its state by; a checkpoint stays with the number it began with.
BUCKETS = 512


class Once(StatefulProcessor):
    """Ids that come for the first time. The last ones of each key are known, `most` at most: when
    one more has come, the `evicted` oldest are forgotten. The keys of a bucket are one value,
    read and written once a batch, as a call of the store takes longer than all the work on
    the rows of a key. A key without rows for `idle` milliseconds is forgotten by its
    bucket's timer, if given."""

    def __init__(self, key: str, order: str, name: str, kinds: dict[str, str], most: int, evicted: int, idle: int | None):
        self.key, self.order, self.name, self.kinds = key, order, name, kinds
        self.most, self.evicted, self.idle = most, evicted, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", f"lines array<struct<key:{self.kinds[self.key]},ids:array<{self.kinds[self.name]}>,at:bigint>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.lines.get()
        lines = {k: (list(ids), at) for k, ids, at in before[0]} if before else {}
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle is not None else 0
        made, known, changed = Row(self.key, self.order, self.name), {}, self.idle is not None
        for _, own, order, value in sorted(rows, key=lambda r: r[2]):
            if own not in known:
                line, _ = lines.get(own, ([], 0))
                lines[own], known[own] = (line, now), set(line)
            if value not in known[own]:
                yield made(own, order, value)
                line, _ = lines[own]
                known[own].add(value)
                line.append(value)
                changed = True
                if len(line) > self.most:
                    known[own].difference_update(line[: self.evicted])
                    del line[: self.evicted]
        if changed:
            self._keep(lines)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before, now = self.lines.get(), timerValues.getCurrentProcessingTimeInMs()
        self._keep({k: (ids, at) for k, ids, at in before[0] if at + self.idle > now} if before else {})
        yield from ()

    def _keep(self, lines: dict) -> None:
        if lines:
            self.lines.update(([(k, list(ids), at) for k, (ids, at) in lines.items()],))
        else:
            self.lines.clear()
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if lines:
                self.handle.registerTimer(min(at for _, at in lines.values()) + self.idle)

    def close(self) -> None:
        pass


def once(stream: DataFrame, key: str, order: str, name: str, most: int = 2000, evicted: int = 1000, idle: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows (key, order, name) whose id in `name` isn't among the last ones of their key."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order, name)}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    made = stream.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), key, order, name).groupBy("_bucket")
    return made.transformWithState(Once(key, order, name, kinds, most, evicted, idle), schema, "Append", "None" if idle is None else "ProcessingTime")
