"""Exact removal of repeated byte strings by hash-compared suffix sorting (operator 13).

A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else. To
bring equal strings together without a suffix of each byte, every text is read through a
window of LENGTH bytes: the K-byte grams that are the least (by hash) of a window are its
anchors, so equal windows hold equal anchors at equal offsets, and some 2 % of all places are
anchors. Around an anchor stands its frame, all bytes of windows that hold it.

* Anchors met once in the corpus can't be in a repeated window. A count of hashes tells, and a
  map of fixed size lets the later passes go by them.
* Frames that are equal as a whole (anchor and frame agree by 64-bit hashes each) are counted
  before anything else is done: all windows of a frame met twice are repeated. However often a
  passage is copied, one frame of it goes on.
* Of anchors with several different frames, one of each kind is brought together. Their
  suffixes from the anchor on, and those of the reversed bytes before it, are sorted by a
  mergesort whose comparisons find the common extension by binary search over prefix
  polynomial hashes; the next byte decides. All neighbours are then verified byte by byte; a
  collision has the block sorted by its bytes instead. Two windows at offset j are equal if
  no neighbours between them share fewer than LENGTH - j bytes forwards or j backwards.
* Anchors with more than HOT different frames (a common passage in ever other surroundings)
  don't come together: their windows are counted by 128-bit digests, STRETCH at a time and
  then one by one where a stretch is neither repeated nor alone, so that no task has to hold
  them. Both ways are exact; which one an anchor takes doesn't change the result.

Equal texts are told by 128 bits of SHA-256: all of them are covered from end to end. Runs of
starts are joined to their texts (only those that lose something are shuffled), merged there
and cut out. A task works on SEGMENT bytes of a text at a time, BLOCK frames at a time.

Null text is empty. Texts under LENGTH bytes lose nothing. Rows are judged each, so a row
repeated whole is a copy; equal or null doc_ids don't matter. Extra columns are ignored. An
empty table gives no rows. Texts are UTF-8 bytes, so a cut may fall within a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, bitmap, chunks, cut, drop, in_bitmap, mix, signed, small_batches, text_bytes
from gleaner.llm.substring_dedup import minimizers

LENGTH, K = 200, 100
SEGMENT = 1 << 18
#: Different frames of an anchor that may come together (10 MB of text), and frames that are
#: sorted at a time at least.
HOT, BLOCK = 1 << 15, 4096
#: Windows of a frame that are counted by one digest before they are looked at one by one.
STRETCH = 13
#: Bits of the maps of anchors, frames, anchors with many frames, and texts.
ANCHORS, FRAMES, HOTS, TEXTS = 1 << 26, 1 << 26, 1 << 22, 1 << 24
PLACES = "a long, f long, r long, t binary, at long, before int, after int"
_BASE = 0x27D4EB2F165667C5  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_TURN = U64(0x9FB21C651E98DF25)
_POWERS: list[np.ndarray] = []
NOTHING = hashlib.sha256(b"").hexdigest()


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base, and of its inverse, up to the n-th at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, 2 * SEGMENT)
        _POWERS[:] = [np.multiply.accumulate(np.array([1] + [x] * size, U64)) for x in (_BASE, _INV)]
    return _POWERS


class Hashed:
    """Prefix polynomial hashes of bytes: any range's hash in two look-ups."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the ranges from x and y on share, `most` of them at most."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = self.of(x, x + middle) == self.of(y, y + middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Anchors of windows within each of the ranges starts..ends of data (LENGTH or more
    bytes each); frames reach from low to high. (range, place in data, anchor hash, frame
    hash, bytes of the frame before the anchor and from it on)"""
    hashed = Hashed(data)
    counts = ends - starts - K + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(starts - bounds[:-1], counts) + np.arange(bounds[-1])
    grams = mix(hashed.of(at, at + K))
    chosen = minimizers(grams, bounds, LENGTH - K + 1)
    owner = np.searchsorted(bounds, chosen, "right") - 1
    place = at[chosen]
    before, after = np.minimum(place - low[owner], LENGTH - K), np.minimum(high[owner] - place, LENGTH)
    frame = mix(mix(hashed.of(place - before, place + after)) ^ ((before << 9) + after).astype(U64) * _TURN)
    return owner, place, grams[chosen], frame, before, after


def anchors(column: pa.Array, segment: int = SEGMENT) -> Iterator[tuple[int | None, np.ndarray, tuple]]:
    """For each text, or for all of a chunk at once: (None, text of each anchor, ...) with the
    place in the text, hashes, and extents of `_anchors`; a long text comes in segments."""
    offsets, data = text_bytes(column)
    sizes = np.diff(offsets)
    if len(data) <= segment + LENGTH:
        some = np.flatnonzero(sizes >= LENGTH)
        if len(some):
            starts, ends = offsets[some], offsets[some + 1]
            owner, place, *rest = _anchors(data, starts, ends, starts, ends)
            yield some[owner], place - starts[owner], *rest
        return
    for text in np.flatnonzero(sizes >= LENGTH):
        own, n, last = data[offsets[text] : offsets[text + 1]], int(sizes[text]), np.zeros(0, np.int64)
        for lo in range(0, n - LENGTH + 1, segment):
            hi = min(lo + segment + LENGTH - 1, n)
            skip, end = max(lo - LENGTH + K, 0), min(hi + LENGTH, n)
            bounds = [np.array([x - skip]) for x in (lo, hi, 0, n)]
            owner, place, *rest = _anchors(own[skip:end], *bounds)
            fresh = ~np.isin(place + skip, last)  # the segment before may have met those at its end
            last = place + skip
            yield np.full(int(fresh.sum()), text), place[fresh] + skip, *(x[fresh] for x in rest)


def keys(column: pa.Array) -> list[bytes]:
    return [hashlib.sha256((x or "").encode()).digest()[:16] for x in column.to_pylist()]


def occurrence(texts: list[bytes], owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each place of a text."""
    own = np.array([int.from_bytes(t[:8], "little") for t in texts], U64)
    return mix(own[owner] ^ mix(at.astype(U64)))


def _mapped(docs: DataFrame, made, schema: str, segment: int) -> DataFrame:
    """mapInArrow over chunks of texts; a text met again in the same task is passed over, as
    equal texts are told by their digests."""

    def run(batches):
        seen: set[bytes] = set()
        for chunk in chunks(batches, segment):
            texts = keys(chunk.column("text"))
            fresh = []
            for t in texts:
                fresh.append(t not in seen)
                seen.add(t)
            column = chunk.column("text").filter(pa.array(fresh))
            own = [t for t, new in zip(texts, fresh, strict=True) if new]
            for found in anchors(column, segment):
                yield from made(column, own, *found)

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, schema)


def anchor_hashes(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    def made(column, own, owner, at, a, *_):
        yield pa.record_batch([pa.array(signed(a))], ["a"])

    return _mapped(docs, made, "a long", segment)


def places(docs: DataFrame, live, segment: int = SEGMENT) -> DataFrame:
    """(a, f, r, t, at, before, after): anchors that the map has, with frame hash and name."""

    def made(column, own, owner, at, a, f, before, after):
        some = in_bitmap(live.value, signed(a) % ANCHORS)
        owner, at = owner[some], at[some]
        columns = [pa.array(signed(x)) for x in (a[some], f[some], occurrence(own, owner, at))]
        columns += [pa.array(own, pa.binary()).take(pa.array(owner)), pa.array(at), *(pa.array(x[some].astype(np.int32)) for x in (before, after))]
        yield pa.record_batch(columns, ["a", "f", "r", "t", "at", "before", "after"])

    return _mapped(docs, made, PLACES, segment)


def frames(docs: DataFrame, live, wanted, hot, segment: int = SEGMENT) -> DataFrame:
    """(a, r, t, at, before, frame, hot) of the places that the maps have."""

    def made(column, own, owner, at, a, f, before, after):
        r = occurrence(own, owner, at)
        some = in_bitmap(live.value, signed(a) % ANCHORS) & in_bitmap(wanted.value, signed(r) % FRAMES)
        if not some.any():
            return
        offsets, data = text_bytes(column)
        a, r, owner, at, before, after = (x[some] for x in (a, r, owner, at, before, after))
        raw, starts = memoryview(data), offsets[owner] + at
        cut_ = [bytes(raw[s - b : s + n]) for s, b, n in zip(starts.tolist(), before.tolist(), after.tolist(), strict=True)]
        columns = [pa.array(signed(a)), pa.array(signed(r)), pa.array(own, pa.binary()).take(pa.array(owner)), pa.array(at)]
        columns += [pa.array(before.astype(np.int32)), pa.array(cut_, pa.binary()), pa.array(in_bitmap(hot.value, signed(a) % HOTS))]
        yield pa.record_batch(columns, ["a", "r", "t", "at", "before", "frame", "hot"])

    return _mapped(docs, made, "a long, r long, t binary, at long, before int, frame binary, hot boolean", segment)


def merged(order: np.ndarray, first: np.ndarray, size: np.ndarray, compare) -> np.ndarray:
    """Mergesort of many groups at once, bottom up. order: elements by place, those of a group
    together; first, size: of each place's group. compare(x, y) gives -1, 0 or 1 for arrays of
    elements. In each round runs of `width` are merged with their neighbours: an element's
    new place is its own rank and that in the other run, found by halving."""
    width, most = 1, int(size.max(initial=0))
    every = np.arange(len(order))
    inside = every - first
    while width < most:
        run = inside // width
        other = first + (run ^ 1) * width
        live = np.flatnonzero(other < first + size)
        low, high, mine = other[live], np.minimum(other + width, first + size)[live], order[live]
        from_right = (run[live] & 1) == 1
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            sign = compare(order[middle], mine[open_])
            lower = (sign < 0) | (from_right[open_] & (sign == 0))
            low[open_[lower]] = middle[lower] + 1
            high[open_[~lower]] = middle[~lower]
        out = order.copy()
        out[first[live] + (run[live] & ~1) * width + (inside[live] - run[live] * width) + (low - other[live])] = mine
        order, width = out, 2 * width
    return order


def suffix_order(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes data[start : start + size] within groups, and the bytes that each
    shares with the one before it (-1 for the first of a group)."""
    hashed = Hashed(data)
    padded = np.concatenate([data.astype(np.int16), [-1]])

    def compare(x, y):
        shared = hashed.common(starts[x], starts[y], np.minimum(sizes[x], sizes[y]))
        next_x = np.where(shared < sizes[x], padded[starts[x] + shared], -1)
        next_y = np.where(shared < sizes[y], padded[starts[y] + shared], -1)
        return np.sign(next_x - next_y)

    order = merged(np.arange(len(starts)), first, size, compare)
    later = np.flatnonzero(np.arange(len(starts)) > first)
    exact, ordered = _neighbours(padded, starts, sizes, order[later - 1], order[later])
    shared = hashed.common(starts[order[later - 1]], starts[order[later]], np.minimum(sizes[order[later - 1]], sizes[order[later]]))
    if not (ordered.all() and (exact == shared).all()):  # a collision: by the bytes themselves
        raw = data.tobytes()
        order = np.array(sorted(range(len(starts)), key=lambda i: (first[i], raw[starts[i] : starts[i] + sizes[i]])))
        exact, _ = _neighbours(padded, starts, sizes, order[later - 1], order[later])
    lcp = np.full(len(starts), -1)
    lcp[later] = exact
    return order, lcp


def _neighbours(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that suffixes share, compared one by one, and whether x comes no later than y."""
    steps = np.arange(LENGTH + 1)
    out, ordered = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for lo in range(0, len(x), 512):
        i, j = x[lo : lo + 512, None], y[lo : lo + 512, None]
        left = np.where(steps < sizes[i], padded[np.minimum(starts[i] + steps, len(padded) - 1)], -1)
        right = np.where(steps < sizes[j], padded[np.minimum(starts[j] + steps, len(padded) - 1)], -1)
        differ = (left != right) | (steps >= np.minimum(sizes[i], sizes[j]))
        at = differ.argmax(axis=1)
        out[lo : lo + 512] = at
        rows = np.arange(len(at))
        ordered[lo : lo + 512] = left[rows, at] <= right[rows, at]
    return out, ordered


def repeated(groups: np.ndarray, before: np.ndarray, kept: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, j0, j1): windows that start j0..j1 bytes before the anchor of a frame and equal
    one of another frame of its group. Frames of a group stand together."""
    data = np.frombuffer(b"".join(kept), np.uint8)
    lengths = np.array([len(x) for x in kept])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = len(kept)
    new = np.concatenate([[True], groups[1:] != groups[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    size = np.bincount(first, minlength=n)[first]
    anchor, after = starts + before, lengths - before
    forth, forth_lcp = suffix_order(data, anchor, after, first, size)
    back, back_lcp = suffix_order(data[::-1], len(data) - anchor, before, first, size)
    found = np.zeros((n, LENGTH - K + 3), np.int8)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(LENGTH - K + 1):
        some = np.flatnonzero((before >= j) & (after >= LENGTH - j) & (size > 1))
        if len(some) > 1:
            right[forth], left[back] = np.cumsum(forth_lcp < LENGTH - j), np.cumsum(back_lcp < j)
            _, kind, count = np.unique(right[some] * (n + 1) + left[some], return_inverse=True, return_counts=True)
            found[some, j + 1] = count[kind] > 1
    edge = np.diff(found, axis=1)
    row, j0 = np.nonzero(edge == 1)
    _, j1 = np.nonzero(edge == -1)
    return row, j0, j1 - 1


def sorted_starts(some: DataFrame, size: int = BLOCK) -> DataFrame:
    """(t, lo, hi): starts of repeated windows, of frames brought together by their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            a, _, t, at, before, kept = zip(*rows, strict=True)
            row, j0, j1 = repeated(np.array(a), np.array(before), list(kept))
            at = np.array(at)[row]
            return pa.record_batch([pa.array(t, pa.binary()).take(pa.array(row)), pa.array(at - j1), pa.array(at - j0)], ["t", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "r", "t", "at", "before", "frame")), strict=True):
                if held and row[:4] == held[-1][:4]:  # a copy of the text in another task
                    continue
                if len(held) >= size and row[0] != held[-1][0]:
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    dealt = some.repartition("a").sortWithinPartitions("a", "r", "at")
    return dealt.mapInArrow(run, "t binary, lo long, hi long")


def _digest(raw: bytes, *told: int) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, key=b",".join(b"%d" % x for x in told)).digest()


def _valid(before: int, frame: bytes) -> range:
    """Offsets before the anchor at which a whole window of the frame starts."""
    return range(max(LENGTH - len(frame) + before, 0), before + 1)


def stretches(some: DataFrame) -> DataFrame:
    """(r, k, t, lo, hi, core, whole): windows of a frame, STRETCH offsets at a time (k). Digests
    of all their bytes, and of those that each of them holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, r, t, at, before, frame in zip(*(batch.column(c).to_pylist() for c in ("a", "r", "t", "at", "before", "frame")), strict=True):
                valid = _valid(before, frame)
                for k in range(valid.start // STRETCH, (valid.stop - 1) // STRETCH + 1):
                    j0, j1 = max(k * STRETCH, valid.start), min((k + 1) * STRETCH, valid.stop) - 1
                    core = frame[before - k * STRETCH : before + LENGTH - (k + 1) * STRETCH + 1]
                    whole = frame[before - j1 : before - j0 + LENGTH]
                    rows.append((r, k, t, at - j1, at - j0, _digest(core, a, k), _digest(whole, a, j0, j1)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["r", "k", "t", "lo", "hi", "core", "whole"])

    return some.mapInArrow(run, "r long, k int, t binary, lo long, hi long, core binary, whole binary")


def single_windows(some: DataFrame) -> DataFrame:
    """(t, lo, w): windows of frames in the stretches `ks`, with digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, starts, digests = [], [], []
            for i, (a, at, before, frame, ks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "at", "before", "frame", "ks")), strict=True)):
                for j in _valid(before, frame):
                    if j // STRETCH in ks:
                        owner.append(i)
                        starts.append(at - j)
                        digests.append(_digest(frame[before - j : before - j + LENGTH], a, j))
            yield pa.record_batch([batch.column("t").take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(digests, pa.binary())], ["t", "lo", "w"])

    return some.mapInArrow(run, "t binary, lo long, w binary")


def counted_starts(some: DataFrame) -> DataFrame:
    """The same of frames whose anchors have too many: by digests that are counted. Stretches
    equal as a whole are repeated, and one of each kind goes on; those whose common bytes
    stand nowhere else aren't. What is between has its windows counted one by one."""
    twice = lambda rows, c: rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c)
    rows = cut(stretches(some), "stretches")
    again = rows.groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first")).where("n > 1")
    told = cut(rows.join(again, "whole", "left"), "told")
    open_ = told.where("n is null or r = first").join(twice(rows, "core"), "core", "left_semi")
    left = some.join(open_.groupBy("r").agg(F.collect_set("k").alias("ks")), "r")
    windows = cut(single_windows(left), "windows")
    found = windows.join(twice(windows, "w"), "w", "left_semi").select("t", "lo", F.col("lo").alias("hi"))
    return told.where("n > 1").select("t", "lo", "hi").unionByName(found)


def starts(docs: DataFrame, hot: int = HOT, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(t, lo, hi): every repeated window of LENGTH bytes starts within one of its text's
    ranges, and all starts in them are repeated. t: 128 bits of the text's SHA-256."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast
    twice = anchor_hashes(docs, segment).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = shared(bitmap(twice, F.pmod("a", F.lit(ANCHORS)), ANCHORS))
    where = cut(places(docs, live, segment), "places")
    kinds = cut(where.groupBy("a", "f").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")), "kinds")
    several = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = cut(kinds.join(several, "a").select("a", "r", "kinds"), "wanted")
    marked = shared(bitmap(wanted, F.pmod("r", F.lit(FRAMES)), FRAMES))
    common = wanted.where(F.col("kinds") > hot)
    many = shared(bitmap(common, F.pmod("a", F.lit(HOTS)), HOTS))
    any_common = bool(common.take(1))
    drop(wanted)
    kept = cut(frames(docs, live, marked, many, segment), "frames")
    whole = where.join(kinds.where("n > 1").select("a", "f"), ["a", "f"]).select(
        "t", (F.col("at") - F.col("before")).alias("lo"), (F.col("at") + F.col("after") - LENGTH).alias("hi")
    )
    found = whole.where("lo <= hi").unionByName(sorted_starts(kept.where("not hot"), block))
    if any_common:
        found = found.unionByName(counted_starts(kept.where("hot")))
    out = cut(found, "starts")
    drop(where, kinds, kept)
    return out


def runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges that windows starting at lo..hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    return lo[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def cleaned(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(t, n_removed, n_spans, kept, removed) of the texts that ranges (t, list of lo, hi)
    name: what is left as bytes, and the ranges cut out."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ranges, F.pmod(F.conv(F.hex(F.substring("t", 1, 7)), 16, 10).cast("long"), F.lit(TEXTS)), TEXTS))

    def some(batches):
        for chunk in chunks(batches):
            texts = keys(chunk.column("text"))
            mark = in_bitmap(bits.value, np.array([int.from_bytes(t[:7], "big") % TEXTS for t in texts], np.int64))
            yield pa.record_batch([pa.array(texts, pa.binary()), chunk.column("text")], ["t", "text"]).filter(pa.array(mark))

    def out(batches):
        for chunk in chunks(batches):
            rows = []
            for t, text, lo, hi in zip(*(chunk.column(c).to_pylist() for c in ("t", "text", "lo", "hi")), strict=True):
                raw = text.encode()
                a, b = runs(np.array(lo), np.array(hi))
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                rows.append((t, int((b - a).sum()), len(a), kept, [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["t", "n_removed", "n_spans", "kept", "removed"])

    met = docs.select("text").mapInArrow(some, "t binary, text string").join(ranges, "t")
    met = met.select("t", "text", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))
    return met.mapInArrow(out, "t binary, n_removed long, n_spans long, kept binary, removed array<struct<start:long,end:long>>")


def deduplicated(docs: DataFrame, hot: int = HOT, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed): what each document loses.
    `removed` lists the ranges of bytes cut out."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("_sha"))
    rows = cut(rows.withColumn("t", F.substring(F.unhex("_sha"), 1, 16)), "rows")
    long = docs.where(F.octet_length("text") >= LENGTH)
    copies = cut(rows.where(F.col("n_bytes") >= LENGTH).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t"), "copies")
    found = starts(long, hot, block, segment).join(copies, "t", "left_anti")
    ranges = cut(found.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    some = cut(cleaned(long, ranges).select("t", "n_removed", "n_spans", F.sha2("kept", 256).alias("_kept"), "removed"), "cleaned")
    none = F.lit(None).cast("long")
    told = some.withColumn("_copy", F.lit(False)).unionByName(
        copies.select("t", none.alias("n_removed"), none.alias("n_spans"), F.lit(None).cast("string").alias("_kept"), F.lit(None).cast(some.schema["removed"].dataType).alias("removed"), F.lit(True).alias("_copy"))
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    empty = F.array().cast(some.schema["removed"].dataType)
    pick = lambda copy, own, rest: F.when(F.col("_copy"), copy).otherwise(F.coalesce(own, rest))
    zero = F.lit(0).cast("long")
    return rows.join(told, "t", "left").select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), zero).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), zero).alias("n_spans"),
        pick(F.lit(NOTHING), F.col("_kept"), F.col("_sha")).alias("kept_sha256"),
        pick(whole, F.col("removed"), empty).alias("removed"),
    )
