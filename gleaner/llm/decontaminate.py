"""Benchmark decontamination by the q-gram lemma (operator 2).

Texts are lower-cased and runs of white space become one blank. Benchmark items are cut
into windows of `window` characters, one each `stride` (a shorter item is one window), so
that any window + stride - 1 characters of an item, word for word, hold a window. A text
region within k edits of a window of w characters shares at least w - q + 1 - k*q of its
q-grams, all within k + 1 neighbouring diagonals. So shared q-grams are counted in bands
of 2*(k+1) diagonals that overlap by half; bands that reach the bound are verified by
banded alignment. No region within the budget is missed.

The benchmark is the query set: it's taken in blocks of at most `block` windows, one after
the other, each broadcast (its size is fixed by `block`), and all documents are read against
each. The search shuffles no texts: candidate regions are cut out where they are found.
`kept_documents` shuffles them once where the list of texts to drop is beyond what Spark
broadcasts.

Null or empty text and null items match nothing; a null item_id is one like others. Items
under `least` characters, Q if not given, have no q-gram and aren't searched; those of less
than 2 * Q are found where they stand word for word. Repeated rows and equal doc_ids each
count; matches are grouped by doc_id, and `kept_documents` decides by the text, so that
rows with null or repeated ids are judged by what they hold. Extra columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, arrow_map, cut, mix

Q, WINDOW, STRIDE, RATE, BLOCK = 8, 64, 16, 0.1, 20_000
#: An item must have a q-gram to be searched by q-grams.
LEAST = Q
#: Hits looked at together; texts with more are halved, down to pieces of SMALLEST characters.
HITS, SMALLEST = 1 << 21, 4096
#: Characters of a text that are looked at together.
PIECE = 1 << 20
_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(w: int) -> int:
    """Edits allowed in a window, with at least one q-gram then shared."""
    return max(0, min(int(RATE * w), (w - Q) // Q))


def qgrams(points: np.ndarray) -> np.ndarray:
    """Hashes of the 8-grams of code points, by doubling."""
    h = points.astype(U64) + U64(1)
    for span in (1, 2, 4):
        h = h[:-span] * U64(pow(_B, span, _MASK + 1)) + h[span:]
    return mix(h)


def windows(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, stride: int = STRIDE) -> DataFrame:
    """(win, item_id, at, pattern): win is a hash of the pattern; windows of one pattern are
    looked for once."""

    def run(chunk: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(chunk.column("item_id").to_pylist(), chunk.column("text").to_pylist(), strict=True):
            t = normal(text)
            if len(t) < least:
                continue
            last = max(0, len(t) - window)
            for at in sorted({*range(0, last, stride), last}):
                rows.append((item, at, t[at : at + window]))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["item_id", "at", "pattern"])

    cuts = arrow_map(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), run, "item_id long, at long, pattern string")
    return cuts.distinct().select(F.xxhash64("pattern").alias("win"), "item_id", "at", "pattern")


class Index:
    """The q-grams of a block of windows."""

    def __init__(self, wins: list[int], patterns: list[str]):
        self.wins = np.array(wins, np.int64)
        sizes = np.array([len(p) for p in patterns])
        self.size, self.budget = sizes, np.array([budget(n) for n in sizes])
        self.need = np.maximum(1, sizes - Q + 1 - self.budget * Q)
        grams = [qgrams(np.frombuffer(p.encode("utf-32-le"), "<u4")) for p in patterns]
        keys = np.concatenate(grams)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.window = np.repeat(np.arange(len(patterns)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> U64(42)] = True

    def _halves(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """regions() of half the texts at a time, or of both halves of one text, which
        overlap by more than a region."""
        if len(texts) > 1:
            half = len(texts) // 2
            return self.regions(texts[:half]) + [(t + half, *rest) for t, *rest in self.regions(texts[half:])]
        half = len(texts[0]) // 2
        late = [(0, w, s + half, e + half) for _, w, s, e in self.regions([texts[0][half:]])]
        return list(dict.fromkeys(self.regions([texts[0][: half + 4 * WINDOW]]) + late))

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, window, start, end) of the bands that reach the bound."""
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        if len(points) < Q:
            return []
        keys = qgrams(points)
        at = np.flatnonzero(self.maybe[keys >> U64(42)])
        owner = np.searchsorted(bounds, at, "right") - 1
        inside = at + Q <= bounds[owner + 1]
        at, owner = at[inside], owner[inside]
        lo, hi = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        times = hi - lo
        if times.sum() <= HITS:
            hit = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            return self._full(bounds, np.repeat(at, times), np.repeat(owner, times), hit)
        if len(texts) > 1 or len(texts[0]) > SMALLEST:
            return self._halves(texts)
        return self._by_windows(bounds, at, owner, lo, hi)

    def _by_windows(self, bounds: np.ndarray, at: np.ndarray, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The same of one short text that has too many hits, for some windows at a time: a
        window alone has no more than its q-grams times the text's."""
        first, which = np.unique(lo, return_inverse=True)
        spans = dict(zip(lo.tolist(), hi.tolist(), strict=True))
        entries = np.concatenate([np.arange(x, spans[x]) for x in first.tolist()])
        of = np.repeat(np.arange(len(first)), [spans[x] - x for x in first.tolist()])
        met = np.argsort(which, kind="stable")  # the text's places by their q-gram
        begin = np.searchsorted(which[met], np.arange(len(first) + 1))
        times = np.diff(begin)[of]
        order = np.argsort(self.window[entries], kind="stable")
        entries, of, times = entries[order], of[order], times[order]
        window, total = self.window[entries], np.cumsum(times)
        out, start = [], 0
        while start < len(entries):
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + HITS, "right"))
            end = int(np.searchsorted(window, window[min(max(end, start), len(window) - 1)], "left"))  # whole windows
            end = end if end > start else int(np.searchsorted(window, window[start], "right"))
            own, n = of[start:end], times[start:end]
            place = met[np.repeat(begin[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            out += self._full(bounds, at[place], owner[place], np.repeat(entries[start:end], n))
            start = end
        return out

    def _full(self, bounds: np.ndarray, at: np.ndarray, owner: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Regions of the bands that enough hits are in: places of texts and entries of the index."""
        window = self.window[hit]
        wide = self.budget[window] + 1
        band = (at - self.place[hit] + WINDOW * 4) // wide
        head = (owner.astype(np.int64) << 48) | (window.astype(np.int64) << 32)
        codes, counts = np.unique(np.concatenate([head | band, head | (band - 1)]), return_counts=True)
        window = (codes >> 32) & 0xFFFF
        full = counts >= self.need[window]
        codes, window = codes[full], window[full]
        owner, band = codes >> 48, codes & 0xFFFFFFFF
        start = band * (self.budget[window] + 1) - WINDOW * 4
        end = start + 2 * (self.budget[window] + 1) + self.size[window] + self.budget[window]
        start = np.maximum(start - bounds[owner], 0)
        end = np.minimum(end, bounds[owner + 1]) - bounds[owner]
        return list(zip(owner.tolist(), window.tolist(), start.tolist(), end.tolist(), strict=True))


def candidates(docs: DataFrame, wins: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, win, start, region): the regions that pass the filter."""
    if block >= 1 << 16:
        raise ValueError("a block's windows are numbered in 16 bits")
    spark = docs.sparkSession
    wins = cut(wins.select("win", "pattern").distinct(), "patterns")
    blocks = max(1, -(-2 * wins.count() // block))
    schema = "doc_id long, key long, win long, start long, region string"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = wins.where(F.pmod("win", F.lit(blocks)) == b).select("win", "pattern").collect()  # about half a block
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(Index([r["win"] for r in rows], [r["pattern"] for r in rows]))
        # each block is written before the next is made, so that one index is alive at a time

        def run(chunk: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            whole = [normal(x) for x in chunk.column("text").to_pylist()]
            # a very long text goes in pieces that overlap by more than a region
            cuts = [(d, at) for d, x in enumerate(whole) for at in range(0, max(1, len(x)), PIECE)]
            found = shared.value.regions([whole[d][at : at + PIECE + 4 * WINDOW] for d, at in cuts])
            got = [(cuts[i][0], w, cuts[i][1] + s, cuts[i][1] + e) for i, w, s, e in found]
            ids, keys = chunk.column("doc_id").to_pylist(), chunk.column("key").to_pylist()
            return pa.record_batch(
                [
                    pa.array([ids[d] for d, *_ in got], pa.int64()), pa.array([keys[d] for d, *_ in got], pa.int64()),
                    pa.array([int(shared.value.wins[w]) for _, w, *_ in got], pa.int64()), pa.array([s for _, _, s, _ in got], pa.int64()),
                    pa.array([whole[d][s:e] for d, _, s, e in got], pa.string()),
                ],
                ["doc_id", "key", "win", "start", "region"],
            )

        found = found.union(cut(arrow_map(own, run, schema), "candidates"))
        shared.destroy()
    return found


def aligned(pattern: pa.Array, region: pa.Array) -> pa.Array:
    """Edits and end of the pattern's best place in each region, by alignment in the band
    that the region spans; patterns of one length go together."""
    patterns, regions = pattern.to_pylist(), region.to_pylist()
    edits, ends = np.full(len(patterns), 1 << 30), np.zeros(len(patterns), np.int64)
    sizes = np.array([len(p) for p in patterns], np.int64)
    for w in np.unique(sizes):
        of_size = np.flatnonzero(sizes == w)
        k = budget(int(w))
        for at in range(0, len(of_size), 2048):
            rows = of_size[at : at + 2048]
            band = 4 * k + 4  # diagonals -k .. 2(k+1)+k
            p = np.array([np.frombuffer(patterns[i].encode("utf-32-le"), "<u4") for i in rows])
            t = np.zeros((len(rows), int(w) + band + k + 1), np.uint32)
            for j, i in enumerate(rows):
                x = np.frombuffer(regions[i].encode("utf-32-le"), "<u4")[: t.shape[1] - k]
                t[j, k : k + len(x)] = x
            steps = np.arange(band)
            row = np.zeros((len(rows), band), np.int64)
            for i in range(int(w)):
                diagonal = row + (t[:, i : i + band] != p[:, i : i + 1])
                skipped = np.concatenate([row[:, 1:], np.full((len(rows), 1), 1 << 20)], axis=1) + 1
                best = np.minimum(diagonal, skipped) - steps
                row = np.minimum.accumulate(best, axis=1) + steps
            edits[rows] = row.min(axis=1)
            ends[rows] = row.argmin(axis=1) + w - k
    return pa.StructArray.from_arrays([pa.array(edits, pa.int64()), pa.array(ends, pa.int64())], ["edits", "end"])


def matches(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, item_id, at, edits, end) for each window found: `at` in the item,
    `end` in the normalised text."""
    wins = cut(windows(benchmark), "windows")
    found = candidates(docs, wins, block).join(wins.select("win", "pattern").distinct(), "win")
    place = F.arrow_udf(aligned, "struct<edits:bigint,end:bigint>")("pattern", "region")
    found = found.withColumn("_a", place)
    k = F.least(F.floor(F.lit(RATE) * F.length("pattern")), F.floor((F.length("pattern") - Q) / Q))
    good = found.where(F.col("_a.edits") <= k).select("doc_id", "key", "pattern", "_a.edits", (F.col("start") + F.col("_a.end")).alias("end"))
    return good.join(wins.select("pattern", "item_id", "at"), "pattern").select("doc_id", "key", "item_id", "at", "edits", "end")


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, first_end, last_end) of documents with passages."""
    return matches(docs, benchmark, block).groupBy("doc_id", "item_id").agg(
        F.countDistinct("at").alias("n_windows"), F.min("edits").alias("edits"), F.min("end").alias("first_end"), F.max("end").alias("last_end")
    )


def kept_documents(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without those that hold a benchmark passage, with docs' columns."""
    bad = cut(matches(docs, benchmark, block).select(F.col("key").alias("_bad")).distinct(), "bad")
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["_bad"], "left_anti")
