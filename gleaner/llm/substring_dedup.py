"""Substring dedup by collinear chaining (operator 3).

Seeds are K-word shingles, sampled by their own hash (one in RARE, and the least of SPAN
neighbours where none is), so that two texts sample the same of the shingles they share. A
seed alone joins too much: in a large corpus most shingles stand in many texts, and a place
would meet only one of them. So seeds are joined by what stands around them, in three ways:

* with the least word (by hash) of the CONTEXT words after them, and likewise before them:
  edits leave most of those words, while texts that share the shingle alone differ in them;
* runs of LEAST_WORDS equal words, sampled as the least of RUN_SPAN neighbours: any two
  texts that share LEAST_WORDS + RUN_SPAN - 1 words in a row share such a run.

Texts with one key aren't paired with each other but with the text of the least hash, so a
key that stands in a third of all documents makes as many matches as it has texts; a further
place in one text is paired with the place before it. Each pair of documents met, one document with itself included,
has its matches chained: ordered in both texts, with a cost for the gaps, by a Fenwick tree
of prefix maxima. Chains are then aligned word by word between their runs of seeds and
parted at stretches that don't align; each part is lengthened over edits on either side by
a banded alignment with drop-off, judged by itself, and kept if it is long and similar
enough.

What this guarantees: if a text shares LEAST_WORDS + RUN_SPAN - 1 or more words in a row with
another text (or with another place of its own), whatever other texts hold, a passage of
LEAST_WORDS or more is found there with some text, and the texts that share one run are all
paired with one of them. Shorter and edited passages are found with a probability that
tests measure against brute force, with and without other texts that hold bits of them.

Equal texts are one text: its passages are found once, and each further copy gets one
row that names the first copy. Null or blank texts have no passages. Equal doc_ids with
different texts are judged by their texts; a null doc_id is carried along. Ties between
chains go to the earlier place. Extra columns are ignored; empty tables give no rows.
Texts of any length are taken whole; chains are made within BLOCK words at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, arrow_map, bitmap, chunks, cut, drop, in_bitmap, list_array, mix, shingles, signed, small_batches, text_bytes, word_counts, words

K, RARE, SPAN, CONTEXT, RUN_SPAN = 5, 8, 32, 22, 20
LEAST_WORDS, SIMILAR = 45, 0.8
GAP, MARGIN, BAND, DRIFT = 0.05, 64, 24, 16
#: Edits in a row that part a chain, and words without a seed that part it unaligned.
STRETCH, WIDE = 16, 64
#: Words of a text whose matches with one other text are chained together.
BLOCK = 1 << 16
#: Bits of the maps that let tasks pass over keys and texts that no join would keep.
KEY_SLOTS, TEXT_SLOTS = 1 << 26, 1 << 24
STEP = U64(0x5851F42D4C957F2D)
AFTER, BEFORE, RUN = U64(0x8C7F0AAC97C4AA2F), U64(0xB5297A4D3F84D5A5), U64(0x1B56C4E9F0A36F21)
FOUND = "key long, source long, a0 long, a1 long, b0 long, b1 long, similarity double"


def slid(values: np.ndarray, span: int, best=np.minimum) -> np.ndarray:
    """The least (or by another ufunc) of each `span` neighbours, by doubling."""
    done = 1
    while 2 * done <= span:
        values, done = best(values[:-done], values[done:]), 2 * done
    return best(values[: len(values) - (span - done)], values[span - done :]) if span > done else values


def minimizers(values: np.ndarray, bounds: np.ndarray, span: int) -> np.ndarray:
    """Places of values that are the least of `span` neighbours of the same text (all equal
    ones); of a text with fewer values, its least."""
    n, counts = len(values), np.diff(bounds)
    if not n:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    chosen = np.zeros(n, bool)
    if n >= span:
        least = np.where(owner[: n - span + 1] == owner[span - 1 :], slid(values, span), U64(0))
        edge = np.zeros(span - 1, U64)
        chosen = slid(np.concatenate([edge, least, edge]), span, np.maximum) == values
    some = np.flatnonzero(counts > 0)
    short = np.flatnonzero(counts < span)
    least = np.zeros(len(counts), U64)
    least[some] = np.minimum.reduceat(values, bounds[some])
    inside = np.isin(owner, short)
    return np.flatnonzero(chosen | inside & (values == least[owner]))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours, by doubling."""
    out, done, part, size = None, 0, hashes, 1
    if len(hashes) < n:
        return hashes[:0]
    while done < n:
        if n & size:
            total = len(hashes) - done - size + 1
            new = part[done : done + total]
            out, done = new if out is None else out[:total] * STEP + new, done + size
        if done < n:
            part, size = part[:-size] * (STEP ^ U64(2 * size)) + part[size:], 2 * size
    return mix(out)


def context(hashes: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least hash of the CONTEXT words from `first` on, as far as they are in lo..hi."""
    out = np.full(len(first), U64(2**64 - 1))
    whole = (first >= lo) & (first + CONTEXT <= hi)
    if whole.any():
        out[whole] = slid(hashes, CONTEXT)[first[whole]]
    part = np.flatnonzero(~whole)
    for j in range(CONTEXT):
        at = first[part] + j
        some = (at >= lo[part]) & (at < hi[part])
        out[part[some]] = np.minimum(out[part[some]], hashes[at[some]])
    return out


def keys_of(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place in words, the key's place before it in the same text or -1) of texts
    of LEAST_WORDS or more."""
    counts = np.where(np.diff(bounds) >= LEAST_WORDS, np.diff(bounds), 0)
    hashes, bounds = hashes[np.repeat(counts > 0, np.diff(bounds))], np.concatenate([[0], np.cumsum(counts)])
    if not len(hashes):
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    seeds, seed_bounds = shingles(hashes, bounds, K)
    rare = seeds < U64(2**64 // RARE)
    rare[minimizers(seeds, seed_bounds, SPAN)] = True
    chosen = np.flatnonzero(rare)
    owner = np.searchsorted(seed_bounds, chosen, "right") - 1
    at = chosen - seed_bounds[owner]
    lo, hi, here = bounds[owner], bounds[owner + 1], bounds[owner] + at
    other = mix(hashes ^ AFTER)
    after, before = context(other, here + K, lo, hi), context(other, here - CONTEXT, lo, hi)
    runs = grams(hashes, LEAST_WORDS)
    run_counts = np.maximum(counts - LEAST_WORDS + 1, 0)
    run_bounds = np.concatenate([[0], np.cumsum(run_counts)])
    runs = runs[np.repeat(bounds[:-1] - run_bounds[:-1], run_counts) + np.arange(run_bounds[-1])]
    run_at = minimizers(runs, run_bounds, RUN_SPAN)
    run_owner = np.searchsorted(run_bounds, run_at, "right") - 1
    key = np.concatenate([mix(seeds[chosen] ^ after ^ AFTER), mix(seeds[chosen] ^ before ^ BEFORE), mix(runs[run_at] ^ RUN)])
    text, place = np.concatenate([owner, owner, run_owner]), np.concatenate([at, at, run_at - run_bounds[run_owner]])
    order = np.argsort(mix(key ^ mix(text.astype(U64))), kind="stable")
    key, text, place = key[order], text[order], place[order]
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (text[1:] == text[:-1])])
    return key, text, place, np.where(again, np.concatenate([[-1], place[:-1]]), -1)


def places(docs: DataFrame, live=None) -> DataFrame:
    """(seed, key, at, before) of texts (key, text), as keys_of has them; a text met again in
    the same task is passed over. live: a broadcast map of the seeds wanted; without it only
    the first place of a seed in a text is returned."""

    def run(batches):
        seen: set[int] = set()
        for chunk in chunks(batches):
            own = chunk.column("key").to_numpy()
            fresh = np.zeros(len(own), bool)
            for i, x in enumerate(own.tolist()):
                fresh[i] = x not in seen
                seen.add(x)
            hashes, bounds, _, _ = words(*text_bytes(chunk.column("text").filter(pa.array(fresh))))
            key, text, at, before = keys_of(hashes, bounds)
            some = before < 0 if live is None else (before >= 0) | in_bitmap(live.value, signed(key) % KEY_SLOTS)
            columns = [signed(key[some]), own[fresh][text[some]], at[some].astype(np.int32), before[some].astype(np.int32)]
            yield pa.record_batch([pa.array(x) for x in columns], ["seed", "key", "at", "before"])

    return docs.mapInArrow(run, "seed long, key long, at int, before int")


def chains(at: np.ndarray, source: np.ndarray, k: int = 5, gap: float = GAP, least: int = 1) -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """Collinear chains of `least` matches or more: (first, end, source first, source end,
    places of the matches in both).

    score(i) = k + max(0, max over j before i in both texts of score(j) - gap * distance),
    the distance being the sum of both; the maximum over what is before in the source is
    a prefix maximum of a Fenwick tree, filled in the order of the other text. A chain is
    parted where it leaves its first diagonal by more than DRIFT words (an insertion).
    """
    order = np.lexsort((-source, at))
    at, source = at[order].tolist(), source[order]
    ranks = (np.unique(source, return_inverse=True)[1] + 1).tolist()
    source = source.tolist()
    n, top = len(at), max(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (top + 1)
    score, back = [0.0] * n, [-1] * n
    for i in range(n):
        best, where, r = float("-inf"), -1, ranks[i] - 1
        while r > 0:
            if tree[r][0] > best:
                best, where = tree[r]
            r &= r - 1
        cost = gap * (at[i] + source[i])
        if best - cost > 0:
            score[i], back[i] = k + best - cost, where
        else:
            score[i] = k
        value, r = (score[i] + cost, i), ranks[i]
        while r <= top:
            if value[0] > tree[r][0]:
                tree[r] = value
            r += r & -r
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda i: (-score[i], at[i])):
        if used[i]:
            continue
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = back[j]
        chain.reverse()
        lo = 0
        for hi in range(1, len(chain) + 1):
            first, last = chain[lo], chain[hi - 1]
            if hi < len(chain) and abs((at[chain[hi]] - source[chain[hi]]) - (at[first] - source[first])) <= DRIFT:
                continue
            if hi - lo >= least:
                out.append((at[first], at[last] + k, source[first], source[last] + k, [(at[c], source[c]) for c in chain[lo:hi]]))
            lo = hi
    return out


def aligned(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Edit distances of word lists, in a band of BAND words around the line between the
    ends; a distance that leaves the band counts as the longer length."""
    out = np.array([max(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64)
    order = np.argsort([len(a) for a in x], kind="stable")
    for lo in range(0, len(order), 128):
        rows = order[lo : lo + 128]
        rows = rows[[abs(len(x[i]) - len(y[i])) < BAND for i in rows]]
        if not len(rows):
            continue
        n = max(len(x[i]) for i in rows)
        width = 2 * BAND + 1
        p, t = np.zeros((len(rows), n), np.int64), np.zeros((len(rows), n + width), np.int64)
        for r, i in enumerate(rows):
            p[r, : len(x[i])] = x[i]
            t[r, BAND : BAND + len(y[i])] = y[i][: n + BAND + 1]
        p[p == 0], t[t == 0] = -1, -2  # fillers are equal to nothing
        steps = np.arange(width)
        row = np.where(steps >= BAND, steps - BAND, 1 << 20)[None, :].repeat(len(rows), axis=0)
        ends = {i: (len(x[i]), BAND + len(y[i]) - len(x[i])) for i in rows}
        stops: dict[int, list[tuple[int, int, int]]] = {}
        for r, i in enumerate(rows):
            stops.setdefault(ends[i][0], []).append((r, i, ends[i][1]))
        for step in range(n):
            diagonal = row + (t[:, step : step + width] != p[:, step : step + 1])
            skipped = np.concatenate([row[:, 1:], np.full((len(rows), 1), 1 << 20)], axis=1) + 1
            outside = step + 1 + steps < BAND
            best = np.where(outside, 1 << 20, np.minimum(diagonal, skipped)) - steps
            row = np.minimum.accumulate(best, axis=1) + steps
            for r, i, column in stops.get(step + 1, ()):
                out[i] = min(out[i], row[r, column])
    return out


def runs(places: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Matches of k words as disjoint runs (place, source place, words), in order."""
    out: list[tuple[int, int, int]] = []
    for a, b in places:
        n = k
        if out:
            p, q, m = out[-1]
            if b - a == q - p and a <= p + m:
                out[-1] = (p, q, max(m, a + k - p))
                continue
            over = max(p + m - a, q + m - b, 0)
            a, b, n = a + over, b + over, k - over
        if n > 0:
            out.append((a, b, n))
    return out


def parts(found: list[tuple[int, int, int]], edits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """A chain of runs, with the edits between each and the next, as parts that are similar
    enough by themselves: (first, end, source first, source end, edits). It is parted at
    every stretch of edits, and then at the most edits in a row while a part has too many."""
    total = np.concatenate([[0], np.cumsum(edits, dtype=np.int64)])
    out, left = [], [(0, len(found) - 1)]
    while left:
        lo, hi = left.pop()
        (a, b, _), (p, q, n) = found[lo], found[hi]
        lost = int(total[hi] - total[lo])
        most = max(edits[lo:hi], default=0)
        if most < STRETCH and lost <= (1 - SIMILAR) * max(p + n - a, q + n - b) + 1e-9:
            out.append((a, p + n, b, q + n, lost))
        else:
            at = lo + edits[lo:hi].index(most)
            left += [(at + 1, hi), (lo, at)]
    return out


def reach(x: list[np.ndarray], y: list[np.ndarray], band: int = DRIFT) -> tuple[np.ndarray, np.ndarray]:
    """How far leading words align, over edits: (words of x, words of y, edits) where the
    words less twice the edits are most, and where the words less five times the edits are.
    It ends where the former has fallen by STRETCH. Both end with equal words."""
    near, far = np.zeros((len(x), 3), np.int64), np.zeros((len(x), 3), np.int64)
    order = np.argsort([len(a) for a in x], kind="stable")
    width = 2 * band + 1
    steps = np.arange(width)
    for lo in range(0, len(order), 256):
        rows = order[lo : lo + 256]
        n, r = max(len(x[i]) for i in rows), np.arange(len(rows))
        p, t = np.full((len(rows), n), -1, np.int64), np.full((len(rows), n + width), -2, np.int64)
        for at, i in enumerate(rows):
            p[at, : len(x[i])] = x[i]
            some = y[i][: n + band + 1]
            t[at, band : band + len(some)] = some
        row = np.where(steps >= band, steps - band, 1 << 20)[None, :].repeat(len(rows), axis=0)
        before, alive = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        tops = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)]
        for step in range(n):
            diagonal = row + (t[:, step : step + width] != p[:, step : step + 1])
            skipped = np.concatenate([row[:, 1:], np.full((len(rows), 1), 1 << 20)], axis=1) + 1
            best = np.where(step + 1 + steps < band, 1 << 20, np.minimum(diagonal, skipped)) - steps
            row = np.minimum.accumulate(best, axis=1) + steps
            column = row.argmin(axis=1)
            lost = row[r, column]
            for out, top, cost in ((near, tops[0], 2), (far, tops[1], 5)):
                score = step + 1 - cost * lost
                on = alive & (lost == before) & (score >= top)
                top[on] = score[on]
                out[rows[on]] = np.stack([np.full(on.sum(), step + 1), step + 1 + column[on] - band, lost[on]], axis=1)
            before = lost
            alive &= tops[0] - (step + 1 - 2 * lost) <= STRETCH
            if not alive.any():
                break
    return near, far


def judged(x: list[np.ndarray], y: list[np.ndarray], found: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int, int, float]]]:
    """Passages (first, end, source first, source end, similarity) of chains of runs."""
    edits: list[list[int]] = []
    one, two, places = [], [], []
    for i, chain in enumerate(found):
        edits.append([])
        for (a, b, n), (p, q, _) in zip(chain[:-1], chain[1:], strict=True):
            u, v = x[i][a + n : p], y[i][b + n : q]
            lost = max(len(u), len(v))
            if lost <= WIDE and min(len(u), len(v)):
                same = len(u) == len(v)
                lost = int(np.count_nonzero(u != v)) if same else lost
                if lost > 2 or not same:
                    one.append(u)
                    two.append(v)
                    places.append((i, len(edits[-1])))
            edits[-1].append(lost)
    for (i, at), lost in zip(places, aligned(one, two) if one else (), strict=True):
        edits[i][at] = int(lost)
    every = [(i, part) for i, chain in enumerate(found) for part in parts(chain, edits[i])]
    if not every:
        return [[] for _ in found]
    back = reach([x[i][max(p[0] - MARGIN, 0) : p[0]][::-1] for i, p in every], [y[i][max(p[2] - MARGIN - DRIFT, 0) : p[2]][::-1] for i, p in every])
    ahead = reach([x[i][p[1] : p[1] + MARGIN] for i, p in every], [y[i][p[3] : p[3] + MARGIN + DRIFT] for i, p in every])
    back, ahead = np.stack(back).tolist(), np.stack(ahead).tolist()
    out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in found]
    for at, (i, (a0, a1, b0, b1, lost)) in enumerate(every):
        best = None
        for l, r in ((0, 0), (0, 1), (1, 0), (1, 1)):
            (la, lb, le), (ra, rb, re) = back[l][at], ahead[r][at]
            similar = 1 - (lost + le + re) / max(a1 - a0 + la + ra, b1 - b0 + lb + rb)
            if a1 - a0 + la + ra >= LEAST_WORDS and similar >= SIMILAR - 1e-9 and (best is None or a1 + ra - a0 + la > best[1] - best[0]):
                best = (a0 - la, a1 + ra, b0 - lb, b1 + rb, similar)
        if best and not any(c[0] <= best[0] and best[1] <= c[1] and c[2] <= best[2] and best[3] <= c[3] for c in out[i]):
            out[i] = [c for c in out[i] if not (best[0] <= c[0] and c[1] <= best[1] and best[2] <= c[2] and c[3] <= best[3])] + [best]
    return out


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, source_doc_id, source_start, source_end, similarity, copy):
    passages in words, end exclusive; copy: the row's whole text is another document's."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    texts = docs.select("key", "text")

    def measured(chunk: pa.RecordBatch) -> pa.RecordBatch:
        offsets, data = text_bytes(chunk.column("text"))
        return pa.record_batch([chunk.column("doc_id"), chunk.column("key"), pa.array(word_counts(offsets, data))], ["doc_id", "key", "n"])

    rows = cut(arrow_map(docs, measured, "doc_id long, key long, n long").where(f"n >= {LEAST_WORDS}"), "rows")
    first = cut(rows.groupBy("key").agg(F.min("doc_id").alias("first")), "first")

    leads = places(texts).groupBy("seed").agg(F.min("key").alias("source"), F.min_by("at", "key").alias("source_at"), F.max("key").alias("last"))
    leads = cut(leads.where("last > source").select("seed", "source", "source_at"), "leads")
    live = spark.sparkContext.broadcast(bitmap(leads, F.pmod("seed", F.lit(KEY_SLOTS)), KEY_SLOTS))
    # written first: a join of two plain exchanges is one whose hot seeds Spark can split
    every = cut(places(texts, live), "places")
    met = every.where("before < 0").join(leads, "seed").where("key <> source").select("key", "source", "at", "source_at")
    met = met.union(every.where("before >= 0").select("key", F.col("key").alias("source"), "at", F.col("before").alias("source_at")))
    met = met.select("key", "source", F.floor(F.col("at") / BLOCK).alias("block"), F.struct("at", "source_at").alias("m"))

    def chained(batches):
        names = ["key", "source", "a0", "a1", "b0", "b1", "runs"]
        for batch in batches:
            out = []
            offsets = batch.column("m").offsets.to_numpy()
            flat = batch.column("m").values
            at, source = (flat.field(i).to_numpy() for i in (0, 1))
            for i, (key, other) in enumerate(zip(batch.column("key").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                lo, hi = offsets[i], offsets[i + 1]
                for *ends, matched in chains(at[lo:hi], source[lo:hi], K):
                    out.append((key, other, *ends, [v for run in runs(matched, K) for v in run]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.list_(pa.int32()))], names)

    groups = met.groupBy("key", "source", "block").agg(F.collect_set("m").alias("m")).drop("block")
    found = cut(groups.mapInArrow(chained, "key long, source long, a0 long, a1 long, b0 long, b1 long, runs array<int>"), "chains")
    drop(every, leads)

    wanted = found.select("key").union(found.select("source")).select(F.pmod("key", F.lit(TEXT_SLOTS)).alias("p"))
    bits = spark.sparkContext.broadcast(bitmap(wanted, F.col("p"), TEXT_SLOTS))

    def coded(batches):
        seen: set[int] = set()

        def fresh(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.column("key").to_numpy()
            some = in_bitmap(bits.value, own % TEXT_SLOTS)
            for i in np.flatnonzero(some):
                some[i] = own[i] not in seen
                seen.add(own[i])
            return batch.filter(pa.array(some))

        for chunk in chunks(fresh(x) for x in batches):
            hashes, bounds, _, _ = words(*text_bytes(chunk.column("text")))
            yield pa.record_batch([chunk.column("key"), list_array((hashes >> U64(32)).astype(np.uint32).view(np.int32), bounds, pa.int32())], ["key", "words"])

    coded_texts = texts.mapInArrow(coded, "key long, words array<int>")
    coded_texts = cut(coded_texts.groupBy("key").agg(F.first("words").alias("words")), "words")

    def part(lo: str, hi: str):
        start = F.greatest(F.col(lo) - MARGIN, F.lit(0))
        return F.slice("words", (start + 1).cast("int"), (F.col(hi) + MARGIN - start).cast("int"))

    def compared(batches):
        names = ["key", "source", "a0", "a1", "b0", "b1", "similarity"]
        for batch in batches:
            x, y, flat = ([v.values.to_numpy() for v in batch.column(c)] for c in ("x", "y", "runs"))
            p, q = (np.maximum(batch.column(c).to_numpy() - MARGIN, 0).tolist() for c in ("a0", "b0"))
            chain = [[(a - p[i], b - q[i], n) for a, b, n in f.reshape(-1, 3).tolist()] for i, f in enumerate(flat)]
            keys, others = batch.column("key").to_pylist(), batch.column("source").to_pylist()
            out = []
            for i, some in enumerate(judged(x, y, chain)):
                out += [(keys[i], others[i], a0 + p[i], a1 + p[i], b0 + q[i], b1 + q[i], s) for a0, a1, b0, b1, s in some]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.float64())], names)

    one = found.join(coded_texts, "key").withColumn("x", part("a0", "a1")).drop("words")
    two = one.join(coded_texts.withColumnRenamed("key", "source"), "source").withColumn("y", part("b0", "b1")).drop("words")
    done = cut(two.select("key", "source", "a0", "b0", "x", "y", "runs").mapInArrow(compared, FOUND), "done").distinct()
    drop(found, coded_texts)
    done = done.join(first.withColumnRenamed("first", "doc_id"), "key").join(first.select(F.col("key").alias("source"), F.col("first").alias("source_doc_id")), "source")
    parts = done.select("doc_id", F.col("a0").alias("start"), F.col("a1").alias("end"), "source_doc_id", F.col("b0").alias("source_start"), F.col("b1").alias("source_end"), "similarity", F.lit(False).alias("copy"))

    zero = F.lit(0).cast("long")
    copies = rows.join(first, "key").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = copies.select("doc_id", zero.alias("start"), F.col("n").alias("end"), F.col("first").alias("source_doc_id"), zero.alias("source_start"), F.col("n").alias("source_end"), F.lit(1.0).alias("similarity"), F.lit(True).alias("copy"))
    return parts.union(copies)
