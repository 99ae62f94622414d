"""Quality by supervised subword embeddings (operator 8).

Features of a text are its words, its word pairs (a word met twice in a row is one
feature whatever the word) and the character n-grams of 3 and 4 of its words with their
edges, hashed into buckets. Each bucket has a learned vector; a text is the average of
its features' vectors, and a softmax over two classes reads it. Vectors and output are
trained together by stochastic gradient descent in numpy.

Learning takes at most SAMPLE labelled documents, those least by a hash of doc_id, outside
of the held-out fold; features are counted on all executors and one task, whose input is
bounded by SAMPLE and by SAMPLE_BYTES of text in all (those first by the hash; none above a
64th of it; of rows that share a labelled doc_id, the least text), makes the passes. For scoring, vectors and output are folded into one
number a bucket. Scores use the text alone. Null, empty and blank texts have no features
and score 0.5. Rows are scored each; a null doc_id is in no fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, arrow_map, bounded_sample, cut, held_out, list_array, mix, text_bytes, within_bytes, words

BITS, DIM, SAMPLE, PASSES, RATE = 17, 8, 8_000, 4, 0.5
#: Bytes of text that the learning task's documents have together at most.
SAMPLE_BYTES = 96 << 20
FOLDS, FOLD, CUT = 4, 2, 0.7
#: Bytes of text whose characters are looked at together.
CHARS = 1 << 18
_B = U64(0x9E3779B97F4A7C15)


def parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and bucket of every feature, repeats included: those of words, then those of
    characters by windows of bytes, so that a text of any length needs little beside itself."""
    offsets, data = text_bytes(column)
    h, bounds, _, _ = words(offsets, data, lower=False)
    place = lambda x: (x >> U64(64 - BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    yield owner, place(h)
    if len(h) > 1:
        same = owner[:-1] == owner[1:]
        pair = mix(mix(h[:-1]) + h[1:])
        # a stutter says the same of a text in any word, and few of its words are in the sample
        pair[h[:-1] == h[1:]] = U64(1) << U64(63)
        yield owner[1:][same], place(pair[same])
    lo = 0
    while lo < len(data):
        hi = _edge(data, lo + CHARS)
        some = data[lo : _edge(data, hi + 9)]  # and three characters more, for n-grams that begin before hi
        at = lo + np.flatnonzero((some & 0xC0) != 0x80)
        points = np.frombuffer(some.tobytes().decode().encode("utf-32-le"), "<u4")
        texts, own = np.searchsorted(offsets, at, "right") - 1, int(np.searchsorted(at, hi))
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        code = np.where(blank, 32, points).astype(U64)
        for n in (3, 4):
            total = min(len(code) - n + 1, own)
            if total <= 0:
                continue
            gram = np.full(total, U64(n))
            whole = texts[:total] == texts[n - 1 : n - 1 + total]
            for k in range(n):
                gram = gram * _B + code[k : k + total]
                if 0 < k < n - 1:
                    whole &= ~blank[k : k + total]
            whole &= ~(blank[:total] & blank[n - 1 : n - 1 + total])
            yield texts[:total][whole], place(mix(gram[whole]))
        lo = hi


def _edge(data: np.ndarray, at: int) -> int:
    """The first character that begins at or after a byte."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every feature of texts of bounded length, at once."""
    owners, buckets = zip(*parts(column), strict=True)
    return np.concatenate(owners), np.concatenate(buckets)


def counted(owner: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, counts = np.unique((owner << BITS) | bucket, return_counts=True)
    return codes & ((1 << BITS) - 1), counts, np.searchsorted(codes >> BITS, np.arange(n + 1))


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = PASSES, seed: int = 11) -> np.ndarray:
    """One number a bucket: its vector's part in the difference of the two outputs."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    output = np.zeros((2, DIM))
    steps, step = passes * len(rows), 0
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            hidden = share @ vectors[at]
            logits = output @ hidden
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ output
            output -= rate * np.outer(p, hidden)
            vectors[at] -= rate * len(at) * share[:, None] * back[None, :]
    return vectors @ (output[1] - output[0])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"), FOLDS, FOLD))
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = cut(bounded_sample(own, ["doc_id"], sample), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id")
    # one row an id, so that the sample bounds what the learning task gets
    texts = cut(texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")
    texts = within_bytes(texts, ["doc_id"], F.coalesce(F.octet_length("text"), F.lit(0)), SAMPLE_BYTES)

    def made(chunk: pa.RecordBatch) -> pa.RecordBatch:
        got, counts, bounds = counted(*features(chunk.column("text")), chunk.num_rows)
        lists = [list_array(x.astype(np.int32), bounds, pa.int32()) for x in (got, counts)]
        return pa.record_batch([chunk.column("doc_id"), chunk.column("quality"), *lists], ["doc_id", "quality", "f", "n"])

    rows = arrow_map(texts, made, "doc_id long, quality int, f array<int>, n array<int>")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        f, n = ([x.values.to_numpy() for x in table.column(c)] for c in ("f", "n"))
        value = sgd([(a, b / max(1, b.sum())) for a, b in zip(f, n, strict=True)], table.column("quality").to_numpy())
        return pa.table({"value": pa.array([value.astype("<f8").tobytes()], pa.binary())})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "value binary").collect()  # one row of 2 ** BITS numbers
    return np.frombuffer(found[0][0], "<f8") if found else np.zeros(1 << BITS)


def scored(docs: DataFrame, value: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(value)

    def run(chunk: pa.RecordBatch) -> pa.RecordBatch:
        total, n = np.zeros(chunk.num_rows), np.zeros(chunk.num_rows, np.int64)
        for owner, bucket in parts(chunk.column("text")):
            total += np.bincount(owner, shared.value[bucket], chunk.num_rows)
            n += np.bincount(owner, minlength=chunk.num_rows)
        logit = total / np.maximum(n, 1)
        return pa.record_batch([chunk.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) a row of docs."""
    rows = scored(docs, trained(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
