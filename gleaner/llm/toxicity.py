"""Toxicity by FTRL-proximal logistic regression (operator 7).

Features are hashed word n-grams (1 and 2) and skip-grams (two words with one left out),
each counted once in a document. Every coordinate has its own learning rate, and the L1
term keeps a weight at 0 until its gradients add up to more than chance, so what is left
is a short list of (bucket, weight) that can be broadcast whatever the corpus.

Learning takes at most SAMPLE labelled documents, those least by a hash of doc_id, outside
of the held-out fold; features are made on all executors, and one task makes PASSES over
them, since the method is sequential; its input is bounded by SAMPLE documents and by
SAMPLE_BYTES of text in all (those first by the hash; none above a 64th of it): of
rows that share a labelled doc_id it learns from the least text. Scores use the text
alone. Null, empty and unseen texts get the bias alone. Rows are scored each, whatever
their doc_id; a null doc_id is in no fold. With no labels all weights are 0 and scores 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import U64, arrow_map, bounded_sample, cut, held_out, list_array, mix, text_bytes, within_bytes, words

BITS, SAMPLE, PASSES = 18, 20_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
#: Bytes of text that the learning task's documents have together at most.
SAMPLE_BYTES = 96 << 20
FOLDS, FOLD = 5, 0

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[c for c in range(128) if not chr(c).isalnum()]] = 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every feature of a column of texts, repeats included."""
    offsets, data = text_bytes(column)
    h, bounds, _, _ = words(offsets, _BLANK[data])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    buckets, owners = [h], [owner]
    for gap, salt in ((1, 0xA5A5A5A5), (2, 0x5EED5EED)):
        if len(h) > gap:
            same = owner[:-gap] == owner[gap:]
            buckets.append(mix(mix(h[:-gap] ^ U64(salt)) + h[gap:])[same])
            owners.append(owner[gap:][same])
    return np.concatenate(owners), (np.concatenate(buckets) >> U64(64 - BITS)).astype(np.int64)


def distinct(owner: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct buckets, and their bounds."""
    codes = np.unique((owner << BITS) | bucket)
    return codes & ((1 << BITS) - 1), np.searchsorted(codes >> BITS, np.arange(n + 1))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the bias, from one document after the other."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    for _ in range(passes):
        for row, label in zip(rows, labels, strict=True):
            at = np.append(row, size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], float(w[-1])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The non-zero weights as an array over buckets, and the bias."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), FOLDS, FOLD))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = cut(bounded_sample(own, ["doc_id"], sample), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own, "doc_id")
    # one row an id, so that the sample bounds what the learning task gets
    texts = cut(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    texts = within_bytes(texts, ["doc_id"], F.coalesce(F.octet_length("text"), F.lit(0)), SAMPLE_BYTES)

    def made(chunk: pa.RecordBatch) -> pa.RecordBatch:
        got, bounds = distinct(*features(chunk.column("text")), chunk.num_rows)
        return pa.record_batch([chunk.column("doc_id"), chunk.column("toxic"), list_array(got.astype(np.int32), bounds, pa.int32())], ["doc_id", "toxic", "f"])

    rows = arrow_map(texts, made, "doc_id long, toxic int, f array<int>")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        f = [x.values.to_numpy() for x in table.column("f")]
        order = np.random.default_rng(7).permutation(len(f))
        w, bias = ftrl([f[i] for i in order], table.column("toxic").to_numpy()[order])
        some = np.flatnonzero(w)
        return pa.table({"bucket": pa.array([-1, *some.tolist()], pa.int32()), "weight": pa.array([bias, *w[some].tolist()], pa.float64())})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "bucket int, weight double").collect()  # 2 ** BITS rows at most
    weights, bias = np.zeros(1 << BITS), 0.0
    for bucket, weight in found:
        if bucket < 0:
            bias = weight
        else:
            weights[bucket] = weight
    return weights, bias


def scored(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) a row."""
    some = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((some, weights[some], bias))
    known: dict[str, np.ndarray] = {}

    def run(chunk: pa.RecordBatch) -> pa.RecordBatch:
        if "w" not in known:
            known["w"] = np.zeros(1 << BITS)
            known["w"][shared.value[0]] = shared.value[1]
        owner, bucket = features(chunk.column("text"))
        live = known["w"][bucket] != 0
        got, bounds = distinct(owner[live], bucket[live], chunk.num_rows)
        total = np.concatenate([[0], np.cumsum(known["w"][got])])
        logit = total[bounds[1:]] - total[bounds[:-1]] + shared.value[2]
        return pa.record_batch([chunk.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) a row of docs."""
    rows = scored(docs, *trained(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
