"""Operators 7 and 8 against loops over dictionaries: features, training and scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import prose

from gleaner.llm import quality_classifier as Q
from gleaner.llm import toxicity as T

ODD = ["", " ", "a", "a b", "A a\ta", "x-y z_z", "é😀 ß\n\nab", "don't  stop", "1 2 3 1 2 3", None]


def buckets(module, text: str) -> list[int]:
    return module.features(pa.array([text]))[1].tolist()


def word_features(text: str | None) -> list[int]:
    """Buckets of words, neighbours, and words with one between: each from a text of its own."""
    plain = "".join(" " if c < "\x80" and not c.isalnum() else c for c in text or "")
    w = plain.split(" ")
    w = [x for x in w if x]
    out = [buckets(T, x)[0] for x in w]
    out += [buckets(T, f"{a} {b}")[2] for a, b in zip(w, w[1:])]
    return out + [buckets(T, f"{a} q {c}")[5] for a, c in zip(w, w[2:])]


def subword_features(text: str | None) -> list[int]:
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    out = [buckets(Q, x)[0] for x in w] + [buckets(Q, f"{a} {b}")[2] for a, b in zip(w, w[1:])]
    flat = re.sub("[ \t-\r]", " ", text or "")
    for n in (3, 4):
        for i in range(len(flat) - n + 1):
            g = flat[i : i + n]
            if " " not in g[1:-1] and g[0] + g[-1] != "  ":
                out.append(buckets(Q, g)[-1])
    return out


@pytest.mark.parametrize(("module", "plain"), [(T, word_features), (Q, subword_features)])
def test_features_of_each_text(module, plain):
    texts = [*ODD, prose(1, 25), prose(2, 1)]
    owner, bucket = module.features(pa.array(texts))
    for i, text in enumerate(texts):
        assert Counter(bucket[owner == i].tolist()) == Counter(plain(text))


def test_stutters_are_one_feature_in_any_word():
    assert buckets(Q, "ab ab")[2] == buckets(Q, "cd cd")[2] != buckets(Q, "ab cd")[2]


def plain_ftrl(rows: list[list[int]], labels: list[int]) -> tuple[dict[int, float], float]:
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= T.L1:
            return 0.0
        return -(z[i] - math.copysign(T.L1, z[i])) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    for _ in range(T.PASSES):
        for row, label in zip(rows, labels):
            w = {i: weight(i) for i in (*row, -1)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if i >= 0 and weight(i)}, weight(-1)


def corpus(make_docs, spark, n: int, words: int, name: str):
    r, rows = random.Random(8), []
    for i in range(n):
        w = prose(i, words).split()
        if i % 3 == 0:
            w[1:1] = ["scum", "trash"] * 2
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    labels = [(i, int((i % 3 == 0) == (name == "toxic"))) for i, _ in rows]
    return make_docs([*rows, (n, None)]), dict(rows), spark.createDataFrame(labels, f"doc_id long, {name} int"), dict(labels)


def learnt(ids, folds: int, fold: int) -> list[int]:
    return sorted(i for i in ids if zlib.crc32(str(i).encode()) % folds != fold)


def test_toxicity_equals_plain_ftrl(spark, make_docs):
    docs, texts, table, labels = corpus(make_docs, spark, 150, 12, "toxic")
    ids = learnt(labels, T.FOLDS, T.FOLD)
    ids = [ids[i] for i in np.random.default_rng(7).permutation(len(ids))]
    weights, bias = plain_ftrl([sorted(set(word_features(texts[i]))) for i in ids], [labels[i] for i in ids])
    got, got_bias = T.trained(docs, table)
    assert set(np.flatnonzero(got).tolist()) == set(weights) and weights
    assert all(abs(got[i] - w) < 1e-8 for i, w in weights.items()) and abs(got_bias - bias) < 1e-8
    for row in T.judged(docs, table).collect():
        total = bias + sum(weights.get(i, 0) for i in set(word_features(texts.get(row["doc_id"]))))
        assert abs(row["score"] - 1 / (1 + math.exp(-total))) < 1e-8


def test_quality_equals_plain_sgd(spark, make_docs):
    docs, texts, table, labels = corpus(make_docs, spark, 40, 8, "quality")
    ids = learnt(labels, Q.FOLDS, Q.FOLD)
    features = {i: subword_features(t) for i, t in texts.items()}
    rng = np.random.default_rng(11)
    vectors, output = rng.uniform(-1 / Q.DIM, 1 / Q.DIM, (1 << Q.BITS, Q.DIM)).tolist(), [[0.0] * Q.DIM, [0.0] * Q.DIM]
    steps, step = Q.PASSES * len(ids), 0
    for _ in range(Q.PASSES):
        for k in rng.permutation(len(ids)):
            own = features[ids[k]]
            rate, step = Q.RATE * (1 - step / steps), step + 1
            hidden = [sum(vectors[f][d] for f in own) / len(own) for d in range(Q.DIM)]
            logits = [sum(o * h for o, h in zip(row, hidden)) for row in output]
            p = [1 / (1 + math.exp(logits[1] - logits[0])), 1 / (1 + math.exp(logits[0] - logits[1]))]
            p[labels[ids[k]]] -= 1
            back = [p[0] * output[0][d] + p[1] * output[1][d] for d in range(Q.DIM)]
            for c in (0, 1):
                output[c] = [o - rate * p[c] * h for o, h in zip(output[c], hidden)]
            # a bucket's step is the number of distinct ones times its share of the text
            for f, n in Counter(own).items():
                scale = rate * len(set(own)) * n / len(own)
                vectors[f] = [v - scale * b for v, b in zip(vectors[f], back)]
    for row in Q.judged(docs, table).collect():
        own = features.get(row["doc_id"], [])
        mean = [sum(vectors[f][d] for f in own) / max(1, len(own)) for d in range(Q.DIM)]
        logit = sum((output[1][d] - output[0][d]) * mean[d] for d in range(Q.DIM))
        assert abs(row["score"] - 1 / (1 + math.exp(-logit))) < 1e-6
