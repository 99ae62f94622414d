"""Columns of clashing names and very long texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import prose

from gleaner.llm import fill_in_middle, packing, quality_classifier, secrets, suffix_dedup, token_counts, toxicity
from gleaner.llm.tokens import byte_tokens, word_tokens

CLASHES = "_n _size _total _rank _deal _salt _row _from _c _b _text _rest spans assign length start rank score label quality toxic f n all t a r at lo hi kind form output ids_crc32 held_out predicted n_docs prefix_chars _fim _sha ranges".split()


@pytest.fixture(scope="module")
def tables(spark, make_docs):
    docs = make_docs([(i, prose(i % 9, 30 + i)) for i in range(24)] + [(40, None), (41, ""), (42, "password=abcdef1 x"), (5, prose(5, 35))])
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(24)], "doc_id long, quality int, toxic int")
    return docs, docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in docs.columns]), labels.withColumn("text", F.lit("x")).withColumn("n", F.lit(1)), labels


def rows(frame):
    return sorted((tuple(r) for r in frame.select(*sorted(frame.columns)).collect()), key=str)


def test_extra_columns_change_nothing(tables):
    docs, clashing, more, labels = tables
    for made in (
        lambda d: token_counts.sums(token_counts.histogram(d)), packing.packed_pieces, secrets.scan, suffix_dedup.deduplicated,
        lambda d: fill_in_middle.digests(fill_in_middle.transformed(d)),
    ):
        assert rows(made(docs)) == rows(made(clashing))
    for module in (toxicity, quality_classifier):
        assert rows(module.judged(docs, labels)) == rows(module.judged(clashing, more))


def test_redaction_keeps_clashing_columns(tables):
    docs, clashing, *_ = tables
    plain, other = secrets.redacted(docs), secrets.redacted(clashing)
    assert other.columns == clashing.columns and plain.columns == docs.columns
    assert rows(plain) == rows(other.select(*docs.columns)) and {r["_row"] for r in other.collect()} == {"clash"}


@pytest.fixture(scope="module")
def long_text():
    return " ".join(prose(i, 400) for i in range(700)) + " é漢🙂" * 2000 + "w" * 300_000


def test_long_texts_are_taken_whole(spark, make_docs, long_text):
    docs = make_docs([(1, long_text), (2, "short")])
    n = len(byte_tokens(token_counts.TOKENIZER).encode_ordinary(long_text))
    assert n in {r["length"] for r in token_counts.sums(token_counts.histogram(docs)).collect()}
    ids = word_tokens(packing.TOKENIZER).tokenizer.encode(long_text, add_special_tokens=False).ids
    pieces = [r for r in packing.packed_pieces(docs).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in pieces) == len(ids) + 1 == pieces[0]["doc_tokens"]
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_classifier):
        got = {r["doc_id"]: r["score"] for r in module.judged(docs, labels).collect()}
        assert 0 <= got[1] <= 1 and got[2] is not None


def test_features_do_not_depend_on_windows(long_text, monkeypatch):
    """Words and n-grams of characters over the edges of windows, and of several texts."""
    column = pa.array([long_text[:5000], "", None, "a b", long_text[-700:-10] + "é漢", "漢" * 50, long_text[2000:9000]])

    def counts():
        owner, bucket = quality_classifier.features(column)
        return np.unique((owner << 20) | bucket, return_counts=True)

    whole = counts()
    for size in (7, 64, 1000):
        monkeypatch.setattr(quality_classifier, "CHARS", size)
        assert all((x == y).all() for x, y in zip(whole, counts(), strict=True))
