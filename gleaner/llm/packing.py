"""Packing documents into training sequences (operator 10).

A document's ids (with the end id 1 appended) are cut into pieces of at most `limit`
ids: full pieces and a rest. The pieces' length histogram, at most `limit` rows whatever
the corpus, is packed on the driver: lengths are placed longest first, each into the
packs with the most room that have enough (shortest pack first), whole counts at a time,
so that the work depends on the histogram and not on the documents. When no pack has room,
new ones are opened and filled with that length one after the other. A pattern is thus a
list of lengths and a number of packs. Pieces get their rank among those of their length
and find pattern, pack and offset by a join on the range of ranks.

Null and empty text: one piece with the end id. Repeated rows, null and equal doc_ids
are packed each; ties in rank are broken by doc_id, start and checksum. Extra columns are
ignored. An empty table gives no rows. Sequence ids are gapless from 0.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import arrow_map, cut, ranked, salt
from gleaner.llm.tokens import word_tokens

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
END = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """The documents' pieces, with the CRC-32 of each one's ids (little-endian, 32 bits)."""

    def run(chunk: pa.RecordBatch) -> pa.RecordBatch:
        flat, bounds = word_tokens(tokenizer).ids(chunk.column("text"))
        end = np.array([END], "<u4")
        rows = []
        for doc_id, lo, hi in zip(chunk.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
            ids = np.concatenate([flat[lo:hi], end]).astype("<u4")
            for start in range(0, len(ids), limit):
                piece = ids[start : start + limit]
                rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Shortest-pack-first over a length histogram: (lengths of a pack, packs like it)."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if most is None:  # new packs, each filled with this length before the next is opened
                fit = limit // length
                for pieces, n in ((fit, left // fit), (left % fit, 1)):
                    if pieces and n:
                        room[limit - pieces * length].append(([length] * pieces, n))
                break
            lengths, n = room[most].pop()
            used = min(n, left)
            if n > used:
                room[most].append((lengths, n - used))
            room[most - length].append(([*lengths, length], used))
            left -= used
    return [pack for r in sorted(room) for pack in room[r]]


def slots(packed: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence, place): pieces of that length with ranks lo..hi go to
    the sequences from `sequence` on, at offset `place`."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, n in packed:
        place = 0
        for length in lengths:
            out.append((length, used[length], used[length] + n - 1, sequence, place))
            used[length] += n
            place += length
        sequence += n
    return out


def packed_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    spark = docs.sparkSession
    made = pieces(docs, tokenizer, limit)
    cuts = cut(made.withColumn("_deal", salt(512, "doc_id", "start", "ids_crc32")), "pieces")
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most `limit` rows
    schema = "length long, lo long, hi long, sequence long, place long"
    where = spark.createDataFrame(slots(patterns(histogram, limit)), schema)
    own = ranked(cuts, ["length"], ["doc_id", "start", "ids_crc32"], "_deal")
    met = own.join(where.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("lo"), F.col("hi")))
    return met.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("place").alias("offset"),
    )
