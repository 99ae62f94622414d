"""Quality rules with a bitmask ledger (operator 6).

Every rule is evaluated once for every document. The ledger keeps the measurements and
one long with a bit for each failed rule; a versioned policy is a set of bits, so a new
policy, its verdicts and its ablations need no second pass over the texts.

Null text counts as having no words; it fails `few_words`. Words are
[^\\x20\\x09-\\x0D]+, lines are split at \\n, lengths are code points. Repeated rows and
null doc_ids are judged row by row; extra columns stay as they are. Ties don't arise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, count_within, mix, shingles, small_batches, span_hashes, text_bytes, words
from gleaner.llm.common import _SPACE as SPACE

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: name -> condition of failing; the place in this table is the bit. Append only.
RULES = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 60 * word_chars AND n_words > 0",
    "marks": "2 * n_marks > n_words AND n_words > 0",
}
#: version -> the rules that count. A published version is never changed.
POLICIES = {
    "base": ("few_words", "repeat_words"),
    "2026-11": tuple(RULES),
}
CURRENT = "2026-11"


def policy_mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(x) for x in POLICIES[version])


_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def measure(column: pa.Array) -> list[np.ndarray]:
    """The measurements of each text, in the order of MEASURES."""
    offsets, data = text_bytes(column)
    hashes, bounds, _, _ = words(offsets, data, lower=False)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(len(hashes) + 2, bool)
    if len(hashes) >= 3:
        windows, _ = shingles(hashes, np.array([0, len(hashes)]), 3)
        own = owner[:-2] == owner[2:]
        keys = mix(windows ^ mix(owner[:-2].astype(np.uint64)))
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = own & (np.bincount(inverse, own, len(times))[inverse] >= 2)
        for j in range(3):
            covered[j : j + len(twice)] |= twice
    solid = ~SPACE[data]
    head = (data & 0xC0) != 0x80
    breaks = np.flatnonzero(data == 10)
    starts, stop = np.sort(np.concatenate([breaks + 1, offsets[:-1]])), np.sort(np.concatenate([breaks, offsets[1:]]))
    filled = np.concatenate([[0], np.cumsum(solid)])
    worded = filled[stop] > filled[starts]
    starts, stop = starts[worded], stop[worded]
    line_owner = np.searchsorted(offsets, starts, "right") - 1
    line_keys = mix(span_hashes(data, starts, stop) ^ mix(line_owner.astype(np.uint64)))
    _, first = np.unique(line_keys, return_index=True)
    n_lines = np.bincount(line_owner, minlength=len(counts))
    n_dup = n_lines - np.bincount(line_owner[first], minlength=len(counts))
    return [
        counts, count_within(solid & head, offsets), count_within(_SYMBOL[data], offsets), n_dup,
        count_within(covered[: len(hashes)], bounds), n_lines, count_within(_UPPER[data], offsets), count_within(data == 33, offsets),
    ]


def _measured(text: pa.Array) -> pa.Array:
    parts = [measure(x.column(0)) for x in chunks(iter([pa.record_batch([text], ["text"])]))]
    whole = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(MEASURES))]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in whole], list(MEASURES))


def measures(text: str | Column) -> Column:
    """The measurements of a text column as a struct."""
    return F.arrow_udf(_measured, "struct<" + ",".join(f"{x}:bigint" for x in MEASURES) + ">")(text)


def failed_bits() -> Column:
    """One long: bit i is set if rule i fails, by the measurements in column m."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        condition = F.expr(" ".join(f"m.{x}" if x in MEASURES else x for x in rule.split()))
        bits = bits.bitwiseOR(F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """docs' doc_id with the measurements and `failed`, the bits of failed rules."""
    small_batches(docs.sparkSession)
    made = docs.select("doc_id", measures("text").alias("m"))
    return made.select("doc_id", "m.*", failed_bits().alias("failed"))


def verdict(failed: Column, version: str = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(policy_mask(version))) == 0


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (which
    dropping the rule would let in), and what the policy keeps. The ledger is first
    counted by bits, at most 2 ** len(RULES) rows, then all is bit arithmetic."""
    mask = policy_mask(version)
    bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in POLICIES[version]])
    each = bits.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"),
    )


def kept_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """docs without the rows that the policy rejects, with docs' columns."""
    small_batches(docs.sparkSession)
    row = F.struct(*[docs[c].alias(c) for c in docs.columns])
    judged = docs.select(row.alias("row"), measures("text").alias("m"))
    return judged.where(verdict(failed_bits(), version)).select("row.*")
