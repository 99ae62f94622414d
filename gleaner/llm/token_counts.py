"""Token counts from an exact length histogram (operator 4).

Documents are counted by encoded length in one pass. The histogram has a row for each
length that occurs and answers everything else: totals, quantiles and, for any context
limit, the tokens left after truncation, without going back to the texts.

Prefix and suffix sums run over blocks of lengths: within each block, and over the
blocks' totals, so no task gets the whole histogram. Null and empty text have length 0.
Repeated rows count each. Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import arrow_map, cut
from gleaner.llm.tokens import byte_tokens, strings

TOKENIZER = "byte_bpe_50k.tiktoken"
BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, length) of each row."""

    def run(chunk: pa.RecordBatch) -> pa.RecordBatch:
        encode = byte_tokens(tokenizer).encode_ordinary
        found = [len(encode(x)) for x in strings(chunk.column("text"))]
        return pa.record_batch([chunk.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "length"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, length long")


def histogram(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(length, n_docs), written, so that whatever is asked of it leaves the texts alone."""
    return cut(lengths(docs, tokenizer).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")


def sums(hist: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of that length (n_docs, n_tokens), of up
    to L (docs_to, tokens_to), documents of L or more (docs_from), their tokens
    (tokens_from), and truncated_tokens: what is left when all are cut at L."""
    block = F.floor(F.col("length") / BLOCK)
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), block.alias("_b"))
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    up = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for 1024 lengths
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = blocks.select("_b", zero(F.sum("_d").over(up)).alias("_d0"), zero(F.sum("_t").over(up)).alias("_t0"), F.sum("_d").over(every).alias("_dn"), F.sum("_t").over(every).alias("_tn"))
    within = Window.partitionBy("_b").orderBy("length")
    out = h.join(before, "_b").withColumn("docs_to", F.col("_d0") + F.sum("n_docs").over(within)).withColumn("tokens_to", F.col("_t0") + F.sum("n_tokens").over(within))
    out = out.withColumn("docs_from", F.col("_dn") - F.col("docs_to") + F.col("n_docs")).withColumn("tokens_from", F.col("_tn") - F.col("tokens_to") + F.col("n_tokens"))
    return out.select(
        "length", "n_docs", "n_tokens", "docs_to", "tokens_to", "docs_from", "tokens_from",
        (F.col("tokens_to") - F.col("n_tokens") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
    )


def quantiles(summed: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least that share of documents doesn't exceed."""
    summed = cut(summed, "sums")
    total = summed.select((F.max("docs_to")).alias("n")).scalar()
    each = [F.min(F.when(F.col("docs_to") >= F.lit(s) * total, F.col("length"))).alias(f"q{s:g}") for s in shares]
    return summed.agg(*each)


def truncated(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """(context, total_tokens, kept_tokens) for any limits (context): every limit is put
    at the greatest length below it, a join on ranges of one row each."""
    s = cut(sums(hist), "sums")
    s = s.withColumn("_b", F.floor(F.col("length") / BLOCK))
    heads = s.groupBy("_b").agg(F.min("length").alias("_head"))
    heads = heads.select("_b", F.lead("_head").over(Window.orderBy("_b")).alias("_head"))  # a row for 1024 lengths
    own = F.lead("length").over(Window.partitionBy("_b").orderBy("length"))
    after = s.withColumn("_own", own).join(heads, "_b").withColumn("_next", F.coalesce("_own", "_head"))
    total = s.select(F.sum("n_tokens")).scalar()
    docs = s.select(F.sum("n_docs")).scalar()
    met = limits.join(after, (F.col("length") <= F.col("context")) & (F.col("_next").isNull() | (F.col("_next") > F.col("context"))), "left")
    kept = F.coalesce(F.col("tokens_to") + F.col("context") * (docs - F.col("docs_to")), F.col("context") * docs, F.lit(0))
    return met.select("context", F.coalesce(total, F.lit(0)).alias("total_tokens"), kept.alias("kept_tokens"))
