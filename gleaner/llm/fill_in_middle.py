"""Fill-in-the-middle transformation (operator 11).

A text is a run of units (lines with their newline; the last may lack it). `regexp_count`
gives their number n; two draws from 0..n, from a hash of seed and doc_id, are where the
middle starts and ends. A pattern is then made for each row: its first group takes `a` units
and its second the next `b - a`, by counted possessive quantifiers, its third the rest, so
that one match captures prefix, middle and suffix, and one replacement writes them in their
new order. Possessive groups are matched in a loop, without a frame of the stack for each
line and without backtracking, so texts of any number of lines pass.

Forms: `psm` is prefix, suffix, middle; `spm` suffix, prefix, middle; `plain` leaves the text
as it is: when it is empty, holds one of the marks already, or isn't drawn at the given rate.
As no part holds a mark and no two marks overlap, the first mark of a kind found in an output
is the one that was written, so `restored` rebuilds the text from output and form alone.

All of it is one projection over the table; nothing is shuffled. Null text counts as empty
and its output is the empty text. A null doc_id is drawn as the seed without a number.
Repeated rows come out alike; extra columns stay; columns of the names that are added here
are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM = 7, 100, 50
#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line; the possessive forms match what `[^\n]*\n|[^\n]+` does.
UNIT = r"(?:[^\n]*+\n|[^\n]++)"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers for a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with n (units), form, output, prefix_chars and middle_chars (null where plain).
    rate: percent of texts that are transformed; spm: percent of those in that form."""
    text = F.coalesce("text", F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    n = F.regexp_count(text, F.lit(UNIT)).cast("long")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(mark)
    plain = (text == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    n_, form_, a, b = F.col("n"), F.col("form"), F.col("_fim.a"), F.col("_fim.b")
    group = lambda k: F.concat(F.lit(f"({UNIT}{{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), group(a), group(b - a), F.lit(r"((?s:.*+))\z"))
    order = F.when(form_ == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(form_ == "plain", text).otherwise(F.regexp_replace(text, pattern, order))
    at = lambda mark: F.instr("output", mark).cast("long")
    next_mark = F.when(form_ == "psm", at(SUFFIX)).otherwise(at(MIDDLE))
    return (
        docs.withColumn("n", n)
        .withColumn("form", form)
        .withColumn("_fim", F.struct(F.least(h1 % (n_ + 1), h2 % (n_ + 1)).alias("a"), F.greatest(h1 % (n_ + 1), h2 % (n_ + 1)).alias("b")))
        .withColumn("output", output)
        .withColumn("prefix_chars", F.when(form_ != "plain", next_mark - at(PREFIX) - len(PREFIX)))
        .withColumn("middle_chars", F.when(form_ != "plain", F.length("output").cast("long") - at(MIDDLE) - len(MIDDLE) + 1))
        .drop("_fim")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of `transformed` was made of."""
    psm = rf"\A{PREFIX}((?s:.*?)){SUFFIX}((?s:.*?)){MIDDLE}((?s:.*+))\z"
    spm = rf"\A{SUFFIX}((?s:.*?)){PREFIX}((?s:.*?)){MIDDLE}((?s:.*+))\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, spm, "$2$3$1"))
        .otherwise(output)
    )


def digests(made: DataFrame) -> DataFrame:
    """What is compared of a transformed table: lengths, and hashes of output and rebuilt text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
