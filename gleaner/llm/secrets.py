"""Secret scans (operator 1), in DataFrame functions only.

Base spans are the leftmost, non-overlapping matches of three patterns, per kind; matches
with too short a value are dropped afterwards and still use up their text:
assign (a password-like name, : or =, and a value of 6 or more), access (AKIA and capitals
or digits, 20 or more in all) and hex (24 or more lower-case hex digits).

The method adds markov spans: runs of 20 or more key characters that meet no base span and
that a Markov model of random strings explains better than one of ordinary identifiers.
Both are first-order models over printable ASCII with add-half smoothing, trained from
labelled samples by counting transitions; the log-likelihood ratios of some stretch of the
run must add up to THRESHOLD nats, so that an ordinary name before a key hides nothing. The
models are 96 * 96 ratios whatever the corpus, one literal of the plan.

Null text counts as empty: no spans. Offsets are code points, ends exclusive. Texts of any
length and with any number of spans are scanned whole, in time that grows with both. Repeated rows are judged each, null doc_ids stay, extra columns
are ignored by `scan` and kept by `redacted`. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_sample

KINDS = ("assign", "access", "hex", "markov")
#: The contract's patterns, letters of the names in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run is as long from its first AKIA as from none
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_.=-]{20,}"
SIDE = 96
THRESHOLD = 10.0
#: Characters that a stretch of a run has at least.
STRETCH = 20
#: Bounds of the labelled sample for training.
SAMPLE_DOCS, SAMPLE_NAMES, SAMPLE_RANDOM = 2000, 40_000, 4000
MARK = "[SECRET]"
#: A noncharacter that stands for each hidden one; where a text has it, it counts as a blank.
HIDDEN = "\uffff"
#: Matches of one text that are placed together.
STRIDE = 256


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, label): names put together from words of a bounded sample of documents
    (0), and random strings in common alphabets made from digests of counters (1)."""
    some = bounded_sample(docs.select("doc_id", "text"), ["doc_id", "text"], SAMPLE_DOCS)
    some = some.select(F.expr(r"filter(split(text, '[^A-Za-z]+'), w -> length(w) > 1)").alias("w"))
    name = """transform(sequence(1, size(w) - 1), i -> case pmod(i, 8)
        when 0 then w[i] when 1 then concat(w[i - 1], '_', w[i]) when 2 then concat(lower(w[i - 1]), initcap(w[i]))
        when 3 then concat(w[i - 1], '.', w[i]) when 4 then concat(w[i - 1], '-', w[i]) when 5 then concat(w[i - 1], '/', w[i])
        when 6 then upper(concat(w[i - 1], '_', w[i])) else concat(w[i], '-', i, '.', pmod(i, 10)) end)"""
    names = some.where("size(w) > 1").select(F.explode(F.expr(name)).alias("token")).distinct()
    names = names.orderBy(F.xxhash64("token"), "token").limit(SAMPLE_NAMES).select("token", F.lit(0).alias("label"))
    digest = docs.sparkSession.range(SAMPLE_RANDOM).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    digest = digest.select("d", F.base64(F.unhex("d")).alias("b"))
    kinds = F.array(
        F.substring("d", 1, 40), "b", F.translate("b", "+/=", "-_"), F.upper(F.translate("b", "+/=", "XYZ")), F.lower(F.translate("b", "+/=", "xyz")), F.translate("b", "+/=", "")
    )
    random = digest.select(F.explode(kinds).alias("token"), F.lit(1).alias("label"))
    return names.union(random)


def transitions(samples: DataFrame) -> DataFrame:
    """(label, a, b, n): transitions between characters; 0 stands for what isn't printable."""
    codes = samples.where("length(token) > 1").select("label", F.expr("transform(split(token, ''), c -> case when ascii(c) between 33 and 126 then ascii(c) - 32 else 0 end)").alias("c"))
    pairs = codes.select("label", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> struct(c[i - 1] as a, c[i] as b))")).alias("p"))
    return pairs.groupBy("label", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def ratios(counts: DataFrame) -> list[float]:
    """Log-likelihood ratios of the transitions, at a * SIDE + b."""
    table = [[[0.5] * SIDE for _ in range(SIDE)] for _ in range(2)]
    for label, a, b, n in counts.select("label", "a", "b", "n").collect():  # 2 * SIDE * SIDE rows at most
        table[label][a][b] += n
    total = [[sum(row) for row in t] for t in table]
    return [
        round(math.log(table[1][a][b] / total[1][a]) - math.log(table[0][a][b] / total[0][a]), 5) for a in range(SIDE) for b in range(SIDE)
    ]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, also where body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _matches(text: str, pattern: str, group: int = 0) -> Column:
    """(p, v, w) for each match of a pattern: what stands before it, the match, and the length
    of its group; at the end, with null v, what stands after the last."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda p, v: F.struct(p.alias("p"), v.alias("v")))
    if not group:
        return F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["v"].alias("v"), F.length(x["v"]).alias("w")))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.zip_with(pairs, own, lambda x, w: F.struct(x["p"].alias("p"), x["v"].alias("v"), F.length(w).alias("w")))


def _placed(has: str, text: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """(s, e, v) of each match whose group has `least` characters or more, in texts that the
    column `has` says to have some. Starts are running
    sums over what stands between; they are taken in blocks, for a growing array is copied
    with each element, and a text may hold any number of matches."""
    kind = "array<struct<s:int,e:int,v:string,w:int>>"
    empty, none = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def one(a, x):
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"), x["w"].alias("w"))).alias("out"))

    def several(z):
        z = F.slice(z, 1, F.size(z) - 1)
        blocks = lambda z: F.sequence(F.lit(0), F.floor((F.size(z) - 1) / STRIDE).cast("int"))
        step = lambda z: lambda a, b: _let(
            F.aggregate(F.slice(z, b * STRIDE + 1, F.lit(STRIDE)), F.struct(a["at"].alias("at"), empty.alias("out")), one),
            lambda i: F.struct(i["at"].alias("at"), F.array_append(a["out"], i["out"]).alias("out")),
        )
        return _let(z, lambda z: F.flatten(F.aggregate(blocks(z), F.struct(F.lit(0).alias("at"), none.alias("out")), step(z), lambda a: a["out"])))

    found = F.filter(_let(_matches(text, pattern, group), several), lambda x: x["w"] >= least)
    return F.when(F.col(has), found).otherwise(empty)


def _masked(has: str, text: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """text with the matches' characters replaced by HIDDEN, each by one."""
    hidden = lambda x: F.when(x["w"] >= least, F.repeat(F.lit(HIDDEN), F.length(x["v"]))).otherwise(x["v"])
    pieces = F.transform(_matches(text, pattern, group), lambda x: F.concat(x["p"], F.coalesce(hidden(x), F.lit(""))))
    return F.when(F.col(has), F.array_join(pieces, "")).otherwise(F.col(text))


def best_stretch(value: Column, llr: list[float]) -> Column:
    """The most that the ratios of some STRETCH or more characters of a string add up to."""
    model = F.from_json(F.lit(json.dumps(llr)), "array<double>")  # folded to one literal
    codes = F.transform(F.split(value, ""), lambda c: F.when(F.ascii(c).between(33, 126), F.ascii(c) - 32).otherwise(0))
    steps = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(model, a * SIDE + b))
    ahead = F.concat(F.array_repeat(F.lit(None).cast("double"), STRETCH - 2), F.array(F.lit(0.0)))
    # each step beside the one that then ends what may stand before the stretch
    both = lambda t: F.filter(F.zip_with(t, F.concat(ahead, t), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("before"), F.lit(0.0).alias("low"), F.lit(float("-inf")).alias("best"))

    def add(a, p):
        all_, before = a["all"] + p["x"], a["before"] + F.coalesce(p["y"], F.lit(0.0))
        low = F.least(a["low"], before)
        return F.struct(all_.alias("all"), before.alias("before"), low.alias("low"), F.when(p["y"].isNotNull(), F.greatest(a["best"], all_ - low)).otherwise(a["best"]).alias("best"))

    return F.aggregate(_let(_let(codes, steps), both), zero, add, lambda a: a["best"])


def _hidden_base(df: DataFrame) -> DataFrame:
    """df with flags of what `_text` may have, and `_rest`, if there is any: `_text` with its
    base spans hidden. A span of one kind that runs into one of another, hidden before, is
    hidden as far as it goes."""
    for has, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_run", RUN)):
        df = df.withColumn(has, F.col("_text").rlike(pattern))
    df = df.withColumn("_rest", F.when(F.expr("_assign or _access or _hex or _run"), F.translate("_text", HIDDEN, " ")))
    df = df.withColumn("_rest", _masked("_assign", "_rest", ASSIGN, 2, 6))
    df = df.withColumn("_rest", _masked("_access", "_rest", f"{ACCESS}|AKIA[A-Z0-9]*(?={HIDDEN})"))
    return df.withColumn("_rest", _masked("_hex", "_rest", f"{HEX}|(?<={HIDDEN})[0-9a-f]+|[0-9a-f]{{23,}}(?={HIDDEN})"))


#: A run that no hidden character touches: those that meet a base span are touched by it.
FREE = f"(?<![A-Za-z0-9+/_.=\\-{HIDDEN}]){RUN}(?![A-Za-z0-9+/_.=\\-{HIDDEN}])"


def with_spans(df: DataFrame, llr: list[float]) -> DataFrame:
    """df (with `_text`) and an array column for each kind, `_base` and `spans`, in order."""
    df = _hidden_base(df)
    df = df.withColumn("assign", _placed("_assign", "_text", ASSIGN, 2, 6)).withColumn("access", _placed("_access", "_text", ACCESS)).withColumn("hex", _placed("_hex", "_text", HEX))
    df = df.withColumn("markov", F.filter(_placed("_run", "_rest", FREE), lambda r: best_stretch(r["v"], llr) >= THRESHOLD))
    span = lambda k: F.transform(KINDS[k], lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    df = df.withColumn("_base", F.sort_array(F.concat(span(0), span(1), span(2))))
    return df.withColumn("spans", F.sort_array(F.concat("_base", span(3)))).drop("_rest", "_assign", "_access", "_hex", "_run")


def written(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def model(docs: DataFrame) -> list[float]:
    return ratios(transitions(labelled_samples(docs)))


def scan(docs: DataFrame, llr: list[float] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) a row."""
    found = with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), llr or model(docs))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written("_base"), 256).alias("base_sha256"), written("spans").alias("spans"), count("markov")
    )


def redacted(docs: DataFrame, llr: list[float] | None = None) -> DataFrame:
    """docs with every stretch of secrets replaced by one mark, and n_chars (where docs has
    it) that of the new text; other columns and null texts as they are."""
    llr = llr or model(docs)
    row = F.struct(*[docs[c].alias(c) for c in docs.columns])
    found = _hidden_base(docs.select(row.alias("_row"), F.coalesce("text", F.lit("")).alias("_text")))
    pieces = F.transform(
        _matches("_rest", FREE),
        lambda x: F.concat(x["p"], F.coalesce(F.when(best_stretch(x["v"], llr) >= THRESHOLD, F.lit(HIDDEN)).otherwise(x["v"]), F.lit(""))),
    )
    found = found.withColumn("_rest", F.when(F.col("_run"), F.array_join(pieces, "")).otherwise(F.col("_rest")))
    some = F.coalesce(F.contains("_rest", F.lit(HIDDEN)), F.lit(False))
    found = found.withColumn("_new", F.when(some, F.regexp_replace("_rest", f"{HIDDEN}+", F.lit(MARK))).otherwise(F.col("_row.text")))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_new").eqNullSafe(F.col("_row.text")), F.col("_row.n_chars")).otherwise(F.length("_new").cast("long")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
