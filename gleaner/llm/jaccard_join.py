"""N-gram Jaccard join: a size-aware join of shingle sets (operator 5).

A document's set holds its distinct k-word shingles (64-bit hashes; two shingles of
one corpus of n coincide with probability 2**-64 a pair). Two documents link when
100 * |A and B| >= percent * |A or B|.

* Equal sets form a class; only one document of a class takes part in the join.
* Light sets (size up to a boundary) meet on fixed-size subsets: sets of sizes s <= t
  share at least c = ceil(percent * t / 100) members, so both list their c-subsets.
* Heavy sets meet on inverted lists. Members are put in the order of (count of the
  member's bucket in the corpus, hash); linked sets share one of the first
  n - ceil(percent * n / 100) + 1, so only these are listed. Light sets near enough
  to the boundary to link with a heavy one are listed too.
* The boundary is the largest size for which listing subsets costs no more than
  scanning lists, whose expected length is a parameter: one measured on the corpus would
  grow with its copies, and with it the subsets of every small set.
* A list isn't expanded into its pairs. Each of its sets is compared with the list's
  leader (the set that comes to the shared member first); then components are formed,
  and only sets of different components within one list are compared, those outside of
  the list's largest component with all others. A pair is skipped only if both are
  already known to be in one component, or size or position bounds exclude it; those
  bounds are part of the join's key, so that a list of sets that can't link makes no pairs.

Nulls and ties: null or blank text has an empty set, n_shingles 0, and is linked with
nothing; its component is its own doc_id. Rows with the same doc_id are judged row by
row. A null doc_id is never a component's id unless all of its documents have none.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import U64, bitmap, chunks, cut, drop, in_bitmap, list_array, mix, shingles, signed, slot, small_batches, text_bytes, words
from gleaner.llm.graph import components

SUBSET = U64(0xD6E8FEB86659FD93)
#: No set above this size is light, whatever the costs.
LARGEST_LIGHT = 24
#: Other sets expected in the list of one of a set's rarest members.
SCAN = 4.0


def least_shared(n: int, percent: int) -> int:
    """Members that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of n lists: one for each larger partner's size."""
    largest = 100 * n // percent
    return sorted({c for t in range(n, largest + 1) if (c := least_shared(t, percent)) <= n})


def boundary(scan: float, percent: int) -> int:
    """The largest size whose subsets cost no more than its lists: a row for each subset,
    against a row and `scan` sets met for each listed member."""
    best = 0
    for n in range(1, LARGEST_LIGHT + 1):
        light = sum(comb(n, c) for c in subset_sizes(n, percent))
        heavy = (n - least_shared(n, percent) + 1) * (1 + scan)
        if light > heavy:
            break
        best = n
    return best


def bucket_counts(docs: DataFrame, k: int, buckets: int) -> np.ndarray:
    """How often shingles fall in each hash bucket, over all documents (copies included).
    The result's size depends on `buckets` only; tasks send slices, which Spark adds up."""
    width, salts = 1024, 64
    names = ["part", "salt", "counts"]

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for chunk in chunks(batches):
            got, _ = shingles(*words(*text_bytes(chunk.column(0)))[:2], k)
            total += np.bincount((got % U64(buckets)).astype(np.int64), minlength=buckets)
        parts = total.reshape(-1, width)
        some = np.flatnonzero(parts.any(axis=1))
        salt = TaskContext.get().partitionId() % salts
        for at in range(0, len(some), 256):
            block = some[at : at + 256]
            yield pa.record_batch([pa.array(block.astype(np.int32)), pa.array([salt] * len(block), pa.int32()), pa.array([parts[i].tobytes() for i in block], pa.binary())], names)

    def add(key, table):
        total = np.zeros(width, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)

    schema = "part int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(run, schema)
    parts = parts.groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    out = np.zeros((buckets // width, width), np.int64)
    for part, _, counts in parts.collect():  # buckets / width rows
        out[part] = np.frombuffer(counts, np.int64)
    return out.reshape(-1)


def shingle_sets(chunk: pa.RecordBatch, k: int) -> list[np.ndarray]:
    got, bounds = shingles(*words(*text_bytes(chunk.column("text")))[:2], k)
    return [np.unique(got[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]


def set_id(members: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(members).sum(dtype=U64) ^ U64(len(members))], U64)).view(np.int64)[0])


def classes(docs: DataFrame, k: int, percent: int, buckets: int, scan: float = SCAN) -> DataFrame:
    """(doc_id, text_key, set_id, n, heavy, light) a row: the listed members in order and the
    subset keys, given for the first copy of a set in each task only."""
    spark = docs.sparkSession
    counts = bucket_counts(docs, k, buckets)
    light_to = boundary(scan, percent)
    shared = spark.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))
    heavy_from = least_shared(light_to + 1, percent)

    def keys(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(members)
        listed = subsets = np.zeros(0, U64)
        if n >= heavy_from:
            order = np.lexsort((members, shared.value[(members % U64(buckets)).astype(np.int64)]))
            listed = members[order[: n - least_shared(n, percent) + 1]]
        if n <= light_to:
            mixed = mix(members ^ SUBSET)
            subsets = np.concatenate(
                [mix(mixed[np.array(list(combinations(range(n), c)))].sum(axis=1, dtype=U64) ^ U64(c)) for c in subset_sizes(n, percent)]
            )
        return listed, subsets

    def run(batches):
        seen: set[int] = set()
        for chunk in chunks(batches):
            ids, sizes, listed, subsets = [], [], [], []
            for members in shingle_sets(chunk, k):
                sizes.append(len(members))
                ids.append(set_id(members) if len(members) else None)
                new = ids[-1] is not None and ids[-1] not in seen
                seen.add(ids[-1])
                a, b = keys(members) if new else (np.zeros(0, U64), np.zeros(0, U64))
                listed.append(a)
                subsets.append(b)
            columns = [chunk.column("doc_id"), chunk.column("text_key"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
            for some in (listed, subsets):
                columns.append(list_array(signed(np.concatenate(some)), np.cumsum([0, *map(len, some)])))
            yield pa.record_batch(columns, ["doc_id", "text_key", "set_id", "n", "heavy", "light"])

    schema = "doc_id long, text_key long, set_id long, n long, heavy array<long>, light array<long>"
    return cut(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema), "sets")


def entries(sets: DataFrame) -> DataFrame:
    """A row for each listed member or subset: (key, set_id, p), where p holds the place
    in its upper and the set's size in its lower half, so that rows stay narrow."""
    some = sets.where("set_id is not null")
    heavy = some.select("set_id", "n", F.posexplode("heavy").alias("at", "key"))
    light = some.select("set_id", "n", F.lit(0).alias("at"), F.explode("light").alias("key"))
    p = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    return heavy.select("key", "set_id", p.alias("p")).union(light.select("key", "set_id", p.alias("p")))


def place(p: str):
    return F.shiftright(p, 32).cast("int")


def size(p: str):
    return F.col(p).bitwiseAND(F.lit((1 << 32) - 1))


def may_link(percent: int):
    """Size and position bounds for sets that meet at places at and at2."""
    least, most = F.least("n", "n2"), F.greatest("n", "n2")
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return (100 * least >= percent * most) & ((100 + percent) * left >= percent * (F.col("n") + F.col("n2")))


def met_by_size(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows (key, set_id, n, at, root, main) of one key, one of them at least outside
    of the key's largest component, whose sizes and places let them link. A set at `at` of n
    members shares n - at of them at most, so its partner has most_size or fewer members; the
    larger set of a pair looks for the smaller one under each step of sizes between. Rows whose
    place leaves no partner are gone before any pair is made."""
    step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(1.02))).cast("int")
    most_size = F.floor((100 + percent) * (F.col("n") - F.col("at")) / percent) - F.col("n")
    rows = mixed.withColumn("most", most_size).withColumn("least", F.ceil(percent * F.col("n") / 100))
    upper = F.least("n", "most")
    larger = rows.where(upper >= F.col("least")).withColumn("step", F.explode(F.sequence(step(F.col("least")), step(upper))))
    smaller = rows.where("most >= n").withColumn("step", step(F.col("n")))
    smaller = smaller.select("key", "step", F.col("set_id").alias("set2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"), "main")
    left, right = larger.drop("main", "most", "least"), smaller.drop("main")
    met = left.join(right.where(smaller["root2"] != smaller["main"]), ["key", "step"])
    outside = larger.where("root <> main").drop("main", "most", "least")
    return met.union(outside.join(smaller.where("root2 = main").drop("main"), ["key", "step"]))


def settled(*tables: DataFrame) -> None:
    """Deletes tables that are done with, and has the driver look for what it no longer needs:
    Spark deletes the shuffle files of a finished job only once its driver has collected the
    plan that made them, which on a driver with free memory may be never."""
    drop(*tables)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that link, by the intersection of their whole sets;
    owners: (set_id, least), the least doc_id that has a set."""
    pairs = cut(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    chosen = cut(owners.join(wanted, "set_id", "left_semi").select("set_id", F.col("least").alias("want")), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(chosen, slot("want")))

    def run(batches):
        some = (x.filter(pa.array(in_bitmap(bits.value, x.column("slot").to_numpy()))) for x in batches)
        for chunk in chunks(some):
            found = shingle_sets(chunk, k)
            ids = [set_id(x) if len(x) else None for x in found]
            yield pa.record_batch([pa.array(ids, pa.int64()), list_array(signed(np.concatenate(found)), np.cumsum([0, *map(len, found)]))], ["set_id", "members"])

    made = docs.select("doc_id", slot("doc_id").alias("slot"), "text").mapInArrow(run, "set_id long, members array<long>")
    made = made.join(chosen.select("set_id"), "set_id", "left_semi")
    members = made = cut(made.groupBy("set_id").agg(F.first("members").alias("members")), "members")
    one = made.select(F.col("set_id").alias("a"), F.col("members").alias("x"))
    two = made.select(F.col("set_id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(one, "a").join(two, "b").withColumn("inter", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("inter")
    out = cut(both.where(100 * F.col("inter") >= percent * union).select("a", "b"), "linked")
    del made, one, two, both
    settled(pairs, chosen, members)
    return out


def linked_sets(docs: DataFrame, k: int, percent: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, as classes() has them, and (set_id, root, least, row) a set: its
    component, its least doc_id, and its row of that doc_id that is least by text_key."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = classes(docs, k, percent, buckets)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    # copies are counted together before anything is dealt by set_id
    owners = cut(sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min(row).alias("row")), "owners")
    every = entries(sets)
    first = every.groupBy("key").agg(F.min(F.struct("p", "set_id")).alias("lead"), F.count(F.lit(1)).alias("c"))
    first = first.where("c > 1").select("key", F.col("lead.set_id").alias("set2"), F.col("lead.p").alias("p2"))
    # written first: a join of two plain exchanges is one whose hot keys Spark can split
    leads = cut(first, "leads")
    shared = every.join(leads, "key").select("key", "set_id", size("p").alias("n"), place("p").alias("at"), "set2", size("p2").alias("n2"), place("p2").alias("at2"))
    shared = cut(shared, "lists")
    # lists and subsets are met: what follows needs the rows' sets alone
    narrow = cut(sets.select("doc_id", "text_key", "set_id", "n"), "rows")
    del every, first
    settled(leads, sets)

    pair = [F.least("set_id", "set2").alias("a"), F.greatest("set_id", "set2").alias("b")]
    near = verified(shared.where((F.col("set_id") != F.col("set2")) & may_link(percent)).select(*pair).distinct(), docs, owners, k, percent)
    found = components(near)

    placed = shared.select("key", "set_id", "n", "at").distinct().join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = cut(placed.select("key", "set_id", "n", "at", F.coalesce("root", "set_id").alias("root")), "placed")
    settled(shared)
    main = placed.groupBy("key", "root").count().groupBy("key").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")
    )
    main = cut(main.where("roots > 1").select("key", "main"), "mains")
    mixed = cut(placed.join(main, "key"), "mixed")
    settled(placed, main)
    rest = met_by_size(mixed, percent).where((F.col("root") != F.col("root2")) & may_link(percent)).select(*pair).distinct()
    late = verified(rest.join(near, ["a", "b"], "left_anti"), docs, owners, k, percent)
    if late.take(1):
        joined = late.join(found.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
            found.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left"
        )
        over = components(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        nodes = found.select("node", "root").union(over.select("node", F.col("node").alias("root")).join(found.select("node"), "node", "left_anti"))
        found = nodes.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    drop(mixed)
    by_set = owners.join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
    return narrow, by_set.select("set_id", F.coalesce("root", "set_id").alias("root"), "least", "row")


def link_components(docs: DataFrame, k: int = 4, percent: int = 85, buckets: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) a row of docs (doc_id, text)."""
    sets, by_set = linked_sets(docs, k, percent, buckets)
    tops = by_set.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = cut(by_set.join(tops, "root").select("set_id", "component_id"), "roots")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85, buckets: int = 1 << 20) -> DataFrame:
    """docs with one row of each linked group: that with the least doc_id, a null one only
    where no row has any; of several, one of the text with the least hash. Groups are those
    of texts, whatever doc_ids repeat. Rows without words are all kept."""
    _, by_set = linked_sets(docs, k, percent, buckets)
    chosen = by_set.groupBy("root").agg(F.min("row").alias("row"))
    chosen = cut(chosen.select(F.col("row.doc_id").alias("_keep"), F.col("row.text_key").alias("_text")), "kept")
    worded = F.coalesce(docs["text"].rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    blank, some = docs.where(~worded), docs.where(worded)
    kept = some.join(chosen, some["doc_id"].eqNullSafe(chosen["_keep"]) & (F.xxhash64(some["text"]) == chosen["_text"]), "left_semi")
    again = kept.groupBy(F.col("doc_id").alias("_again"), F.xxhash64("text").alias("_text")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    again = cut(again.select("_again", "_text"), "again")
    if not again.take(1):
        return blank.unionByName(kept)
    repeated = kept["doc_id"].eqNullSafe(again["_again"]) & (F.xxhash64(kept["text"]) == again["_text"])
    single, several = kept.join(again, repeated, "left_anti"), kept.join(again, repeated, "left_semi")
    row = F.struct(*[several[c].alias(c) for c in docs.columns])
    place = Window.partitionBy(several["doc_id"], several["text"]).orderBy(F.xxhash64(*[several[c] for c in docs.columns]))
    ranked = several.select(row.alias("row"), F.row_number().over(place).alias("n"))
    return blank.unionByName(single).unionByName(ranked.where("n = 1").select("row.*"))
