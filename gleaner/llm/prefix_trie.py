"""The prefix trie of conversations (operator 12).

A turn becomes a fixed-width id (WIDTH bytes of the SHA-256 of role and text, compared as a
big-endian number), a conversation the ids of its turns one after the other. Equal sequences
are collapsed first, so a conversation that a third of all others repeat is one row. The
sequences are then dealt out by ranges of their bytes and read in order, some MB at a time:
each such run is a stretch of the whole order, and goes into an adaptive radix tree (node
layouts of 4, 16, 48 and 256 kids, paths compressed). Where a tree branches within an id,
that is no node of the trie: only depths that are whole turns emit nodes.

What is below a node of a run lies in that run, unless the node is on the way to the run's
first or last sequence. Such open nodes, two paths a run, are the only ones that other runs
share: their parts are added up by a digest of their prefix, and what hangs below one another
by doubling (each round adds what is twice as far below), so depth costs a logarithm of
rounds. No group of conversations, however common its first turns are, meets in one task.
A conversation itself is held in one task as WIDTH bytes and a count for each turn, and the
digest of those that end at a node is taken over their ids in one stream, in order.

Turns are ordered by turn, null first; ties by role, then text. Null role and text are empty;
rows without a conv_id belong to no conversation and are left out. Repeated rows are turns
each. Extra columns are ignored. An empty table gives no rows, not even the root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut, drop, small_batches

SHARE, HEADS = 20, 4
WIDTH = 16
#: Bytes of sequences that one tree is made of.
RUN = 1 << 20
SEQUENCES = "key binary, words array<long>, n long, conv_id long, ends string"
NODES = (
    "open boolean, node binary, parent binary, parent_conv_id long, conv_id long, depth long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, words): turns in order, from 0, by their ids."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    known = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("pos"),
        F.unhex(F.substring(F.sha2(known, 256), 1, 2 * WIDTH)).alias("id"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("words"),
    )


def taken(conv_id: Column, heads: int = HEADS) -> Column:
    """How many first turns a conversation has from another."""
    return F.crc32(conv_id.cast("string")) % heads


def rebuilt(conversations: DataFrame, share: int = SHARE, heads: int = HEADS) -> DataFrame:
    """(conv_id, key, words): the first turns of conversation c - c % share, then c's own
    after as many; key holds the ids, words the words of each turn."""
    rows = cut(turns(conversations), "turns")
    convs = rows.select("conv_id").distinct().withColumn("_from", F.col("conv_id") - F.col("conv_id") % share)
    convs = convs.withColumn("_taken", taken(F.col("conv_id"), heads))
    first = rows.where((F.col("pos") < heads - 1) & (F.col("conv_id") % share == 0)).withColumnRenamed("conv_id", "_from")
    shared = convs.join(first, "_from").where(F.col("pos") < F.col("_taken")).select("conv_id", F.lit(0).alias("part"), "pos", "id", "words")
    own = rows.where(F.col("pos") >= taken(F.col("conv_id"), heads)).select("conv_id", F.lit(1).alias("part"), "pos", "id", "words")
    none = convs.select("conv_id", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("words"))
    made = shared.unionByName(own).unionByName(none).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "id", "words"))).alias("all"))
    in_order = F.filter("all", lambda t: t["part"] < 2)
    return made.select(
        "conv_id",
        F.unhex(F.array_join(F.transform(in_order, lambda t: F.hex(t["id"])), "")).alias("key"),
        F.transform(in_order, lambda t: t["words"]).alias("words"),
    )


def collapsed(sequences: DataFrame) -> DataFrame:
    """Distinct sequences with their count, least conv_id and the SHA-256 of all conv_ids in
    order. Each sequence's rows come sorted, and one running digest reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, n, least, digest = None, None, 0, 0, None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "words", "n", "conv_id", "ends"])

        for part in batches:
            counts = part.column("words")
            for i, (own, conv_id) in enumerate(zip(part.column("key").to_pylist(), part.column("conv_id").to_pylist(), strict=True)):
                if own != key:
                    if key is not None:
                        done.append((key, words, n, least, digest.hexdigest()))
                    key, words, n, least, digest = own, counts[i].as_py(), 0, conv_id, hashlib.sha256()
                digest.update(b",%d" % conv_id if n else b"%d" % conv_id)
                n += 1
            if done:
                yield batch()
                done.clear()
        if key is not None:
            done.append((key, words, n, least, digest.hexdigest()))
            yield batch()

    small_batches(sequences.sparkSession)
    dealt = sequences.select("key", "words", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(run, SEQUENCES)


class Sorted:
    """Kids by sorted bytes: 4 of them, then 16."""

    __slots__ = ("bytes", "kids", "room")

    def __init__(self, room: int = 4, held: tuple = ()):
        self.room, self.bytes, self.kids = room, bytearray(b for b, _ in held), [k for _, k in held]

    def get(self, byte: int):
        i = self.bytes.find(byte)
        return self.kids[i] if i >= 0 else None

    def put(self, byte: int, kid) -> object:
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.kids[i] = kid
            return self
        if len(self.kids) == self.room:
            grown = Sorted(16, tuple(self.items())) if self.room == 4 else Indexed(self.items())
            return grown.put(byte, kid)
        self.bytes.insert(i, byte)
        self.kids.insert(i, kid)
        return self

    def items(self):
        return zip(self.bytes, self.kids, strict=True)


class Indexed:
    """Up to 48 kids; a table of 256 bytes says which."""

    __slots__ = ("place", "kids")

    def __init__(self, held=()):
        self.place, self.kids = bytearray(256), []
        for byte, kid in held:
            self.put(byte, kid)

    def get(self, byte: int):
        i = self.place[byte]
        return self.kids[i - 1] if i else None

    def put(self, byte: int, kid) -> object:
        if i := self.place[byte]:
            self.kids[i - 1] = kid
        elif len(self.kids) == 48:
            return Direct(self.items()).put(byte, kid)
        else:
            self.kids.append(kid)
            self.place[byte] = len(self.kids)
        return self

    def items(self):
        return ((b, self.kids[i - 1]) for b, i in enumerate(self.place) if i)


class Direct:
    """A place for each byte."""

    __slots__ = ("kids",)

    def __init__(self, held=()):
        self.kids = [None] * 256
        for byte, kid in held:
            self.kids[byte] = kid

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid) -> object:
        self.kids[byte] = kid
        return self

    def items(self):
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """`label`: the bytes on the way from the parent, its kids' byte included. `row`: the
    sequence that ends here, or -1."""

    __slots__ = ("label", "kids", "row")

    def __init__(self, label: bytes, row: int = -1):
        self.label, self.kids, self.row = label, None, row


def shared_length(a: bytes, b: bytes) -> int:
    """Of the longest common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def radix_tree(keys: list[bytes]) -> Node:
    """An adaptive radix tree of distinct keys; rows are places in the list."""
    root = Node(b"")
    for row, key in enumerate(keys):
        node, at = root, 0
        while at < len(key):
            kid = node.kids.get(key[at]) if node.kids is not None else None
            if kid is None:
                node.kids = (Sorted() if node.kids is None else node.kids).put(key[at], Node(key[at:], row))
                break
            if not key.startswith(kid.label, at):
                same = shared_length(kid.label, key[at : at + len(kid.label)])
                fork = Node(kid.label[:same])
                kid.label = kid.label[same:]
                fork.kids = Sorted().put(kid.label[0], kid)
                node.kids = node.kids.put(key[at], fork)
                kid = fork
            node, at = kid, at + len(kid.label)
        else:
            node.row = row
    return root


def path_digests(key: bytes, width: int) -> list[bytes]:
    """Digests of a key's whole-turn prefixes, by depth."""
    h, out = hashlib.sha256(), [hashlib.sha256(b"").digest()[:16]]
    for at in range(0, len(key), width):
        h.update(key[at : at + width])
        out.append(h.digest()[:16])
    return out


def nodes_of(keys: list[bytes], words: list, counts: list[int], least: list[int], ends: list[str], width: int = WIDTH) -> dict[str, list]:
    """The trie nodes of a run of distinct sequences in order; columns as NODES has them.
    Open nodes carry what the closed ones below them add up to, and nothing of other open ones."""
    last = len(keys) - 1
    digests = {0: path_digests(keys[0], width), last: path_digests(keys[last], width)}
    out: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}
    # of a tree node, once its kids are done: members, least member, first and last row, and
    # of the closed trie nodes next below: how many, their leaves and savings; and which nodes
    # of the trie, closed or open, are next below
    done: dict[int, tuple] = {}
    stack = [(radix_tree(keys), 0, False)]
    while stack:
        node, start, seen = stack.pop()
        end = start + len(node.label)
        if not seen:
            stack.append((node, start, True))
            if node.kids is not None:
                stack += [(kid, end, False) for _, kid in node.kids.items()]
            continue
        n, conv, low, high = (counts[node.row], least[node.row], node.row, node.row) if node.row >= 0 else (0, None, last + 1, -1)
        kids, leaves, saved, tops = 0, 0, 0, []
        for _, kid in node.kids.items() if node.kids is not None else ():
            k_n, k_conv, k_low, k_high, k_kids, k_leaves, k_saved, k_tops = done.pop(id(kid))
            n, conv, low, high = n + k_n, k_conv if conv is None else min(conv, k_conv), min(low, k_low), max(high, k_high)
            kids, leaves, saved = kids + k_kids, leaves + k_leaves, saved + k_saved
            tops = tops + k_tops if len(k_tops) <= len(tops) else k_tops + tops
        is_open = low == 0 or high == last
        path = digests[0 if low == 0 else last] if is_open else None
        for depth in range(end // width, -1 if not end else start // width, -1):
            mine = len(out["depth"])
            tokens = words[low][depth - 1] if depth else 0
            if not is_open:
                leaves, saved = leaves if kids else 1, saved + (n - 1) * tokens
            values = (
                is_open, path[depth] if is_open else None, path[depth - 1] if is_open and depth else None, None, conv, depth,
                n, kids, leaves, saved, tokens, ends[node.row] if node.row >= 0 and depth * width == end else None,
            )
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
            for top in tops:
                if not out["open"][top]:
                    out["parent" if is_open else "parent_conv_id"][top] = path[depth] if is_open else conv
            kids, leaves, saved, tops = (0, 0, 0, [mine]) if is_open else (1, leaves, saved, [mine])
        done[id(node)] = (n, conv, low, high, kids, leaves, saved, tops)
    return out


def run_nodes(sequences: DataFrame, most: int = RUN) -> DataFrame:
    """Nodes of every run of sequences, in ranges of their bytes."""
    kinds = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        size = 0

        def batch() -> pa.RecordBatch:
            made = nodes_of(*held)
            return pa.record_batch([pa.array(v, k) for v, k in zip(made.values(), kinds, strict=True)], list(made))

        for part in batches:
            sizes = np.diff(np.frombuffer(part.column("key").buffers()[1], np.int32, part.num_rows + 1, 4 * part.column("key").offset))
            columns = [part.column(c).to_pylist() for c in ("key", "words", "n", "conv_id", "ends")]
            at = 0
            for i, more in enumerate(sizes.tolist()):
                size += more + 64
                if size >= most:
                    for have, new in zip(held, columns, strict=True):
                        have += new[at : i + 1]
                    yield batch()
                    held, size, at = [[] for _ in range(5)], 0, i + 1
            for have, new in zip(held, columns, strict=True):
                have += new[at:]
        if held[0]:
            yield batch()

    return sequences.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, NODES)


def below(nodes: DataFrame) -> DataFrame:
    """Adds what hangs below: nodes (node, parent, n_leaves, saved_tokens, depth) with both
    sums over each one's subtree. After k rounds a node has all that is less than 2**k deeper,
    and `up` is the node 2**k above."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    now = nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    for _ in range(int(deepest or 0).bit_length()):
        more = now.where("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        above = now.select(F.col("node").alias("_at"), F.col("up").alias("_up"))
        met = now.withColumn("_at", F.coalesce("up", "node")).join(above, "_at").join(more.withColumnRenamed("up", "node"), "node", "left")
        added = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_leaves", "_leaves"), ("saved_tokens", "_saved"))]
        before, now = now, cut(met.select("node", F.when(F.col("up").isNotNull(), F.col("_up")).alias("up"), *added), "below")
        drop(before)
    return now.drop("up")


def trie(sequences: DataFrame, run: int = RUN) -> DataFrame:
    """Nodes of the trie of sequences (conv_id, key, words); run: bytes of a tree's sequences."""
    distinct = cut(collapsed(sequences), "sequences")
    found = cut(run_nodes(distinct, run), "trie")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    least = [F.min(c).alias(c) for c in ("parent", "conv_id", "depth", "words")]
    opened = cut(found.where("open").groupBy("node").agg(*least, *sums, F.max("ends").alias("ends")), "open")
    kids = opened.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_kids"))
    whole = opened.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    whole = whole.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    whole = cut(whole.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")), "whole")
    whole = cut(whole.drop("n_leaves", "saved_tokens").join(below(whole), "node"), "opened")
    ids = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv_id"))
    closed = found.where("not open")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")]
    hanging = closed.where("parent is not null").drop("parent_conv_id").join(ids, "parent").withColumnRenamed("_parent_conv_id", "parent_conv_id")
    upper = whole.join(ids, "parent", "left").withColumnRenamed("_parent_conv_id", "parent_conv_id")
    return closed.where("parent is null").select(*columns).unionByName(hanging.select(*columns)).unionByName(upper.select(*columns))


def prefix_trie(conversations: DataFrame, share: int = SHARE, heads: int = HEADS, run: int = RUN) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return trie(rebuilt(conversations, share, heads), run)
