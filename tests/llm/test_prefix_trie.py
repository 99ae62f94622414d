"""Operator 12 against plain Python: every prefix, every member."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, node int"


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, seq in full.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(frame):
    assert frame.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def conversations():
    r = random.Random(5)
    rows = []
    for c in [*range(0, 130), 1000, 10**12, 10**12 + 7, 2003]:
        stem = r.randrange(4)
        for t in range(r.randint(1, 7)):
            text = f"stem {stem} turn {t}" if t < r.randint(0, 7) else r.choice(["", None, "a b\tc", f"x {r.randrange(9)}", "ab", "a\nb "])
            rows.append((c, r.choice([t, t, None, 3]), r.choice(["user", "bot", None, ""]), text, "k", 1))
    rows += [(c, t, "user", f"same {t}", "k", 1) for c in range(200, 260) for t in range(3)]  # one conversation again and again
    rows += [(300, t, "bot", f"long {t % 3}", "k", 1) for t in range(300)] + [(301, t, "bot", f"long {t % 3}", "k", 1) for t in range(250)]
    rows += [(301, 9, "a", "tie", "k", 1), (301, 9, "a", "tie", "k", 1), (None, 1, "user", "no conversation", "k", 1), (77, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(conversations(), SCHEMA)


@pytest.mark.parametrize("run", [1, 700, 5000, 1 << 20])
def test_equals_plain_python(table, run):
    """Whatever the size of runs: of one sequence each, of some, of all in a range."""
    assert rows_of(prefix_trie.prefix_trie(table, run=run)) == brute(conversations())


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(prefix_trie.prefix_trie(empty)) == []
    turnless = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20]
    rows = [(c, 0, "user", "gone", "k", 1) for c in turnless]
    got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and got[0][:6] == (turnless[0], 0, -1, len(turnless), 0, 1)


def test_layouts_grow():
    """Trees of random keys find each one and list their kids in order, through all layouts."""
    r = random.Random(1)
    keys = sorted({bytes(r.choice((r.randrange(256), r.randrange(3), 7)) for _ in range(4 * r.randint(0, 3))) for _ in range(3000)})
    root, kinds = prefix_trie.radix_tree(keys), set()

    def walk(node, path):
        path += node.label
        if node.row >= 0:
            assert keys[node.row] == path
            found.append(path)
        if node.kids is not None:
            held = list(node.kids.items())
            kinds.add((type(node.kids).__name__, getattr(node.kids, "room", 0)))
            assert [b for b, _ in held] == sorted({k.label[0] for _, k in held}) and all(node.kids.get(b) is k for b, k in held)
            assert len(held) > 1 or node.row >= 0 or not path
            for _, kid in held:
                walk(kid, path)

    found: list[bytes] = []
    walk(root, b"")
    assert sorted(found) == keys and {("Sorted", 4), ("Sorted", 16), ("Indexed", 0), ("Direct", 0)} <= kinds


@pytest.mark.parametrize("width", [1, 2, 4])
def test_branches_within_an_id(width):
    """Ids that share bytes: nodes are at whole turns alone."""
    r = random.Random(width)
    seqs = sorted({bytes(r.randrange(3) for _ in range(width * r.randint(0, 5))) for _ in range(150)})
    words = [[1] * (len(k) // width) for k in seqs]
    made = prefix_trie.nodes_of(seqs, words, [1] * len(seqs), list(range(len(seqs))), ["e"] * len(seqs), width)
    prefixes = {k[:d] for k in seqs for d in range(0, len(k) + 1, width)}
    assert len(made["depth"]) == len(prefixes)
    for i, is_open in enumerate(made["open"]):
        if not is_open:
            p = seqs[made["conv_id"][i]][: width * made["depth"][i]]
            assert made["n_children"][i] == len({q for q in prefixes if len(q) == len(p) + width and q.startswith(p)})
            assert made["n_convs"][i] == sum(k.startswith(p) for k in seqs)


def test_hot_first_turn_is_dealt_out(spark):
    """A first turn of all conversations: no task of the tree's stage has more than its range."""
    rows = [(20 * c, t, "user", "hello" if t == 0 else f"{c} {t}", "k", 1) for c in range(600) for t in range(4)]
    table = spark.createDataFrame(rows, SCHEMA)
    dealt = prefix_trie.collapsed(prefix_trie.rebuilt(table)).repartitionByRange(8, "key").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 200
    assert rows_of(prefix_trie.prefix_trie(table)) == brute(rows)
