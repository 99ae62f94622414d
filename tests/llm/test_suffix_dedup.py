"""Operator 13 against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from samples import prose

from gleaner.llm import suffix_dedup as sd


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + 200] for _, t in texts for s in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s] += 1
                gone[s + 200 if s + 200 <= len(t) else len(t)] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], flags.astype(np.int8)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~flags])
        out.append((str(i), len(t), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(frame):
    rows = frame.collect()
    for r in rows:
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"] and len(r["removed"]) == r["n_spans"]
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def documents():
    r = random.Random(3)
    base = [prose(i, 160) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):  # edits, cuts and joins of the same texts
        t = base[i % 6]
        at = r.randrange(len(t))
        rows.append((100 + i, r.choice([t[:at] + "#" + t[at + 1 :], t[at : at + r.randint(190, 400)], t[:at] + prose(900 + i, 30) + t[at:], base[(i + 1) % 6][:at] + t[at:]])))
    for n in (198, 199, 200, 201, 210):  # a passage of n bytes in other surroundings
        passage = prose(50 + n, 60)[:n]
        rows += [(1000 + 10 * n + k, prose(2000 + 10 * n + k, 20) + "|" + passage + "|" + prose(3000 + 10 * n + k, 20)) for k in range(3)]
    line = prose(77, 45)[:230]
    rows += [(5000 + i, f"{prose(6000 + i, 8)} {line} {prose(7000 + i, 8)}") for i in range(40)]  # one line, many surroundings
    rows += [(8000, "ab" * 300), (8001, "a" * 199), (8002, "a" * 200), (8003, "a" * 201), (8004, "é漢🙂" * 60), (8005, "x" + "é漢🙂" * 60)]
    rows += [(9000, prose(1, 160)), (9001, prose(4000, 90)), (9001, prose(4000, 90)), (9002, prose(4001, 90)), (9002, prose(4001, 90)), (None, prose(4001, 90))]
    return rows + [(9100, None), (9101, ""), (9102, "short"), (9103, "short"), (None, None)]


@pytest.mark.parametrize(("hot", "block", "segment"), [(2048, 4096, 1 << 18), (3, 8, 1 << 18), (0, 1, 333), (10, 50, 1000)])
def test_equals_every_window(make_docs, hot, block, segment):
    """By suffix sorting, by counted digests, and by both; texts in one piece and in segments."""
    rows = documents()
    assert rows_of(sd.deduplicated(make_docs(rows).repartition(3), hot, block, segment)) == brute(rows)


def test_empty_table(make_docs):
    assert sd.deduplicated(make_docs([(1, "x")]).where("false")).count() == 0
    assert rows_of(sd.deduplicated(make_docs([(1, "x"), (None, None)]))) == brute([(1, "x"), (None, None)])


def test_long_texts(make_docs):
    """Passages far apart in long texts, over the edges of segments."""
    far = prose(61, 200)
    a = prose(62, 60_000)
    rows = [(1, a[:262_100] + far + a[262_100:]), (2, prose(63, 30_000) + far), (3, a[100_000:101_000])]
    got = {r[0]: r for r in rows_of(sd.deduplicated(make_docs(rows)))}
    n = len(far)
    assert n <= got["1"][2] - 1000 <= n + 4 and n <= got["2"][2] <= n + 4 and got["3"][2] == 1000
    assert got["1"][3] == 2 and got["2"][3] == got["3"][3] == 1


def naive_order(data, starts, sizes, first):
    return sorted(range(len(starts)), key=lambda i: (first[i], bytes(data[starts[i] : starts[i] + sizes[i]])))


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_order(letters):
    r = np.random.default_rng(letters)
    data = r.integers(0, letters, 3000).astype(np.uint8)
    starts = r.integers(0, 2700, 400)
    sizes = r.integers(0, 201, 400)
    bounds = np.sort(r.choice(np.arange(1, 400), 6, replace=False))
    first = np.repeat(np.concatenate([[0], bounds]), np.diff(np.concatenate([[0], bounds, [400]])))
    size = np.bincount(first, minlength=400)[first]
    order, lcp = sd.suffix_order(data, starts, sizes, first, size)
    text = lambda i: bytes(data[starts[i] : starts[i] + sizes[i]])
    assert [text(i) for i in order] == [text(i) for i in naive_order(data, starts, sizes, first)]
    for k in range(400):
        if k == first[k]:
            assert lcp[k] == -1
        else:
            x, y = text(order[k - 1]), text(order[k])
            want = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[k] == want


def test_collisions_are_found(monkeypatch):
    """With a hash that calls everything equal, the bytes decide."""
    monkeypatch.setattr(sd.Hashed, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"banana bandana" * 30, np.uint8)
    starts = np.arange(0, 200)
    first, size = np.zeros(200, np.int64), np.full(200, 200)
    order, _ = sd.suffix_order(data, starts, np.full(200, 150), first, size)
    assert order.tolist() == naive_order(data, starts, np.full(200, 150), first)


def test_runs_touch_and_overlap():
    lo, hi = sd.runs(np.array([500, 0, 100, 301, 900]), np.array([500, 0, 101, 301, 950]))
    assert lo.tolist() == [0, 900] and hi.tolist() == [700, 1150]
    lo, hi = sd.runs(np.array([0, 201]), np.array([0, 201]))
    assert lo.tolist() == [0, 201] and hi.tolist() == [200, 401]
