"""Joins, passages, decontamination and the pipeline against brute force."""

import random
import re

from samples import prose

import corpus_pipeline
from gleaner.llm import decontaminate, graph, jaccard_join, packing, secrets, substring_dedup


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    return out


def brute_components(rows):
    ids, sets = [i for i, _ in rows], sets_of([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(rows))}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        at = r.randrange(len(w))
        if r.random() < 0.3:
            del w[at]
        else:
            w[at] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    """Chains of edits, small sets around the boundary, copies, blanks."""
    rows = [(i, prose(i, 120)) for i in range(6)]
    base = prose(99, 150)
    rows += [(100 + i, edited(base, i % 7, i)) for i in range(60)]
    for n in range(1, 30):
        small = prose(200 + n, n)
        rows += [(1000 + 10 * n, small), (1001 + 10 * n, small + " more"), (1002 + 10 * n, small.upper()), (1003 + 10 * n, edited(small, 1, n))]
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, prose(3, 120)), (5004, prose(3, 120))]


def test_jaccard_components_equal_brute_force(make_docs):
    rows = near_rows()
    found = jaccard_join.link_components(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_jaccard_thresholds_and_subset_sizes():
    assert jaccard_join.least_shared(20, 85) == 17
    for n in range(1, 25):
        for t in range(n, 100 * n // 85 + 1):
            need = jaccard_join.least_shared(t, 85)
            assert need > n or need in jaccard_join.subset_sizes(n, 85)
            assert need > n or need in jaccard_join.subset_sizes(t, 85)
    assert 6 <= jaccard_join.boundary(4.0, 85) <= jaccard_join.boundary(50.0, 85)


def test_keep_one(make_docs):
    rows = [(1, prose(1, 100)), (2, prose(1, 100)), (3, edited(prose(1, 100), 1, 1)), (4, prose(4, 80)), (5, None), (6, None), (4, prose(4, 80)), (None, prose(7, 60))]
    docs = make_docs(rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert jaccard_join.keep_one(docs.where("false")).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "lang", "n as _drop", "n as _again", "n as _c", "n as count", "key as row", "n")
    assert jaccard_join.keep_one(clashing).count() == 5 and jaccard_join.keep_one(clashing).columns == clashing.columns


def test_keep_one_by_rows(make_docs):
    """A null id linked with a row that has one, ids that repeat over texts, copies without ids."""
    near = edited(prose(21, 100), 1, 1)
    rows = [(None, prose(21, 100)), (8, near), (None, prose(22, 80)), (None, prose(23, 80)), (None, prose(23, 80))]
    rows += [(5, prose(24, 90)), (6, prose(24, 90)), (5, prose(25, 90)), (3, prose(25, 90)), (9, prose(26, 50)), (9, prose(27, 50)), (9, None), (9, " ")]
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in jaccard_join.keep_one(make_docs(rows)).collect()))
    assert kept == sorted([(8, near), (0, prose(22, 80)), (0, prose(23, 80)), (5, prose(24, 90)), (3, prose(25, 90)), (9, prose(26, 50)), (9, prose(27, 50)), (9, ""), (9, " ")])


def test_keep_one_of_texts_that_share_ids(make_docs):
    """Unrelated texts whose doc_ids repeat: none of them goes with another's group."""
    x, y, p, q = (prose(30 + i, 80) for i in range(4))
    rows = [(3, y), (7, x), (7, y), (9, x), (8, p), (8, q)]
    kept = jaccard_join.keep_one(make_docs(rows)).collect()
    assert sorted((k["doc_id"], k["text"]) for k in kept) == sorted([(3, y), (7, x), (8, p), (8, q)])


def test_sizes_and_places_bound_what_meets(spark):
    """met_by_size returns every pair that may link, one of it outside of the main component,
    and no pair of sets whose places leave no partner."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(r.randrange(3), i, n := r.randint(1, 120), r.randint(0, max(0, n * 15 // 100)), r.randrange(6)) for i in range(300)]
    mains = {k: max(range(6), key=lambda c: sum(x[0] == k and x[4] == c for x in rows)) for k in range(3)}
    rows = [(*x, mains[x[0]]) for x in rows]
    for percent in (80, 85):
        frame = spark.createDataFrame(rows, "key long, set_id long, n long, at int, root long, main long")
        met = jaccard_join.met_by_size(frame, percent).where((F.col("root") != F.col("root2")) & jaccard_join.may_link(percent))
        got = {frozenset((m["set_id"], m["set2"])) for m in met.collect()}
        want = set()
        for a in rows:
            for b in rows:
                if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and (a[4] != a[5] or b[4] != b[5]):
                    left = min(a[2] - a[3], b[2] - b[3])
                    if 100 * min(a[2], b[2]) >= percent * max(a[2], b[2]) and (100 + percent) * left >= percent * (a[2] + b[2]):
                        want.add(frozenset((a[1], b[1])))
        assert got == want and want
    hot = spark.createDataFrame([(1, i, 100, 14, i, 0) for i in range(1, 2000)], "key long, set_id long, n long, at int, root long, main long")
    assert jaccard_join.met_by_size(hot, 85).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(1000, 1000)]
    rows = graph.components(spark.createDataFrame(path + star + [(7, 3)], "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(roots) == 201 + 50
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[i] for i in range(1000, 1050)}) == 1 and roots[0] != roots[1000]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, key string")


def test_decontamination(spark, make_docs):
    bench = [prose(500 + i, 40) for i in range(4)] + ["short one", None, ""]
    r = random.Random(1)
    fuzzy = list(bench[2])
    for at in range(5, len(fuzzy), 25):
        fuzzy[at] = r.choice("qxz")
    rows = [(1, prose(1, 50) + " " + bench[0] + " " + prose(2, 50)), (2, prose(3, 400)), (3, prose(4, 30) + "\n" + "".join(fuzzy).upper() + " " + prose(5, 9)), (4, bench[1].replace(" ", "\n  ")), (5, None), (6, ""), (7, "short one"), (1, prose(9, 30))]
    rows += [(None, bench[3])]
    docs = make_docs(rows)
    found = decontaminate.contaminated(docs, items(spark, bench)).collect()
    assert {(f["doc_id"], f["item_id"]) for f in found} == {(1, 0), (3, 2), (4, 1), (None, 3), (7, 4)}
    assert {f["edits"] for f in found if f["doc_id"] == 1} == {0}
    small = decontaminate.contaminated(docs, items(spark, bench), block=10).collect()
    assert {(f["doc_id"], f["item_id"]) for f in small} == {(f["doc_id"], f["item_id"]) for f in found}
    kept = decontaminate.kept_documents(docs, items(spark, bench))
    assert kept.columns == docs.columns and sorted(k["key"] for k in kept.collect()) == ["k1", "k4", "k5", "k7"]
    assert decontaminate.kept_documents(docs.withColumnRenamed("n", "_bad"), items(spark, bench)).count() == 4
    assert decontaminate.contaminated(docs, items(spark, bench).where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), items(spark, bench)).count() == 0


def test_decontamination_equals_brute_force(spark, make_docs):
    """Every window against every text, by plain edit distance of the window to any stretch."""

    def nearest(pattern, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(pattern, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(text, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return min(row)

    r = random.Random(8)
    bench = [(1, prose(510, 12)), (2, prose(511, 9)), (None, prose(512, 8)), (3, "short text"), (4, "-" * 70), (5, "tiny")]
    rows = []
    for i in range(24):
        x = list(decontaminate.normal(bench[i % 5][1])[: r.choice([20, 70, 90])])
        for _ in range(i % 9):
            at = r.randrange(len(x))
            x[at] = r.choice(["", "q", x[at] + "z"])
        rows.append((i, f"{prose(i, 6)} {''.join(x)} {prose(50 + i, 6)}"))
    wins = decontaminate.windows(spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = set()
    for i, t in rows:
        for w in wins:
            if nearest(w["pattern"], decontaminate.normal(t)) <= decontaminate.budget(len(w["pattern"])):
                want.add((i, w["item_id"], w["at"]))
    got = decontaminate.matches(make_docs(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(m["doc_id"], m["item_id"], m["at"]) for m in got} == want and len({i for i, *_ in want}) > 8


def test_frequent_qgrams_go_in_parts():
    """Texts and windows of one repeated character, beyond the hits looked at together."""
    text = "-" * 30_000 + "x" + decontaminate.normal(prose(1, 20)) + "-" * 30_000
    wins = ["-" * 64] * 3 + [decontaminate.normal(prose(1, 20))[:64]]
    index = decontaminate.Index([1, 2, 3, 4], wins)
    found = index.regions([text, "none", text])
    assert {(t, w) for t, w, *_ in found} == {(t, w) for t in (0, 2) for w in range(4)}
    assert any(abs(s - 30_001) < 40 for t, w, s, _ in found if w == 3 and t == 2)


def test_decontamination_of_long_texts():
    """Passages at any place of a text that is looked at in pieces."""
    bench = prose(700, 30)
    far = prose(701, 900)
    for at in (0, 990, 1000, 1500, 2040):
        text = far[:at] + " " + bench + " " + far[at:]
        index = decontaminate.Index([1], [decontaminate.normal(bench)[: decontaminate.WINDOW]])
        pieces = [(0, i) for i in range(0, len(text), 1000)]
        found = index.regions([text[i : i + 1000 + 4 * decontaminate.WINDOW] for _, i in pieces])
        assert any(abs(pieces[n][1] + s - at) < 40 for n, _, s, _ in found)


def test_qgram_bound_misses_no_window():
    """Every place within the budget is in a region that passes the filter."""
    r = random.Random(3)
    for trial in range(60):
        pattern = decontaminate.normal(prose(trial, 40))[: decontaminate.WINDOW]
        k = decontaminate.budget(len(pattern))
        x = list(pattern)
        for _ in range(r.randint(0, k)):
            at = r.randrange(len(x))
            kind = r.random()
            if kind < 0.34:
                x[at] = r.choice("qxz")
            elif kind < 0.67:
                del x[at]
            else:
                x.insert(at, r.choice("qxz"))
        before = decontaminate.normal(prose(900 + trial, r.randint(0, 60)))
        text = before + "".join(x) + decontaminate.normal(prose(800 + trial, 30))
        regions = decontaminate.Index([1], [pattern]).regions([text])
        import pyarrow as pa

        got = decontaminate.aligned(pa.array([pattern] * len(regions)), pa.array([text[s:e] for _, _, s, e in regions]))
        assert regions and min(g["edits"] for g in got.to_pylist()) <= k


def test_passages(make_docs):
    shared, other = prose(70, 80), prose(71, 60)
    rows = [(1, prose(1, 100) + " " + shared), (2, shared + " " + prose(2, 200)), (3, prose(3, 50) + " " + edited(shared, 3, 5) + " " + prose(4, 90)), (4, prose(5, 300)), (5, other), (6, other), (7, None), (8, ""), (9, "a b c"), (9, "a b c"), (None, prose(6, 70) + " " + shared)]
    found = substring_dedup.passages(make_docs(rows)).collect()
    ids = {x for f in found for x in (f["doc_id"], f["source_doc_id"])}
    assert ids == {1, 2, 3, 5, 6, None}
    for f in found:
        assert f["end"] - f["start"] >= substring_dedup.LEAST_WORDS and f["similarity"] >= 0.8
    exact = next(f for f in found if {f["doc_id"], f["source_doc_id"]} == {1, 2} or f["similarity"] == 1.0 and not f["copy"])
    assert exact["end"] - exact["start"] >= 80
    assert [f["copy"] for f in found if f["doc_id"] == 6] == [True]
    assert substring_dedup.passages(make_docs(rows).where("false")).count() == 0


def test_minimizers_are_shared_by_equal_runs():
    import numpy as np

    values = np.random.default_rng(1).integers(1, 1 << 60, 300).astype(np.uint64)
    bounds = np.array([0, 100, 100, 103, 150, 300])
    for span in (5, 20, 32):
        want = set()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            windows = [range(i, i + span) for i in range(lo, hi - span + 1)] or ([range(lo, hi)] if hi > lo else [])
            want |= {min(w, key=lambda i: values[i]) for w in windows}
        assert set(substring_dedup.minimizers(values, bounds, span).tolist()) == want


def test_grams_are_hashes_of_what_they_cover():
    import numpy as np

    values = np.random.default_rng(2).integers(1, 1 << 60, 200).astype(np.uint64)
    for n in (1, 2, 5, 45, 64):
        whole, part = substring_dedup.grams(values, n), substring_dedup.grams(values[7:150], n)
        assert len(whole) == 200 - n + 1 and (whole[7 : 7 + len(part)] == part).all() and len(np.unique(whole)) == len(whole)


def test_chains_are_collinear():
    import numpy as np

    at, source = np.array([0, 5, 9, 20, 24, 300, 305, 309]), np.array([100, 105, 109, 3, 124, 7, 12, 16])
    assert sorted(c[:4] for c in substring_dedup.chains(at, source, least=3)) == [(0, 29, 100, 129), (300, 314, 7, 21)]
    r = random.Random(4)
    for _ in range(30):
        n = r.randint(1, 60)
        pairs = sorted({(r.randrange(200), r.randrange(200)) for _ in range(n)})
        found = substring_dedup.chains(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        assert sorted(m for c in found for m in c[4]) == pairs
        # the best score by trying every match before each, against that of a chain's matches
        best = {}
        for a, b in pairs:
            best[a, b] = 5 + max([0.0, *(best[p] - substring_dedup.GAP * (a - p[0] + b - p[1]) for p in best if p[0] < a and p[1] < b)])
        for *_, chain in found:
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:], strict=False))
        top = max(best.values())
        score = lambda c: sum(5 for _ in c) - substring_dedup.GAP * sum(q[0] - p[0] + q[1] - p[1] for p, q in zip(c, c[1:], strict=False))
        spread = max(max(a - b for a, b in pairs) - min(a - b for a, b in pairs), 0)
        if spread <= substring_dedup.DRIFT:
            assert abs(max(score(c[4]) for c in found) - top) < 1e-6


def test_passages_around_other_bodies(make_docs):
    """A header and a footer that are equal, around bodies of like length that aren't."""
    head, foot = prose(80, 60), prose(81, 60)
    rows = [(i, f"{head} {prose(820 + i, 100 + i)} {foot}") for i in range(2)]
    found = substring_dedup.passages(make_docs(rows)).collect()
    assert sorted((min(f["start"], f["source_start"]), f["end"] - f["start"], f["similarity"]) for f in found) == [(0, 60, 1.0), (160, 60, 1.0)]


def test_passages_whose_halves_stand_elsewhere(make_docs):
    """Both halves of a passage, and a passage within one document, whatever the keys' order."""
    rows = []
    for i in range(8):
        one, two, again = prose(900 + i, 30), prose(920 + i, 30), prose(940 + i, 60)
        between = [prose(1000 + 10 * i + j, 90) for j in range(8)]
        texts = [f"{between[0]} {one} {between[1]}", f"{between[2]} {two} {between[3]}", f"{between[4]} {one} {two}", f"{one} {two} {between[5]}", f"{again} {between[6]} {again} {between[7]}"]
        rows += [(10 * i + j, t) for j, t in enumerate(texts)]
    found = {(f["doc_id"], f["source_doc_id"]): f for f in substring_dedup.passages(make_docs(rows)).collect()}
    for i in range(0, 80, 10):
        assert (i + 2, i + 3) in found or (i + 3, i + 2) in found
        own = found[(i + 4, i + 4)]
        assert (own["start"], own["end"], own["source_start"], own["source_end"]) == (150, 210, 0, 60)


def rewritten(words, n, r):
    out = list(words)
    for at in r.sample(range(1, len(words) - 1), n):
        kind = r.random()
        out[at] = f"e{r.randrange(10**7)}" if kind < 0.6 else "" if kind < 0.8 else f"{out[at]} i{r.randrange(10**7)}"
    return " ".join(x for x in out if x)


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_passages_against_brute_force(make_docs):
    """Passages shared by two texts each, word for word and edited, among texts that hold bits
    of them: what is found is what a plain alignment of the two stretches says, exact runs of
    LEAST_WORDS + RUN_SPAN - 1 are all found, and 9 of 10 edited ones."""
    r, rows, exact, fuzzy = random.Random(5), [], set(), set()
    for i in range(90):
        p = prose(5000 + i, 64 if i < 30 else 60).split()
        edits = 0 if i < 30 else (3, 6)[i % 2]
        (exact if not edits else fuzzy).add((2 * i, 2 * i + 1))
        rows.append((2 * i, f"{prose(6000 + i, r.randint(5, 60))} {' '.join(p)} {prose(6100 + i, r.randint(5, 60))}"))
        rows.append((2 * i + 1, f"{prose(6200 + i, r.randint(5, 60))} {rewritten(p, edits, r)} {prose(6300 + i, r.randint(5, 60))}"))
        for b in range(12):
            size = 40 if i < 30 else 10
            at = r.randrange(len(p) - size + 1)
            rows.append((1000 + 20 * i + b, f"{prose(7000 + 20 * i + b, 40)} {' '.join(p[at:at + size])} {prose(9000 + 20 * i + b, 20)}"))
    text = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in rows}
    found = substring_dedup.passages(make_docs(rows)).collect()
    pairs = {tuple(sorted((f["doc_id"], f["source_doc_id"]))) for f in found}
    assert exact <= pairs and pairs <= exact | fuzzy
    assert len(fuzzy & pairs) >= 0.9 * len(fuzzy)
    for f in found[:60]:
        x, y = text[f["doc_id"]][f["start"] : f["end"]], text[f["source_doc_id"]][f["source_start"] : f["source_end"]]
        assert len(x) >= substring_dedup.LEAST_WORDS and 1 - distance(x, y) / max(len(x), len(y)) >= substring_dedup.SIMILAR - 1e-9


def test_passages_that_many_texts_hold(make_docs):
    """800 texts that each hold a bit of a passage don't hide it, and a passage of many texts
    gives each of them a row."""
    shared, hot = prose(77, 100).split(), prose(78, 70)
    rows = [(1, prose(1, 30) + " " + " ".join(shared)), (2, " ".join(shared) + " " + prose(2, 30))]
    for i in range(800):
        at = i % 90
        rows.append((10 + i, f"{prose(20000 + i, 40)} {' '.join(shared[at : at + 10])} {prose(30000 + i, 10)}"))
    rows += [(2000 + i, f"{prose(40000 + i, 20)} {hot} {prose(50000 + i, 20)}") for i in range(150)]
    found = substring_dedup.passages(make_docs(rows)).collect()
    pairs = {tuple(sorted((f["doc_id"], f["source_doc_id"]))) for f in found}
    assert (1, 2) in pairs and not any(10 <= i < 1000 for p in pairs for i in p)
    assert {i for p in pairs for i in p if i >= 2000} == set(range(2000, 2150))
    assert len(found) < 1000


def test_passages_of_repeating_and_long_texts(make_docs):
    """A line repeated in one text is one stretch, not a row for each repeat; a long text's
    passage beyond a block of words is found."""
    line = prose(60, 12)
    far = prose(61, 70)
    rows = [(1, "\n".join([line] * 400)), (2, prose(62, 70000) + " " + far + " " + prose(63, 50)), (3, prose(64, 40) + " " + far)]
    found = substring_dedup.passages(make_docs(rows)).collect()
    own = [f for f in found if f["doc_id"] == f["source_doc_id"] == 1]
    assert own and len(own) < 20 and min(f["start"] for f in own) <= 12 and max(f["end"] for f in own) == 4800
    assert any({f["doc_id"], f["source_doc_id"]} == {2, 3} and max(f["end"], f["source_end"]) > 70000 for f in found)


def test_pipeline_equals_brute_force(spark, make_docs, tmp_path):
    bench = [prose(600 + i, 40) for i in range(3)]
    keep = [(i, prose(i, 90)) for i in range(12)]
    rows = keep + [(50, prose(3, 90)), (51, edited(prose(4, 90), 1, 1)), (52, prose(52, 60) + " " + bench[1]), (53, prose(53, 70) + " password=abcdef123 end"), (54, "too short"), (55, None), (56, "again and again " * 40)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, bench).write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        left.append({r["doc_id"] for r in docs.collect()})
    ids = {i for i, _ in keep}
    assert left == [ids | {50, 51, 52, 53}, ids | {52, 53}, ids | {53}, ids | {53}]
    assert docs.where("doc_id = 53").first()["text"] == prose(53, 70) + " [SECRET] end"
    want = packing.pieces(docs).collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(map(tuple, want))
    room, sequences = [], {}
    for length in sorted((r["length"] for r in want), reverse=True):  # piece by piece into the emptiest with room
        fits = [i for i, left in enumerate(room) if left >= length]
        if fits:
            room[max(fits, key=lambda i: room[i])] -= length
        else:
            room.append(packing.LIMIT - length)
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(room)))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
    assert sorted(packing.LIMIT - sum(n for _, n in p) for p in sequences.values()) == sorted(room)
    assert secrets.MARK in docs.where("doc_id = 53").first()["text"]
