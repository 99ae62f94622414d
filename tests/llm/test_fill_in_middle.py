"""Operator 11 against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from samples import prose

from gleaner.llm import fill_in_middle as fim

TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na\n\nb\r\nc d\x0b", "x <P> y\nz", "<S>", "a<M>b", "<", "a<\nS>\n<P\n>", "<<\n<P\n>S>\nM>\n<",
    "$1\n\\2\n$3 ${x}\n\\\\\n", "𝒳é漢\n字🙂\n" * 3, "\n".join(prose(i, 9) for i in range(40)), "word " * 50, "é\r\n\x00\n", "l\n" * 200_000, "y" * 3_000_000 + "\nz",
]


def plain(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.fixture(scope="module")
def docs(make_docs):
    rows = [(1000 * k + i, t) for k in range(6) for i, t in enumerate(TEXTS[:-2])] + [(900 + i, t) for i, t in enumerate(TEXTS[-2:])]
    return make_docs(rows + [(None, "a\nb\nc\n"), (None, None), (3, "q\nr\n"), (3, "q\nr\n"), (-5, "s\nt")])


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 50), (100, 0), (100, 100), (0, 50)])
def test_equals_plain_python(docs, rate, spm):
    rows = fim.transformed(docs, rate=rate, spm=spm).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
        assert got == plain(r["doc_id"], r["text"], rate, spm) and r["back"] == (r["text"] or "")


def test_digests_and_columns(docs):
    made = fim.transformed(docs.withColumn("form", F.lit(1)).withColumn("output", F.lit("x")).withColumn("_fim", F.lit(2)))
    assert set(docs.columns) <= set(made.columns) and "_fim" not in made.columns
    want = sorted(
        (str(r["doc_id"]), *(p := plain(r["doc_id"], r["text"]))[:4], *(hashlib.sha256(x.encode()).hexdigest() for x in (p[4], r["text"] or "")))
        for r in docs.collect()
    )
    assert sorted((str(r["doc_id"]), *r[1:]) for r in fim.digests(made).collect()) == want
    assert fim.digests(fim.transformed(docs.where("false"))).count() == 0


def test_one_projection(docs):
    plan = fim.digests(fim.transformed(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
