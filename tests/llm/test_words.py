import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.common import chunks, shingles, text_bytes, words

TEXT = st.text(alphabet="aAbBé \t\n\u00a0漢.", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_shingles_equal_plain_python(texts):
    offsets, data = text_bytes(pa.array(texts, pa.string()))
    h, bounds, starts, ends = words(offsets, data)
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in split]
    flat = [x for w in split for x in w]
    seen = {}
    for x, y in zip(h.tolist(), flat, strict=True):
        assert seen.setdefault(y, x) == x
    assert len(set(seen.values())) == len(seen)
    got, sb = shingles(h, bounds, 4)
    for i, w in enumerate(split):
        own = [tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        assert sb[i + 1] - sb[i] == len(own)
        assert len(set(got[sb[i] : sb[i + 1]].tolist())) == len(set(own))


def test_chunks_hold_every_row_once():
    batch = pa.record_batch([pa.array(["x" * n for n in (0, 5, 50, 500, 0, 7)] + [None])], ["text"])
    parts = list(chunks(iter([batch, batch.slice(0, 0)]), limit=60))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(parts) > 2
