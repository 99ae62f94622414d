"""Tokenizers in tasks: loaded once per Python worker, with word-level caching.

A tokenizer file may be given as a path or as the name of a file of the installed
public_tokenizers package. Files are opened on the executors and are never shipped.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from gleaner.llm.common import text_bytes, words

_loaded: dict[str, object] = {}
#: Runs, and parts between blanks, that a worker remembers; those seen later are encoded again.
CACHE = 150_000


def file_of(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never joins a
    letter with anything else, so that a text's ids are those of its runs one after the
    other. Runs of Latin letters are remembered; whatever else stands between blanks goes
    to the tokenizer whole."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file_of(name))
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(words.values()) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}
        self.keys, self.pool = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: letters, then punctuation without apostrophes, which may begin an ending like 're
        self.plain = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def _encode(self, runs: list[str], joined: bool) -> list[bytes]:
        """Ids of each of the runs; joined: each is one run of letters or of punctuation."""
        if not joined:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        out = []
        blocks = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(x) for x in blocks], add_special_tokens=False), strict=True):
            ids = array("I", e.ids).tobytes()
            ends = (np.flatnonzero(self.last[e.ids]) + 1) * 4
            if len(ends) != len(block):
                raise ValueError("a run was split")
            at = 0
            for end in ends.tolist():
                out.append(ids[at:end])
                at = end
        return out

    def _fresh(self, new: list[str]) -> list[bytes]:
        """Ids of parts that are not known yet."""
        found = [self.plain(x) for x in new]
        pairs = [(m[1].lower(), m[2]) if m else None for m in found]
        unknown = list({r for p in pairs if p for r in p if r and r not in self.runs})
        made = dict(zip(unknown, self._encode(unknown, True), strict=True))
        rest = [x for x, p in zip(new, pairs, strict=True) if not p]
        whole = iter(self._encode(rest, False) if rest else [])
        get = lambda r: made[r] if r in made else self.runs[r]
        out = [next(whole) if not p else get(p[0]) + get(p[1]) if p[1] else get(p[0]) for p in pairs]
        if len(self.runs) < CACHE:
            self.runs.update(made)
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, and the bounds of each text among them.
        Parts are known by a 64-bit hash."""
        offsets, data = text_bytes(column)
        hashes, bounds, starts, ends = words(offsets, data, lower=False)
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        lost = np.ones(len(own), bool)
        inside = at < len(self.keys)
        lost[inside] = self.keys[at[inside]] != own[inside]
        begin, length = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
        begin[~lost], length[~lost] = self.begin[at[~lost]], self.length[at[~lost]]
        pool = self.pool
        if lost.any():
            raw = data.tobytes()
            fresh = self._fresh([raw[starts[i] : ends[i]].decode() for i in first[lost]])
            sizes = np.array([len(x) // 4 for x in fresh], np.int64)
            begin[lost], length[lost] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, np.frombuffer(b"".join(fresh), "<u4")])
            if len(self.keys) < 4 * CACHE:
                where = at[lost]
                self.pool, self.keys = pool, np.insert(self.keys, where, own[lost])
                self.begin, self.length = np.insert(self.begin, where, begin[lost]), np.insert(self.length, where, length[lost])
        sizes = length[inverse]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return pool[np.repeat(begin[inverse] - total[:-1], sizes) + np.arange(total[-1])], total[bounds]


def word_tokens(name: str) -> WordTokens:
    if name not in _loaded:
        _loaded[name] = WordTokens(name)
    return _loaded[name]


def byte_tokens(name: str):
    """A tiktoken encoding made from a file of ranks."""
    if name not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(file_of(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
