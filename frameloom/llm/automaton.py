"""Token counts by a linear longest-match automaton.

A word's pieces are found greedily, the longest first.  The automaton is a trie of
the vocabulary with a failure link at each node and, precomputed, the number of
tokens that following the link pops; so a word's number of pieces is found in one
pass over its characters, without building a piece.  A batch's distinct words run
through it side by side, a character of all of them at a time.

A word is what stands between ASCII white space; its first piece carries the
vocabulary's start marker.  A word that the vocabulary can't cover is one unknown
token.

Defined cases: a null or wordless text has no tokens; a word may have any length;
repeated rows and null ids need nothing special; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK, NORMAL, USER, parse
from .textkit import steps, texts_of, word_hashes, words_of

UNKNOWN = -1
COUNTED = "id long, n_words long, n_tokens long, n_unknown long"


class Automaton:
    """Greedy longest match over a vocabulary of strings."""

    def __init__(self, vocabulary: list[str]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            at = 0
            for ch in map(ord, piece):
                if ch not in children[at]:
                    children[at][ch] = len(children)
                    children.append({})
                    final.append(False)
                at = children[at][ch]
            final[at] = at != 0
        n = len(children)
        fail, pops = [UNKNOWN] * n, [0] * n
        queue = deque((0, ch, v) for ch, v in children[0].items())
        while queue:
            up, ch, v = queue.popleft()
            if final[v]:
                fail[v], pops[v] = 0, 1
            else:
                z, p = fail[up], pops[up]
                while z != UNKNOWN and ch not in children[z]:
                    p += pops[z]
                    z = fail[z]
                if z != UNKNOWN:
                    fail[v], pops[v] = children[z][ch], p
            queue.extend((v, c, w) for c, w in children[v].items())
        self.fail, self.pops = np.array(fail), np.array(pops)
        edges = sorted((v << 21 | ch, w) for v, kids in enumerate(children) for ch, w in kids.items())
        self.keys = np.array([k for k, _ in edges] or [-1], dtype=np.int64)
        self.to = np.array([w for _, w in edges] or [0], dtype=np.int64)
        self.settle = self._settle(final)

    def _settle(self, final: list[bool]) -> np.ndarray:
        """Tokens popped when a word ends at a node; -1 if its rest can't be covered."""
        out = np.full(len(final), UNKNOWN, dtype=np.int64)
        out[0] = 0
        for v in range(1, len(final)):
            path, at = 0, v
            while at not in (0, UNKNOWN):
                path += self.pops[at]
                at = self.fail[at]
            if at == 0:
                out[v] = path
        return out

    def step(self, at: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = at << 21 | ch
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.to[k], self.keys[k] == key

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each word, or -1 where it can't be covered."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])[:-1][order]
        size = size[order]
        at, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for t, n in enumerate(live.tolist()):
            todo = np.flatnonzero(at[:n] != UNKNOWN)
            ch = flat[first[todo] + t]
            while len(todo):
                to, ok = self.step(at[todo], ch)
                at[todo[ok]] = to[ok]
                todo, ch = todo[~ok], ch[~ok]
                count[todo] += self.pops[at[todo]]
                at[todo] = self.fail[at[todo]]
                alive = at[todo] != UNKNOWN
                todo, ch = todo[alive], ch[alive]
        rest = np.where(at == UNKNOWN, UNKNOWN, self.settle[at])
        out = np.empty(len(words), dtype=np.int64)
        out[order] = np.where(rest == UNKNOWN, UNKNOWN, count + rest)
        return out


def vocabulary_of(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    with open(path, "rb") as f:
        model = parse(f.read())
    return [p for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER)]


_LOCK = threading.Lock()
_BUILT: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    with _LOCK:
        if path not in _BUILT:
            _BUILT[path] = Automaton(vocabulary_of(path))
        return _BUILT[path]


#: Words whose counts a task remembers from batch to batch (16 bytes each); beyond, it starts again.
REMEMBERED = 1 << 18


class Known:
    """Counts of words met before, by hash: saves work, never changes a result."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.keys, self.counts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def look(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of sorted hashes, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(kinds), np.int64), np.zeros(len(kinds), dtype=bool)
        k = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
        return self.counts[k], self.keys[k] == kinds

    def add(self, kinds: np.ndarray, counts: np.ndarray) -> None:
        if len(self.keys) + len(kinds) > self.most:
            self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, values = np.concatenate([self.keys, kinds[: self.most]]), np.concatenate([self.counts, counts[: self.most]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.counts = keys[order], values[order]


def count_texts(own: Automaton, column: pa.Array, known: Known | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, tokens and unknown words of each text."""
    known = Known(0) if known is None else known
    words = words_of(texts_of(column))
    kinds, pick, inverse = np.unique(word_hashes(words), return_index=True, return_inverse=True)
    n, met = known.look(kinds)
    if not met.all():
        new = pick[~met]
        n[~met] = own.counts([MARK + words.texts.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.start[new].tolist(), words.end[new].tolist(), strict=True)])
        known.add(kinds[~met], n[~met])
    total = np.concatenate([[0], np.cumsum(np.where(n < 0, 1, n)[inverse])])
    unknown = np.concatenate([[0], np.cumsum((n < 0)[inverse])])
    return words.counts, np.diff(total[words.first]), np.diff(unknown[words.first])


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = automaton(path), Known()
        for batch in batches:
            for step in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([step.column("id"), *(pa.array(x, pa.int64()) for x in count_texts(own, step.column("text"), known))], ["id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_tokens, n_unknown of every text."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_count(path), COUNTED).withColumnRenamed("id", id_col)
