"""Quality classifier: a generalised additive model with pairwise interactions.

Method.  Measures of a text are cut into bins.  Cyclic boosting visits one measure
after the other, fits a shallow tree (at most ``LEAVES`` leaves over that
measure's bins) to the gradient of the log loss and adds its shrunk leaf values to
the measure's lookup table; then the pairs of measures whose residuals a
four-leaf tree explains best get two-way tables in the same way.  A score is the
sum of table entries through the logistic function: searches for bins and vector
additions, no tree is walked.

The model is fitted on at most ``MAX_LABELLED`` labelled ids, the first by a hash
of the id (a documented bound); the cuts of bins come from the same rows.  The
model is a few kilobytes.  Every text is measured whole and scored where it is
read: one scan, no shuffle.

Defined cases: a null text counts as empty and gets a score like any other (all
measures zero); rows that repeat an id are scored alike, each on its own, and teach
once, by the smallest label and the text with the smallest measures; labels
with a null id, a null label or no document teach nothing; with no labels, or of
one kind only, the score is the share of label 1 with one row of each kind added;
a row with a null id is scored and counts as held out; an empty table gives an
empty result; other columns never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import Words, steps, texts_of, word_hashes, words_of

MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 120, 60, 0.1, 3, 1.0
THRESHOLD = 0.3

#: Bytes of text measured at once: many arrays of a word or a byte each are alive at a time.
STEP_BYTES = 1 << 20

MEASURES = (
    "log_words", "word_length", "symbols", "bangs", "capitals", "digits", "marks", "other_bytes",
    "echo", "distinct", "top_word", "repeat_lines", "line_length", "repeat_runs", "longest",
)

_KIND = np.zeros((6, 256), dtype=bool)
for _row, _chars in enumerate((b"#*$%&|<>", b"!", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?'\"()-_+=@/\\[]{}~^`", bytes(range(128, 256)))):
    _KIND[_row, list(_chars)] = True


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(run[offsets])


def _groups(words: Words, keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of its most frequent."""
    if not len(keys):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))
    times = np.diff(np.append(head, len(k)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[head], times)
    return np.bincount(d[head], minlength=n), top


def measures(column: pa.Array) -> np.ndarray:
    """A row of MEASURES for each text."""
    texts = texts_of(column)
    words = words_of(texts)
    n, counts = len(texts), words.counts
    buf, off = texts.buf[: texts.size], texts.offsets
    size = np.maximum(np.diff(off), 1)
    nw = np.maximum(counts, 1)
    sym, bang, cap, digit, mark, other = (_per_text(kind[buf], off) for kind in _KIND)
    h, doc = word_hashes(words), words.doc()
    distinct, top = _groups(words, h, doc, n)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = words.end - words.start
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    # runs of four words seen before in the text
    from .textkit import window_hashes, window_mask

    runs = window_hashes(h, 4)
    ok = window_mask(words, 4)
    run_doc = doc[: len(runs)][ok]
    run_kinds, _ = _groups(words, runs[ok], run_doc, n)
    n_runs = np.bincount(run_doc, minlength=n)
    # lines that hold a word: hash of their words in order, by prefix sums that the line's start cancels
    line_no = np.concatenate([[0], np.cumsum(buf == 10)])
    word_line = line_no[words.start] if len(words) else np.zeros(0, np.int64)
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (word_line[1:] != word_line[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(fresh)
    place = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
    mixed = h * (place.astype(np.uint64) * np.uint64(2654435761) * np.uint64(2) + np.uint64(1))
    lines = np.add.reduceat(mixed, heads) if len(heads) else np.zeros(0, np.uint64)
    line_doc = doc[heads] if len(heads) else np.zeros(0, np.int64)
    line_kinds, _ = _groups(words, lines, line_doc, n)
    n_lines = np.bincount(line_doc, minlength=n)
    per = lambda x, by: x / by
    return np.column_stack([
        np.log1p(counts), per(_per_text_words(length, words), nw), per(sym, nw), per(bang, nw), per(cap, size), per(digit, size), per(mark, nw), per(other, size),
        per(_per_text_words(same, words), nw), per(distinct, nw), per(top, nw), per(n_lines - line_kinds, np.maximum(n_lines, 1)), per(counts, np.maximum(n_lines, 1)),
        per(n_runs - run_kinds, np.maximum(n_runs, 1)), longest.astype(float),
    ]).astype(np.float64)


def _per_text_words(values: np.ndarray, words: Words) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(run[words.first])


@dataclass
class Gam:
    """Lookup tables: ``cuts`` and ``tables`` by measure; ``pairs`` with their coarse cuts and two-way tables."""

    start: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[bins[a], bins[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin, for the best tree of at most LEAVES leaves over ordered bins."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = _gain(cg[at] - cg[a], ch[at] - ch[a]) + _gain(cg[b] - cg[at], ch[b] - ch[at]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(at[k]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts both measures once (four leaves)."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    best, out = 0.0, np.zeros_like(g)
    if n < 2 or m < 2:
        return best, out
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    parts = lambda c: (c[i, j], c[i, m] - c[i, j], c[n, j] - c[i, j], c[n, m] - c[i, m] - c[n, j] + c[i, j])
    gs, hs = parts(cg), parts(ch)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs, strict=True)) - _gain(cg[n, m], ch[n, m])
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [-x[a, b] / (y[a, b] + RIDGE) for x, y in zip(gs, hs, strict=True)]
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = v
    return float(gain[a, b]), out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit tables to rows of measures and labels 0 or 1."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Gam(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    n = x.shape[1]
    model.cuts = [_cuts(x[:, j], BINS) for j in range(n)]
    model.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(n)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    margin = np.full(len(y), model.start)

    def slope():
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-9)

    for _ in range(ROUNDS):
        for j in range(n):
            g, h = slope()
            width = len(model.tables[j])
            leaf = RATE * _tree(np.bincount(bins[j], g, width), np.bincount(bins[j], h, width))
            model.tables[j] += leaf
            margin += leaf[bins[j]]

    def grid_of(a, b, values):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slope()
    gains = {(a, b): _pair_tree(grid_of(a, b, g), grid_of(a, b, h))[0] for a in range(n) for b in range(a + 1, n)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.grids = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slope()
            leaf = RATE * _pair_tree(grid_of(a, b, g), grid_of(a, b, h))[1]
            model.grids[k] += leaf
            margin += leaf[coarse[a], coarse[b]]
    return model


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch, "text", STEP_BYTES):
            x = measures(step.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([step.column("id"), rows, step.column("y")], ["id", "x", "y"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Gam:
    """Fit on at most ``most`` of the labelled ids for which ``learn`` (over ``id_col``) holds."""
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()).where(learn)
    picked = known.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    picked = picked.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("id", "text", "y")  # at most ``most`` rows are broadcast
    measured = rows.mapInArrow(_measure_batches, "id long, x array<double>, y int")
    found = measured.groupBy("id").agg(F.min(F.struct("x", "y")).alias("row")).select("row.*").toArrow()  # a row per picked id
    y = found.column("y").to_numpy().astype(np.float64)
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(len(y), len(MEASURES))
    rank = np.lexsort((*x.T, y))  # whatever order rows arrive in
    return train(x[rank], (y[rank] > 0).astype(np.float64))


def _scored(model: Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text", STEP_BYTES):
                yield pa.RecordBatch.from_arrays([step.column("id"), pa.array(model.score(measures(step.column("text"))))], ["id", "score"])

    return run


def scores(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score) of every text."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_scored(model), "id long, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, text_col, STEP_BYTES):
                yield step.filter(pa.array(model.score(measures(step.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
