"""Removal of word sequences that another document with a smaller id also has.

Method: difference-cover anchors.  ``COVERS`` gives, for a period v, residues
such that any two residues differ by a difference of two of them.  Only the
places of a document whose index modulo v is in the cover carry an anchor, a hash
of the next ``window - v + 1`` words.  If two documents share a window of
``window`` words, at whatever places, some anchor inside it lies at a cover place
in both (with the period 7 and three residues, 3 in 7 places carry an anchor).
So windows without an anchor that occurs twice are unique; the others are
extended to the full window, and the smallest id of each window decides.

Plan: documents become compressed chunks (see ``chunks``); then two exchanges.
First, each chunk sends each of its distinct anchors once to the anchor's bucket,
which answers with one bit per anchor: does another chunk have it?  Second, each
chunk sends each of its distinct candidate windows with its smallest id; the
bucket answers with the windows that have a smaller id elsewhere.  A passage that
a third of all documents share is one entry per chunk, so nothing is paired and
no bucket is hot.  Buckets grow in number with the corpus.  Answers go back to
chunks by chunk number.  A false anchor match (32 bits in a bucket of about a
million) only costs a candidate; windows compare on 64 bits.

Defined cases: a null or wordless text yields an empty text, no words, none
removed; a text shorter than the window keeps all words; rows that repeat an id
do not remove each other's words (the id isn't smaller) but other rows see their
windows; a row with a null id is kept whole and others don't see it; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_bucket, chunked, ids_in, rest_in, words_in
from .shared import written
from .textkit import Texts, Words, joined, pack, padded, unpack, window_hashes, window_mask, word_hashes

WINDOW = 13

#: Perfect difference sets, by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}

#: Entries that a bucket should hold, about: what one task sorts at once.
BUCKET_ENTRIES = 1_000_000

MESSAGE = "bucket long, chunk long, keys binary, low binary"
REPLY = "chunk long, bucket long, body binary"


def period_for(window: int) -> int:
    """The largest period that leaves anchors at least as long as itself."""
    fits = [v for v in COVERS if window - v + 1 >= v]
    return max(fits) if fits else min(COVERS)


class _Chunk:
    """Words of a chunk and their hashes."""

    def __init__(self, row: dict, window: int, period: int):
        self.words: Words = words_in(row)
        self.ids = ids_in(row["ids"], row["id_set"])
        self.h = word_hashes(self.words)
        self.window, self.period = window, period
        self.length = window - period + 1
        live = np.repeat(~np.ma.getmaskarray(self.ids), self.words.counts)
        self.whole = window_mask(self.words, window)
        self.whole &= live[: len(self.whole)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors that can lie in a window, and their hashes."""
        a = window_hashes(self.h, self.length)
        place = np.arange(len(a)) - np.repeat(self.words.first[:-1], self.words.counts)[: len(a)]
        ok = np.isin(place % self.period, COVERS[self.period]) & window_mask(self.words, self.length)
        # an anchor of a window lies at most period - 1 after the window's start
        reach = np.concatenate([[0], np.cumsum(self.whole)])
        at = np.flatnonzero(ok)
        low, high = np.maximum(at - self.period + 1, 0), np.minimum(at + 1, len(self.whole))
        at = at[reach[np.maximum(high, low)] > reach[low]] if len(self.whole) else at[:0]
        return at, a[at]

    def candidates(self, flagged: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a flagged anchor."""
        mark = np.zeros(len(self.whole) + self.period, dtype=np.int64)
        mark[flagged] = 1
        run = np.concatenate([[0], np.cumsum(mark)])
        n = len(self.whole)
        return np.flatnonzero(self.whole & (run[self.period : self.period + n] > run[:n]))

    def id_at(self, places: np.ndarray) -> np.ndarray:
        return np.repeat(self.ids.data, self.words.counts)[places]


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)


def _thin(rising: np.ndarray, kind: str) -> bytes:
    """Rising keys as compressed steps."""
    return zstandard.ZstdCompressor(level=1).compress(pack(np.diff(rising, prepend=rising.dtype.type(0)), kind))


def _thick(blob: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(zstandard.ZstdDecompressor().decompress(blob), kind), dtype=kind)


def _sorted_anchors(chunk: _Chunk, n_buckets: int):
    """Anchors of a chunk, and its distinct hashes in the order in which they are sent."""
    at, a = chunk.anchors()
    kinds, inverse, times = np.unique(a, return_inverse=True, return_counts=True)
    order, met, limits = by_bucket(_bucket_of(kinds, n_buckets), n_buckets)
    return at, kinds, inverse, times, order, met, limits


def _message(bucket, chunk, keys, low) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(keys, pa.binary()), pa.array(low, pa.binary())], ["bucket", "chunk", "keys", "low"])


def _send_anchors(window: int, period: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, window, period)
                _, kinds, _, _, order, met, limits = _sorted_anchors(chunk, n_buckets)
                high = (kinds[order] >> np.uint64(32)).astype("<u4")  # rising within a bucket, as kinds rise
                keys = [_thin(high[a:b], "<u4") for a, b in zip(limits[:-1], limits[1:], strict=True)]
                yield _message(met, np.full(len(met), row["chunk"]), keys, [None] * len(met))

    return run


def _replies(chunk, bucket, body) -> pa.Table:
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "body": pa.array(body, pa.binary())})


def _judge_anchors(group: pa.Table) -> pa.Table:
    """For each message, a bit per key: does another chunk have it?"""
    parts = [_thick(x, "<u4") for x in group.column("keys").to_pylist()]
    flat = np.concatenate(parts)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    twice = times[inverse] > 1
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return _replies(group.column("chunk"), group.column("bucket"), [np.packbits(x).tobytes() for x in np.split(twice, cuts)])


def _send_windows(window: int, period: int, n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row in left.to_pylist():
            chunk = _Chunk(row, window, period)
            at, kinds, inverse, times, order, met, limits = _sorted_anchors(chunk, n_buckets)
            flag = times > 1
            answers = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True))
            for b, lo, hi in zip(met.tolist(), limits[:-1], limits[1:], strict=True):
                bits = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=hi - lo).astype(bool)
                flag[order[lo:hi]] |= bits
            places = chunk.candidates(at[flag[inverse]])
            if not len(places):
                continue
            w = window_hashes(chunk.h, window)[places]
            ids = chunk.id_at(places)
            rank = np.lexsort((ids, w))
            w, ids = w[rank], ids[rank]
            head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            w, ids = w[head], ids[head]
            order, met, limits = by_bucket(_bucket_of(w, n_buckets), n_buckets)
            w, ids = w[order], ids[order]
            spans = list(zip(limits[:-1], limits[1:], strict=True))
            made.append(_message(met, np.full(len(met), row["chunk"]), [_thin(w[a:b], "<u8") for a, b in spans], [_thin(ids[a:b], "<i8") for a, b in spans]))
        empty = _message([], [], [], [])
        return pa.Table.from_batches(made or [empty])

    return run


def _judge_windows(group: pa.Table) -> pa.Table:
    """For each message, its keys for which another chunk has a smaller id."""
    parts = [_thick(x, "<u8") for x in group.column("keys").to_pylist()]
    keys, ids = np.concatenate(parts), np.concatenate([_thick(x, "<i8") for x in group.column("low").to_pylist()])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    least = np.minimum.reduceat(ids[order], head)
    least = np.repeat(least, np.diff(np.append(head, len(ranked))))
    lost = np.zeros(len(keys), dtype=bool)
    lost[order] = ids[order] > least
    chunks = group.column("chunk").to_pylist()
    bucket = group.column("bucket")[0].as_py()
    body = [pack(keys[lost & (owner == k)], "<u8") for k in range(len(parts))] if len(parts) < 64 else [pack(x[y], "<u8") for x, y in zip(parts, np.split(lost, np.cumsum([len(p) for p in parts])[:-1]), strict=True)]
    some = [k for k, b in enumerate(body) if b]
    return _replies([chunks[k] for k in some], [bucket] * len(some), [body[k] for k in some])


def _gone(chunk: _Chunk, lost: np.ndarray) -> np.ndarray:
    """Whether each word of a chunk lies in a window that a smaller id has, here or (``lost``) elsewhere."""
    n = len(chunk.words)
    depth = np.zeros(n + 1, dtype=np.int64)
    places = np.flatnonzero(chunk.whole)
    if len(places):
        w = window_hashes(chunk.h, chunk.window)[places]
        drop = np.isin(w, lost) if len(lost) else np.zeros(len(w), dtype=bool)
        ids = chunk.id_at(places)
        rank = np.argsort(w, kind="stable")
        ranked = w[rank]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        if len(head) < len(w):
            least = np.repeat(np.minimum.reduceat(ids[rank], head), np.diff(np.append(head, len(w))))
            drop[rank] |= ids[rank] > least
        places = places[drop]
        np.add.at(depth, places, 1)
        np.subtract.at(depth, places + chunk.window, 1)
    return np.cumsum(depth)[:n] > 0


def _cut_out(words: Words, gone: np.ndarray) -> Texts:
    """The texts without the gone words and the white space after each; all else as it was."""
    texts = words.texts
    stop = np.concatenate([words.start[1:], [texts.size]]) if len(words) else words.start
    stop = np.minimum(stop, np.repeat(texts.offsets[1:], words.counts))
    depth = np.zeros(texts.size + 1, dtype=np.int64)
    np.add.at(depth, words.start[gone], 1)
    np.subtract.at(depth, stop[gone], 1)
    keep = np.cumsum(depth)[: texts.size] == 0
    offsets = np.concatenate([[0], np.cumsum(keep)])[texts.offsets]
    return Texts(padded(texts.buf[: texts.size][keep]), offsets)


def _strings(texts: Texts) -> pa.Array:
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(texts.offsets.astype(np.int64)), pa.py_buffer(texts.buf[: texts.size].tobytes())])
    return flat.cast(pa.large_string()).cast(pa.string())


STRIPPED = "id long, n_words long, n_removed long, text string"


def _strip(window: int, period: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lost = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack(x, "<u8") for x in right.column("body").to_pylist())]))
        out = []
        for row in left.to_pylist():
            chunk = _Chunk(row, window, period)
            gone = _gone(chunk, lost)
            counts = chunk.words.counts
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.words.first])
            ids = pa.array(chunk.ids.data, pa.int64(), mask=np.ma.getmaskarray(chunk.ids))
            out.append(pa.table({"id": ids, "n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "text": _strings(joined(chunk.words, ~gone))}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "text": pa.array([], pa.string())})

    return run


def _strip_in_place(window: int, period: int, text_col: str, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lost = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack(x, "<u8") for x in right.column("body").to_pylist())]))
        out = []
        for row in left.to_pylist():
            chunk = _Chunk(row, window, period)
            columns = rest_in(row["rest"])
            columns[text_col] = _strings(_cut_out(chunk.words, _gone(chunk, lost)))
            out.append(pa.table([columns[k] for k in names], names))
        return pa.concat_tables(out)

    return run


def _lost_windows(chunks: DataFrame, window: int, period: int) -> DataFrame:
    """By chunk: the hashes of its windows that another chunk has under a smaller id."""
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    entries = n_words * len(COVERS[period]) // period
    n_buckets = max(entries // BUCKET_ENTRIES + 1, 16)
    texts = chunks.drop("rest")
    anchors = texts.mapInArrow(_send_anchors(window, period, n_buckets), MESSAGE)
    shared = anchors.groupBy("bucket").applyInArrow(_judge_anchors, REPLY)
    pairs = texts.groupBy("chunk").cogroup(shared.groupBy("chunk"))
    windows = pairs.applyInArrow(_send_windows(window, period, n_buckets), MESSAGE)
    return written(windows.groupBy("bucket").applyInArrow(_judge_windows, REPLY), "windows")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, text (kept words, one space between)."""
    period = period_for(window)
    chunks = chunked(docs, id_col, text_col)
    lost = _lost_windows(chunks, window, period)
    found = chunks.drop("rest").groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(_strip(window, period), STRIPPED)
    return found.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with all their columns, the repeated words cut out of the text.

    White space between kept words stays as it was; a text that loses nothing stays equal (null becomes empty).
    """
    period = period_for(window)
    chunks = chunked(docs, id_col, text_col, carry=True)
    lost = _lost_windows(chunks, window, period)
    schema = docs.select(*(F.col(f"`{c}`") for c in docs.columns)).schema
    return chunks.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(_strip_in_place(window, period, text_col, docs.columns), schema)


QUERY_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), tokens AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), runs AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER p AS run, count(*) OVER p AS n FROM tokens
  WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), firsts AS (
  SELECT run, min(doc_id) AS first FROM runs WHERE n = 13 GROUP BY run
), gone AS (
  SELECT DISTINCT r.doc_id, r.i + k AS i FROM runs r JOIN firsts f ON f.run = r.run AND f.first < r.doc_id, range(13) s(k) WHERE r.n = 13
), kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS text, count(*) AS n FROM tokens t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, len(w.words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
