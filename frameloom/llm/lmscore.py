"""Scores of texts under a hidden Markov language model.

Model.  A text is its words (A-Z lower-cased) and one end token.  A word has a
class that depends on its bytes alone: short words have a hashed class of their
own kind, longer words the class of their ending, the end token class 0.  Latent
states emit classes; a class emits its words by their smoothed share in the
training texts:

    P(text) = sum over state paths of  pi(s1) prod A(s, s') prod E(class | s) * prod P(word | class)
    P(word | class) = (c + 1) / (N_class + V_class + 1)

(the end token is the only word of its class, so its factor is one).  The first
factor is computed exactly by the scaled forward recursion over the whole text.

Training.  Baum-Welch over every training text: each partition runs forward and
backward over segments of SEGMENT tokens and returns its expected counts, a
table of states x classes; the partitions' tables are summed.  The tables have a
fixed size, so what reaches the driver is bounded however large the corpus is.
Starting values come from clustering the segments of a few chunks, a documented
bounded sample; the counts of all rounds come from all training texts.

Word counts.  The vocabulary grows with the corpus and is never broadcast or
collected.  Each coded chunk sends its distinct words (64-bit hashes) with their
counts to the words' buckets and gets the corpus counts back, aligned with what it
sent.  A word that makes up a third of the corpus is one entry per chunk.

Defined cases: a null or wordless text is the end token alone; repeated rows count
as often as they occur and are all scored; a row with a null id or a null training
mark isn't learnt from and is scored as held out; with no training token the base
score is log10(1 / 1) = 0 per token and the model's classes are uniform; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import by_bucket
from .shared import written
from .textkit import pack, steps, texts_of, unpack, word_hashes, words_of

STATES = 8
CLASSES = 4096
ROUNDS = 3

#: Count tables that one task adds up.
FAN_IN = 16
SEGMENT = 128

#: Words of up to this many bytes have a hashed class, longer ones that of their last three bytes.
SHORT_WORD = 6

#: Bytes of text in a coded chunk, about; and of the sample for starting values, chunks and segments.
CHUNK_BYTES = 8 << 20
SEED_CHUNKS, SEED_SEGMENTS = 4, 2000

BUCKET_ENTRIES = 1_000_000

#: The end token's place in the vocabulary.
END = np.uint64(0)

CODED = "chunk long, ids binary, id_set binary, train binary, n_tokens binary, token binary, kinds binary, classes binary"
MESSAGE = "bucket long, chunk long, keys binary, classes binary, times binary"
ANSWER = "chunk long, bucket long, body binary, class_sizes binary, total long"
SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _squeeze(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(values, kind))


def _loosen(blob: bytes, kind: str) -> np.ndarray:
    return unpack(zstandard.ZstdDecompressor().decompress(blob), kind)


def class_of(words, h: np.ndarray) -> np.ndarray:
    """Classes 1 .. CLASSES - 1 of words."""
    size = words.end - words.start
    buf = words.texts.buf
    tail = np.uint64(0)
    for k in (1, 2, 3):
        tail = (tail << np.uint64(8)) | buf[np.maximum(words.end - k, 0)].astype(np.uint64)
    half = CLASSES // 2
    short = np.uint64(1) + h % np.uint64(half - 1)
    ending = np.uint64(half) + ((tail * np.uint64(11400714785074694791)) >> np.uint64(40)) % np.uint64(CLASSES - half)
    return np.where(size <= SHORT_WORD, short, ending).astype(np.uint16)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    names = [x.split()[0] for x in CODED.split(", ")]
    for batch in batches:
        for step in steps(batch, "text", CHUNK_BYTES):
            words = words_of(texts_of(step.column("text"), lower=True))
            h = word_hashes(words)
            h[h == END] = np.uint64(1)
            counts = words.counts
            n = len(words) + len(counts)
            ends = words.first[1:] + np.arange(len(counts))
            is_end = np.zeros(n, dtype=bool)
            is_end[ends] = True
            tokens = np.full(n, END)
            tokens[~is_end] = h
            classes = np.zeros(n, dtype=np.uint16)
            classes[~is_end] = class_of(words, h)
            kinds, at, inverse = np.unique(tokens, return_index=True, return_inverse=True)
            ids = step.column("id")
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            train = step.column("train").fill_null(False).to_numpy(zero_copy_only=False) & there
            row = [(part << 32) + made, pack(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8"), pack(there, "u1"), pack(train, "u1"), pack(counts + 1, "<i8"), _squeeze(inverse, "<u4"), pack(kinds, "<u8"), pack(classes[at], "<u2")]
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names)


# ---------------------------------------------------------------- Baum-Welch


class Model:
    """Start ``pi``, segment start ``mid``, transitions ``a``, class emissions ``e`` (states x classes)."""

    def __init__(self, pi, mid, a, e):
        self.pi, self.mid, self.a, self.e = pi, mid, a, e


def _segments(n_tokens: np.ndarray, train: np.ndarray):
    """Start, length and whether it opens a text, of each segment of the training texts; longest first."""
    first = np.concatenate([[0], np.cumsum(n_tokens)])[:-1]
    n = np.where(train, -(-n_tokens // SEGMENT), 0)
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    start = first[doc] + k * SEGMENT
    size = np.minimum(n_tokens[doc] - k * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    return start[order], size[order], (k == 0)[order]


def expected_counts(model: Model, classes: np.ndarray, start: np.ndarray, size: np.ndarray, opens: np.ndarray):
    """Expected starts (both kinds), transitions and emissions of segments, longest first, and their log2 likelihood."""
    k = len(model.pi)
    pi, mid, mids, emits, ll = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES)), 0.0
    et, a = np.ascontiguousarray(model.e.T, dtype=np.float32), model.a.astype(np.float32)
    step = 8192
    for lo in range(0, len(start), step):
        s, n, o = start[lo : lo + step], size[lo : lo + step], opens[lo : lo + step]
        steps_ = int(n[0])
        live = np.searchsorted(-n, -np.arange(steps_), side="left")  # segments longer than t
        off = np.concatenate([[0], np.cumsum(live)])
        cls = np.concatenate([classes[s[: live[t]] + t] for t in range(steps_)])
        b = et[cls]
        alpha = np.empty_like(b)
        x = np.where(o[:, None], model.pi, model.mid).astype(np.float32)
        scale = np.empty(len(cls), dtype=np.float32)
        for t in range(steps_):
            i, j = off[t], off[t + 1]
            y = (x if t == 0 else x[: live[t]] @ a) * b[i:j]
            z = y.sum(axis=1)
            y /= z[:, None]
            alpha[i:j], scale[i:j], x = y, z, y
        ll += float(np.log2(scale, dtype=np.float64).sum())
        gamma = np.empty_like(b)
        beta = np.ones((live[-1], k), dtype=np.float32)
        for t in range(steps_ - 1, -1, -1):
            i, j = off[t], off[t + 1]
            if t < steps_ - 1:
                i2, j2 = off[t + 1], off[t + 2]
                w = b[i2:j2] * beta / scale[i2:j2, None]
                mids += alpha[i : i + live[t + 1]].T @ w
                beta = np.ones((live[t], k), dtype=np.float32)
                beta[: live[t + 1]] = w @ a.T
            gamma[i:j] = alpha[i:j] * beta
        for q in range(k):
            emits[q] += np.bincount(cls, gamma[:, q], CLASSES)
        g0 = gamma[: live[0]]
        pi += g0[o].sum(axis=0)
        mid += g0[~o].sum(axis=0)
    return pi, mid, mids * model.a, emits, ll


def _load(row: dict):
    n_tokens, train = unpack(row["n_tokens"], "<i8"), unpack(row["train"], "u1") == 1
    token = _loosen(row["token"], "<u4")
    return n_tokens, train, token, unpack(row["classes"], "<u2")


def _expect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                n_tokens, train, token, classes = _load(row)
                part = expected_counts(model, classes[token], *_segments(n_tokens, train))
                total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
        if total is not None:
            blob = np.concatenate([np.ravel(x) for x in total])
            yield pa.RecordBatch.from_arrays([pa.array([pack(blob, "<f8")], pa.binary())], ["counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column("counts").to_pylist():
            x = unpack(blob, "<f8")
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pack(total, "<f8")], pa.binary())], ["counts"])


def _summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of the count tables of all partitions, by a tree: a task adds up FAN_IN tables at most, and FAN_IN tables arrive here."""
    width = parts.rdd.getNumPartitions()
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        parts = parts.repartition(width).mapInArrow(_add_up, "counts binary")
    rows = parts.collect()
    return sum(unpack(r.counts, "<f8") for r in rows) if rows else None


def _normal(x: np.ndarray, prior: float) -> np.ndarray:
    x = x + prior
    return x / x.sum(axis=-1, keepdims=True)


def _from_counts(flat: np.ndarray, k: int) -> tuple[Model, float]:
    pi, mid = flat[:k], flat[k : 2 * k]
    a, e = flat[2 * k : 2 * k + k * k].reshape(k, k), flat[2 * k + k * k : -1].reshape(k, CLASSES)
    back = e.sum(axis=0) / max(e.sum(), 1.0)  # a state's rare classes lean on the share in all states
    e = e + 2.0 * CLASSES * 0.05 * _normal(back, 0.5 / CLASSES)
    return Model(_normal(pi, 0.1), _normal(mid, 0.1), _normal(a, 0.1), e / e.sum(axis=1, keepdims=True)), float(flat[-1])


def starting_model(rows: list[dict], k: int = STATES) -> Model:
    """Clusters of segments (spherical k-means on root class shares) as starting states."""
    rng = np.random.default_rng(7)
    found = []
    for row in rows:
        n_tokens, train, token, classes = _load(row)
        start, size, _ = _segments(n_tokens, train)
        pick = rng.permutation(len(start))[: SEED_SEGMENTS // max(len(rows), 1)]
        all_classes = classes[token]
        for s, n in zip(start[pick], size[pick], strict=True):
            found.append(np.bincount(all_classes[s : s + n], minlength=CLASSES).astype(np.float32))
    a = np.full((k, k), 0.1 / k) + np.eye(k) * 0.9
    flat = np.full(k, 1 / k)
    if not found:
        return Model(flat, flat, _normal(a, 0), np.full((k, CLASSES), 1 / CLASSES))
    counts = np.stack(found)
    x = np.sqrt(counts)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[:1]
    for _ in range(k - 1):  # farthest-first seeds
        centre = np.concatenate([centre, x[[int(np.argmin((x @ centre.T).max(axis=1)))]]])
    for _ in range(12):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[own == q].sum(axis=0) if (own == q).any() else centre[q] for q in range(k)])
        centre = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    emits = np.stack([counts[own == q].sum(axis=0) for q in range(k)])
    share = counts.sum(axis=0) / counts.sum()
    e = _normal(emits + 200 * share, 0.01)
    return Model(flat, flat, _normal(a, 0), e)


def train_model(coded: DataFrame, k: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch rounds over every training text of ``coded``."""
    picked = [r.chunk for r in coded.select("chunk").orderBy(F.xxhash64("chunk")).limit(SEED_CHUNKS).collect()]
    seed = coded.where(F.col("chunk").isin(picked)).select("n_tokens", "train", "token", "classes").collect()
    model = starting_model([r.asDict() for r in seed], k)
    for _ in range(rounds):
        flat = _summed(coded.select("n_tokens", "train", "token", "classes").mapInArrow(_expect(model), "counts binary"))
        if flat is None:
            break
        model, _ = _from_counts(flat, k)
    return model


# ---------------------------------------------------------------- word counts


def _send_words(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n_tokens, train, token, classes = _load(row)
                kinds = unpack(row["kinds"], "<u8")
                times = np.bincount(token[np.repeat(train, n_tokens)], minlength=len(kinds))
                order, met, limits = by_bucket((kinds % np.uint64(n_buckets)).astype(np.int64), n_buckets)
                spans = list(zip(limits[:-1], limits[1:], strict=True))
                k, c, t = kinds[order], classes[order], times[order]
                cols = [[pack(x[a:b], kind) for a, b in spans] for x, kind in ((k, "<u8"), (c, "<u2"), (t, "<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(np.full(len(met), row["chunk"]), pa.int64()), *(pa.array(x, pa.binary()) for x in cols)], ["bucket", "chunk", "keys", "classes", "times"])

    return run


def _count_words(group: pa.Table) -> pa.Table:
    """Corpus counts of each message's words; one row besides has the bucket's distinct words by class and all its tokens."""
    parts = [unpack(x, "<u8") for x in group.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    classes = np.concatenate([unpack(x, "<u2") for x in group.column("classes").to_pylist()])
    times = np.concatenate([unpack(x, "<u4") for x in group.column("times").to_pylist()])
    _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(inverse, times, len(at)).astype(np.int64)
    known = total > 0
    sizes = np.bincount(classes[at][known], minlength=CLASSES)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    body = [zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").tobytes()) for x in np.split(total[inverse], cuts)]
    bucket = group.column("bucket")[0].as_py()
    n = len(parts)
    return pa.table({
        "chunk": pa.array([*group.column("chunk").to_pylist(), None], pa.int64()),
        "bucket": pa.array([bucket] * (n + 1), pa.int64()),
        "body": pa.array([*body, None], pa.binary()),
        "class_sizes": pa.array([None] * n + [pack(np.concatenate([sizes, np.bincount(classes[at], total, CLASSES)]), "<f8")], pa.binary()),
        "total": pa.array([None] * n + [int(total.sum())], pa.int64()),
    })


# ---------------------------------------------------------------- scores


def forward_log2(model: Model, classes: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Exact log2 likelihood of each class sequence, by the scaled forward recursion; sequences run side by side."""
    et, a = np.ascontiguousarray(model.e.T), model.a
    first = np.concatenate([[0], np.cumsum(n_tokens)])[:-1]
    order = np.argsort(-n_tokens, kind="stable")
    size, at = n_tokens[order], first[order]
    out = np.zeros(len(size))
    if not len(size):
        return out
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    prod = np.ones(len(size))
    x = np.broadcast_to(model.pi, (len(size), len(model.pi)))
    for t, n in enumerate(live.tolist()):
        x = (x if t == 0 else x[:n] @ a) * et[classes[at[:n] + t]]
        z = x.sum(axis=1)
        x = x / z[:, None]
        prod[:n] *= z
        if t % 16 == 15 or t + 1 == len(live):
            out += np.log2(prod)
            prod[:] = 1.0
    back = np.empty(len(size))
    back[order] = out
    return back


def _score(model: Model, class_tokens: np.ndarray, class_words: np.ndarray, train_tokens: int, train_words: int, n_buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row in left.to_pylist():
            n_tokens, train, token, classes = _load(row)
            kinds = unpack(row["kinds"], "<u8")
            order, met, limits = by_bucket((kinds % np.uint64(n_buckets)).astype(np.int64), n_buckets)
            answers = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True))
            c = np.zeros(len(kinds), dtype=np.int64)
            for b, lo, hi in zip(met.tolist(), limits[:-1], limits[1:], strict=True):
                c[order[lo:hi]] = _loosen(answers[b], "<i8")
            base = np.log10((c + 1.0) / (train_tokens + train_words + 1.0))
            own = np.log10((c + 1.0) / (class_tokens[classes] + class_words[classes] + 1.0))
            own[kinds == END] = 0.0
            first = np.concatenate([[0], np.cumsum(n_tokens)])[:-1]
            add = lambda per_kind: np.add.reduceat(per_kind[token], first) if len(first) else np.zeros(0)
            score = forward_log2(model, classes[token], n_tokens) * np.log10(2.0) + add(own)
            there = unpack(row["id_set"], "u1") == 1
            made.append(pa.table({
                "id": pa.array(unpack(row["ids"], "<i8"), pa.int64(), mask=~there), "held_out": pa.array(~train), "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(add((c > 0).astype(np.int64)).astype(np.int64)), "train_tokens": pa.array(np.full(len(n_tokens), train_tokens), pa.int64()),
                "base_score": pa.array(add(base)), "score": pa.array(score),
            }))
        return pa.concat_tables(made) if made else pa.table({k: pa.array([], t) for k, t in (("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    return run


def language_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", k: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Score every text under a model of the rows for which ``train`` holds.

    Returns ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), train.alias("train"))
    coded = written(slim.mapInArrow(_code, CODED), "coded")
    kinds = coded.agg(F.sum(F.octet_length("classes"))).first()[0] or 0
    n_buckets = max(kinds // 2 // BUCKET_ENTRIES + 1, 16)
    model = train_model(coded, k, rounds)
    messages = coded.select("chunk", "n_tokens", "train", "token", "kinds", "classes").mapInArrow(_send_words(n_buckets), MESSAGE)
    answers = written(messages.groupBy("bucket").applyInArrow(_count_words, ANSWER), "counts")
    sizes = _summed(answers.where("class_sizes IS NOT NULL").select(F.col("class_sizes").alias("counts")))
    class_words, class_tokens = (sizes[:CLASSES], sizes[CLASSES:]) if sizes is not None else (np.zeros(CLASSES), np.zeros(CLASSES))
    score = _score(model, class_tokens, class_words, int(class_tokens.sum()), int(class_words.sum()), n_buckets)
    back = answers.where("body IS NOT NULL").select("chunk", "bucket", "body")
    return coded.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, SCORED).withColumnRenamed("id", id_col)
