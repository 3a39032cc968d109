"""SimHash near-duplicate detection (fingerprints of 64 bits, few differing bits).

Method: a byte-position inverted index with count filtering.  A fingerprint has
eight positional bytes.  Two fingerprints that differ in at most ``max_bits``
bits differ in at most that many bytes, so they share at least
``8 - max_bits`` positional bytes: the guaranteed minimum of matches.  Lists of
one positional byte would hold 1/256 of the corpus each, so lists are met in
advance: the positions are taken in groups, and as at least
``groups - max_bits`` groups of a pair hold no differing bit, a fingerprint is
posted once for every choice of that many groups (two bits: four groups of two
bytes, six lists keyed by four bytes).  In a list the shared positional bytes of
every pair are tallied, pairs under the minimum fall, and the differing bits of
the others are counted.

Scale: copies are folded into one fingerprint class before anything is indexed,
so a group of equal texts, of any size, is one entry.  A list is cut into blocks
of about ``BLOCK`` entries and each pair of its blocks is a group of its own, so a
list of any length is many tasks of one size.  Lists of four bytes hold N / 2**32
unrelated fingerprints; a fingerprint has at most 2,080 neighbours at two bits,
so links grow in proportion to classes.  Components come from alternating star
contractions over DataFrames; nothing is collected.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; a text of fewer than three words has its whole sequence as the one
shingle; repeated rows are kept, one output row per input row; a row with a null
id gets a fingerprint, takes no part in links, and has a null component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .shared import written
from .textkit import joined, steps, texts_of, words_of, xxh64_ranges

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42

#: Entries of a list that one group compares with as many others, about.
BLOCK = 1024

#: Pairs of lists worked on at once.
PAIR_STEP = 1 << 20


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit integers."""
    words = words_of(joined(words_of(texts_of(column, lower=True))))
    n_docs, counts = len(words.texts), words.counts
    n_shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    total = int(n_shingles.sum())
    if not total:
        return np.zeros(n_docs, np.uint64)
    first = np.concatenate([[0], np.cumsum(n_shingles)])
    at = np.arange(total) - np.repeat(first[:-1], n_shingles) + np.repeat(words.first[:-1], n_shingles)
    to = np.minimum(at + shingle, np.repeat(words.first[1:], n_shingles)) - 1
    h = xxh64_ranges(words.texts.buf, words.start[at], words.end[to], seed)
    has = n_shingles > 0
    # tallies of one bit of each byte at a time: eight byte-wide counters in an integer, of at most 255 shingles
    spans = np.concatenate([np.arange(a, b, 255) for a, b in zip(first[:-1][has], first[1:][has], strict=True)])
    owner = np.searchsorted(first[1:], spans, side="right")
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    half = n_shingles[has]
    out = np.zeros(int(has.sum()), dtype=np.uint64)
    ones = np.uint64(0x0101010101010101)
    for bit in range(8):
        tally = np.add.reduceat((h >> np.uint64(bit)) & ones, spans)
        counts8 = np.add.reduceat(tally.view(np.uint8).reshape(-1, 8).astype(np.int64), edges, axis=0)
        for byte in range(8):
            out |= (2 * counts8[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + bit)
    full = np.zeros(n_docs, dtype=np.uint64)
    full[has] = out
    return full


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch, "text"):
            fp = fingerprints_of(step.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([step.column("id"), pa.array(fp)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every document; fp holds the 64 bits as a signed long."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_fingerprint_batches, "id long, fp long")


def _groups(max_bits: int) -> list[tuple[int, ...]]:
    """Positions of a fingerprint in groups, more than differing bits can touch."""
    if not 0 <= max_bits <= 7:
        raise ValueError("a fingerprint of eight bytes guarantees a shared one up to seven bits")
    size = 2 if max_bits < 4 else 1
    return [tuple(range(p, p + size)) for p in range(0, 8, size)]


def _postings(fp, max_bits: int):
    """One key for each choice of groups that a pair may share: the bytes there, and which choice it is."""
    groups = _groups(max_bits)
    keys = []
    for i, choice in enumerate(combinations(groups, len(groups) - max_bits)):
        mask = sum(0xFF << (8 * p) for group in choice for p in group)
        keys.append(F.struct(F.lit(i).cast("byte").alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes")))
    return F.explode(F.array(*keys))


def _tally(x: np.ndarray) -> np.ndarray:
    """Positional bytes that pairs share, from their differing bits."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _near(u: np.ndarray, v: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of fingerprints, those that share the guaranteed bytes and then differ in few enough bits."""
    x = u ^ v
    enough = _tally(x) >= 8 - max_bits
    u, v, x = u[enough], v[enough], x[enough]
    close = np.bitwise_count(x) <= max_bits
    return u[close], v[close]


def _pairs(fps: np.ndarray, block: np.ndarray, off: np.ndarray, across: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each list, lists of one length together; ``across``: only pairs of its first with its second block."""
    size = np.diff(off)
    for n in np.unique(size[(size > 1) & ~across]).tolist():
        i, j = np.triu_indices(n, 1)
        lists = np.flatnonzero((size == n) & ~across)
        step = max(PAIR_STEP // len(i), 1)
        for lo in range(0, len(lists), step):
            at = off[lists[lo : lo + step], None]
            yield fps[at + i].ravel(), fps[at + j].ravel()
    for k in np.flatnonzero(across):
        own, first = fps[off[k] : off[k + 1]], block[off[k] : off[k + 1]]
        one, two = own[first == first.min()], own[first != first.min()]
        for lo in range(0, len(one), max(PAIR_STEP // max(len(two), 1), 1)):
            part = one[lo : lo + max(PAIR_STEP // max(len(two), 1), 1)]
            yield np.repeat(part, len(two)), np.tile(two, len(part))


def _verify(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("l")
            off = lists.offsets.to_numpy()
            fps, block = (lists.values.field(k).to_numpy() for k in range(2))
            across = batch.column("i").to_numpy() != batch.column("j").to_numpy()
            for u, v in _pairs(fps.view(np.uint64), block, off, across):
                u, v = (w.view(np.int64) for w in _near(u, v, max_bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (u < v) of fingerprints in ``classes`` (column fp, distinct) within max_bits."""
    posted = classes.select("fp", _postings(F.col("fp"), max_bits).alias("key"))
    met = posted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    own = met.select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    lists = sent.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("fp", "own")).alias("l"))
    return lists.select("i", "j", "l").mapInArrow(_verify(max_bits), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``id_col``, fp, component (its smallest id), n_links of its fingerprint class."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    classes = written(classes, "classes")
    pairs = links(classes, max_bits)
    left = classes.select(F.col("fp").alias("u"), F.col("rep").alias("a"))
    right = classes.select(F.col("fp").alias("v"), F.col("rep").alias("b"))
    edges = written(pairs.join(left, "u").join(right, "v").select("a", "b"), "edges")
    degree = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    roots = connected(edges)
    found = (
        classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("fp", F.coalesce("root", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    out = prints.join(found, "fp", "left")
    live = F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), "fp", F.when(live, F.col("component")).alias("component"), F.when(live, F.col("n_links")).alias("n_links"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that are the smallest id of their component, all columns kept.

    Rows with a null id stay; of rows that repeat one id, all stay if it is the smallest.
    """
    found = near_duplicates(docs, id_col, text_col, max_bits)
    out = found.where(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(out, docs[f"`{id_col}`"] == out["__gone"], "left_anti")
