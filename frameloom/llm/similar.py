"""Near copies by the Jaccard similarity of their word shingles, checked exactly.

Method: texts of one set of shingles are one class.  A class has a SimHash
fingerprint of its shingle set, wider than 64 bits, and the candidates come from a
byte-position inverted index with count filtering: a class is posted under every
positional byte; in a list the positional bytes that each pair shares are tallied,
pairs under ``SHARED`` fall, the differing bits of the others are counted, and pairs
with more than similar sets can have fall too.  A candidate pair is linked if the
Jaccard similarity of the whole shingle sets is ``least`` or more.

Width: a bit of two sets of one size differs with probability acos(2s / (1 + s)) / pi,
0.1515 at s = 0.8 (0.161 at most for sets of six to twenty-nine shingles, computed
exactly; 0.1875 for four shared of five).  64 bits guarantee no shared byte, so the
fingerprint is as wide as ``MISSED`` asks: 56 bytes at 0.8, where a pair shares 15 on
average, and fewer than two with probability 5e-7 (3e-6 for the worst of six to
twenty-nine shingles, 1e-4 for four of five); more similar pairs with less.

Scale: a list holds 1/256 of the classes, about, in the order of their numbers of
shingles, so that only sets of near sizes meet; a list over ``LIST`` is cut into
blocks that meet pairwise, each pair of blocks a group of its own.  Tallies grow with
the square of the classes over 256, rows in proportion.  The candidates of a list
fall into parts; in each part every class is first compared with one hub, chosen by
a hash so that the lists of a group have several hubs: a few comparisons for each
copy.  After components of these links, only parts that still hold classes of
different components are looked at again.  They are cut into blocks of about
``BLOCK`` classes or ``HELD`` shingles, and a task compares the texts of two blocks, classes of different
components only, and returns the links that join components: fewer than it has
classes.  No candidate pair is left out, no pair becomes a row but those with a hub,
and no list is held by one task.

Defined cases: shingles are of lower-cased words (A to Z); a text with fewer words
than a shingle has its whole sequence as the one shingle; null and wordless texts
are one class; a row with a null id takes no part in links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import written
from .textkit import joined, mix64, steps, texts_of, words_of, xxh64_ranges

SHINGLE_WORDS = 5
LEAST = 0.8
SEED = 42

#: Positional bytes that a pair must share, and how likely a pair at the threshold may share fewer.
SHARED, MISSED = 2, 4e-6

#: Differing bits of small sets over those of large ones, at most; deviations allowed over the expected number.
SMALL, DEVIATIONS = 1.07, 5

#: Entries of a list in a block, about, pairs of a list tallied at once, rows of them, and orders of hubs.
LIST, PAIR_STEP, ROWS, HUBS = 65536, 1 << 18, 128, 8

#: Bytes of text worked on at once: several arrays of a word each are alive at a time.
STEP_BYTES = 1 << 20

#: Classes and shingles of a part in a block, about (whichever is reached first), and shingles of a table of shared shingles.
BLOCK, HELD, COLUMNS = 1024, 1 << 18, 4096

_SALTS = mix64(np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array, shingle: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and the n + 1 offsets of texts."""
    words = words_of(joined(words_of(texts_of(column, lower=True))))
    counts = words.counts
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(first[-1])) - np.repeat(first[:-1], n) + np.repeat(words.first[:-1], n)
    to = np.minimum(at + shingle, np.repeat(words.first[1:], n)) - 1
    h = xxh64_ranges(words.texts.buf, words.start[at], words.end[to], SEED)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(n) + 1))


def _per_set(how, values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(offsets) - 1, empty, dtype=np.uint64)
    has = np.diff(offsets) > 0
    if has.any():
        out[has] = how.reduceat(values, offsets[:-1][has])
    return out


def differing(least: float) -> float:
    """Share of bits in which the fingerprints of sets of this similarity differ, at most."""
    return SMALL * math.acos(min(2 * least / (1 + least), 1.0)) / math.pi


def positions(least: float) -> int:
    """Positional bytes of a fingerprint, in eights."""
    same = (1 - differing(least)) ** 8
    for n in range(8, 481, 8):
        if sum(math.comb(n, k) * same**k * (1 - same) ** (n - k) for k in range(SHARED)) <= MISSED:
            return n
    raise ValueError("sets so different share too few bytes for an index")


def most_bits(least: float) -> int:
    """Differing bits of a pair at the threshold, at most."""
    n, p = 8 * positions(least), differing(least)
    return math.ceil(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


def set_keys(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Key of each set: one for equal sets."""
    return mix64(_per_set(np.add, mix64(h ^ _SALTS[0]), offsets, 0) ^ (np.diff(offsets).astype(np.uint64) * _SALTS[1]))


def fingerprints(h: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each set, ``width`` positional bytes as integers of eight: a bit is 1 if set in over half the hashes."""
    n = np.diff(offsets)
    full = np.zeros((len(n), width // 8), dtype=np.uint64)
    has = n > 0
    if not has.any():
        return full
    # tallies of one bit of each byte at a time: eight byte-wide counters in an integer, of at most 255 shingles
    size = n[has]
    parts = -(-size // 255)
    edges = np.cumsum(parts) - parts
    spans = np.repeat(offsets[:-1][has], parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(edges, parts))
    ones = np.uint64(0x0101010101010101)
    for word in range(width // 8):
        x, out = mix64(h ^ _SALTS[2 + word]), np.zeros(len(size), dtype=np.uint64)
        for bit in range(8):
            tally = np.add.reduceat((x >> np.uint64(bit)) & ones, spans)
            counts = np.add.reduceat(tally.view(np.uint8).reshape(-1, 8).astype(np.int32), edges, axis=0)
            over = (2 * counts > size[:, None]).astype(np.uint8)
            out |= np.ascontiguousarray(over).view(np.uint64)[:, 0] << np.uint64(bit)
        full[has, word] = out
    return full


def _print_names(width: int) -> list[str]:
    return [f"f{k}" for k in range(width // 8)]


def _print_batches(shingle: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text", STEP_BYTES):
                h, offsets = shingle_sets(step.column("text"), shingle)
                prints = np.ascontiguousarray(fingerprints(h, offsets, width).T).view(np.int64)
                key = set_keys(h, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays([step.column("id"), pa.array(key), pa.array(np.diff(offsets), pa.int64()), *map(pa.array, prints)], ["id", "key", "n", *_print_names(width)])

    return run


def _enough(shared: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """Of pairs with so many shared positional bytes and differing bits ``x`` (a row each), the candidates."""
    return (shared >= SHARED) & (np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= bits)


def candidates(n: np.ndarray, prints: np.ndarray, own: np.ndarray, across: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a list whose sets ascend in their number of shingles ``n``; ``across``: only of its two blocks."""
    bits = most_bits(least)
    at = np.ascontiguousarray(prints.view(np.uint8).T)
    top = np.searchsorted(n, n / least + 1e-9, side="right")
    lo = 0
    while lo < len(n) - 1:
        hi = min(lo + max(min(ROWS, PAIR_STEP // max(int(top[lo]) - lo, 1)), 1), len(n))
        for left in range(lo, int(top[hi - 1]), PAIR_STEP):
            right = min(left + PAIR_STEP, int(top[hi - 1]))
            shared = np.zeros((hi - lo, right - left), dtype=np.uint8)
            for byte in at:
                shared += byte[lo:hi, None] == byte[None, left:right]
            i, j = np.nonzero(shared >= SHARED)
            meet = (i + lo < j + left) & (j + left < top[i + lo])
            if across:
                meet &= own[i + lo] != own[j + left]
            i, j = i[meet], j[meet]
            near = _enough(shared[i, j], prints[i + lo] ^ prints[j + left], bits)
            yield i[near] + lo, j[near] + left
        lo = hi


def _merged(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots after links between u and v: the smallest entry of each component."""
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def parts_of(keys: np.ndarray, n: np.ndarray, prints: np.ndarray, own: np.ndarray, across: bool, turn: int, least: float) -> tuple[np.ndarray, ...]:
    """Classes of a list that are candidates of another: their part (its smallest key), key, the part's size, shingles and hub, and if the hub is a candidate."""
    order = np.lexsort((keys, n))
    keys, n, prints, own = keys[order], n[order], prints[order], own[order]
    root = np.arange(len(keys))
    for u, v in candidates(n, prints, own, across, least):
        if len(u):
            root = _merged(root, u, v)
    size = np.bincount(root, minlength=len(keys))
    live = np.flatnonzero(size[root] > 1)
    by = np.lexsort((mix64(keys[live].view(np.uint64) ^ _SALTS[64 + turn % HUBS]), root[live]))
    live = live[by]
    first = np.flatnonzero(np.diff(root[live], prepend=-1))
    counts = np.diff(np.append(first, len(live)))
    hub = np.repeat(live[first], counts)
    part = np.repeat(np.minimum.reduceat(keys[live], first), counts) if len(live) else keys[:0]
    x = prints[live] ^ prints[hub]
    near = _enough((np.ascontiguousarray(x).view(np.uint8).reshape(len(x), prints.shape[1] * 8) == 0).sum(axis=1), x, most_bits(least))
    near &= (live != hub) & (np.minimum(n[live], n[hub]) >= least * np.maximum(n[live], n[hub]) - 1e-9)
    held = np.add.reduceat(n[live], first) if len(live) else n[:0]
    return part, keys[live], counts.repeat(counts), held.repeat(counts), keys[hub], near


def _lists(width: int, least: float):
    """Parts of sorted lists: a list may go on in the next batch."""
    names = _print_names(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def parts(group: int) -> Iterator[pa.RecordBatch]:
            key, n, own, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(key) > 1:
                part, *out = parts_of(key, n, prints, own, (group >> 16 & 0xFFFF) != (group & 0xFFFF), group >> 40, least)
                name = mix64(mix64(part.view(np.uint64)) ^ np.uint64(group)).view(np.int64)
                for lo in range(0, len(name), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 14)]) for x in (name, *out)], ["band", "key", "size", "held", "hub", "near"])

        group = None
        for batch in batches:
            lists, key, n, own = (batch.column(k).to_numpy() for k in ("list", "key", "n", "own"))
            prints = np.stack([batch.column(k).to_numpy() for k in names], axis=1).view(np.uint64)
            cuts = [*np.flatnonzero(np.diff(lists, prepend=lists[:1] - 1)).tolist(), len(lists)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lists[lo] != group:
                    if held:
                        yield from parts(group)
                    held, group = [], int(lists[lo])
                held.append((key[lo:hi], n[lo:hi], own[lo:hi], prints[lo:hi]))
        if held:
            yield from parts(group)

    return run


def index(classes: DataFrame, width: int, least: float, longest: int = LIST) -> DataFrame:
    """(band, key, size, held, hub, near): the classes of each part of a list, by the byte-position index.

    ``band`` names the part, of ``size`` classes with ``held`` shingles; ``near`` tells if the class and the part's hub are a candidate pair.
    """
    names = _print_names(width)
    byte = [F.lit(256 * p) + F.shiftrightunsigned(names[p // 8], 8 * (p % 8)).bitwiseAND(255).cast("int") for p in range(width)]
    posted = classes.where("n > 0").select("key", "n", *names, F.explode(F.array(*byte)).alias("place"))
    long = written(posted.groupBy("place").count().where(F.col("count") > longest), "long")
    own, i, j = F.lit(0), F.lit(0), F.lit(0)
    if not long.isEmpty():
        blocks = F.ceil(F.coalesce("count", F.lit(1)) / longest).cast("int")
        posted = posted.join(long, "place", "left").withColumn("own", F.pmod(F.xxhash64("key", "place"), blocks).cast("int"))
        posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        own, i, j = F.col("own"), F.least("own", "other"), F.greatest("own", "other")
    name = F.shiftleft(F.col("place").cast("long"), 32) + F.shiftleft(i.cast("long"), 16) + j
    groups = posted.select(name.alias("list"), "key", "n", own.alias("own"), *names).repartition("list").sortWithinPartitions("list")
    return groups.mapInArrow(_lists(width, least), "band long, key long, size long, held long, hub long, near boolean")


def similarity(left: pa.Array, right: pa.Array, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of texts."""
    (a, at), (b, bt) = shingle_sets(left, shingle), shingle_sets(right, shingle)
    n, m = np.diff(at), np.diff(bt)
    doc = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
    h = np.concatenate([a, b])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    both = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n))
    return both / np.maximum(n + m - both, 1)


def _near(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "left", STEP_BYTES):
                near = pa.array(similarity(step.column("left"), step.column("right"), shingle) >= least - 1e-9)
                yield step.select(["u", "v"]).rename_columns(["a", "b"]).filter(near)

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each two sets share."""
    size = np.array([len(x) for x in sets])
    kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    rank = np.cumsum(np.bincount(at, minlength=len(kinds)) > 1) - 1  # shingles of one set alone are shared with none
    keep = np.bincount(at, minlength=len(kinds))[at] > 1
    at, owner = rank[at[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(at.max(initial=-1)) + 1, COLUMNS):
        here = (at >= lo) & (at < lo + COLUMNS)
        table = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        table[owner[here], at[here] - lo] = 1
        out += table @ table.T
    return out


def joining(keys: np.ndarray, labels: np.ndarray, own: np.ndarray, across: bool, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between classes of a group (``across``: of its two blocks) that join different labels, one for each that is joined."""
    if len(keys) < 2 or labels.min() == labels.max():
        return keys[:0], keys[:0]
    both = _shared(sets)
    size = np.array([len(x) for x in sets], dtype=np.float32)
    near = both >= least * (size[:, None] + size[None, :] - both) - 1e-6 * both
    near &= labels[:, None] != labels[None, :]
    if across:
        near &= own[:, None] != own[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    _, first = np.unique(np.stack([np.minimum(labels[i], labels[j]), np.maximum(labels[i], labels[j])]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    kept = []
    for k in np.sort(first).tolist():
        a, b = top(int(labels[i[k]])), top(int(labels[j[k]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
    return keys[i[kept]], keys[j[kept]]


def _joins(shingle: int, least: float):
    """Links of sorted groups (band, i, j): a group may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def links() -> pa.RecordBatch:
            keys, labels, own = (np.array([x[k] for x in held]) for k in range(3))
            u, v = joining(keys, labels, own, group[1] != group[2], [x[3] for x in held], least)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], ["a", "b"])

        for batch in batches:
            for step in steps(batch, "text", STEP_BYTES):
                h, off = shingle_sets(step.column("text"), shingle)
                facts = [step.column(k).to_pylist() for k in ("band", "i", "j", "key", "label", "own")]
                for k, (band, i, j, key, label, own) in enumerate(zip(*facts, strict=True)):
                    if (band, i, j) != group:
                        if len(held) > 1:
                            yield links()
                        held, group = [], (band, i, j)
                    held.append((key, label, own, h[off[k] : off[k + 1]].copy()))
        if len(held) > 1:
            yield links()

    return run


def _texts(keys: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, tag: str) -> DataFrame:
    """(key, text) of the named classes."""
    reps = classes.select("key", "rep").join(keys.hint("merge"), "key").select(F.col("rep").alias("id")).distinct()
    # rows that repeat an id may differ in text: a text is taken with its own key, not the id's
    texts = docs.join(reps.hint("merge"), "id").mapInArrow(_text_keys(shingle), "key long, text string")
    return written(texts.join(keys.hint("merge"), "key").groupBy("key").agg(F.first("text").alias("text")), tag)


def _text_keys(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text", STEP_BYTES):
                h, offsets = shingle_sets(step.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(h, offsets).view(np.int64)), step.column("text")], ["key", "text"])

    return run


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, least: float = LEAST, block: int = BLOCK, longest: int = LIST) -> DataFrame:
    """(id, component) of every row with an id: component is the smallest id of its near copies."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    width = positions(least)
    names = _print_names(width)
    keyed = written(slim.mapInArrow(_print_batches(shingle, width), "id long, key long, n long, " + ", ".join(f"{k} long" for k in names)), "fingerprints")
    classes = written(keyed.groupBy("key").agg(F.min("id").alias("rep"), *(F.first(k).alias(k) for k in ("n", *names))), "classes")

    # each class of a part with the part's hub
    met = written(index(classes, width, least, longest), "lists")
    pairs = written(met.where("near").select(F.least("key", "hub").alias("u"), F.greatest("key", "hub").alias("v")).distinct(), "pairs")
    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), classes, slim, shingle, "texts")
    left, right = texts.withColumnsRenamed({"key": "u", "text": "left"}), texts.withColumnsRenamed({"key": "v", "text": "right"})
    edges = written(pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").mapInArrow(_near(shingle, least), "a long, b long"), "edges")
    roots = written(connected(edges), "roots")

    # parts whose classes are not all of one component (a part of two is settled by its hub)
    open_ = met.where("size > 2").select("band", "key", "size", "held").join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left")
    open_ = written(open_.select("band", "key", "size", "held", F.coalesce("root", "key").alias("label")), "labels")
    mixed = open_.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("held") / HELD)).cast("int")
    rest = open_.join(mixed.hint("merge"), "band").withColumn("own", F.pmod(F.xxhash64("key", "band"), blocks).cast("int"))
    rest = written(rest.select("band", "key", "label", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")), "open")
    if not rest.isEmpty():
        texts = _texts(rest.select("key").distinct(), classes, slim, shingle, "texts")
        rest = rest.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "label", "own")
        groups = rest.join(texts.hint("merge"), "key").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        more = written(groups.select("band", "i", "j", "key", "label", "own", "text").mapInArrow(_joins(shingle, least), "a long, b long"), "edges")
        roots = written(connected(edges.unionByName(more)), "roots")

    grouped = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least_id = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    found = written(grouped.join(least_id, "root").select("key", "component"), "components")
    return keyed.select("id", "key").join(found, "key").select("id", "component")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """The documents that are the smallest id of their near copies, all columns kept.

    Rows with a null id stay; of rows that repeat one id, all stay if it is the smallest.
    """
    out = components(docs, id_col, text_col, shingle, least).where("id <> component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(out, docs[f"`{id_col}`"] == out["__gone"], "left_anti")
