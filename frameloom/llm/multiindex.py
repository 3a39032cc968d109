"""Nearest neighbours by cosine with an inverted multi-index.

Method.  Vectors are scaled to unit length and cut in two halves; each half is
quantised with its own codebook of k centroids, which makes k * k cells.  A query
ranks the centroids of both halves and walks pairs of them in order of summed
distance with a heap, skipping empty cells, until it has met a given share of all
entries; the entries of those cells are reranked by their exact cosine.

The share is not guessed: on the bounded sample that the codebooks are fitted on,
exact neighbours are computed by brute force and the share is the smallest that
would have found ``TARGET_RECALL`` of them.  Structured vectors need a small share,
vectors without structure a large one.

Plan.  Equal vectors are folded to one entry with its smallest ids (as many as a
result can hold, plus one for the query itself): lossless, and a vector that a
third of all rows repeat is one entry.  Equal queries search once.  Entries are
dealt by cell into blocks of bounded size (a large cell is split by a hash), and
blocks to buckets; queries go to the buckets of their cells, once each.  The
codebooks and the counts of cells (at most ``MAX_CENTROIDS`` squared) are the only
data that is broadcast or collected, besides the sample.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite
components take no part, nor do vectors of another length than the most frequent;
rows with a null id take no part; rows that repeat an id count as one candidate
per vector; ties go to the smaller id; fewer candidates than wanted are all
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

NEIGHBOURS = 5
SAMPLE = 20_000
SAMPLE_QUERIES = 200
TARGET_RECALL = 0.97
MAX_CENTROIDS = 256
BLOCK_ENTRIES = 4_000
BUCKET_ENTRIES = 16_000

#: Queries that one task answers from one bucket, about.
QUERY_GROUP = 20_000

ENTRIES = "vec binary, ids array<long>, cell int, block int, bucket int"
ROUTED = "bucket int, group int, vec binary, cells binary"
FOUND = "query binary, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in order of left[i] + right[j], until their entries reach ``wanted``; empty cells are passed over."""
    k = len(right)
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    da, db, pa_, pb = left[a].tolist(), right[b].tolist(), a.tolist(), b.tolist()
    heap = [(da[0] + db[0], 0, 0)]
    out, met = [], 0
    while heap and met < wanted:
        _, i, j = heapq.heappop(heap)
        cell = pa_[i] * k + pb[j]
        n = counts[cell]
        if n:
            out.append(cell)
            met += n
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


class Index:
    """Codebooks of both halves, and the share of entries that a query visits."""

    def __init__(self, sample: np.ndarray, n_entries: int):
        x = unit(sample)
        self.half = max(x.shape[1] // 2, 1)
        k = int(2 ** np.round(np.log2(max(np.sqrt(n_entries) / 4, 4))))
        k = min(k, MAX_CENTROIDS, len(x))
        self.left, self.right = codebook(x[:, : self.half], k), codebook(x[:, self.half :], k)
        self.k = len(self.right)
        self.share = self._calibrate(x)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.left), distances(x[:, self.half :], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.split(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def _calibrate(self, x: np.ndarray) -> float:
        """The share of the sample to visit so that TARGET_RECALL of its exact neighbours are met."""
        if len(x) <= NEIGHBOURS + 1:
            return 1.0
        cells = self.cells(x)
        counts = np.bincount(cells, minlength=len(self.left) * self.k)
        some = np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int)
        near = x[some] @ x.T
        near[np.arange(len(some)), some] = -np.inf
        top = np.argpartition(-near, NEIGHBOURS, axis=1)[:, :NEIGHBOURS]
        a, b = self.split(x[some])
        need = []
        for row in range(len(some)):
            total = (a[row][:, None] + b[row][None, :]).ravel()
            rank = np.argsort(total, kind="stable")
            reached = np.empty(len(total))
            reached[rank] = np.cumsum(counts[rank])
            need += (reached[cells[top[row]]] / len(x)).tolist()
        return float(min(1.0, np.quantile(need, TARGET_RECALL) + 2 / len(x)))


def _fold(dim: int, most: int):
    """Valid vectors as double-precision bytes; equal ones of a batch folded, with their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f8")
            ok = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            flat = flat[ok] + 0.0  # minus zero is zero
            ids = batch.column("id").to_numpy()[ok]
            if not len(ids):
                continue
            vecs = [r.tobytes() for r in flat]
            kinds: dict[bytes, list[int]] = {}
            for v, i in zip(vecs, ids.tolist(), strict=True):
                kinds.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(kinds), pa.binary()), pa.array([sorted(set(i))[:most] for i in kinds.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    return run


def _smallest(lists: Column, most: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), 1, most)


def entries_of(vectors: DataFrame, id_col: str, vec_col: str, most: int) -> DataFrame:
    """(vec, ids): each distinct valid vector with its smallest ids."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    valid = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND NOT exists(x, e -> e IS NULL)")
    sizes = valid.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "vec binary, ids array<long>")
    folded = valid.where(F.size("x") == sizes[0].dim).mapInArrow(_fold(sizes[0].dim, most), "vec binary, ids array<long>")
    # in two steps, so that a vector met in very many batches is no one task's
    part = folded.groupBy("vec", F.pmod(F.xxhash64("ids"), F.lit(16)).alias("salt")).agg(_smallest(F.col("ids"), most).alias("ids"))
    return part.groupBy("vec").agg(_smallest(F.col("ids"), most).alias("ids"))


def _assign(index: Index, blocks: np.ndarray, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = index.cells(unit(matrix(batch.column("vec").to_pylist())))
            block = batch.column("h").to_numpy() % (blocks[cell] if blocks is not None else 1)
            bucket = _bucket(cell, block, n_buckets)
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("ids"), *(pa.array(v.astype(np.int32)) for v in (cell, block, bucket))], ["vec", "ids", "cell", "block", "bucket"])

    return run


def _bucket(cell: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    h = (np.asarray(cell, dtype=np.uint64) * np.uint64(1 << 20) + np.asarray(block, dtype=np.uint64)) * np.uint64(11400714785074694791)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _route(index: Index, counts: np.ndarray, blocks: np.ndarray, n_buckets: int, share: float):
    wanted = share * counts.sum()
    quick = counts.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = batch.column("vec").to_pylist()
            left, right = index.split(unit(matrix(vecs)))
            to, of, who, cells = [], [], [], []
            for v, g, a, b in zip(vecs, batch.column("group").to_pylist(), left, right, strict=True):
                met = np.array(walk(a, b, quick, wanted), dtype=np.int64)
                each = np.repeat(met, blocks[met])
                block = np.arange(len(each)) - np.repeat(np.cumsum(blocks[met]) - blocks[met], blocks[met])
                bucket = _bucket(each, block, n_buckets)
                order = np.argsort(bucket, kind="stable")
                kinds, first = np.unique(bucket[order], return_index=True)
                for q, part in zip(kinds.tolist(), np.split(each[order], first[1:]), strict=True):
                    to.append(q)
                    who.append(v)
                    cells.append(np.unique(part).astype("<i4").tobytes())
                    of.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(of, pa.int32()), pa.array(who, pa.binary()), pa.array(cells, pa.binary())], ["bucket", "group", "vec", "cells"])

    return run


def _best(query: np.ndarray, entry: np.ndarray, score: np.ndarray, least_id: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best entries of each query."""
    order = np.lexsort((least_id[entry], -score, query))
    q = query[order]
    head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    return order[rank < most]


def _rerank(most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        raw, queries = matrix(left.column("vec").to_pylist()), matrix(right.column("vec").to_pylist())
        e, q = unit(raw), unit(queries)
        ids = left.column("ids").to_pylist()
        least_id = np.array([x[0] for x in ids])
        cell = left.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        kinds, first = np.unique(cell[order], return_index=True)
        spans = dict(zip(kinds.tolist(), np.split(order, first[1:]), strict=True))
        asked = [np.frombuffer(x, "<i4") for x in right.column("cells").to_pylist()]
        ask_cell, ask_query = np.concatenate(asked), np.repeat(np.arange(len(asked)), [len(x) for x in asked])
        order = np.argsort(ask_cell, kind="stable")
        kinds, first = np.unique(ask_cell[order], return_index=True)
        floor = np.full(len(q), -np.inf)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        fresh, n_fresh = [], 0

        def settle():
            nonlocal held, fresh, n_fresh
            parts = [held, *fresh]
            query, entry, score = (np.concatenate([p[k] for p in parts]) for k in range(3))
            top = _best(query, entry, score, least_id, most)
            held = query[top], entry[top], score[top]
            n = np.bincount(held[0], minlength=len(q))
            low = np.full(len(q), np.inf)
            np.minimum.at(low, held[0], held[2])
            floor[n >= most] = low[n >= most] - 1e-12
            fresh, n_fresh = [], 0

        for c, who in zip(kinds.tolist(), np.split(ask_query[order], first[1:]), strict=True):
            rows = spans.get(c)
            if rows is None:
                continue
            score = e[rows] @ q[who].T
            i, j = np.nonzero(score >= floor[who][None, :])
            fresh.append((who[j], rows[i], score[i, j]))
            n_fresh += len(i)
            if n_fresh > 300_000:
                settle()
        settle()
        query, entry, _ = held
        score = cosine(raw[entry], queries[query]) if len(entry) else np.zeros(0)
        n_ids = np.array([len(ids[k]) for k in entry], dtype=np.int64)
        blobs = right.column("vec").to_pylist()
        return pa.table({
            "query": pa.array([blobs[k] for k in np.repeat(query, n_ids)], pa.binary()),
            "vec_id": pa.array([i for k in entry for i in ids[k]], pa.int64()),
            "score": pa.array(np.repeat(score, n_ids)),
        })

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", most: int = NEIGHBOURS, share: float | None = None, group: int = QUERY_GROUP) -> DataFrame:
    """For each row with ``is_query``: query_id, rank (from 1), vec_id, score of its nearest other rows.

    ``share`` is the share of entries that a query visits: by default what the sample calls for; 1.0
    visits every cell, so the neighbours are exact.
    """
    spark = vectors.sparkSession
    entries = written(entries_of(vectors, id_col, vec_col, most + 1), "entries")
    n = entries.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    sample = entries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    index = Index(matrix([bytes(r.vec) for r in sample]), n)
    n_buckets = n // BUCKET_ENTRIES + 1
    keyed = entries.withColumn("h", F.pmod(F.xxhash64("vec"), F.lit(1 << 30)))
    size = keyed.mapInArrow(_assign(index, None, 1), ENTRIES).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per cell
    counts = np.zeros(len(index.left) * index.k, dtype=np.int64)
    for r in size:
        counts[r.cell] = r.n
    blocks = np.maximum(-(-counts // BLOCK_ENTRIES), 1)
    dealt = keyed.mapInArrow(_assign(index, blocks, n_buckets), ENTRIES)
    asking = entries_of(vectors.where(is_query), id_col, vec_col, 1).select("vec")
    asking = asking.join(entries.select("vec"), "vec", "left_semi").repartition(min(n // 200 + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a task holds one bucket of entries and one group of queries, neither of which grows with the table
    groups = int(asking.count() // group + 1)
    asking = asking.withColumn("group", F.pmod(F.xxhash64("vec"), F.lit(groups)).cast("int"))
    routed = asking.mapInArrow(_route(index, counts, blocks, n_buckets, index.share if share is None else share), ROUTED)
    dealt = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = dealt.groupBy("bucket", "group").cogroup(routed.groupBy("bucket", "group")).applyInArrow(_rerank(most + 1), FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    x = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.where(is_query).select(F.col(f"`{id_col}`").cast("long").alias("query_id"), x.alias("x")).where("query_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND NOT exists(x, e -> e IS NULL)")
    keyed_rows = rows.mapInArrow(_keys, "query_id long, query binary").distinct()
    others = keyed_rows.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, most).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("pos", "e")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("x")
        off = x.offsets.to_numpy() if len(x) else np.zeros(1, np.int64)
        values = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([values[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["query_id", "query"])
