"""Packing of documents into sequences of a fixed number of tokens.

Method: a configuration linear program over the length histogram.  There are at
most ``capacity`` different piece lengths, so the histogram is a fixed-size table
however many documents there are; it is all that reaches the driver.  The program
(fewest sequences, each filled by a configuration of lengths, covering the
histogram) is solved by multiplicative weights: lengths have weights, and a
knapsack dynamic program, bounded by the pieces still there, prices them.  One
table of it gives the best configuration around every length.  Those that fill a
sequence are used for up to half of the pieces they need, a whole number of
times (the rounding); the weight of a length shrinks with the share of its pieces
used and with each configuration that found none left, so that lengths which lag
come to lead.  A round that places nothing lets configurations fall short of a
full sequence, by one token and then twice as many each time.  Rounds end when
``REST`` of the tokens are left; those are packed best-fit decreasing.  There is
no other packing: what the program places stays.

Pieces find their places without a global sort: within a length, pieces are
numbered by shard (shards of ``SHARD_PIECES``, dealt by a hash of the piece), so a
length that a third of all pieces have is spread over many tasks; the n-th piece
of a length goes to the n-th slot for that length, found by binary search in the
table of configurations.

Defined cases: a null or empty text is the end id alone; a text longer than the
capacity is cut into full pieces, the last may be shorter; repeated rows are
packed as often as they occur; a null id stays null; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textkit import steps
from .wordcodec import codec

CAPACITY = 2048
END_ID = 0
SHARD_PIECES = 2_000

#: Rounds of the program; the share of the tokens that it may leave; how fast weights shrink, and how far;
#: the power of a length that it is worth (over 1: the small ones are kept for the gaps).
ROUNDS, REST, ETA, LEAST_LEAN, LARGE_FIRST = 60, 0.03, 0.1, -3.0, 1.02

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for step in steps(batch, "text"):
                ids, size = own.encode(step.column("text"))
                n = len(size)
                at = np.concatenate([[0], np.cumsum(size)])
                flat = np.insert(ids.astype("<u4"), at[1:], end_id)
                size = size + 1
                first = np.concatenate([[0], np.cumsum(size)])[:-1]
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(n), pieces)
                piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                begin = first[doc] + start
                raw = memoryview(flat.tobytes())
                spans = list(zip((begin * 4).tolist(), ((begin + length) * 4).tolist(), strict=True))
                cols = [step.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document; ids (little-endian unsigned 32-bit) on request."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_cut(tokenizer, capacity, end_id, keep_ids), PIECES + (", ids binary" if keep_ids else ""))


# ------------------------------------------------- the configuration program


@dataclass
class Plan:
    """Configurations: ``rows`` of (configuration, length, copies, offset of the first copy), ``times`` used."""

    config: np.ndarray
    length: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    times: np.ndarray

    @property
    def sequences(self) -> int:
        return int(self.times.sum())


def _knapsack(lengths: np.ndarray, weights: np.ndarray, most: np.ndarray, capacity: int):
    """Bounded knapsack over all capacities: a row of ``took`` per lot of copies, the last lot taken at each capacity (-1: none)."""
    kinds, lots = [], []
    for k, n in enumerate(np.minimum(most, capacity // lengths).tolist()):
        lot = 1
        while n > 0:  # lots of 1, 2, 4, ... copies make up any number
            kinds.append(k)
            lots.append(min(lot, n))
            n, lot = n - lot, 2 * lot
    kinds, lots = np.array(kinds, dtype=np.int64), np.array(lots, dtype=np.int64)
    size, gain = lengths[kinds] * lots, weights[kinds] * lots
    best = np.zeros(capacity + 1)
    took = np.full((len(kinds) + 1, capacity + 1), -1, dtype=np.int32)
    for i, (x, g) in enumerate(zip(size.tolist(), gain.tolist(), strict=True)):
        made = best[: capacity + 1 - x] + g
        better = made > best[x:]
        took[i + 1] = took[i]
        took[i + 1, x:][better] = i
        best[x:][better] = made[better]
    return took, kinds, lots, size


def _fillings(priced, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The heaviest filling of each room: (place in ``room``, kind, copies), by place, and the room it leaves."""
    took, kinds, lots, size = priced
    room, live = room.copy(), np.arange(len(room))
    last = np.full(len(room), len(took) - 1)
    parts = []
    while len(live):
        t = took[last[live], room[live]]
        live, t = live[t >= 0], t[t >= 0]
        parts.append((live, t))
        room[live] -= size[t]
        last[live] = t
    place, t = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    order = np.argsort(place, kind="stable")
    return place[order], kinds[t[order]], lots[t[order]], room


def price(lengths: np.ndarray, weights: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length, at most ``most``, in the heaviest configuration."""
    copies = np.zeros(len(lengths), dtype=np.int64)
    _, kind, n, _ = _fillings(_knapsack(lengths, weights, most, capacity), np.array([capacity]))
    np.add.at(copies, kind, n)
    return copies


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: (configuration, times).  Equal sequences are opened and filled together."""
    left = {int(x): int(n) for x, n in zip(lengths, counts, strict=True) if n}
    out: list[tuple[dict[int, int], int]] = []
    spaces = sorted(left)
    while spaces:
        # open sequences with the largest length left, and fill each with the largest that fits, again and again
        fill: dict[int, int] = {}
        room = capacity
        while room > 0:
            k = np.searchsorted(spaces, room, side="right") - 1
            while k >= 0 and left[spaces[k]] <= fill.get(spaces[k], 0):
                k -= 1
            if k < 0:
                break
            x = spaces[k]
            n = min(room // x, left[x] - fill.get(x, 0))
            fill[x] = fill.get(x, 0) + n
            room -= n * x
        times = min(left[x] // n for x, n in fill.items())
        for x, n in fill.items():
            left[x] -= n * times
        out.append((fill, times))
        spaces = [x for x in spaces if left[x]]
    return out


def program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Configurations of the covering program and how often each is used, and the pieces of each length that are left."""
    left = counts.copy()
    whole = float((counts * lengths).sum())
    lean = np.zeros(len(lengths))  # logarithms of the weights, over what a length is worth by its size
    used: dict[tuple, int] = {}
    short = 0
    for _ in range(rounds):
        live = np.flatnonzero(left)
        if not len(live) or (left * lengths).sum() <= REST * whole:
            break
        size, start = lengths[live], left[live]
        lean -= lean[live].max()
        weights = (size / capacity) ** LARGE_FIRST * np.exp(np.maximum(lean[live], LEAST_LEAN))
        place, kind, n, room = _fillings(_knapsack(size, weights, start, capacity), capacity - size)
        edge = np.searchsorted(place, np.arange(len(live) + 1)).tolist()
        kind, n, there, at_most = kind.tolist(), n.tolist(), start.tolist(), np.maximum(start // 2, 1).tolist()
        wanted = np.zeros(len(live))
        placed = 0
        near = np.flatnonzero(room <= short)
        for k in near[np.argsort(-weights[near] / size[near], kind="stable")].tolist():
            fill = {k: 1}
            for j in range(edge[k], edge[k + 1]):
                fill[kind[j]] = fill.get(kind[j], 0) + n[j]
            times = min(min(there[j] // c, max(at_most[j] // c, 1)) for j, c in fill.items())
            if times <= 0:
                for j, c in fill.items():
                    wanted[j] += there[j] < c
                continue
            for j, c in fill.items():
                there[j] -= c * times
            key = tuple(sorted((int(size[j]), c) for j, c in fill.items()))
            used[key] = used.get(key, 0) + times
            placed += times
        left[live] = there
        lean[live] -= ETA * (1 - left[live] / start + np.minimum(wanted, 2))
        if not placed:
            short = 2 * short + (not short)
    return [(dict(key), times) for key, times in used.items()], left


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used, covering the histogram exactly."""
    rank = np.argsort(lengths)
    lengths, counts = lengths[rank].astype(np.int64), counts[rank].astype(np.int64)
    found, left = program(lengths, counts, capacity, rounds)
    return found + best_fit(lengths, left, capacity)


def plan_of(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    found = solve(lengths, counts, capacity) if len(lengths) else []
    rows = []
    for c, (fill, _) in enumerate(found):
        at = 0
        for x in sorted(fill, reverse=True):
            rows.append((c, x, fill[x], at))
            at += x * fill[x]
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], np.array([t for _, t in found], dtype=np.int64))


def _place(plan: Plan):
    base = np.concatenate([[0], np.cumsum(plan.times)])[:-1]
    rank = np.lexsort((plan.config, plan.length))
    config, length, copies, offset = (x[rank] for x in (plan.config, plan.length, plan.copies, plan.offset))
    slots = copies * plan.times[config]
    ends = np.cumsum(slots)
    firsts = ends - slots
    kinds, head = np.unique(length, return_index=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("length").to_numpy()
            n = batch.column("rank").to_numpy() + firsts[head[np.searchsorted(kinds, x)]]
            row = np.searchsorted(ends, n, side="right")
            within = n - firsts[row]
            sequence = base[config[row]] + within // copies[row]
            place = offset[row] + within % copies[row] * x
            keep = [k for k in batch.schema.names if k not in ("rank", "shard")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sequence), pa.array(place)], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (column length, 1 .. capacity; written, as it is read twice)."""
    shards = max((pieces.count() // SHARD_PIECES) + 1, 1)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(shards)))
    sizes = dealt.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length: capacity rows at most
    plan = plan_of(np.array([r.length for r in whole], dtype=np.int64), np.array([r.n for r in whole], dtype=np.int64), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")
    starts = sizes.select("length", "shard", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "shard").orderBy("id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(starts, ["length", "shard"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("own") - 1).alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(_place(plan), f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    pieces = written(pieces_of(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian unsigned 32-bit), from packed(..., keep_ids=True).

    A sequence has at most ``capacity`` ids, so a group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
