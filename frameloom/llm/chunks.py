"""Documents regrouped into compressed chunks of like size.

Operators that visit the corpus several times, with answers from other machines
in between, need a stable unit to address those answers to.  A chunk is one row:
the ids and the zstandard-compressed texts of some documents that one task read
one after the other.  Chunks have about the same size whatever the skew of any
column, so no source, key or group of copies can make one of them large; only a
single long document can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textkit import Texts, Words, pack, padded, steps, texts_of, unpack, words_of

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 4 << 20

SCHEMA = "chunk long, n_docs long, n_words long, ids binary, id_set binary, sizes binary, body binary, rest binary"


def _cut(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made = 0
        pool: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for step in steps(batch, "text", target):
                size = texts_of(step.column("text")).size
                if pool and held + size > target * 5 // 4:
                    yield _chunk(pool, (part << 32) + made)
                    made, pool, held = made + 1, [], 0
                pool.append(step)
                held += size
        if pool:
            yield _chunk(pool, (part << 32) + made)

    return run


def _chunk(pool: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(pool)
    ids = table.column("id").combine_chunks()
    texts = texts_of(table.column("text"))
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    body = zstandard.ZstdCompressor(level=3).compress(texts.buf[: texts.size].tobytes())
    columns = [[number], [len(texts)], [len(words_of(texts))], [pack(values, "<i8")], [pack(there, "u1")], [pack(np.diff(texts.offsets), "<i8")], [body], [_stored(table)]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["chunk", "n_docs", "n_words", "ids", "id_set", "sizes", "body", "rest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _stored(table: pa.Table) -> bytes | None:
    """The documents' other columns, compressed."""
    if "rest" not in table.column_names:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.select(["rest"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.select(["rest"]))
    return sink.getvalue().to_pybytes()


def rest_in(blob: bytes) -> dict[str, pa.Array]:
    """The other columns of a chunk made with ``carry``."""
    column = pa.ipc.open_stream(blob).read_all().column("rest").combine_chunks()
    return dict(zip([f.name for f in column.type], column.flatten(), strict=True))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = CHUNK_BYTES, carry: bool = False) -> DataFrame:
    """Write documents as chunks; no shuffle, one scan.  ``carry`` keeps all columns but the text."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")] if carry else []))
    return written(slim.mapInArrow(_cut(target), SCHEMA), "chunks")


def texts_in(body: bytes, sizes: bytes) -> Texts:
    offsets = np.concatenate([[0], np.cumsum(unpack(sizes, "<i8"))])
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(int(offsets[-1]), 1)), np.uint8)
    return Texts(padded(flat), offsets)


def ids_in(ids: bytes, id_set: bytes) -> np.ma.MaskedArray:
    return np.ma.MaskedArray(unpack(ids, "<i8"), mask=unpack(id_set, "u1") == 0)


def words_in(row: dict, lower: bool = False) -> Words:
    texts = texts_in(row["body"], row["sizes"])
    if lower:
        from .textkit import LOWER

        texts = Texts(LOWER[texts.buf], texts.offsets)
    return words_of(texts)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by bucket (stable), the buckets met, and their limits in that order."""
    order = np.argsort(bucket, kind="stable")
    met, first = np.unique(bucket[order], return_index=True)
    return order, met, np.append(first, len(bucket))
