"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a run of frames, each the ids of one document (little-endian unsigned
32-bit), compressed on its own; then a skippable frame with the documents' ids
and id counts; then the seek table of the public zstandard seekable format, a
skippable frame with the compressed size, the uncompressed size and a checksum
(the low 32 bits of XXH64) of every frame.  Any zstandard tool can decompress the
whole file; a reader that wants some documents reads the two tables from the end,
then only those documents' frames, and verifies their checksums.

Writing: texts are encoded where they are read and only compressed frames move:
one exchange by document id ranges, one file per range.  The bounds of the ranges
come from a sample of the id column, a bounded number of ids per file; they decide
which file a document goes to, never whether.  An id that many rows share (or the
null id) is met by several bounds; its rows are spread over the files between them
by their checksum, which is also their order.  Files get a fresh name per attempt and only names
returned by successful tasks enter the manifest, so a task that runs twice leaves
at most an unread file.  Paths may be of any file system that pyarrow opens.

Defined cases: a null text is empty and yields the end id alone; rows with a null
document id come first and keep a null id; rows that repeat an id stay next to
each other, in order of their ids' checksum; a document of any length is one
frame; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, written
from .textkit import pack, steps, unpack
from .wordcodec import codec

END_ID = 2

#: Fixed values of the public formats: skippable frames and the seek table's footer.
INDEX_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

#: Documents of a file, about, and sampled ids per file.
FILE_DOCS, SAMPLED_IDS = 20_000, 20
LEVEL = 3

#: Stands for a null id, which comes before all others.
NO_ID = -(1 << 63)

FRAMES = "part int, id long, n long, crc long, xxh long, raw long, frame binary"
MANIFEST = "part int, path string, n_docs long, n_ids long"
READ = "id long, start long, n_tokens long, ids_crc32 long, path string"


def frame_of(ids: bytes, packer: zstandard.ZstdCompressor) -> tuple[bytes, int]:
    return packer.compress(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF


def parts_of(cuts: np.ndarray, ids: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """File of each document.  An id that several cuts name is spread over all the files that meet there, by its checksum."""
    low, high = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    return low + (crc * (high - low + 1) >> 32)


def _encode(path: str, end_id: int, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = codec(path), zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for step in steps(batch, "text"):
                ids, size = own.encode(step.column("text"))
                at = np.concatenate([[0], np.cumsum(size)])
                raw = memoryview(np.insert(ids.astype("<u4"), at[1:], end_id).tobytes())
                size = size + 1
                ends = np.cumsum(size) * 4
                docs = [bytes(raw[a:b]) for a, b in zip((ends - size * 4).tolist(), ends.tolist(), strict=True)]
                frames = [frame_of(x, packer) for x in docs]
                ids = step.column("id")
                crc = np.array([zlib.crc32(x) for x in docs], dtype=np.int64)
                part = parts_of(cuts, np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.maximum(ids.fill_null(0).to_numpy(zero_copy_only=False), NO_ID + 1), NO_ID), crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), ids, pa.array(size), pa.array(crc), pa.array([x for _, x in frames], pa.int64()), pa.array([len(x) for x in docs], pa.int64()), pa.array([x for x, _ in frames], pa.binary())],
                    ["part", "id", "n", "crc", "xxh", "raw", "frame"],
                )

    return run


def trailer(ids: np.ndarray, there: np.ndarray, counts: np.ndarray, packed: np.ndarray, raw: np.ndarray, sums: np.ndarray) -> bytes:
    """The two tables that end a file."""
    index = zstandard.ZstdCompressor(level=3).compress(pack(ids, "<i8") + pack(there, "u1") + pack(counts, "<i8"))
    index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
    n = len(ids) + 1  # the index is a frame of the file as well; it decompresses to nothing
    entries = np.zeros((n, 3), dtype="<u4")
    entries[:-1, 0], entries[:-1, 1], entries[:-1, 2] = packed, raw, sums
    entries[-1, 0], entries[-1, 2] = len(index), xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF
    table = entries.tobytes() + struct.pack("<IBI", n, CHECKSUMS, SEEKABLE_MAGIC)
    return index + struct.pack("<II", SEEK_MAGIC, len(table)) + table


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.zst"
        out = None
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files, path = _open(uri)
                out = files.open_output_stream(path, compression=None)
            frames = batch.column("frame").to_pylist()
            for x in frames:
                out.write(x)
            ids = batch.column("id")
            for col, x in zip(cols, (ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), np.array([len(x) for x in frames]), batch.column("raw").to_numpy(), batch.column("xxh").to_numpy()), strict=True):
                col.append(x)
        if out is not None:
            ids, there, counts, packed, raw, sums = (np.concatenate(c) for c in cols)
            out.write(trailer(ids, there, counts, packed, raw, sums))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(ids)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids in ascending order of document id; returns the manifest.

    Manifest: part, path, n_docs, n_ids, first_id (ids in the files before it): one row per file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    if "://" not in folder:
        folder = folder.replace("file:/", "file:///") if folder.startswith("file:/") else f"file://{folder}"
    _make(folder)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n = slim.count()
    width = max(n // FILE_DOCS + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 200 + 1))
    ids = slim.select(F.coalesce("id", F.lit(NO_ID)).alias("id")).sample(False, min(1.0, SAMPLED_IDS * width / max(n, 1)), 29).limit(2 * SAMPLED_IDS * width)
    found = np.sort(np.array([r.id for r in ids.collect()], dtype=np.int64))
    cuts = found[len(found) * np.arange(1, width) // width] if len(found) else found
    frames = slim.mapInArrow(_encode(tokenizer, end_id, cuts), FRAMES)
    order = [F.col("id").asc_nulls_first(), F.col("crc"), F.col("raw")]
    ranged = frames.repartitionById(int(width), "part").sortWithinPartitions(*order)
    made = written(ranged.mapInArrow(_write(folder), MANIFEST), "manifest")  # one row per file
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("first_id", F.coalesce(before, F.lit(0)))


def _make(folder: str) -> None:
    files, path = _open(folder)
    files.create_dir(path, recursive=True)


class TokenFile:
    """A reader of one file: reads the tables, then only the frames that are asked for."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        size = 12 * n + 9
        kind, length = struct.unpack("<II", self._read(end - size - 8, 8))
        if kind != SEEK_MAGIC or length != size:
            raise ValueError(f"{uri}: bad seek table")
        entries = np.frombuffer(self._read(end - size, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        at = end - size - 8 - int(entries[-1, 0])
        if struct.unpack("<I", self._read(at, 4))[0] != INDEX_MAGIC:
            raise ValueError(f"{uri}: no index")
        index = zstandard.ZstdDecompressor().decompress(self._read(at + 8, int(entries[-1, 0]) - 8))
        n -= 1
        self.n = n
        self.ids = np.ma.MaskedArray(unpack(index[: 8 * n], "<i8"), mask=unpack(index[8 * n : 9 * n], "u1") == 0)
        self.counts = unpack(index[9 * n :], "<i8")
        self.packed, self.raw, self.sums = entries[:n].T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frames(self, places) -> Iterator[bytes]:
        """Ids of the documents at these places, checked; neighbours are read together."""
        places = np.asarray(places)
        for lo in range(0, len(places), 512):
            group = places[lo : lo + 512]
            if len(group) and (np.diff(group) == 1).all():
                base, blob = self.at[group[0]], self._read(int(self.at[group[0]]), int(self.at[group[-1] + 1] - self.at[group[0]]))
                parts = [blob[self.at[k] - base : self.at[k + 1] - base] for k in group]
            else:
                parts = [self._read(int(self.at[k]), int(self.packed[k])) for k in group]
            for k, part in zip(group, parts, strict=True):
                ids = self.unpacker.decompress(part, max_output_size=max(int(self.raw[k]), 1))
                if len(ids) != self.raw[k] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[k]:
                    raise ValueError(f"document at {k}: checksum differs")
                yield ids

    def document(self, doc_id: int) -> list[bytes]:
        """Ids of every row with this document id."""
        if np.ma.is_masked(self.ids):
            places = np.flatnonzero((self.ids == doc_id).filled(False))
        else:
            a, b = np.searchsorted(self.ids.data, [doc_id, doc_id], side="left")[0], np.searchsorted(self.ids.data, doc_id, side="right")
            places = np.arange(a, b)
        return list(self.frames(places))

    def close(self) -> None:
        self.file.close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = TokenFile(row["path"])
            for lo in range(0, file.n, 4096):
                places = np.arange(lo, min(lo + 4096, file.n))
                crc = [zlib.crc32(x) for x in file.frames(places)]
                ids = pa.array(file.ids.data[places], pa.int64(), mask=np.ma.getmaskarray(file.ids)[places])
                yield pa.RecordBatch.from_arrays([ids, pa.array(file.starts[places] + row["first_id"]), pa.array(file.counts[places]), pa.array(crc, pa.int64()), pa.array([row["path"]] * len(places))], ["id", "start", "n_tokens", "ids_crc32", "path"])
            file.close()


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: ``id_col``, start, n_tokens, ids_crc32, path."""
    files = manifest.count()
    return manifest.repartition(max(files, 1), "path").mapInArrow(_read, READ).withColumnRenamed("id", id_col)
